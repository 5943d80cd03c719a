"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packspark.session import checkpoint_dir

# ASCII white space of the word rules: space, tab, line feed, vertical tab, form feed, carriage return
SPACE = "[\\x20\\x09-\\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also when ``body`` uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(df: DataFrame, name: str = "text") -> Column:
    """The text column with null read as the empty text."""
    return F.coalesce(df[name], F.lit(""))


def words_of(text: Column) -> Column:
    """Words (maximal runs without ASCII white space) of a text column, as an array."""
    return F.array_remove(F.split(F.regexp_replace(text, SPACE, " "), " "), "")


def texts(column: pa.Array) -> Iterator[str | None]:
    """The strings of an Arrow column, a few hundred at a time."""
    for at in range(0, len(column), 256):
        yield from column.slice(at, 256).to_pylist()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table into the shared checkpoint folder and reads it back.

    Cuts the lineage at a point that several branches read: the table is computed once, survives
    the loss of executors and is pruned by column.  It stays in the folder until its owner empties it.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_bytes(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts take about ``limit`` bytes; a longer text stands alone."""
    sizes = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)).astype(np.int64)
    start, held = 0, 0
    for at, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def lean(run):
    """A mapInArrow function that gives its memory back to the system when its task ends: workers stay alive between
    tasks, and what they keep adds up over the stages of a job."""
    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)     # the C library's own, where it has one
        if trim:
            trim(0)

    return out
