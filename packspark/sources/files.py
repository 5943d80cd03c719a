"""File sources for dense series and summaries."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packspark.schema import nan_to_null, rename_cycle_to_series


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
             schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header; a schema avoids an inference pass over the data."""
    r = spark.read.option("header", True)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    df = r.csv(path)
    return nan_to_null(df.select(*columns) if columns else df)


def file_format(path: str, fmt: str | None = None) -> str:
    """``fmt`` (csv or parquet; a folder of files needs it), else what the path's ending says."""
    fmt = fmt or path.rstrip("/").rpartition(".")[2]
    if fmt not in ("csv", "parquet"):
        raise ValueError("the data file extension should be .csv or .parquet, or fmt given")
    return fmt


def read_data(spark: SparkSession, data: str | DataFrame, schema: T.StructType | str | None = None,
              fmt: str | None = None) -> DataFrame:
    """Time-series data from a DataFrame, or a file or folder of CSV or parquet (see ``file_format``), keys
    renamed to the time-series dialect (doe, instance, cycle_num, charging_state_name)."""
    if isinstance(data, DataFrame):
        df = data
    elif file_format(data, fmt) == "csv":
        df = read_csv(spark, data, schema=schema)
    else:
        df = spark.read.parquet(data)
    return rename_cycle_to_series(df)


def content_lists(df: DataFrame, every: Sequence[str] = ("doe", "instance"), ranged: str = "cycle_num", most: int = 6) -> DataFrame:
    """(column, value): all different values of the ``every`` columns, and of ``ranged`` all of them if there are at most
    ``most``, else its range as ``low - high``.  Values are text; null values are left out."""
    parts = [df.select(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")).where(F.col("value").isNotNull()).distinct()
             for c in every if c in df.columns]
    if ranged in df.columns:
        r = df.groupBy().agg(F.count_distinct(ranged).alias("n"), F.min(ranged).cast("string").alias("lo"),
                             F.max(ranged).cast("string").alias("hi"))
        few = df.select(F.col(ranged).cast("string").alias("value")).where(F.col("value").isNotNull()).distinct() \
            .where(r.select("n").scalar() <= most)
        span = r.where(F.col("n") > most).select(F.concat_ws(" - ", "lo", "hi").alias("value"))
        parts.append(few.unionByName(span).select(F.lit(ranged).alias("column"), "value"))
    return functools.reduce(DataFrame.unionByName, parts)


def content_summary(df: DataFrame, cols: Sequence[str] = ("doe", "instance", "cycle_num")) -> DataFrame:
    """One row per key column: distinct count, min and max (as text).

    One pass for all columns: a row hands on each column's value in a row of its own, whose repeats go before the
    shuffle (hashed, as there is nothing to add up; min and max of texts beside the counts would have every task sort all
    of its rows once a column).  The single result row over the different values is then unpivoted.  Nothing is collected
    to the driver.
    """
    cols = [c for c in cols if c in df.columns]
    alone = [F.struct(*[(F.col(c) if c == own else F.lit(None).cast(df.schema[c].dataType)).alias(f"v{i}")
                        for i, c in enumerate(cols)]) for own in cols]
    values = df.select(F.explode(F.array(*alone)).alias("s")).select("s.*").distinct()
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.count(f"v{i}").alias(f"n{i}"), F.min(f"v{i}").cast("string").alias(f"lo{i}"),
                 F.max(f"v{i}").cast("string").alias(f"hi{i}")]
    row = values.agg(*aggs)
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n_distinct"),
                             F.col(f"lo{i}").alias("min_value"), F.col(f"hi{i}").alias("max_value"))
                    for i, c in enumerate(cols)])
    return row.select(F.explode(arr).alias("s")).select("s.*")
