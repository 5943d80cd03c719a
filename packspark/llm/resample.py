"""Importance resampling towards a target distribution, with Arrow kernels.

Texts are lower-cased (A-Z), split and flattened by Arrow; the words of a slice are dictionary-encoded and
n-grams are formed from shifted dictionary indices.  Each distinct n-gram of a slice is hashed once (the CRC
of its beginning is carried on by one more word); all occurrences take their bucket from there.  Bucket
counts of the documents and of the target texts give each bucket an integer gain, and a document's weight
is the sum of the gains of its n-grams.  A Gumbel draw keyed by the id is added, and the highest scores
are drawn, which samples without replacement in proportion to the weights.

Defined results: null and empty texts have no features and weight 0; very long texts are read whole (slices go
by bytes, such a text stands alone); rows without an id draw as the empty id and sort first among ties; repeated rows
count and are drawn each; an empty target or corpus has counts of 0; an empty table gives an empty result; columns named
like a result are replaced, others kept.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packspark.llm.common import by_bytes, materialise
from packspark.llm.sharding import number_rows

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ADDED = ("n_words", "n_features", "weight", "score", "rank")


class Grams:
    """N-grams of a slice of texts: ``buckets`` of all occurrences, grouped by order and then by text;
    ``lengths`` has, per order, the number of occurrences in each text."""

    def __init__(self, text: pa.Array, orders: range, n_buckets: int):
        words = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(text, "")), BREAKS)
        row = pc.list_parent_indices(words).to_numpy()
        flat = pc.list_flatten(words)
        real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)         # a text that begins or ends with a break
        row = row[real]
        coded = flat.filter(pa.array(real)).dictionary_encode()
        names = [w.encode() for w in coded.dictionary.to_pylist()]
        index = coded.indices.to_numpy().astype(np.int64)
        self.n_words = np.bincount(row, minlength=len(text))
        self.buckets, self.lengths = [], []
        crc = np.array([zlib.crc32(w) for w in names], np.int64)              # of each distinct n-gram
        code, place = index, row                                             # n-gram and text of each occurrence
        for n in range(1, orders.stop):
            if n > 1:
                inside = row[:max(len(row) - n + 1, 0)] == row[n - 1:]
                before, after = code[:len(inside)], index[n - 1:]
                pairs, code = np.unique(before * max(len(names), 1) + after, return_inverse=True)
                grown = np.zeros(len(pairs), np.int64)
                for i, pair in enumerate(pairs.tolist()):
                    a, b = divmod(pair, len(names))
                    grown[i] = zlib.crc32(b" " + names[b], int(crc[a]))
                crc, place, use = grown, row[:len(inside)], inside
            else:
                use = np.ones(len(index), bool)
            if n in orders:
                self.buckets.append((crc % n_buckets)[code[use]])
                self.lengths.append(np.bincount(place[use], minlength=len(text)))

    def counts(self, n_buckets: int) -> np.ndarray:
        return sum((np.bincount(b, minlength=n_buckets) for b in self.buckets), np.zeros(n_buckets, np.int64))

    def sums(self, gains: np.ndarray) -> np.ndarray:
        """Sum of the gains of each text's n-grams."""
        out = np.zeros(len(self.n_words), np.int64)
        for buckets, n in zip(self.buckets, self.lengths):
            held = np.nonzero(n)[0]
            if len(held):
                out[held] += np.add.reduceat(gains.take(buckets), (np.cumsum(n) - n)[held])
        return out


def bucket_counts(df: DataFrame, text: str, orders: range, n_buckets: int) -> np.ndarray:
    """Occurrences per bucket, added up in each task and then by Spark (``n_buckets`` rows reach the driver)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for part in by_bytes(batch, text):
                total += Grams(part.column(text), orders, n_buckets).counts(n_buckets)
        held = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], ["b", "n"])

    out = np.zeros(n_buckets, np.int64)
    for r in df.select(text).mapInArrow(run, "b int, n bigint").groupBy("b").agg(F.sum("n").alias("n")).collect():
        out[r["b"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed ratio of target to source shares."""
    b, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((float(t + 1) * float(s_all + b))
                                                / (float(s + 1) * float(t_all + b))))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def draw(seed: int, doc_id: object) -> int:
    """Gumbel noise of an id, in thousandths."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gains: np.ndarray, orders: range, seed: int, doc_id: str, text: str,
          columns: list[str] | None = None) -> DataFrame:
    """Adds ``n_words``, ``n_features``, ``weight`` and ``score`` to ``columns`` (all)."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)
    keep = [c for c in docs.columns if c not in ADDED and (columns is None or c in columns or c == doc_id)]
    schema = T.StructType([*[docs.schema[c] for c in keep], *[T.StructField(c, T.LongType()) for c in ADDED[:4]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, text):
                grams = Grams(part.column(text), orders, len(shared.value))
                weight = grams.sums(shared.value)
                noise = np.array([draw(seed, i) for i in part.column(doc_id).to_pylist()], np.int64)
                made = [grams.n_words, sum(grams.lengths, np.zeros(len(weight), np.int64)), weight, weight + noise]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *[pa.array(m, pa.int64()) for m in made]],
                                                 [*keep, *ADDED[:4]])

    return docs.mapInArrow(run, schema)


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, max_n: int = 1, min_n: int = 1,
             n_buckets: int = 10_000, seed: int = 2024, doc_id: str = "doc_id", text: str = "text",
             target_text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """Every row's ``columns`` (all; those named, and the id, travel through the sort) with ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` (1, 2, ... of those drawn, others null).

    Of the N texts with at least ``min_words`` words, floor(percent * N / 100) are drawn.  Ranks come from a range
    sort of the scores over all tasks; documents are read twice, for the counts and for the weights."""
    orders = range(min_n, max_n + 1)
    gains = bucket_gains(bucket_counts(docs, text, orders, n_buckets), bucket_counts(target, target_text, orders, n_buckets))
    scored = materialise(weigh(docs, gains, orders, seed, doc_id, text, columns).withColumn("_rs_down", -F.col("score")), "weights")
    able = number_rows(scored.where(F.col("n_words") >= min_words), ["_rs_down", doc_id])
    drawn = F.col("row_number") < F.expr(f"total * {int(percent)} div 100")
    cols = [F.col(f"`{c}`") for c in scored.columns if c != "_rs_down"]
    return able.select(*cols, F.when(drawn, F.col("row_number") + 1).alias("rank")).unionByName(
        scored.where(F.col("n_words") < min_words).select(*cols, F.lit(None).cast("bigint").alias("rank")))
