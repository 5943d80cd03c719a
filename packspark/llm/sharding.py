"""Sharding: a keyed Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0..n-1 in a stated order, the number is permuted within 0..n-1, and the
permuted position p gives shard p mod k and slot p div k.  Shards differ by at most one row, slots
have no gaps, and both directions can be computed: ``locate`` names the row number behind
(shard, slot) without reading data.

Defined results: nulls in the order columns sort first; rows equal in every order column are
interchangeable (they get different positions); an empty table gives an empty result; extra
columns are kept, those named like an added column are replaced.  A hot key cannot fill one
task: ties are split by the position in the input.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packspark.llm.common import materialise

ROUNDS = 6
ADDED = ("row_number", "total", "position", "shard", "slot")


def _round_keys(key: str, rounds: int = ROUNDS) -> np.ndarray:
    return np.frombuffer(hashlib.blake2b(key.encode(), digest_size=8 * rounds).digest(), dtype="<u8").copy()


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit avalanche of the round input (multiply and shift)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _feistel(x: np.ndarray, bits: int, keys: np.ndarray, inverse: bool) -> np.ndarray:
    """One pass over 0..2^bits-1: alternate rounds change the low and the high part."""
    low = np.uint64(bits // 2)
    mask_low, mask_high = np.uint64((1 << int(low)) - 1), np.uint64((1 << (bits - int(low))) - 1)
    a, b = x >> low, x & mask_low
    for r in (reversed(range(len(keys))) if inverse else range(len(keys))):
        if r % 2:
            a = a ^ (_mix(b + keys[r]) & mask_high)
        else:
            b = b ^ (_mix(a + keys[r]) & mask_low)
    return (a << low) | b


def permute(x: np.ndarray, n: int, key: str, inverse: bool = False) -> np.ndarray:
    """Permutes row numbers within 0..n-1; values that leave the range walk on along their cycle.

    The domain is the next power of two, so each step stays inside with a chance over one half."""
    out = np.asarray(x).astype(np.uint64)
    bits, keys = max(2, int(n - 1).bit_length()), _round_keys(key)
    left = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(left):
            out[left] = _feistel(out[left], bits, keys, inverse)
            left = left[out[left] >= np.uint64(n)]
    return out.astype(np.int64)


def locate(shard: int, slot: int, n: int, n_shards: int, key: str) -> int:
    """The row number stored at (shard, slot)."""
    return int(permute(np.array([slot * n_shards + shard]), n, key, inverse=True)[0])


def number_rows(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``row_number`` (0..n-1 in ``order``) and ``total`` (n).

    Range partitions are numbered inside and shifted by the counts before them.  The numbered
    table is written once: range bounds come from a sample, and a second run of the sort could
    cut elsewhere.  The count table has a row per partition."""
    keep = [c for c in df.columns if c not in ADDED]
    tied = df.select(*[F.col(f"`{c}`") for c in keep], F.monotonically_increasing_id().alias("_sh_tie"))
    placed = tied.orderBy(*[F.col(f"`{c}`").asc_nulls_first() for c in order], "_sh_tie") \
        .drop("_sh_tie").withColumn("_sh_at", F.monotonically_increasing_id())
    placed = materialise(placed, "row-numbers")
    part = F.shiftright("_sh_at", 33)
    w = Window.orderBy("_sh_part")
    before = placed.groupBy(part.alias("_sh_part")).agg(F.count("*").alias("_sh_n")).select(
        "_sh_part", (F.sum("_sh_n").over(w) - F.col("_sh_n")).alias("_sh_before"),
        F.sum("_sh_n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    inside = F.col("_sh_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_sh_part", part).join(before, "_sh_part").select(
        *[F.col(f"`{c}`") for c in keep], (F.col("_sh_before") + inside).alias("row_number"), "total")


def shard_rows(df: DataFrame, order: list[str], n_shards: int, key: str) -> DataFrame:
    """Adds ``row_number``, ``total``, ``position``, ``shard`` and ``slot`` to every row."""
    @F.pandas_udf("bigint")
    def place(number: pd.Series, total: pd.Series) -> pd.Series:
        if not len(number):
            return number
        return pd.Series(permute(number.to_numpy(), int(total.iloc[0]), key))

    return number_rows(df, order).withColumn("position", place("row_number", "total")) \
        .withColumn("shard", F.pmod("position", F.lit(n_shards)).cast("int")) \
        .withColumn("slot", F.floor(F.col("position") / n_shards).cast("bigint"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Writes sharded rows as ``path/shard=<k>/``, rows of a file in slot order.  A large shard is cut
    into ranges of slots, so no task holds a whole shard."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot") \
        .write.partitionBy("shard").parquet(path)
