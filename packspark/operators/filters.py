"""Key filters over time-series (``doe``/``instance``/``cycle_num``) or cycle-table keys."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def filter_by_doe(df: DataFrame, does: Iterable, col: str = "doe") -> DataFrame:
    return df.where(F.col(col).isin(list(does)))


def filter_by_instance(df: DataFrame, instances: Iterable, col: str = "instance") -> DataFrame:
    return df.where(F.col(col).isin([str(i) for i in instances]))


def filter_by_cycle(df: DataFrame, cycles: Iterable, col: str = "cycle_num") -> DataFrame:
    return df.where(F.col(col).isin([int(c) for c in cycles]))


def filter_by_doe_instance(df: DataFrame, pairs: Sequence[tuple], cols: tuple[str, str] = ("doe", "instance"),
                           spark: SparkSession | None = None) -> DataFrame:
    """Rows matching any (doe, instance) pair; a pair listed twice returns its rows twice.

    The pair list is given by the caller, so its size is known: it is joined as a
    broadcast table (an inner join keeps the repetition semantics).
    """
    spark = spark or df.sparkSession
    schema = T.StructType([T.StructField(cols[0], T.StringType()), T.StructField(cols[1], T.StringType()),
                           T.StructField("_ps_pos", T.IntegerType())])
    p = spark.createDataFrame([(str(a), str(b), i) for i, (a, b) in enumerate(pairs)], schema)
    return df.join(F.broadcast(p), on=list(cols), how="inner").drop("_ps_pos")


def cycle_window_filter(df: DataFrame, lo: int, hi: int, skip_every: int | None = None,
                        col: str = "cycle") -> DataFrame:
    """Cycles in ``[lo, hi]``, optionally without multiples of ``skip_every`` (e.g. test cycles)."""
    c = F.col(col)
    cond = c.between(lo, hi)
    if skip_every:
        cond = cond & (c % skip_every != 0)
    return df.where(cond)
