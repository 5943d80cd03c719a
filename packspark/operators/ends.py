"""The k smallest and k largest values of every group, exactly, in one pass without sorting rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Positions are cut into nested stretches of 2^10, 2^20 and 2^30: a list holds at most 1,024 values, or the ends of 1,024
# inner stretches, while positions stay below 2^40.
STRETCH_BITS = (10, 20, 30)


def group_ends(df: DataFrame, columns: Mapping[str, str], k: int, by: Sequence[str], position: str,
               bits: Sequence[int] = STRETCH_BITS) -> DataFrame:
    """``<name>_low`` and ``<name>_high`` per group: the ``k`` smallest and ``k`` largest non-null values of every column in
    ``columns`` (output name -> column), both as ascending arrays; repeated values count as often as they occur.

    ``position`` is a whole number unique within a group (any gaps, any order; NULL: stretch 0).  Rows are first
    gathered by stretch of positions, where at most ``2^bits[0]`` lie, and cut to both ends; wider stretches then merge ends
    only.  So a group of any size is spread over its stretches, each shuffle carries at most ``2 k`` values a
    stretch and column, and a row's place depends on the row alone, which keeps re-run tasks exact.  A
    frame already partitioned by a subset of ``by`` isn't shuffled at all.  NaN counts as the largest value.
    An empty frame gives no rows; a group without values gives empty arrays.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    if not bits or list(bits) != sorted(set(bits)):
        raise ValueError("bits must rise")
    by, names = list(by), list(columns)
    where = F.coalesce(F.col(position).cast("long"), F.lit(0).cast("long"))
    d = df.select(*by, F.shiftright(where, bits[0]).alias("_ps_at"), *[F.col(c).alias(f"_ps_{n}") for n, c in columns.items()])
    d = d.groupBy(*by, "_ps_at").agg(*[F.sort_array(F.collect_list(f"_ps_{n}")).alias(f"_ps_{n}") for n in names])
    d = d.select(*by, "_ps_at", *[e for n in names for e in (_first(F.col(f"_ps_{n}"), k).alias(f"{n}_low"),
                                                             _last(F.col(f"_ps_{n}"), k).alias(f"{n}_high"))])
    for step in [b - a for a, b in zip(bits, bits[1:])] + [None]:
        stretch = [] if step is None else [F.shiftright("_ps_at", step).alias("_ps_at")]
        d = d.groupBy(*by, *stretch).agg(*[e for n in names for e in (
            _first(F.sort_array(F.flatten(F.collect_list(f"{n}_low"))), k).alias(f"{n}_low"),
            _last(F.sort_array(F.flatten(F.collect_list(f"{n}_high"))), k).alias(f"{n}_high"))])
    return d


def array_median(values: Column) -> Column:
    """Median of an ascending array; NULL when it is empty."""
    n = F.size(values)
    lower, upper = F.get(values, F.floor((n - 1) / 2).cast("int")), F.get(values, F.floor(n / 2).cast("int"))
    return F.lit(0.5) * lower + F.lit(0.5) * upper


def _first(values: Column, k: int) -> Column:
    return F.slice(values, 1, k)


def _last(values: Column, k: int) -> Column:
    return F.slice(values, F.greatest(F.size(values) - (k - 1), F.lit(1)), k)
