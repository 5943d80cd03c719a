"""Exact group quantiles by radix selection, so that no task ever holds a group.

``F.median`` (and a window median) hands every value of a group to one task; a group
holding a third of all rows would then be sorted by a single task.  Here equal values of a group are
counted first (map-side).  Each double becomes a 64-bit whole number of the same order, and the ranks that
are looked for are followed down its three digits (22, 21 and 21 bits): a round counts the values per digit
under the prefixes found so far (map-side; a task reads one count per digit, two million a rank at most) and
keeps the digit each rank falls into.  How the values are spread doesn't matter: a far value takes no more than a digit of its own.
All rounds read one shuffle of the counts; everything is lazy and depends on values only.
The median equals ``percentile(x, 0.5)``: the mean of the values at ranks floor((n-1)/2) and ceil((n-1)/2); other quantiles
are interpolated likewise.  NaN sorts last; both zeros are one value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHIFTS = (42, 21, 0)       # digits of 22, 21 and 21 bits
_UNIT = 1 << 52            # whole numbers between two powers of two


def order_key(v: Column) -> Column:
    """A 64-bit whole number for each double, in the order of the doubles: exponent, then mantissa, the sign in front."""
    a = F.abs(v)
    least_normal, least = F.lit(2.0 ** -1022), F.lit(5e-324)
    guess = F.floor(F.log2(F.greatest(F.least(a, F.lit(1.7976931348623157e308)), least_normal)))
    scaled = a / F.pow(F.lit(2.0), guess)
    e = F.when(scaled >= 2.0, guess + 1).when(scaled < 1.0, guess - 1).otherwise(guess)     # the logarithm may round
    mantissa = ((a / F.pow(F.lit(2.0), e) - 1.0) * float(_UNIT)).cast("bigint")
    size = F.when(a < least_normal, (a / least).cast("bigint")) \
        .when(a == F.lit(float("inf")), F.lit(2047 * _UNIT)) \
        .otherwise((e + 1023).cast("bigint") * F.lit(_UNIT) + mantissa)
    return F.when(F.isnan(v), F.lit(2047 * _UNIT + 1)).otherwise(F.when(v < 0, -size).otherwise(size))


def _same(cols: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return cond


def group_quantiles(df: DataFrame, value: str, by: Sequence[str], quantiles: Mapping[str, float]) -> DataFrame:
    """One row per group of ``by`` (one row overall when empty) with an exact quantile per name."""
    by = list(by)
    keys = by or ["_ps_g"]
    x = df.select(*by, (F.col(value).cast("double") + 0.0).alias("_ps_v")).where(F.col("_ps_v").isNotNull())
    counts = (x if by else x.withColumn("_ps_g", F.lit(0))).groupBy(*keys, "_ps_v").agg(F.count(F.lit(1)).alias("_ps_c"))
    counts = counts.withColumn("_ps_k", order_key(F.col("_ps_v")))
    n = F.col("_ps_n")
    ranks = []
    for i, q in enumerate(quantiles.values()):
        place = (n - 1).cast("double") * F.lit(float(q))
        ranks += [F.struct(F.lit(2 * i).alias("slot"), F.floor(place).alias("rank")),
                  F.struct(F.lit(2 * i + 1).alias("slot"), F.ceil(place).alias("rank"))]

    def cells(rows: DataFrame, within: list[str], shift: int) -> DataFrame:
        """Counts per digit, and how many values of the group or prefix come before each."""
        cell = rows.groupBy(*within, F.shiftright("_ps_k", shift).alias("_ps_p")) \
            .agg(F.sum("_ps_c").alias("_ps_m"), F.min("_ps_v").alias("_ps_x"))
        w = Window.partitionBy(*within)
        return cell.withColumn("_ps_from", F.sum("_ps_m").over(
            w.orderBy("_ps_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_ps_m"))

    inside = (F.col("_ps_rank") >= F.col("_ps_from")) & (F.col("_ps_rank") < F.col("_ps_from") + F.col("_ps_m"))
    rest = (F.col("_ps_rank") - F.col("_ps_from")).alias("_ps_rank")
    want = cells(counts, keys, SHIFTS[0]).withColumn("_ps_n", F.sum("_ps_m").over(Window.partitionBy(*keys))) \
        .withColumn("_ps_r", F.explode(F.array(*ranks))) \
        .select("*", F.col("_ps_r.slot").alias("_ps_s"), F.col("_ps_r.rank").alias("_ps_rank")).where(inside) \
        .select(*keys, "_ps_n", "_ps_s", rest, "_ps_p", "_ps_x")
    for above, shift in zip(SHIFTS, SHIFTS[1:]):
        own = counts.withColumn("_ps_p", F.shiftright("_ps_k", above)).alias("a").join(
            want.drop("_ps_x").alias("b"), _same([*keys, "_ps_p"])).select(
            *[F.col(f"a.{k}").alias(k) for k in keys], "_ps_k", "_ps_v", "_ps_c", "_ps_n", "_ps_s", "_ps_rank")
        want = cells(own, [*keys, "_ps_s", "_ps_n", "_ps_rank"], shift).where(inside) \
            .select(*keys, "_ps_n", "_ps_s", rest, "_ps_p", "_ps_x")
    found = want.groupBy(*keys, "_ps_n").pivot("_ps_s", list(range(2 * len(quantiles)))).agg(F.first("_ps_x"))
    out = []
    for i, (name, q) in enumerate(quantiles.items()):
        place = (n - 1).cast("double") * F.lit(float(q))
        low, high = F.col(f"`{2 * i}`"), F.col(f"`{2 * i + 1}`")
        out.append((low * 0.5 + high * 0.5 if q == 0.5 else low + (high - low) * (place - F.floor(place))).alias(name))
    return found.select(*by, *out)


def group_median(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "median") -> DataFrame:
    """One row per group of ``by`` (one row overall when empty) with the exact median of ``value``."""
    return group_quantiles(df, value, by, {out: 0.5})
