"""Group statistics used by the plots of the source: mean + interval, histogram, density."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packspark.functions.columns import ci95_bounds
from packspark.operators.median import group_quantiles


def mean_ci(df: DataFrame, x: str, y: str, hue: Sequence[str] = ()) -> DataFrame:
    """Per (hue, x): n, mean, sample std and a normal-approximation 95 % interval of the mean."""
    g = df.groupBy(*hue, x).agg(F.count(F.col(y)).alias("n"), F.avg(y).alias("mean"),
                                F.stddev_samp(y).alias("std"))
    lo, hi = ci95_bounds(F.col("mean"), F.col("std"), F.col("n"))
    return g.withColumn("ci_low", lo).withColumn("ci_high", hi)


def histogram(df: DataFrame, value: str, lo: float, width: float, by: Sequence[str] = ()) -> DataFrame:
    """Fixed-width histogram: ``bin = floor((x - lo) / width)``, count and probability per group.

    Counts are partial-aggregated before the shuffle; the probability divides by the
    group total from a second, tiny aggregation over the bins.
    """
    b = F.floor((F.col(value) - F.lit(float(lo))) / F.lit(float(width))).cast("int")
    c = (df.where(F.col(value).isNotNull()).withColumn("bin", b)
         .groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("count")))
    # the binned table has one row per (group, bin): its size does not grow with the rows
    total = F.sum("count").over(Window.partitionBy(*by))
    return (c.withColumn("bin_low", F.lit(float(lo)) + F.col("bin") * F.lit(float(width)))
            .withColumn("probability", F.col("count") / total))


def bin_rule(n: Column, lo: Column, hi: Column, iqr: Column) -> Column:
    """Number of equal bins that the data choose: the narrower of the Freedman-Diaconis and the Sturges width (the latter alone
    where the quartiles are equal); one bin for a single value."""
    size = n.cast("double")
    sturges = (hi - lo) / (F.ln(size) / F.lit(math.log(2.0)) + 1.0)
    spread = 2.0 * iqr / F.pow(size, F.lit(1.0 / 3.0))
    width = F.when(spread > 0, F.least(spread, sturges)).otherwise(sturges)
    return F.when(hi > lo, F.ceil((hi - lo) / F.when(width > 0, width))).otherwise(F.lit(1)).cast("int")


def histogram_auto(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Histogram per group whose bins the group's own values choose (``bin_rule``): bins, bin, count, bin_low,
    bin_width and probability.  The last bin is closed.

    Size and range are partial-aggregated, quartiles come from radix selection, so no group lies in one task.  The
    statistics have a row per group and are joined without a hint; counts are partial-aggregated."""
    by = list(by)
    keys = by or ["_ps_all"]
    x = F.col(value).cast("double")
    d = df.where(x.isNotNull() & ~F.isnan(x)).select(*by, x.alias("_ps_x"))
    if not by:
        d = d.withColumn("_ps_all", F.lit(0))
    size = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_ps_n"), F.min("_ps_x").alias("_ps_lo"), F.max("_ps_x").alias("_ps_hi"))
    quart = group_quantiles(d, "_ps_x", keys, {"_ps_q1": 0.25, "_ps_q3": 0.75})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    st = size.alias("a").join(quart.alias("b"), same).select("a.*", "_ps_q1", "_ps_q3")
    lo, hi = F.col("_ps_lo"), F.col("_ps_hi")
    st = st.withColumn("bins", bin_rule(F.col("_ps_n"), lo, hi, F.col("_ps_q3") - F.col("_ps_q1")))
    at = F.when(hi > lo, F.least(F.floor((F.col("_ps_x") - lo) / (hi - lo) * F.col("bins")).cast("int"), F.col("bins") - 1)) \
        .otherwise(F.lit(0))
    placed = d.alias("a").join(st.alias("b"), same).select(*[F.col(f"a.{k}").alias(k) for k in keys], "_ps_n", "_ps_lo", "_ps_hi",
                                                           "bins", at.alias("bin"))
    c = placed.groupBy(*keys, "_ps_n", "_ps_lo", "_ps_hi", "bins", "bin").agg(F.count(F.lit(1)).alias("count"))
    width = (hi - lo) / F.col("bins")
    return c.select(*by, "bins", "bin", "count", (lo + F.col("bin") * width).alias("bin_low"), width.alias("bin_width"),
                    (F.col("count") / F.col("_ps_n")).alias("probability"))


def density(df: DataFrame, value: str, by: Sequence[str] = (), points: int = 50) -> DataFrame:
    """Gaussian kernel density on ``points`` grid points between the group min and max.

    Bandwidth = Scott's factor n^(-1/5) × sample std.  Each row contributes to every grid
    point of its group (a fixed fan-out of ``points``) and the sums are partial-aggregated
    before the shuffle; no pairs of rows are formed.  Without spread there is no bandwidth: the density is NULL.
    ``density_binned`` does without the fan-out, within a stated error.
    """
    x = F.col(value)
    st = (df.where(x.isNotNull()).groupBy(*by)
          .agg(F.count(x).alias("_n"), F.stddev_samp(x).alias("_sd"), F.min(x).alias("_lo"), F.max(x).alias("_hi")))
    width = F.pow(F.col("_n").cast("double"), F.lit(-0.2)) * F.col("_sd")
    st = st.withColumn("_bw", F.when(width > 0, width))
    if by:
        # one stats row per group; adaptive execution broadcasts it only when it is small
        d = df.where(x.isNotNull()).select(*by, value).join(st, on=list(by), how="inner")
    else:
        # one stats row: scalar subqueries instead of a join
        d = df.where(x.isNotNull()).select(value).withColumns(
            {c: st.select(c).scalar() for c in ("_n", "_sd", "_lo", "_hi", "_bw")})
    step = (F.col("_hi") - F.col("_lo")) / F.lit(float(points - 1))
    d = d.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    gx = F.col("_lo") + F.col("point").cast("double") * step
    u = (gx - x) / F.col("_bw")
    kern = F.exp(F.lit(-0.5) * u * u) / (F.col("_bw") * F.lit((2 * 3.141592653589793) ** 0.5))
    return (d.withColumn("_k", kern).withColumn("x", gx)
            .groupBy(*by, "point", "x").agg((F.sum("_k") / F.first("_n")).alias("density")))


def binning_error(cells_per_bandwidth: int) -> float:
    """Largest error of the binned density, in units of 1 / bandwidth.

    Sharing a value between the two ends of its cell replaces the kernel by its chord there, which is off by at most
    an eighth of the squared cell width times the largest second derivative, 1 / sqrt(2 pi) for the normal kernel."""
    return 1.0 / (8.0 * cells_per_bandwidth ** 2 * math.sqrt(2.0 * math.pi))


def density_binned(df: DataFrame, value: str, by: Sequence[str] = (), points: int = 50,
                   cells_per_bandwidth: int = 64) -> DataFrame:
    """Gaussian kernel density as in ``density``, from counts in cells instead of rows: point, x, density and its ``error_bound``.

    A cell is ``1 / cells_per_bandwidth`` of the group's bandwidth wide.  A value is shared linearly between the two ends of
    its cell, so a cell needs only its count and the sum of the shares; both are partial-aggregated before the
    shuffle, and only occupied cells meet the ``points``.  The result differs from the exact one by at most
    ``error_bound`` (``binning_error`` over the bandwidth; at 64 cells 1.2e-5 of a bandwidth's inverse).  Groups without
    spread have no bandwidth: their density is NULL at every point.  NULL and NaN values are left out.
    """
    by = list(by)
    keys = by or ["_ps_all"]
    x = F.col(value).cast("double")
    d = df.where(x.isNotNull() & ~F.isnan(x)).select(*by, x.alias("_ps_x"))
    if not by:
        d = d.withColumn("_ps_all", F.lit(0))
    st = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_ps_n"), F.stddev_samp("_ps_x").alias("_ps_sd"),
                              F.min("_ps_x").alias("_ps_lo"), F.max("_ps_x").alias("_ps_hi"))
    width = F.pow(F.col("_ps_n").cast("double"), F.lit(-0.2)) * F.col("_ps_sd")
    st = st.withColumn("_ps_bw", F.when(width > 0, width))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    lo, bw = F.col("_ps_lo"), F.col("_ps_bw")
    cell = bw / F.lit(float(cells_per_bandwidth))
    at = F.coalesce((F.col("_ps_x") - lo) / cell, F.lit(0.0))
    placed = (d.alias("a").join(st.alias("b"), same)
              .select("b.*", F.floor(at).alias("_ps_cell"), (at - F.floor(at)).alias("_ps_share")))
    cells = (placed.groupBy(*st.columns, "_ps_cell")
             .agg((F.count(F.lit(1)) - F.sum("_ps_share")).alias("_ps_left"), F.sum("_ps_share").alias("_ps_right")))
    cells = cells.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    gx = lo + F.col("point").cast("double") * ((F.col("_ps_hi") - lo) / F.lit(float(points - 1)))
    scale = float(cells_per_bandwidth)

    def kernel(end: Column) -> Column:
        u = (gx - lo) / bw - end / F.lit(scale)
        return F.exp(F.lit(-0.5) * u * u)

    left, right = F.col("_ps_cell").cast("double"), F.col("_ps_cell").cast("double") + 1.0
    part = F.col("_ps_left") * kernel(left) + F.col("_ps_right") * kernel(right)
    total = F.sum("_ps_part") / (F.first("_ps_n") * F.first("_ps_bw") * F.lit(math.sqrt(2.0 * math.pi)))
    return (cells.withColumn("x", gx).withColumn("_ps_part", part).groupBy(*keys, "point", "x")
            .agg(total.alias("density"), (F.lit(binning_error(cells_per_bandwidth)) / F.first("_ps_bw")).alias("error_bound"))
            .select(*by, "point", "x", "density", "error_bound"))
