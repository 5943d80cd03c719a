"""Fade trend extrapolation and energy-jump removal on normalised energy series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packspark.functions.columns import safe_div
from packspark.schema import CYCLE_KEYS


def fade_target_cycle(df: DataFrame, target_energy: float = 0.64, last_n: int = 30,
                      value: str = "norm_discharge_energy", keys: Sequence[str] = CYCLE_KEYS,
                      cycle: str = "cycle") -> DataFrame:
    """Linear fit of ``value`` on ``cycle`` over the last ``last_n`` cycles of each series.

    ``target_cycle`` = cycle where the line reaches ``target_energy``, truncated toward
    zero (NULL for a flat line); ``r2_score`` is the coefficient of determination.  A
    series shorter than ``last_n`` uses all its rows.  Only degree 1 is fitted.
    """
    keys = list(keys)
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(cycle).desc()))
    d = df.withColumn("_ps_rn", rn).where(F.col("_ps_rn") <= last_n)
    y, x = F.col(value), F.col(cycle).cast("double")
    g = d.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                             F.regr_r2(y, x).alias("r2_score"), F.count(y).alias("n_points"))
    root = safe_div(F.lit(float(target_energy)) - F.col("intercept"), F.col("slope"))
    return (g.withColumn("target_cycle", F.when(F.col("slope") != 0, root.try_cast("int")))
            .withColumn("best_degree", F.lit(1)))


def extrapolation_segments(series: DataFrame, fits: DataFrame, r2_min: float = 0.90, target_energy: float = 0.64,
                           value: str = "norm_discharge_energy", keys: Sequence[str] = CYCLE_KEYS,
                           cycle: str = "cycle", back: int = 5) -> DataFrame:
    """For well-fitted series: start point (last cycle − ``back``, value at the last cycle) and
    end point (target cycle, target energy)."""
    keys = list(keys)
    good = fits.where(F.col("r2_score") > r2_min).select(*keys, "target_cycle", "r2_score")
    s = series.join(good.select(*keys), on=keys, how="left_semi")
    start = s.groupBy(*keys).agg((F.max(cycle) - back).alias("start_cycle"),
                                 F.max_by(F.col(value), F.col(cycle)).alias("start_energy"))
    return (start.join(good, on=keys, how="inner")
            .withColumnRenamed("target_cycle", "end_cycle")
            .withColumn("end_energy", F.lit(float(target_energy))))


def fit_segments(series: DataFrame, target_energy: float = 0.64, last_n: int = 30, r2_min: float = 0.90,
                 value: str = "norm_discharge_energy", keys: Sequence[str] = CYCLE_KEYS, cycle: str = "cycle",
                 back: int = 5) -> DataFrame:
    """Fit and extrapolation segments in one aggregation per series.

    Same result as ``extrapolation_segments(series, fade_target_cycle(series))``: the line is
    fitted on the last ``last_n`` cycles (conditional regression aggregates), the start point
    uses all cycles, and series with ``r2 <= r2_min`` are dropped - one pass, no semi join.
    """
    keys = list(keys)
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(cycle).desc()))
    d = series.withColumn("_ps_rn", rn)
    last = F.col("_ps_rn") <= last_n
    y, x = F.when(last, F.col(value)), F.when(last, F.col(cycle).cast("double"))
    g = d.groupBy(*keys).agg(F.regr_slope(y, x).alias("_ps_m"), F.regr_intercept(y, x).alias("_ps_b"),
                             F.regr_r2(y, x).alias("r2_score"), (F.max(cycle) - back).alias("start_cycle"),
                             F.max_by(F.col(value), F.col(cycle)).alias("start_energy"))
    root = safe_div(F.lit(float(target_energy)) - F.col("_ps_b"), F.col("_ps_m"))
    return (g.where(F.col("r2_score") > r2_min)
            .withColumn("end_cycle", F.when(F.col("_ps_m") != 0, root.try_cast("int")))
            .withColumn("end_energy", F.lit(float(target_energy)))
            .drop("_ps_m", "_ps_b"))


def _jump_frame(df, value, keys, cycle, jump_threshold_pc, start_cycle, closest_cycles, jump_cycle_neighbors):
    """Columns ``_ps_out`` (adjusted), ``_ps_keep``, ``_ps_len``, ``_ps_shift`` per row.

    A jump shifts its own and all later rows, so jumps two cycles apart or more shift the whole neighbourhood of
    the next one alike and its length depends on original differences only.  With ``closest_cycles`` of 1 a jump may follow the
    one of the cycle before; then the first row of its neighbourhood (c-2) lacks that shift, all others have
    it, so ``len(c) = len0(c) - len(c-1)``.  Along such a run of jumps this is an alternating sum of the original lengths: again
    windows, no sequential pass.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(cycle)
    x = F.col(value)
    pct = F.abs(safe_div(x, F.lag(x).over(w)) - F.lit(1.0))
    cand = F.coalesce(pct > F.lit(jump_threshold_pc / 100.0), F.lit(False)) & (F.col(cycle) >= start_cycle)
    d = df.withColumn("_ps_cand", cand)
    # next candidate: a running minimum over the reversed order (the frame only grows)
    wrev = Window.partitionBy(*keys).orderBy(F.col(cycle).desc())
    nxt = F.min(F.when(F.col("_ps_cand"), F.col(cycle))).over(wrev.rowsBetween(Window.unboundedPreceding, -1))
    keep = F.col("_ps_cand") & (nxt.isNull() | (nxt - F.col(cycle) >= closest_cycles))
    d = d.withColumn("_ps_keep", keep)
    # neighbourhood [c-2, c+n] by cycle value: its size is bounded by n+3 rows per jump
    # (cycles are whole numbers, unique in a series); its first row is one of c-2, c-1, c, and the
    # largest of the others is a maximum over the range that starts after it
    near = lambda a: Window.partitionBy(*keys).orderBy(cycle).rangeBetween(a, jump_cycle_neighbors)
    first = F.min(cycle).over(near(-2)) - F.col(cycle)
    rest = F.when(first == -2, F.max(x).over(near(-1))).when(first == -1, F.max(x).over(near(0))) \
        .otherwise(F.max(x).over(near(1)))
    length = F.when(F.count(F.lit(1)).over(near(-2)) > 1, rest - F.first(x).over(near(-2))).otherwise(F.lit(0.0))
    d = d.withColumn("_ps_len", F.when(F.col("_ps_keep"), length).otherwise(F.lit(0.0)))
    if closest_cycles < 2:
        after = F.col("_ps_keep") & (first == -2) & (F.lag(cycle).over(w) == F.col(cycle) - 1) & F.lag("_ps_keep").over(w)
        d = d.withColumn("_ps_after", after)
        d = d.withColumn("_ps_run", F.count(F.when(F.col("_ps_keep") & ~F.col("_ps_after"), F.lit(1)))
                         .over(w.rowsBetween(Window.unboundedPreceding, 0)))
        sign = F.when(F.pmod(F.col(cycle), F.lit(2)) == 0, F.lit(1.0)).otherwise(F.lit(-1.0))     # jumps of a run: one a cycle
        run = Window.partitionBy(*keys, "_ps_run").orderBy(cycle).rowsBetween(Window.unboundedPreceding, 0)
        total = F.sum(sign * F.col("_ps_len")).over(run)
        d = d.withColumn("_ps_len", F.when(F.col("_ps_keep"), sign * total).otherwise(F.lit(0.0)))
    d = d.withColumn("_ps_shift", F.sum("_ps_len").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.withColumn("_ps_out", x - F.col("_ps_shift"))


def energy_jump_removed(df: DataFrame, jump_threshold_pc: float = 0.2, start_cycle: int = 2,
                        closest_cycles: int = 3, jump_cycle_neighbors: int = 5,
                        value: str = "norm_discharge_energy", keys: Sequence[str] = CYCLE_KEYS,
                        cycle: str = "cycle") -> DataFrame:
    """Series with level jumps removed.

    Jumps: |pct change| > threshold % at cycles >= ``start_cycle``; of jumps closer than
    ``closest_cycles`` only the last of each chain is kept.  Each kept jump at cycle c
    shifts all later rows by ``max(x_i - x_first)`` over the rows with cycle in
    ``[c-2, c+neighbors]`` (first row excluded; 0 when there is a single row), as earlier jumps left them.
    """
    d = _jump_frame(df, value, keys, cycle, jump_threshold_pc, start_cycle, closest_cycles, jump_cycle_neighbors)
    return d.withColumn(value, F.col("_ps_out")).drop(*[c for c in d.columns if c.startswith("_ps_")])


def energy_jump_details(df: DataFrame, jump_threshold_pc: float = 0.2, start_cycle: int = 2,
                        closest_cycles: int = 3, jump_cycle_neighbors: int = 5,
                        value: str = "norm_discharge_energy", keys: Sequence[str] = CYCLE_KEYS,
                        cycle: str = "cycle") -> DataFrame:
    """One row per kept jump: cycle, energy and percent change as seen after earlier jumps were removed."""
    keys = list(keys)
    d = _jump_frame(df, value, keys, cycle, jump_threshold_pc, start_cycle, closest_cycles, jump_cycle_neighbors)
    w = Window.partitionBy(*keys).orderBy(cycle)
    seen = F.col(value) - (F.col("_ps_shift") - F.col("_ps_len"))
    d = d.withColumn("_ps_prev", F.lag("_ps_out").over(w))
    return (d.where("_ps_keep")
            .select(*keys, cycle, seen.alias("energy"),
                    (F.abs(safe_div(seen, F.col("_ps_prev")) - F.lit(1.0)) * 100.0).alias("jump_energy_pct"),
                    F.col("_ps_len").alias("jump_length")))
