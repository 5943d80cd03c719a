"""Discharge energy, before/after reference-test statistics and gains."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packspark.functions.columns import normal_draw, safe_div, second_row
from packspark.operators.clean import rolling_outlier_replace, segment_clean
from packspark.schema import CYCLE_KEYS, DCIR, DISCHARGE

# Expected values of standard normal order statistics, largest first
# (used instead of unseeded random draws when early cycles are re-filled).
EXPECTED_NORMAL_ORDER = {
    1: [0.0],
    2: [0.5642, -0.5642],
    3: [0.8463, 0.0, -0.8463],
    4: [1.0294, 0.2970, -0.2970, -1.0294],
    5: [1.1630, 0.4950, 0.0, -0.4950, -1.1630],
    6: [1.2672, 0.6418, 0.2015, -0.2015, -0.6418, -1.2672],
}


def raw_discharge_energy(df: DataFrame, keys: Sequence[str] = CYCLE_KEYS, cycle: str = "cycle",
                         state: str = "cycling_substate") -> DataFrame:
    """Σ energy of DISCHARGE rows + Σ energy_rest of DCIR rows per (keys, cycle); empty sum = 0."""
    s = F.col(state)
    return (df.where(s.isin(DISCHARGE, DCIR))
            .groupBy(*keys, cycle)
            .agg((F.coalesce(F.sum(F.when(s == DISCHARGE, F.col("energy"))), F.lit(0.0))
                  + F.coalesce(F.sum(F.when(s == DCIR, F.col("energy_rest"))), F.lit(0.0)))
                 .alias("raw_discharge_energy")))


def _z_table(most: int):
    """Expected normal order statistics of 1..most values, largest first: fixed values up to six, beyond them
    the quantiles at (i - 3/8) / (n + 1/4)."""
    inv = NormalDist().inv_cdf
    rows = [EXPECTED_NORMAL_ORDER.get(n) or [-inv((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
            for n in range(1, most + 1)]
    return F.array(*[F.array(*[F.lit(float(z)) for z in r]) for r in rows])


def early_cycle_adjust(df: DataFrame, value: str = "raw_discharge_energy",
                       out: str = "adjusted_raw_discharge_energy", keys: Sequence[str] = CYCLE_KEYS,
                       cycle: str = "cycle", before_cycle: int = 6, threshold: float = 0.005,
                       spread: float = 0.00025, mode: str = "expected", seed: int = 0) -> DataFrame:
    """Re-fill the first cycles of a series when any of them jumps by more than ``threshold``.

    Rows with ``cycle < before_cycle`` form the early block.  If any |pct change| inside it
    exceeds ``threshold`` the block is replaced by ``median·(1 + spread·z_i)`` with ``z_i``
    the expected normal order statistics, largest first (``mode='expected'``), or normal draws of
    (keys, cycle, ``seed``), largest first (``mode='seeded'``, the same on every run and partitioning), or by the
    block median (``mode='median'``).  Other rows are unchanged.
    """
    wk = Window.partitionBy(*keys).orderBy(cycle)
    wall = Window.partitionBy(*keys)
    x = F.col(value)
    early = F.col(cycle) < before_cycle
    # early rows come first in cycle order, so the previous row of an early row is early
    pct = F.abs(safe_div(x, F.lag(x).over(wk)) - F.lit(1.0))
    d = (df.withColumn("_ps_pct", F.when(early, pct))
         .withColumn("_ps_i", F.row_number().over(wk))
         .withColumn("_ps_n", F.count(F.when(early, F.lit(1))).over(wall))
         .withColumn("_ps_md", F.median(F.when(early, x)).over(wall))
         .withColumn("_ps_hit", F.max(F.when(F.col("_ps_pct") > threshold, 1).otherwise(0)).over(wall)))
    if mode == "expected":
        n, i = F.col("_ps_n").cast("int"), F.col("_ps_i").cast("int")
        most = max(6, int(before_cycle))     # whole cycles from 0 or 1: no more early rows than that
        row = F.try_element_at(_z_table(most), F.greatest(F.least(n, F.lit(most)), F.lit(1)))
        z = F.when((n >= 1) & (i <= n), F.try_element_at(row, F.greatest(i, F.lit(1)))).otherwise(F.lit(0.0))
        fill = F.col("_ps_md") * (F.lit(1.0) + F.lit(float(spread)) * z)
    elif mode == "seeded":
        draws = F.sort_array(F.collect_list(F.when(early, normal_draw([*keys, cycle], seed))).over(wall), asc=False)
        d = d.withColumn("_ps_z", F.try_element_at(draws, F.col("_ps_i").cast("int")))
        fill = F.col("_ps_md") * (F.lit(1.0) + F.lit(float(spread)) * F.col("_ps_z"))
    elif mode == "median":
        fill = F.col("_ps_md")
    else:
        raise ValueError("mode must be 'expected', 'seeded' or 'median'")
    d = d.withColumn(out, F.when(early & (F.col("_ps_hit") == 1), fill).otherwise(x))
    return d.drop("_ps_pct", "_ps_i", "_ps_n", "_ps_md", "_ps_hit", "_ps_z")


def cycle_band(e: DataFrame, value: str, by: Sequence[str], method: str = "window") -> DataFrame:
    """Adds ``mean_energy`` (median of ``value``) and ``std_energy`` (ddof=1) per ``by`` group.

    ``'window'``: one window per group, in a single pass; a group is the packs of one test at one cycle.
    ``'distributed'``: a statistics table (exact median without gathering a group into one task,
    partial-aggregated std) joined back, for tests with too many packs for one task.  Both give the same
    result; neither starts a job while the plan is built.
    """
    by = list(by)
    if method == "window":
        w = Window.partitionBy(*by)
        return e.withColumn("mean_energy", F.median(value).over(w)).withColumn("std_energy", F.stddev_samp(value).over(w))
    from packspark.operators.median import group_median
    stats = (e.groupBy(*by).agg(F.stddev_samp(value).alias("std_energy"))
             .join(group_median(e, value, by, out="mean_energy"), on=by, how="left"))
    return e.join(stats, on=by, how="left")


def discharge_energy(df: DataFrame, window: int = 7, sigma_multiplier: float = 0.1, raw: bool = False,
                     keys: Sequence[str] = CYCLE_KEYS, cycle: str = "cycle",
                     early_mode: str = "expected", band_method: str = "window", seed: int = 0) -> DataFrame:
    """Per (doe, instance, cycle) discharge energy, cleaned, with per-(doe, cycle) band.

    ``raw=True`` stops after the early-cycle adjustment (columns ``raw_discharge_energy``
    and ``adjusted_raw_discharge_energy``).  ``early_mode`` and ``seed`` see ``early_cycle_adjust``, ``band_method`` see ``cycle_band``.  Otherwise adds ``discharge_energy``,
    ``mean_energy`` (a median, as named by the source), ``std_energy`` (ddof=1),
    ``lower_energy_bound`` = mean − 3·std, ``norm_discharge_energy`` (divided by the
    second cycle, then cleaned again), ``norm_mean_energy`` and ``norm_lower_energy``.
    """
    keys = list(keys)
    e = raw_discharge_energy(df, keys, cycle)
    e = early_cycle_adjust(e, keys=keys, cycle=cycle, mode=early_mode, seed=seed)
    if raw:
        return e
    e = rolling_outlier_replace(e, "adjusted_raw_discharge_energy", keys, cycle, window, sigma_multiplier,
                                out="discharge_energy")
    e = cycle_band(e, "discharge_energy", [keys[0], cycle], band_method)
    e = e.withColumn("lower_energy_bound", F.col("mean_energy") - F.lit(3.0) * F.col("std_energy"))
    e = (e.withColumn("norm_discharge_energy",
                      safe_div("discharge_energy", second_row("discharge_energy", keys, [cycle])))
         .withColumn("norm_mean_energy", safe_div("mean_energy", second_row("mean_energy", keys, [cycle])))
         .withColumn("norm_lower_energy",
                     safe_div("lower_energy_bound", second_row("lower_energy_bound", keys, [cycle]))))
    return rolling_outlier_replace(e, "norm_discharge_energy", keys, cycle, window, sigma_multiplier)


def rpt_cycle_sets(rpt_cycle: int, neighbors_cycle: int, avoid_close_cycle: int = 0):
    """``before = [r-1-n-a, r-1-a)``, ``after = [r+1+a, r+1+n+a)`` as (lo, hi) half-open ranges."""
    r, n, a = rpt_cycle, neighbors_cycle, avoid_close_cycle
    return (r - 1 - n - a, r - 1 - a), (r + 1 + a, r + 1 + n + a)


def rpt_normalised(df: DataFrame, rpt_cycle: int = 201, window: int = 5, sigma_multiplier: float = 0.1,
                   keys: Sequence[str] = CYCLE_KEYS, cycle: str = "cycle") -> DataFrame:
    """Adjusted raw energy / second cycle, cleaned before and after the reference test separately."""
    keys = list(keys)
    e = discharge_energy(df, raw=True, keys=keys, cycle=cycle)
    e = e.withColumn("norm_discharge_energy",
                     safe_div("adjusted_raw_discharge_energy",
                              second_row("adjusted_raw_discharge_energy", keys, [cycle])))
    return segment_clean(e, "norm_discharge_energy", keys, cycle, rpt_cycle, window, sigma_multiplier)


def _in_range(c, rng):
    return (F.col(c) >= rng[0]) & (F.col(c) < rng[1])


def rpt_statistics(df: DataFrame, rpt_cycle: int = 201, neighbors_cycle: int = 3, window: int = 5,
                   sigma_multiplier: float = 0.1, avoid_close_cycle: int = 0,
                   keys: Sequence[str] = CYCLE_KEYS, cycle: str = "cycle") -> DataFrame:
    """Per (doe, cycle) min/avg/max/std/cv_pc/sample_size of normalised energy around the test."""
    before, after = rpt_cycle_sets(rpt_cycle, neighbors_cycle, avoid_close_cycle)
    n = rpt_normalised(df, rpt_cycle, window, sigma_multiplier, keys, cycle)
    x = F.col("norm_discharge_energy")
    st = (n.where(_in_range(cycle, before) | _in_range(cycle, after))
          .groupBy(keys[0], cycle)
          .agg(F.min(x).alias("min"), F.avg(x).alias("avg"), F.max(x).alias("max"),
               F.stddev_samp(x).alias("std"), F.count(F.lit(1)).alias("sample_size")))
    return st.withColumn("cv_pc", F.when(F.col("avg") > 0, F.col("std") * 100.0 / F.col("avg"))
                         .otherwise(F.lit(float("inf"))))


def rpt_samples(df: DataFrame, rpt_cycle: int = 201, neighbors_cycle: int = 3, window: int = 5,
                sigma_multiplier: float = 0.1, avoid_close_cycle: int = 0,
                keys: Sequence[str] = CYCLE_KEYS, cycle: str = "cycle") -> DataFrame:
    """Normalised energies labelled ``sample = 'after'`` / ``'before'`` for a t-test."""
    before, after = rpt_cycle_sets(rpt_cycle, neighbors_cycle, avoid_close_cycle)
    n = rpt_normalised(df, rpt_cycle, window, sigma_multiplier, keys, cycle)
    lab = F.when(_in_range(cycle, after), "after").when(_in_range(cycle, before), "before")
    return n.withColumn("sample", lab).where(F.col("sample").isNotNull())


def rpt_gain(df: DataFrame, rpt_cycle: int = 201, neighbors_cycle: int = 5, avoid_close_cycle: int = 0,
             window: int = 5, sigma_multiplier: float = 0.1, keys: Sequence[str] = CYCLE_KEYS,
             cycle: str = "cycle") -> DataFrame:
    """Per (doe, instance): before/after mean, median, std and the energy and cycle gains.

    ``gain_in_cycle``: among cycles later than the first after-cycle, the cycle whose
    normalised energy is closest to the before-mean (first cycle on ties), minus the last
    before-cycle; NULL when there are no after-rows.
    """
    keys = list(keys)
    before, after = rpt_cycle_sets(rpt_cycle, neighbors_cycle, avoid_close_cycle)
    n = rpt_normalised(df, rpt_cycle, window, sigma_multiplier, keys, cycle)
    x = F.col("norm_discharge_energy")
    isb, isa = _in_range(cycle, before), _in_range(cycle, after)
    n = n.withColumn("_ps_avg_b", F.avg(F.when(isb, x)).over(Window.partitionBy(*keys)))
    cand = F.when((F.col(cycle) > after[0]) & x.isNotNull() & F.col("_ps_avg_b").isNotNull(),
                  F.struct(F.abs(x - F.col("_ps_avg_b")).alias("d"), F.col(cycle).alias("c")))
    g = (n.groupBy(*keys)
         .agg(F.avg(F.when(isb, x)).alias("avg_energy_before"),
              F.median(F.when(isb, x)).alias("median_energy_before"),
              F.stddev_samp(F.when(isb, x)).alias("std_energy_before"),
              F.avg(F.when(isa, x)).alias("avg_energy_after"),
              F.median(F.when(isa, x)).alias("median_energy_after"),
              F.stddev_samp(F.when(isa, x)).alias("std_energy_after"),
              F.count(F.when(isa, F.lit(1))).alias("_ps_n_after"),
              F.min_by(F.col(cycle), cand).alias("_ps_close")))
    g = (g.withColumn("rpt_cycle", F.lit(int(rpt_cycle)))
         .withColumn("gain_in_energy", F.col("median_energy_after") - F.col("median_energy_before"))
         .withColumn("gain_in_cycle", F.when(F.col("_ps_n_after") > 0,
                                             F.col("_ps_close") - F.lit(before[1] - 1)))
         .withColumn("gain_in_energy_pc", safe_div(F.col("gain_in_energy") * 100.0, "median_energy_before")))
    return g.drop("_ps_n_after", "_ps_close")


def gain_correlation(gain: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of ``gain_in_energy_pc`` and ``gain_in_cycle`` (optionally per group)."""
    agg = F.corr(F.col("gain_in_energy_pc"), F.col("gain_in_cycle").cast("double")).alias("pearson_r")
    cnt = F.count(F.when(F.col("gain_in_energy_pc").isNotNull() & F.col("gain_in_cycle").isNotNull(),
                         F.lit(1))).alias("n_pairs")
    return gain.groupBy(*by).agg(agg, cnt) if by else gain.agg(agg, cnt)


def overlay_test_reference(test: DataFrame, reference: DataFrame, window: int = 7,
                           sigma_multiplier: float = 0.1) -> DataFrame:
    """Normalised energy of a test group next to the mean and lower band of a reference group."""
    t = (discharge_energy(test, window, sigma_multiplier)
         .select("doe_number", "instance_number", "cycle", "norm_discharge_energy")
         .withColumn("role", F.lit("test")))
    r = (discharge_energy(reference, window, sigma_multiplier)
         .select("doe_number", "instance_number", "cycle", "norm_mean_energy", "norm_lower_energy")
         .withColumn("role", F.lit("reference")))
    return t.unionByName(r, allowMissingColumns=True)
