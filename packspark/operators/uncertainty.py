"""Capacity and charge-time measurement uncertainty of dense charge series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packspark.functions.columns import bin_right_closed, pct_text
from packspark.operators.clean import sigma_band_filter
from packspark.operators.ends import array_median, group_ends
from packspark.operators.median import group_median
from packspark.operators.ordering import prefix_scan, range_cells
from packspark.session import written

SERIES = ("doe", "instance", "cycle_num")
ORDER = ("elapsed_minutes", "sample_id")

# Current error limits as (upper bound of the current range in A, error %),
# ranges right-closed, the first open to -inf; currents above the last bound get no error.
ERROR_LIMITS = ((-3.0, 1.0), (-1.5, 1.5), (-1.0, 2.0), (0.0, 8.0))


def _null_if_any_null(a: Column, b: Column, pick_low: bool) -> Column:
    both = a.isNotNull() & b.isNotNull()
    return F.when(both, F.when(a <= b, a if pick_low else b).otherwise(b if pick_low else a))


def capacity_bounds(df: DataFrame, limits: Sequence[tuple[float, float]] = ERROR_LIMITS, adc_tick: float = 0.0,
                    state: str | None = "CHARGE", keys: Sequence[str] = SERIES,
                    order: Sequence[str] = ORDER, method: str = "window", partitions: int | None = None) -> DataFrame:
    """Error class per sample, current bounds and cumulative charge capacity with bounds (Ah).

    ``capacity = Σ -I·Δt / 60`` over the series in ``order`` (right-endpoint rule; the first
    sample and samples whose term is NULL are NULL, later samples keep accumulating).
    The two bound series are named by size: ``capacity_lower_bound <= capacity_upper_bound``.
    ``method='range'`` spreads each series over many tasks (``ordering.prefix_scan``; it writes the frame to the checkpoint
    folder at once), ``'window'`` takes a task per series.  Sums differ in the last bits only.
    """
    d = df
    if state is not None:
        d = d.where(F.col("charging_state_name") == state)
    d = d.where(F.col("avg_current_a").isNotNull())
    i = F.col("avg_current_a")
    ups = [u for u, _ in limits]
    labs = [p for _, p in limits]
    d = d.withColumn("error_pc", bin_right_closed(i, ups, labs))
    e = F.col("error_pc") * 0.01
    d = (d.withColumn("avg_current_a_lower_bound", i * (F.lit(1.0) + e) + F.lit(float(adc_tick)))
         .withColumn("avg_current_a_upper_bound", i * (F.lit(1.0) - e) - F.lit(float(adc_tick))))
    currents = {"capacity": "avg_current_a", "_ps_ca": "avg_current_a_lower_bound", "_ps_cb": "avg_current_a_upper_bound"}
    if method == "range":
        d = prefix_scan(range_cells(d, keys, order, partitions), keys, order, lags={"_ps_before": "elapsed_minutes"})
        dt = F.col("elapsed_minutes") - F.col("_ps_before")
        d = d.withColumns({f"_ps_t_{o}": -F.col(c) * dt for o, c in currents.items()})
        d = prefix_scan(d, keys, order, sums={o: f"_ps_t_{o}" for o in currents})
        d = d.withColumns({o: F.when(F.col(f"_ps_t_{o}").isNotNull(), F.col(o) / 60.0) for o in currents}) \
            .drop("_ps_pid", "_ps_before", *[f"_ps_t_{o}" for o in currents])
    elif method == "window":
        w = Window.partitionBy(*keys).orderBy(*order)
        run = w.rowsBetween(Window.unboundedPreceding, 0)
        d = d.withColumn("_ps_dt", F.col("elapsed_minutes") - F.lag("elapsed_minutes").over(w))

        def cum(cur: str) -> Column:
            term = -F.col(cur) * F.col("_ps_dt")
            return F.when(term.isNotNull(), F.sum(term).over(run) / 60.0)

        for out, current in currents.items():
            d = d.withColumn(out, cum(current))
    else:
        raise ValueError("method must be 'window' or 'range'")
    a, b = F.col("_ps_ca"), F.col("_ps_cb")
    return (d.withColumn("capacity_lower_bound", _null_if_any_null(a, b, True))
            .withColumn("capacity_upper_bound", _null_if_any_null(a, b, False))
            .drop("_ps_dt", "_ps_ca", "_ps_cb"))


def series_max(df: DataFrame, column: str = "capacity", keys: Sequence[str] = SERIES) -> DataFrame:
    return df.groupBy(*keys).agg(F.max(column).alias(column))


def _band(mx: DataFrame, column: str, sigma_multiplier: float) -> Column:
    """``column`` inside the global median ± k·std (ddof=1) of ``mx``.

    The two statistics are scalar subqueries, not a join; the median is exact.
    The median is found by radix selection over counted values, so no task holds all series maxima.
    """
    md = group_median(mx, column, out="md").select("md").scalar()
    sd = mx.agg(F.stddev_samp(column).alias("sd")).select("sd").scalar()
    k = F.lit(float(sigma_multiplier))
    return F.coalesce(F.col(column).between(md - k * sd, md + k * sd), F.lit(False))


def outlier_cycles(df: DataFrame, column: str = "capacity", sigma_multiplier: float = 3.0,
                   keys: Sequence[str] = SERIES, cycle: str = "cycle_num") -> DataFrame:
    """Cycle numbers with a series maximum outside the global median ± k·std (ddof=1) band.

    The maxima (a row per series) are written once; median, deviation and list read that table, so ``df`` is
    computed once here."""
    mx = written(series_max(df, column, keys), "series-maxima")
    return mx.where(~_band(mx, column, sigma_multiplier)).select(cycle).distinct()


def drop_outlier_cycles(df: DataFrame, column: str = "capacity", sigma_multiplier: float = 3.0,
                        keys: Sequence[str] = SERIES, cycle: str = "cycle_num",
                        scope: str = "all") -> DataFrame:
    """Drop every row whose cycle number is an outlier cycle.

    ``scope='all'`` (the source's rule) drops that cycle number in all series;
    ``scope='series'`` drops only the offending series.  The drop list is joined with a
    left-anti join; adaptive execution broadcasts it when it is small.
    """
    if scope == "all":
        return df.join(outlier_cycles(df, column, sigma_multiplier, keys, cycle), on=cycle, how="left_anti")
    if scope == "series":
        mx = written(series_max(df, column, keys), "series-maxima")
        bad = mx.where(~_band(mx, column, sigma_multiplier)).select(*keys)
        return df.join(bad, on=list(keys), how="left_anti")
    raise ValueError("scope must be 'all' or 'series'")


def capacity_uncertainty(df: DataFrame, sigma_multiplier: float = 3.0, keys: Sequence[str] = SERIES) -> DataFrame:
    """Per cycle: max capacity and bounds, band-filtered per pack, with percent texts."""
    keys = list(keys)
    c = df.groupBy(*keys).agg(F.max("capacity").alias("capacity"),
                              F.max("capacity_lower_bound").alias("capacity_lower_bound"),
                              F.max("capacity_upper_bound").alias("capacity_upper_bound"))
    c = sigma_band_filter(c, "capacity", keys[:-1], sigma_multiplier, ddof=0)
    cap = F.col("capacity")
    return (c.withColumn("capacity_lower_bound_pc", pct_text(F.try_divide(F.col("capacity_lower_bound") * 100.0, cap)))
            .withColumn("capacity_upper_bound_pc", pct_text(F.try_divide(F.col("capacity_upper_bound") * 100.0, cap)))
            .withColumn("capacity_uncertainty_pc",
                        pct_text(F.try_divide((F.col("capacity_upper_bound") - F.col("capacity_lower_bound")) * 100.0,
                                              cap))))


def time_uncertainty(df: DataFrame, cut_off_current: float = -0.5, current_error_pc: float = 8.0,
                     state: str | None = "CHARGE", keys: Sequence[str] = SERIES,
                     order: Sequence[str] = ORDER) -> DataFrame:
    """Charge-time uncertainty from the constant-voltage part of each series (``cccv_state = 2``).

    ``charge_time`` = last time; ``charge_time_lower_bound`` = time of the sample whose
    current is closest to ``max(I)·u`` with ``u = 1 + e/100``; ``t*`` = time of the sample
    closest to ``cut_off·u``; ``avg_current_below_delta_time`` = current of the sample
    closest in time to ``2·t* − charge_time``.  Ties go to the earliest sample.
    """
    keys = list(keys)
    u = 1.0 + current_error_pc / 100.0
    d = df
    if state is not None:
        d = d.where(F.col("charging_state_name") == state)
    d = d.where(F.col("avg_current_a").isNotNull() & (F.col("cccv_state") == 2))
    i, t = F.col("avg_current_a"), F.col("elapsed_minutes")
    w = Window.partitionBy(*keys)
    tie = [F.col(o) for o in order]

    def closest(dist: Column) -> Column:
        return F.struct(dist.alias("d"), *tie)

    d = (d.withColumn("_ps_tmax", F.max(t).over(w))
         .withColumn("_ps_imax", F.max(i).over(w))
         .withColumn("_ps_tstar", F.min_by(t, closest(F.abs(i - F.lit(cut_off_current * u)))).over(w)))
    target = F.col("_ps_tstar") - (F.col("_ps_tmax") - F.col("_ps_tstar"))
    g = d.groupBy(*keys).agg(
        F.max(t).alias("charge_time"),
        F.min_by(t, closest(F.abs(i - F.col("_ps_imax") * F.lit(u)))).alias("charge_time_lower_bound"),
        F.min_by(i, closest(F.abs(t - target))).alias("avg_current_below_delta_time"))
    pct = F.try_divide((F.col("charge_time") - F.col("charge_time_lower_bound")) * 200.0, F.col("charge_time"))
    return (g.withColumn("avg_current_a_cut_off", F.lit(float(cut_off_current)))
            .withColumn("avg_current_lower_bound", F.lit(float(cut_off_current * u)))
            .withColumn("charge_time_uncertainty", pct_text(pct)))


REGIME_COLS = {"time_min": "elapsed_minutes", "capacity_upper": "capacity_upper_bound",
               "capacity": "capacity", "capacity_lower": "capacity_lower_bound"}


def regime_breakdown(df: DataFrame, top: int = 10, keys: Sequence[str] = SERIES, position: str = "sample_id") -> DataFrame:
    """Per series and error class: median of the ``top`` largest minus median of the ``top``
    smallest time and capacities, and the time / capacity share of each class (percent).

    The ends of all columns come from one pass (``group_ends``); no rows are ranked.  ``position`` is a whole number
    unique within a series."""
    keys = list(keys)
    g = [*keys, "error_pc"]
    ends = group_ends(df.where(F.col("error_pc").isNotNull()), REGIME_COLS, top, g, position)
    r = ends.select(*g, *[(array_median(F.col(f"{out}_high")) - array_median(F.col(f"{out}_low"))).alias(out)
                          for out in REGIME_COLS])
    ws = Window.partitionBy(*keys)
    return (r.withColumn("time_pc", F.try_divide(F.col("time_min") * 100.0, F.sum("time_min").over(ws)))
            .withColumn("capacity_pc", F.try_divide(F.col("capacity") * 100.0, F.sum("capacity").over(ws))))
