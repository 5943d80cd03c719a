"""Charge step tables of dense charge series (constant-current steps + constant-voltage part).

Per series (doe, instance, cycle_num, charging_state_name), in ``order``:

1. ``cc_time`` ends the constant-current part: the first sample with ``cccv_state = 2``
   (``cc_end='state'``) or the last of the first 50 samples with any cell at or above
   4.20 V (``cc_end='cell_voltage'``).  A series without such a sample has no table.
2. Samples in ``[0, cc_time]`` with a current form the CC part; currents before minute 1
   take their median; the current is cleaned with the rolling outlier filter.
3. A new step starts where the cleaned current moves by more than ``current_threshold``.
   Neighbouring steps share the boundary sample (a step runs from its first sample to
   the first sample of the next step, both included).
4. Step boundaries in time are ``T_0 = 0``, ``T_{j+1} = T_j + length_j`` and, after the last
   step, the last sample time.  Each boundary interval ``[T_j, T_{j+1}]`` (closed) takes the
   max voltage and capacity of all samples of the series inside it; a step's min is the
   previous interval's max (the first valid sample for the first step).
5. A final ``cv`` row covers ``cc_time .. last sample``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packspark.operators.clean import rolling_outlier_replace

SERIES = ("doe", "instance", "cycle_num", "charging_state_name")
ORDER = ("elapsed_minutes", "sample_id")
CELLS = tuple(f"cell{i}_voltage_v" for i in range(1, 6))


def _series_frame(df, keys, order, cc_end, first_n_high, high_voltage):
    e = F.col("elapsed_minutes")
    ws = Window.partitionBy(*keys)
    if cc_end == "state":
        cc = F.min(F.when(F.col("cccv_state") == 2, e)).over(ws)
        d = df
    elif cc_end == "cell_voltage":
        hi = F.coalesce(F.greatest(*[F.col(c) for c in CELLS]) >= F.lit(float(high_voltage)), F.lit(False))
        d = df.withColumn("_ps_hi", hi)
        # rank among the high-voltage samples = running count of them (series window, so the
        # series partitioning is shared with every later stage)
        rk = F.sum(F.col("_ps_hi").cast("int")).over(
            Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        d = d.withColumn("_ps_rk", rk)
        cc = F.max(F.when(F.col("_ps_hi") & (F.col("_ps_rk") <= first_n_high), e)).over(ws)
    else:
        raise ValueError("cc_end must be 'state' or 'cell_voltage'")
    pos = F.struct(*[F.col(o) for o in order])

    def first_valid(c):
        # first non-null value in order, on the unordered series window (no extra sort)
        return F.min_by(F.col(c), F.when(F.col(c).isNotNull(), pos)).over(ws)

    return (d.withColumn("_ps_cc", cc).withColumn("_ps_tmax", F.max(e).over(ws))
            .withColumn("_ps_v0", first_valid("avg_voltage_v"))
            .withColumn("_ps_c0", first_valid("avail_battery_capacity_ah")))


def charge_steps(df: DataFrame, cc_end: str = "state", current_threshold: float = 1.0,
                 sigma_multiplier: float = 3.0, window: int = 200, state: str | None = "CHARGE",
                 min_step_minutes: float | None = 0.2, short_step_minutes: float = 1.0,
                 first_n_high: int = 50, high_voltage: float = 4.20, keys: Sequence[str] = SERIES,
                 order: Sequence[str] = ORDER, method: str = "auto", keep_series_end: bool = False) -> DataFrame:
    """Step table per series; see the module docstring.

    Output: keys, ``step`` (0-based), ``step_type`` (``'cc'``/``'cv'``),
    ``step_avg_current_a`` (NULL for cv), ``step_time_length_min``, ``min_avg_voltage_v``,
    ``max_avg_voltage_v``, ``min_capacity_ah``, ``max_capacity_ah``, ``short_step``.
    Rows with length ``<= min_step_minutes`` are dropped when it is given.

    Plan shape: one shuffle by series; every later window is partitioned by the series
    key (or a superset of it), so it reuses that partitioning.  Each sample fans out to a
    fixed number of tagged records (sample / step member / boundary / interval member),
    and a final aggregation per (series, step) builds the table - no joins, no pairs.
    """
    keys, order = list(keys), list(order)
    d = df if state is None else df.where(F.col("charging_state_name") == state)
    d = _series_frame(d, keys, order, cc_end, first_n_high, high_voltage)
    e = F.col("elapsed_minutes")
    ws = Window.partitionBy(*keys)

    # -- constant-current samples: clamp the first minute, clean, detect steps
    is_cc = F.coalesce(e.between(F.lit(0.0), F.col("_ps_cc")) & F.col("avg_current_a").isNotNull(), F.lit(False))
    d = d.withColumn("_ps_iscc", is_cc)
    early = F.col("_ps_iscc") & (e < 1.0)
    d = d.withColumn("_ps_cur", F.when(early, F.median(F.when(early, F.col("avg_current_a"))).over(ws))
                     .otherwise(F.col("avg_current_a")))
    ck = [*keys, "_ps_iscc"]
    # every later window is keyed by the series (or a superset of it): if the blocked filter
    # had to spread a huge series over tasks it restores the series partitioning once
    d = rolling_outlier_replace(d, "_ps_cur", ck, order, window, sigma_multiplier, out="_ps_clean", method=method,
                                restore_partitioning=keys)
    wc = Window.partitionBy(*ck).orderBy(*order)
    chg = F.coalesce(F.abs(F.col("_ps_clean") - F.lag("_ps_clean").over(wc)) > F.lit(float(current_threshold)),
                     F.lit(False))
    d = d.withColumn("_ps_chg", chg & F.col("_ps_iscc"))
    d = d.withColumn("_ps_sid", F.sum(F.col("_ps_chg").cast("int")).over(wc.rowsBetween(Window.unboundedPreceding, 0)))

    # -- records: 0 = sample, 1 = member of step sid, 2 = member of step sid-1 (shared boundary sample)
    rec = F.array_compact(F.array(F.lit(0), F.when(F.col("_ps_iscc"), F.lit(1)),
                                  F.when(F.col("_ps_chg"), F.lit(2))))
    d = d.withColumn("_ps_k", F.explode(rec))
    d = d.withColumn("step", F.when(F.col("_ps_k") == 1, F.col("_ps_sid"))
                     .when(F.col("_ps_k") == 2, F.col("_ps_sid") - 1).cast("int"))
    d = d.withColumn("_ps_ism", F.col("_ps_k") > 0)
    wstep = Window.partitionBy(*keys, "_ps_ism", "step")
    pos = F.struct(*[F.col(o) for o in order])
    d = (d.withColumn("_ps_med", F.median("_ps_clean").over(wstep))
         .withColumn("_ps_len", F.max(e).over(wstep) - F.min(e).over(wstep))
         # representative record of a step / first sample of a series: the smallest position
         # (order is unique per series), found on unordered windows without another sort
         .withColumn("_ps_rep", F.col("_ps_ism") & (pos == F.min(pos).over(wstep)))
         .withColumn("_ps_first", (F.col("_ps_k") == 0)
                     & (pos == F.min(F.when(F.col("_ps_k") == 0, pos)).over(ws)))
         .withColumn("_ps_m", F.coalesce(F.max(F.when(F.col("_ps_ism"), F.col("step"))).over(ws) + 1, F.lit(0))))
    wrep = Window.partitionBy(*keys, "_ps_rep").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_ps_T", F.when(F.col("_ps_rep"), F.coalesce(F.sum("_ps_len").over(wrep), F.lit(0.0))))

    # -- boundary records T_0..T_{m+1}: 10 = T_step, 11 = T_m after the last step,
    #    12 = last sample time (T_{m+1}), 13 = T_0 = 0 when there are no steps
    has_cc = F.col("_ps_cc").isNotNull()
    m = F.col("_ps_m")
    emit = F.array_compact(F.array(
        F.lit(0), F.when(F.col("_ps_rep"), F.lit(10)), F.when(F.col("_ps_rep") & (F.col("step") == m - 1), F.lit(11)),
        F.when(F.col("_ps_first") & has_cc, F.lit(12)), F.when(F.col("_ps_first") & has_cc & (m == 0), F.lit(13))))
    d = d.withColumn("_ps_emit", F.explode(emit))
    em = F.col("_ps_emit")
    d = (d.withColumn("_ps_j", F.when(em == 10, F.col("step")).when(em == 11, m).when(em == 12, m + 1)
                      .when(em == 13, F.lit(0)).cast("int"))
         .withColumn("_ps_pos", F.when(em == 10, F.col("_ps_T")).when(em == 11, F.col("_ps_T") + F.col("_ps_len"))
                     .when(em == 12, F.col("_ps_tmax")).when(em == 13, F.lit(0.0)).otherwise(e)))

    # -- each sample belongs to the closed intervals [T_j, T_{j+1}] containing it:
    #    a = last boundary index with T <= e, b = first with T >= e; intervals b-1 .. a
    #    (b runs over the reversed order: a frame that only grows is one pass over the series)
    wpos = Window.partitionBy(*keys).orderBy("_ps_pos")
    wrev = Window.partitionBy(*keys).orderBy(F.col("_ps_pos").desc())
    d = (d.withColumn("_ps_a", F.max("_ps_j").over(wpos.rangeBetween(Window.unboundedPreceding, 0)))
         .withColumn("_ps_b", F.min("_ps_j").over(wrev.rangeBetween(Window.unboundedPreceding, 0))))
    lo = F.greatest(F.col("_ps_b") - 1, F.lit(0))
    hi = F.least(F.col("_ps_a"), m)
    own = em == 0
    tag_t = "array<struct<j:int,kind:string>>"
    none = F.array().cast(tag_t)
    iv = F.when(own & (F.col("_ps_k") == 0) & has_cc & (lo <= hi),
                F.transform(F.sequence(lo, hi), lambda x: F.struct(x.alias("j"), F.lit("I").alias("kind")))
                ).otherwise(none)
    st = F.when(own & F.col("_ps_rep"), F.array(F.struct(F.col("step").alias("j"), F.lit("R").alias("kind")))
                ).otherwise(none)
    cv = F.when(own & F.col("_ps_first") & has_cc, F.array(F.struct(m.alias("j"), F.lit("C").alias("kind")))
                ).otherwise(none)
    d = d.withColumn("_ps_t", F.explode(F.concat(iv, st, cv)))
    kind, j = F.col("_ps_t.kind"), F.col("_ps_t.j")
    g = (d.groupBy(*keys, j.alias("step"))
         .agg(F.max(F.when(kind == "I", F.col("avg_voltage_v"))).alias("max_avg_voltage_v"),
              F.max(F.when(kind == "I", F.col("avail_battery_capacity_ah"))).alias("max_capacity_ah"),
              F.max(F.when(kind == "R", F.col("_ps_med"))).alias("step_avg_current_a"),
              F.max(F.when(kind == "R", F.col("_ps_len"))
                    .when(kind == "C", F.col("_ps_tmax") - F.col("_ps_cc"))).alias("step_time_length_min"),
              F.max(F.when(kind == "R", F.lit("cc")).when(kind == "C", F.lit("cv"))).alias("step_type"),
              F.max(F.when(kind == "C", F.col("_ps_v0"))).alias("_ps_v0"),
              F.max(F.when(kind == "C", F.col("_ps_c0"))).alias("_ps_c0"),
              F.max(F.when(kind == "C", F.col("_ps_tmax"))).alias("_ps_end")))
    g = g.where(F.col("step_type").isNotNull())
    rw = Window.partitionBy(*keys).orderBy("step")
    sv = Window.partitionBy(*keys)
    res = (g.withColumn("min_avg_voltage_v", F.when(F.col("step") == 0, F.max("_ps_v0").over(sv))
                        .otherwise(F.lag("max_avg_voltage_v").over(rw)))
           .withColumn("min_capacity_ah", F.when(F.col("step") == 0, F.max("_ps_c0").over(sv))
                       .otherwise(F.lag("max_capacity_ah").over(rw)))
           .withColumn("short_step", F.col("step_time_length_min") < F.lit(float(short_step_minutes)))
           .withColumn("charge_time", F.max("_ps_end").over(sv)))
    if min_step_minutes is not None:
        res = res.where(F.col("step_time_length_min") > F.lit(float(min_step_minutes)))
    out = [*keys, "step", "step_type", "step_avg_current_a", "step_time_length_min",
           "min_avg_voltage_v", "max_avg_voltage_v", "min_capacity_ah", "max_capacity_ah", "short_step"]
    return res.select(*out, *(["charge_time"] if keep_series_end else []))


def charge_steps_state(df: DataFrame, **kw) -> DataFrame:
    """Variant with the CC end at the first constant-voltage sample (threshold 1.0 A, window 200)."""
    kw.setdefault("current_threshold", 1.0)
    kw.setdefault("window", 200)
    return charge_steps(df, cc_end="state", **kw)


def charge_steps_voltage(df: DataFrame, **kw) -> DataFrame:
    """Variant with the CC end from the cell voltages (threshold 0.6 A, window 300, no length filter)."""
    kw.setdefault("current_threshold", 0.6)
    kw.setdefault("window", 300)
    kw.setdefault("min_step_minutes", None)
    return charge_steps(df, cc_end="cell_voltage", **kw)


def step_reconcile(steps: DataFrame, samples: DataFrame | None = None, state: str | None = "CHARGE",
                   keys: Sequence[str] = SERIES) -> DataFrame:
    """Σ step lengths per series next to the last sample time; ``difference`` should be ~0.

    The last sample time comes from ``samples``, or, when they are not given, from the
    ``charge_time`` column of a step table built with ``keep_series_end=True`` (one pass).
    """
    keys = list(keys)
    if samples is None:
        return (steps.groupBy(*keys).agg(F.sum("step_time_length_min").alias("charge_time_steps"),
                                         F.max("charge_time").alias("charge_time"))
                .withColumn("difference", F.col("charge_time_steps") - F.col("charge_time")))
    s = samples if state is None else samples.where(F.col("charging_state_name") == state)
    raw = s.groupBy(*keys).agg(F.max("elapsed_minutes").alias("charge_time"))
    tot = steps.groupBy(*keys).agg(F.sum("step_time_length_min").alias("charge_time_steps"))
    return (tot.join(raw, on=keys, how="inner")
            .withColumn("difference", F.col("charge_time_steps") - F.col("charge_time")))
