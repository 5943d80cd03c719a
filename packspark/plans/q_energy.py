"""Registered queries: discharge energy, cleaning, reference-test statistics, trend, jumps."""

from __future__ import annotations

from pyspark.sql import functions as F

from packspark.functions.columns import safe_div, second_row
from packspark.operators import clean as cl
from packspark.operators import energy as en
from packspark.operators import trend as tr
from packspark.operators.ttest import welch_stats, welch_ttest
from packspark.plans import adapters as ad
from packspark.plans import sqltext as sq
from packspark.plans.registry import RPT, register
from packspark.plans.sqltext import K, lit, w1

KC = "doe_number:s, instance_number:s"
SKEY = "doe, instance, cycle_num, charging_state_name"
ROV_ORDER = "elapsed_minutes, sample_id"
W = sq.with_

# ------------------------------------------------------------------ T1 discharge energy
ENERGY_COLS = (KC + ", cycle:i, raw_discharge_energy:d, adjusted_raw_discharge_energy:d, discharge_energy:d, "
               "mean_energy:d, std_energy:d, lower_energy_bound:d, norm_discharge_energy:d, norm_mean_energy:d, "
               "norm_lower_energy:d")


@register("discharge_energy", ENERGY_COLS, W(ad.CYCLE_SQL, sq.discharge_energy_ctes(7, 0.1)) + "\nSELECT * FROM energy",
          ids=["T1", "A1", "W5", "W1", "A2", "A3", "W4", "E2"])
def q_discharge_energy(spark, sf):
    return en.discharge_energy(ad.cycle_view(spark, sf), window=7, sigma_multiplier=0.1)


# ------------------------------------------------------------------ W1 rolling outlier replacement
@register("rolling_outlier_w5", KC + ", cycle:i, energy:d, energy_clean:d",
          W(ad.CYCLE_SQL) + f"""
SELECT doe_number, instance_number, cycle, energy, {w1('energy', K, 'cycle', 5, 0.1)} AS energy_clean
FROM cyc WHERE cycling_substate = 'DISCHARGE'""", ids=["W1", "W2", "P8"])
def q_rolling_w5(spark, sf):
    d = ad.cycle_view(spark, sf).where(F.col("cycling_substate") == "DISCHARGE") \
        .select("doe_number", "instance_number", "cycle", "energy")
    return cl.rolling_outlier_replace(d, "energy", ["doe_number", "instance_number"], "cycle", 5, 0.1,
                                      out="energy_clean")


SERIES_W_COLS = ("doe:s, instance:s, cycle_num:i, charging_state_name:s, sample_id:l, elapsed_minutes:d, "
                "avg_current_a:d, current_clean:d")


def _series_w1_sql(window, k):
    return W(ad.SERIES_SQL) + f"""
SELECT doe, instance, cycle_num, charging_state_name, sample_id, elapsed_minutes, avg_current_a,
       {w1('avg_current_a', SKEY, ROV_ORDER, window, k)} AS current_clean
FROM samples"""


def _series_w1(spark, sf, window, k, method):
    d = ad.series_view(spark, sf).select("doe", "instance", "cycle_num", "charging_state_name", "sample_id",
                                        "elapsed_minutes", "avg_current_a")
    return cl.rolling_outlier_replace(d, "avg_current_a", ["doe", "instance", "cycle_num", "charging_state_name"],
                                      ["elapsed_minutes", "sample_id"], window, k, out="current_clean", method=method)


@register("rolling_outlier_w7", SERIES_W_COLS, _series_w1_sql(7, 0.5), ids=["W1", "W2"])
def q_rolling_w7(spark, sf):
    return _series_w1(spark, sf, 7, 0.5, "native")


@register("rolling_outlier_wide", SERIES_W_COLS, _series_w1_sql(100, 3.0), ids=["W1"])
def q_rolling_wide(spark, sf):
    return _series_w1(spark, sf, 100, 3.0, "auto")


@register("rolling_outlier_blocked", KC + ", cycle:i, energy:d, energy_clean:d",
          W(ad.CYCLE_SQL) + f"""
SELECT doe_number, instance_number, cycle, energy, {w1('energy', K, 'cycle', 25, 0.1)} AS energy_clean
FROM cyc WHERE cycling_substate = 'DISCHARGE'""", ids=["W1"])
def q_rolling_blocked(spark, sf):
    d = ad.cycle_view(spark, sf).where(F.col("cycling_substate") == "DISCHARGE") \
        .select("doe_number", "instance_number", "cycle", "energy")
    return cl.rolling_outlier_replace(d, "energy", ["doe_number", "instance_number"], "cycle", 25, 0.1,
                                      out="energy_clean", method="blocked", block_rows=32)


# ------------------------------------------------------------------ W4 / W5 / W3
@register("norm_second_row", KC + ", cycle:i, energy:d, norm_energy:d",
          W(ad.CYCLE_SQL) + f"""
SELECT doe_number, instance_number, cycle, energy, energy / nullif({sq.second('energy')}, 0) AS norm_energy
FROM cyc WHERE cycling_substate = 'DISCHARGE'""", ids=["W4", "N9"])
def q_norm_second(spark, sf):
    d = ad.cycle_view(spark, sf).where(F.col("cycling_substate") == "DISCHARGE") \
        .select("doe_number", "instance_number", "cycle", "energy")
    return d.withColumn("norm_energy", safe_div("energy", second_row("energy", ["doe_number", "instance_number"],
                                                                     ["cycle"])))


@register("early_cycle_adjust", KC + ", cycle:i, raw_discharge_energy:d, adjusted_raw_discharge_energy:d",
          W(ad.CYCLE_SQL, sq.raw_energy_cte("cyc", "e_raw"), sq.early_cte("e_raw", "e_adj"))
          + "\nSELECT * FROM e_adj", ids=["W5", "A1"])
def q_early(spark, sf):
    return en.discharge_energy(ad.cycle_view(spark, sf), raw=True)


@register("early_cycle_seeded", KC + ", cycle:i, raw_discharge_energy:d, adjusted_raw_discharge_energy:d",
          W(ad.CYCLE_SQL, sq.raw_energy_cte("cyc", "e_raw"), sq.early_cte("e_raw", "e_adj", seed=7))
          + "\nSELECT * FROM e_adj", ids=["W5", "A1"])
def q_early_seeded(spark, sf):
    return en.discharge_energy(ad.cycle_view(spark, sf), raw=True, early_mode="seeded", seed=7)


def seg_ctes(rpt=RPT, window=5, k=0.1):
    return f"""{sq.raw_energy_cte('cyc', 's_raw')},
{sq.early_cte('s_raw', 's_adj')},
s_n0 AS (
  SELECT *, adjusted_raw_discharge_energy / nullif({sq.second('adjusted_raw_discharge_energy')}, 0) AS nde,
         CASE WHEN cycle < {rpt - 1} THEN 0 WHEN cycle <= {rpt} THEN 1 ELSE 2 END AS seg
  FROM s_adj),
seg AS (
  SELECT doe_number, instance_number, cycle, adjusted_raw_discharge_energy,
         CASE WHEN seg = 1 THEN nde ELSE {w1('nde', K + ', seg', 'cycle', window, k)} END AS norm_discharge_energy
  FROM s_n0)"""


@register("segment_clean", KC + ", cycle:i, adjusted_raw_discharge_energy:d, norm_discharge_energy:d",
          W(ad.CYCLE_SQL, seg_ctes()) + "\nSELECT * FROM seg", ids=["W3", "W4"])
def q_segment(spark, sf):
    return en.rpt_normalised(ad.cycle_view(spark, sf), rpt_cycle=RPT, window=5, sigma_multiplier=0.1) \
        .select("doe_number", "instance_number", "cycle", "adjusted_raw_discharge_energy", "norm_discharge_energy")


# ------------------------------------------------------------------ T3 / T4 / A8 / T2
def _between(lo, hi):
    return f"(cycle >= {lo} AND cycle < {hi})"


def _sets(n, a=0):
    b, af = en.rpt_cycle_sets(RPT, n, a)
    return _between(*b), _between(*af), b, af


STATS_COLS = "doe_number:s, cycle:i, min:d, avg:d, max:d, std:d, cv_pc:d, sample_size:l"
_b3, _a3, _, _ = _sets(3)


@register("rpt_statistics", STATS_COLS, W(ad.CYCLE_SQL, seg_ctes()) + f"""
SELECT doe_number, cycle, min(norm_discharge_energy) AS "min", avg(norm_discharge_energy) AS "avg",
       max(norm_discharge_energy) AS "max", stddev_samp(norm_discharge_energy) AS std,
       CASE WHEN avg(norm_discharge_energy) > 0 THEN stddev_samp(norm_discharge_energy) * 100.0 / avg(norm_discharge_energy)
            ELSE 'inf'::DOUBLE END AS cv_pc,
       count(*) AS sample_size
FROM seg WHERE {_b3} OR {_a3}
GROUP BY doe_number, cycle""", ids=["T3", "A4", "P3"])
def q_rpt_stats(spark, sf):
    return en.rpt_statistics(ad.cycle_view(spark, sf), rpt_cycle=RPT, neighbors_cycle=3)


GAIN_COLS = (KC + ", rpt_cycle:i, avg_energy_before:d, median_energy_before:d, std_energy_before:d, "
             "avg_energy_after:d, median_energy_after:d, std_energy_after:d, gain_in_energy:d, gain_in_cycle:i, "
             "gain_in_energy_pc:d")
_b5, _a5, _rb5, _ra5 = _sets(5)


def gain_ctes():
    x = "norm_discharge_energy"
    return f"""{seg_ctes()},
g0 AS (SELECT *, avg(CASE WHEN {_b5} THEN {x} END) OVER (PARTITION BY {K}) AS avg_b FROM seg),
g_close AS (
  SELECT doe_number, instance_number, cycle AS close_cycle FROM (
    SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY abs({x} - avg_b), cycle) AS rn
    FROM g0 WHERE cycle > {_ra5[0]} AND {x} IS NOT NULL AND avg_b IS NOT NULL) WHERE rn = 1),
g_agg AS (
  SELECT doe_number, instance_number,
    avg(CASE WHEN {_b5} THEN {x} END) AS avg_energy_before, median(CASE WHEN {_b5} THEN {x} END) AS median_energy_before,
    stddev_samp(CASE WHEN {_b5} THEN {x} END) AS std_energy_before,
    avg(CASE WHEN {_a5} THEN {x} END) AS avg_energy_after, median(CASE WHEN {_a5} THEN {x} END) AS median_energy_after,
    stddev_samp(CASE WHEN {_a5} THEN {x} END) AS std_energy_after,
    count(CASE WHEN {_a5} THEN 1 END) AS n_after
  FROM g0 GROUP BY doe_number, instance_number),
gain AS (
  SELECT g_agg.*, {RPT} AS rpt_cycle, median_energy_after - median_energy_before AS gain_in_energy,
         CASE WHEN n_after > 0 THEN close_cycle - {_rb5[1] - 1} END AS gain_in_cycle,
         (median_energy_after - median_energy_before) * 100.0 / nullif(median_energy_before, 0) AS gain_in_energy_pc
  FROM g_agg LEFT JOIN g_close USING (doe_number, instance_number))"""


@register("rpt_gain", GAIN_COLS, W(ad.CYCLE_SQL, gain_ctes()) + "\nSELECT * FROM gain",
          ids=["T4", "A5", "A6", "A7", "J7", "O5"])
def q_rpt_gain(spark, sf):
    return en.rpt_gain(ad.cycle_view(spark, sf), rpt_cycle=RPT, neighbors_cycle=5)


@register("gain_corr", "pearson_r:d, n_pairs:l", W(ad.CYCLE_SQL, gain_ctes()) + """
SELECT corr(gain_in_energy_pc, CAST(gain_in_cycle AS DOUBLE)) AS pearson_r,
       count(CASE WHEN gain_in_energy_pc IS NOT NULL AND gain_in_cycle IS NOT NULL THEN 1 END) AS n_pairs
FROM gain""", ids=["A8"])
def q_gain_corr(spark, sf):
    return en.gain_correlation(en.rpt_gain(ad.cycle_view(spark, sf), rpt_cycle=RPT, neighbors_cycle=5))


TT_COLS = "doe_number:s, n1:l, mean1:d, var1:g, n2:l, mean2:d, var2:g, T:d, dof:d, cohen_d:d"


WELCH_CTE = f"""tt AS (
  SELECT doe_number,
    count(CASE WHEN {_a3} THEN norm_discharge_energy END) AS n1, avg(CASE WHEN {_a3} THEN norm_discharge_energy END) AS mean1,
    var_samp(CASE WHEN {_a3} THEN norm_discharge_energy END) AS var1,
    count(CASE WHEN {_b3} THEN norm_discharge_energy END) AS n2, avg(CASE WHEN {_b3} THEN norm_discharge_energy END) AS mean2,
    var_samp(CASE WHEN {_b3} THEN norm_discharge_energy END) AS var2
  FROM seg GROUP BY doe_number),
welch AS (
SELECT *, CASE WHEN n1 > 1 AND n2 > 1 THEN (mean1 - mean2) / nullif(sqrt(var1 / n1 + var2 / n2), 0) END AS "T",
  CASE WHEN n1 > 1 AND n2 > 1 THEN (var1 / n1 + var2 / n2) * (var1 / n1 + var2 / n2)
       / nullif((var1 / n1) * (var1 / n1) / (n1 - 1) + (var2 / n2) * (var2 / n2) / (n2 - 1), 0) END AS dof,
  abs(CASE WHEN n1 > 1 AND n2 > 1 THEN (mean1 - mean2)
       / nullif(sqrt(((n1 - 1) * var1 + (n2 - 1) * var2) / (n1 + n2 - 2)), 0) END) AS cohen_d
FROM tt)"""


@register("welch_ttest", TT_COLS, W(ad.CYCLE_SQL, seg_ctes(), WELCH_CTE) + "\nSELECT * FROM welch", ids=["T2"])
def q_welch(spark, sf):
    s = en.rpt_samples(ad.cycle_view(spark, sf), rpt_cycle=RPT, neighbors_cycle=3)
    return welch_stats(s, "norm_discharge_energy", "sample", "after", "before", by=["doe_number"])


def t_newton_ctes(name, dof, tail, steps=14):
    """Chain of CTEs whose last, ``name``, has the t with upper tail ``tail`` of each row of ``welch``.  The tail is
    Simpson's rule over the angle atan(t / sqrt(dof)) up to a right angle, where the density is a power of the cosine."""
    out = [f"{name}0 AS (SELECT doe_number, {dof} AS nu, {lit(0.0)} AS q, lgamma(({dof}) / 2 + 0.5) - lgamma(({dof}) / 2) "
           f"- 0.5 * ln(pi()) AS c FROM welch WHERE \"T\" IS NOT NULL)"]
    for k in range(steps):
        end = name if k == steps - 1 else f"{name}{k + 1}"
        out.append(f"{end} AS MATERIALIZED (SELECT doe_number, nu, c, q + ({t_tail_sql('q', 'nu', 'c')} - {lit(tail)}) "
                   f"/ exp(c - 0.5 * ln(nu) - (nu + 1) / 2 * ln(1 + q * q / nu)) AS q FROM {name}{k})")
    return ",\n".join(out)


def t_tail_sql(t, nu, c, n=4000):
    low = f"atan({t} / sqrt({nu}))"
    h = f"((pi() / 2 - {low}) / {n})"
    return (f"({h} / 3 * list_sum(list_transform(range(0, {n}), lambda k: (CASE WHEN k = 0 THEN 1 ELSE 2 + 2 * (k % 2) END) "
            f"* exp({c} + ({nu} - 1) * ln(cos({low} + k * {h}))))))")


# The non-central tail at the critical value is alpha at shift 0 and rises with the shift by the mean of the normal density
# at shift - t v, so it's a double sum: Simpson's rule over the shift (the density ends within 3 t + 9), a trapezoid over s = log v.
WELCH_FULL_CTES = f"""tail AS (
  SELECT w.*, se, d / sqrt(1.0::DOUBLE / n1 + 1.0::DOUBLE / n2) AS shift, n1 + n2 - 2.0::DOUBLE AS pooled,
         (n1 * n2)::DOUBLE / (n1 + n2) AS n, lgamma(dof / 2 + 0.5) - lgamma(dof / 2) - 0.5 * ln(pi()) AS c
  FROM (SELECT *, sqrt(var1 / n1 + var2 / n2) AS se,
               (mean1 - mean2) / sqrt(((n1 - 1) * var1 + (n2 - 1) * var2) / (n1 + n2 - 2)) AS d
        FROM welch WHERE "T" IS NOT NULL) AS w),
{t_newton_ctes('qc', 'dof', 0.05)},
{t_newton_ctes('qa', 'n1 + n2 - 2.0::DOUBLE', 0.05)},
grid AS (SELECT k FROM range(0, 1001) AS g(k)),
pow1 AS (
  SELECT doe_number, shift, q, pooled, s, h * exp(ln(2.0) + pooled / 2 * ln(pooled / 2) - lgamma(pooled / 2) + pooled * s
                                                  - pooled / 2 * exp(2 * s)) AS w
  FROM (SELECT doe_number, shift, q, pooled, h, -(9 / sqrt(2 * pooled) + 20 / pooled) + h * k AS s
        FROM (SELECT *, (18 / sqrt(2 * pooled) + 20 / pooled) / 1000 AS h FROM tail JOIN qa USING (doe_number)) CROSS JOIN grid)),
pow AS (
  SELECT doe_number, 0.05 + sum(w * u / 3000 * (CASE WHEN k IN (0, 1000) THEN 1 ELSE 2 + 2 * (k % 2) END)
                                * exp(-0.5 * pow(u * k / 1000 - q * exp(s), 2)) / sqrt(2 * pi())) AS power
  FROM (SELECT *, greatest(-9 - 3 * q, least(9 + 3 * q, shift)) AS u FROM pow1) CROSS JOIN grid GROUP BY doe_number),
bay AS (
  SELECT doe_number, 2 * sum(0.04 * exp(-0.5 * ln(a) + (pooled + 1) / 2 * (ln(1 + "T" * "T" / pooled) - ln(1 + "T" * "T" / (a * pooled)))
                                        - 0.5 * ln(2 * pi()) - 0.5 * s - 0.5 * exp(-s))) AS b
  FROM (SELECT doe_number, "T", pooled, s, 1 + n * exp(s) * 0.707 * 0.707 AS a
        FROM (SELECT *, -20 + 0.04 * k::DOUBLE AS s FROM tail CROSS JOIN grid)) GROUP BY doe_number),
full_test AS (
  SELECT t.*, CASE WHEN "T" >= 0 THEN {t_tail_sql('abs("T")', 'dof', 't.c', 40000)} ELSE 1 - {t_tail_sql('abs("T")', 'dof', 't.c', 40000)} END AS p_val,
         ("T" - qc.q) * se AS ci95_low, 'inf'::DOUBLE AS ci95_high, power,
         CASE WHEN "T" < 0 AND b > 1 THEN 1 / b ELSE b END AS bf10
  FROM tail AS t JOIN qc USING (doe_number) JOIN pow USING (doe_number) JOIN bay USING (doe_number))"""


@register("welch_ttest_full", TT_COLS + ", p_val:g, ci95_low:g, ci95_high:d, power:g, bf10:g, alternative:s, "
          "significance:s, bayes_support:s, effect_size:s, power_reading:s",
          W(ad.CYCLE_SQL, seg_ctes(), WELCH_CTE, WELCH_FULL_CTES) + """
SELECT w.*, p_val, ci95_low, ci95_high, power, bf10, 'greater' AS alternative,
  CASE WHEN p_val < 0.05 THEN 'statistically significant' WHEN p_val >= 0.05 THEN 'not statistically significant' END AS significance,
  CASE WHEN bf10 >= 1 THEN 'change' WHEN bf10 < 1 THEN 'no change' END AS bayes_support,
  CASE WHEN w.cohen_d < 0.2 THEN 'a very small impact' WHEN w.cohen_d < 0.5 THEN 'a small impact'
       WHEN w.cohen_d < 0.8 THEN 'a moderate impact' WHEN w.cohen_d >= 0.8 THEN 'a substantial impact' END AS effect_size,
  CASE WHEN power >= 0.8 THEN 'detects a true difference' WHEN power < 0.8 THEN 'might not detect a true difference' END
    AS power_reading
FROM welch AS w LEFT JOIN full_test USING (doe_number)""", ids=["T2", "F13"])
def q_welch_full(spark, sf):
    s = en.rpt_samples(ad.cycle_view(spark, sf), rpt_cycle=RPT, neighbors_cycle=3)
    return welch_ttest(s, "norm_discharge_energy", "sample", "after", "before", by=["doe_number"],
                       alternative="greater")


# ------------------------------------------------------------------ T32 / T25 / T26 / T27 / T33
def jump_ctes(thr=0.2, start=2, closest=3, n=5):
    return f"""{sq.discharge_energy_ctes(7, 0.1)},
j1 AS (
  SELECT doe_number, instance_number, cycle, norm_discharge_energy AS x,
         coalesce(abs(norm_discharge_energy / nullif(lag(norm_discharge_energy) OVER (PARTITION BY {K} ORDER BY cycle), 0)
                       - 1.0) > {lit(thr / 100.0)}, false) AND cycle >= {start} AS cand
  FROM energy),
j2 AS (
  SELECT *, min(CASE WHEN cand THEN cycle END) OVER (PARTITION BY {K} ORDER BY cycle
                                                     ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt,
         list(x ORDER BY cycle) OVER (PARTITION BY {K} ORDER BY cycle RANGE BETWEEN 2 PRECEDING AND {n} FOLLOWING) AS near
  FROM j1),
j3 AS (
  SELECT *, cand AND (nxt IS NULL OR nxt - cycle >= {closest}) AS keep FROM j2),
j4 AS (
  SELECT *, CASE WHEN keep THEN (CASE WHEN len(near) > 1 THEN list_max(near[2:]) - near[1] ELSE 0.0 END)
                 ELSE 0.0 END AS L FROM j3),
j5 AS (SELECT *, sum(L) OVER (PARTITION BY {K} ORDER BY cycle ROWS UNBOUNDED PRECEDING) AS S FROM j4),
jumps AS (SELECT *, x - S AS out_x, lag(x - S) OVER (PARTITION BY {K} ORDER BY cycle) AS prev_out FROM j5)"""


def screened_ctes(min_last=30, dejump=False):
    src = "energy"
    pre = sq.discharge_energy_ctes(7, 0.1)
    if dejump:
        pre = jump_ctes() + """,
dejumped AS (SELECT doe_number, instance_number, cycle, out_x AS norm_discharge_energy FROM jumps)"""
        src = "dejumped"
    return f"""{pre},
scr0 AS (
  SELECT doe_number, instance_number, cycle, norm_discharge_energy AS x,
         min(norm_discharge_energy) OVER (PARTITION BY {K}) AS mn, max(norm_discharge_energy) OVER (PARTITION BY {K}) AS mx,
         max(cycle) OVER (PARTITION BY {K}) AS mc
  FROM {src}),
screened AS (
  SELECT doe_number, instance_number, cycle, {w1('x', K, 'cycle', 7, 0.015)} AS norm_discharge_energy
  FROM scr0 WHERE mn > {lit(0.64)} AND mx < {lit(1.05)} AND mc > {min_last})"""


def _screened(spark, sf, dejump=False):
    e = en.discharge_energy(ad.cycle_view(spark, sf), 7, 0.1).select(
        "doe_number", "instance_number", "cycle", "norm_discharge_energy")
    if dejump:
        e = tr.energy_jump_removed(e)
    s = cl.group_screen(e, ["doe_number", "instance_number"], min_last_order=30)
    return cl.rolling_outlier_replace(s, "norm_discharge_energy", ["doe_number", "instance_number"], "cycle", 7, 0.015)


@register("group_screen", KC + ", cycle:i, norm_discharge_energy:d",
          W(ad.CYCLE_SQL, screened_ctes()) + "\nSELECT * FROM screened", ids=["T32", "P13"])
def q_screen(spark, sf):
    return _screened(spark, sf)


FIT_COLS = KC + ", slope:d, intercept:d, r2_score:d, n_points:l, target_cycle:i, best_degree:i"


def fit_ctes(dejump=False):
    return f"""{screened_ctes(dejump=dejump)},
fit0 AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY cycle DESC) AS rn FROM screened),
fit AS (
  SELECT doe_number, instance_number, regr_slope(norm_discharge_energy, CAST(cycle AS DOUBLE)) AS slope,
         regr_intercept(norm_discharge_energy, CAST(cycle AS DOUBLE)) AS intercept,
         regr_r2(norm_discharge_energy, CAST(cycle AS DOUBLE)) AS r2_score, count(norm_discharge_energy) AS n_points
  FROM fit0 WHERE rn <= 30 GROUP BY doe_number, instance_number),
fitted AS (
  SELECT *, CASE WHEN slope <> 0 THEN TRY_CAST(trunc(({lit(0.64)} - intercept) / slope) AS INTEGER) END AS target_cycle,
         1 AS best_degree FROM fit)"""


def _fits(spark, sf):
    return tr.fade_target_cycle(_screened(spark, sf), 0.64, 30)


@register("fade_target_cycle", FIT_COLS, W(ad.CYCLE_SQL, fit_ctes()) + "\nSELECT * FROM fitted",
          ids=["T25", "A23", "W12"])
def q_fit(spark, sf):
    return _fits(spark, sf)


@register("extrapolation_segments", KC + ", start_cycle:i, start_energy:d, end_cycle:i, end_energy:d, r2_score:d",
          W(ad.CYCLE_SQL, fit_ctes(dejump=True)) + f"""
, good AS (SELECT * FROM fitted WHERE r2_score > {lit(0.9)})
SELECT s.doe_number, s.instance_number, max(s.cycle) - 5 AS start_cycle,
       arg_max(s.norm_discharge_energy, s.cycle) AS start_energy, any_value(g.target_cycle) AS end_cycle,
       {lit(0.64)} AS end_energy, any_value(g.r2_score) AS r2_score
FROM screened s JOIN good g USING (doe_number, instance_number)
GROUP BY s.doe_number, s.instance_number""", ids=["T26", "J3", "A21", "E8"])
def q_segments(spark, sf):
    # level jumps removed first (T27), so the fade trend is fitted on a continuous series
    return tr.fit_segments(_screened(spark, sf, dejump=True), 0.64, 30, 0.90)


def _energy_norm(spark, sf):
    return en.discharge_energy(ad.cycle_view(spark, sf), 7, 0.1).select(
        "doe_number", "instance_number", "cycle", "norm_discharge_energy")


@register("energy_jump_removed", KC + ", cycle:i, norm_discharge_energy:d",
          W(ad.CYCLE_SQL, jump_ctes()) + "\nSELECT doe_number, instance_number, cycle, out_x AS norm_discharge_energy FROM jumps",
          ids=["T27", "W7", "W11", "J10"])
def q_jumps_removed(spark, sf):
    return tr.energy_jump_removed(_energy_norm(spark, sf))


@register("energy_jump_details", KC + ", cycle:i, energy:d, jump_energy_pct:d, jump_length:d",
          W(ad.CYCLE_SQL, jump_ctes()) + """
SELECT doe_number, instance_number, cycle, x - (S - L) AS energy,
       abs((x - (S - L)) / nullif(prev_out, 0) - 1.0) * 100.0 AS jump_energy_pct, L AS jump_length
FROM jumps WHERE keep""", ids=["T27"])
def q_jumps_details(spark, sf):
    return tr.energy_jump_details(_energy_norm(spark, sf))


@register("overlay_test_reference", KC + ", cycle:i, norm_discharge_energy:d, norm_mean_energy:d, norm_lower_energy:d, role:s",
          W(ad.CYCLE_SQL, "test_rows AS (SELECT * FROM cyc WHERE doe_number = 'A')",
            sq.discharge_energy_ctes(7, 0.1, "test_rows", "te"),
            "ref_rows AS (SELECT * FROM cyc WHERE doe_number = 'R')",
            sq.discharge_energy_ctes(7, 0.1, "ref_rows", "re")) + """
SELECT doe_number, instance_number, cycle, norm_discharge_energy, NULL AS norm_mean_energy, NULL AS norm_lower_energy,
       'test' AS role FROM te
UNION ALL
SELECT doe_number, instance_number, cycle, NULL, norm_mean_energy, norm_lower_energy, 'reference' FROM re""",
          ids=["T33", "U1", "E6"])
def q_overlay(spark, sf):
    c = ad.cycle_view(spark, sf)
    return en.overlay_test_reference(c.where(F.col("doe_number") == "A"), c.where(F.col("doe_number") == "R"))


@register("sigma_band_filter", KC + ", cycle:i, energy:d", W(ad.CYCLE_SQL) + f"""
SELECT doe_number, instance_number, cycle, energy FROM (
  SELECT *, median(energy) OVER (PARTITION BY {K}) AS md, stddev_pop(energy) OVER (PARTITION BY {K}) AS sd
  FROM cyc WHERE cycling_substate = 'DISCHARGE')
WHERE energy >= md - {lit(1.0)} * sd AND energy <= md + {lit(1.0)} * sd""", ids=["A13"])
def q_sigma_band(spark, sf):
    d = ad.cycle_view(spark, sf).where(F.col("cycling_substate") == "DISCHARGE") \
        .select("doe_number", "instance_number", "cycle", "energy")
    return cl.sigma_band_filter(d, "energy", ["doe_number", "instance_number"], 1.0, ddof=0)


@register("energy_jump_wide_spacing", KC + ", cycle:i, energy:d, jump_energy_pct:d, jump_length:d",
          W(ad.CYCLE_SQL, jump_ctes(0.1, 10, 50, 5)) + """
SELECT doe_number, instance_number, cycle, x - (S - L) AS energy,
       abs((x - (S - L)) / nullif(prev_out, 0) - 1.0) * 100.0 AS jump_energy_pct, L AS jump_length
FROM jumps WHERE keep""", ids=["T27", "E9"])
def q_jumps_wide(spark, sf):
    return tr.energy_jump_details(_energy_norm(spark, sf), 0.1, 10, 50, 5)


@register("energy_jump_adjacent", KC + ", cycle:i, norm_discharge_energy:d, jump_length:d",
          "WITH RECURSIVE " + W(ad.CYCLE_SQL, jump_ctes(0.1, 2, 1, 5)).lstrip()[4:].lstrip() + """,
ord AS (SELECT *, row_number() OVER (PARTITION BY doe_number, instance_number ORDER BY cycle) AS k,
          coalesce(lag(cycle) OVER s = cycle - 1 AND lag(keep) OVER s, false) AND min(cycle) OVER n = cycle - 2 AS after
        FROM jumps WINDOW s AS (PARTITION BY doe_number, instance_number ORDER BY cycle),
          n AS (PARTITION BY doe_number, instance_number ORDER BY cycle RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)),
fold AS (
  SELECT doe_number, instance_number, k, cycle, x, keep, CAST(L AS DOUBLE) AS own, CAST(L AS DOUBLE) AS shift FROM ord WHERE k = 1
  UNION ALL
  SELECT o.doe_number, o.instance_number, o.k, o.cycle, o.x, o.keep,
         CASE WHEN o.keep AND o.after THEN o.L - f.own ELSE o.L END,
         f.shift + CASE WHEN o.keep AND o.after THEN o.L - f.own ELSE o.L END
  FROM fold f JOIN ord o ON o.doe_number = f.doe_number AND o.instance_number = f.instance_number AND o.k = f.k + 1)
SELECT doe_number, instance_number, cycle, x - shift AS norm_discharge_energy, own AS jump_length FROM fold""", ids=["T27", "W7", "W11"])
def q_jumps_adjacent(spark, sf):
    """Jumps of neighbouring cycles all count; the twin folds the rows of a series one after the other."""
    e = _energy_norm(spark, sf)
    keys = ["doe_number", "instance_number", "cycle"]
    out = tr.energy_jump_removed(e, 0.1, 2, 1, 5)
    own = tr.energy_jump_details(e, 0.1, 2, 1, 5).select(*keys, "jump_length")
    return out.join(own, keys, "left").fillna(0.0, ["jump_length"])


@register("welch_ttest_pooled", "n1:l, mean1:d, var1:g, n2:l, mean2:d, var2:g, T:d, dof:d, cohen_d:d",
          W(ad.CYCLE_SQL, seg_ctes()) + f"""
, tt AS (
  SELECT count(CASE WHEN {_a3} THEN norm_discharge_energy END) AS n1,
         avg(CASE WHEN {_a3} THEN norm_discharge_energy END) AS mean1,
         var_samp(CASE WHEN {_a3} THEN norm_discharge_energy END) AS var1,
         count(CASE WHEN {_b3} THEN norm_discharge_energy END) AS n2,
         avg(CASE WHEN {_b3} THEN norm_discharge_energy END) AS mean2,
         var_samp(CASE WHEN {_b3} THEN norm_discharge_energy END) AS var2
  FROM seg)
SELECT *, CASE WHEN n1 > 1 AND n2 > 1 THEN (mean1 - mean2) / nullif(sqrt(var1 / n1 + var2 / n2), 0) END AS "T",
  CASE WHEN n1 > 1 AND n2 > 1 THEN (var1 / n1 + var2 / n2) * (var1 / n1 + var2 / n2)
       / nullif((var1 / n1) * (var1 / n1) / (n1 - 1) + (var2 / n2) * (var2 / n2) / (n2 - 1), 0) END AS dof,
  abs(CASE WHEN n1 > 1 AND n2 > 1 THEN (mean1 - mean2)
       / nullif(sqrt(((n1 - 1) * var1 + (n2 - 1) * var2) / (n1 + n2 - 2)), 0) END) AS cohen_d
FROM tt""", ids=["T2", "T3"])
def q_welch_pooled(spark, sf):
    s = en.rpt_samples(ad.cycle_view(spark, sf), rpt_cycle=RPT, neighbors_cycle=3)
    return welch_stats(s, "norm_discharge_energy", "sample", "after", "before")


@register("gain_histogram", "bin:i, count:l, bin_low:d, probability:d",
          W(ad.CYCLE_SQL, gain_ctes()) + f""",
hb AS (SELECT CAST(floor((gain_in_energy_pc - {lit(-5.0)}) / {lit(0.25)}) AS INTEGER) AS bin, count(*) AS count
       FROM gain WHERE gain_in_energy > 0 AND gain_in_energy_pc IS NOT NULL GROUP BY 1)
SELECT bin, count, {lit(-5.0)} + bin * {lit(0.25)} AS bin_low, count / sum(count) OVER () AS probability FROM hb""",
          ids=["T4", "A24"])
def q_gain_hist(spark, sf):
    from packspark.operators.stats import histogram
    g = en.rpt_gain(ad.cycle_view(spark, sf), rpt_cycle=RPT, neighbors_cycle=5)
    return histogram(g.where(F.col("gain_in_energy") > 0), "gain_in_energy_pc", -5.0, 0.25)
