"""Registered queries: resistance, voltages, polarization, temperature, histograms."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from packspark.operators import filters as fl
from packspark.operators import stats as stt
from packspark.operators import voltage as vo
from packspark.plans import adapters as ad
from packspark.plans import sqltext as sq
from packspark.plans.registry import register
from packspark.plans.sqltext import K, lit, w1

W = sq.with_
KC = "doe_number:s, instance_number:s"
CI_COLS = "n:l, mean:d, std:d, ci_low:d, ci_high:d"


def mean_ci_sql(src: str, x: str, y: str, hue: list[str]) -> str:
    h = ", ".join(hue)
    return f"""
SELECT {h}, {x}, count({y}) AS n, avg({y}) AS mean, stddev_samp({y}) AS std,
       avg({y}) - {lit(1.96)} * (stddev_samp({y}) / nullif(sqrt(CAST(count({y}) AS DOUBLE)), 0)) AS ci_low,
       avg({y}) + {lit(1.96)} * (stddev_samp({y}) / nullif(sqrt(CAST(count({y}) AS DOUBLE)), 0)) AS ci_high
FROM {src} GROUP BY {h}, {x}"""


DCIR_SQL = """dcir_t AS (
  SELECT doe_number, instance_number, cycle, round_even(dcir * 1000.0, 1) AS dcir FROM cyc WHERE dcir IS NOT NULL)"""


@register("dcir_table", KC + ", cycle:i, dcir:d", W(ad.CYCLE_SQL, DCIR_SQL) + "\nSELECT * FROM dcir_t",
          ids=["T5", "P21", "P10", "F4"])
def q_dcir(spark, sf):
    return vo.dcir_table(ad.cycle_view(spark, sf))


@register("dcir_series", "doe_number:s, cycle:i, " + CI_COLS,
          W(ad.CYCLE_SQL, DCIR_SQL) + mean_ci_sql("dcir_t", "cycle", "dcir", ["doe_number"]), ids=["T9", "A26"])
def q_dcir_series(spark, sf):
    return vo.dcir_series(ad.cycle_view(spark, sf), hue="doe_number")


@register("mean_voltage_series", "doe_number:s, cycle:i, " + CI_COLS, W(ad.CYCLE_SQL, f"""
mv AS (SELECT doe_number, cycle, {w1('mean_mean_voltage', K, 'cycle', 5, 0.2)} AS mean_mean_voltage
       FROM cyc WHERE cycling_substate = 'CHARGE')""") + mean_ci_sql("mv", "cycle", "mean_mean_voltage", ["doe_number"]),
          ids=["T10", "A26", "P8", "E3"])
def q_mean_voltage(spark, sf):
    return vo.mean_voltage_series(ad.cycle_view(spark, sf), hue="doe_number", raw_data=False)


METRICS = ("avg_current_a", "avg_voltage_v", "avail_battery_capacity_ah")


@register("series_metrics", "doe_instance:s, elapsed_minutes:d, sample_id:l, metric:s, value:d",
          W(ad.SERIES_SQL, """ch AS (SELECT doe || '_' || instance AS doe_instance, elapsed_minutes, sample_id,
                                     abs(avg_current_a) AS avg_current_a, avg_voltage_v, avail_battery_capacity_ah
                              FROM samples WHERE charging_state_name = 'CHARGE')""") + "\n" + "\nUNION ALL\n".join(
              f"SELECT doe_instance, elapsed_minutes, sample_id, '{m}' AS metric, {m} AS value FROM ch" for m in METRICS),
          ids=["T11", "P22", "F7", "P16"])
def q_series_metrics(spark, sf):
    return vo.series_metrics(ad.series_view(spark, sf), METRICS)


SERIES_LONG = """lng AS (
  SELECT instance, cycle_num, '{0}' AS metric, abs({0}) AS value FROM samples WHERE charging_state_name = 'CHARGE'
  UNION ALL
  SELECT instance, cycle_num, '{1}', {1} FROM samples WHERE charging_state_name = 'CHARGE')""".format(*METRICS[:2])


@register("series_metric_means", "instance:s, cycle_num:i, metric:s, " + CI_COLS,
          W(ad.SERIES_SQL, SERIES_LONG) + mean_ci_sql("lng", "cycle_num", "value", ["instance", "metric"]),
          ids=["T11", "E1", "A26"])
def q_series_metric_means(spark, sf):
    return vo.series_metric_means(ad.series_view(spark, sf), METRICS[:2], x="cycle_num", hue="instance")


def _cell_case(i):
    return (f"CASE WHEN cycling_substate IN ('CHARGE', 'DISCHARGE REST') THEN max_cell{i}_voltage_v "
            f"ELSE min_cell{i}_voltage_v END AS cell{i}_voltage_v")


CELLS = [f"cell{i}_voltage_v" for i in range(1, 6)]
STATE_CELLS_SQL = f"""sc AS (
  SELECT doe_number, instance_number, cycling_substate, cycle, {', '.join(_cell_case(i) for i in range(1, 6))}
  FROM cyc WHERE cycling_substate IN ('CHARGE', 'CHARGE REST', 'DISCHARGE', 'DISCHARGE REST'))"""


def cell_std_ctes():
    cleaned = ", ".join(f"{w1(c, K + ', cycling_substate', 'cycle', 5, 0.1)} AS {c}" for c in CELLS)
    notnull = " AND ".join(f"{c} IS NOT NULL" for c in CELLS)
    mean = "(" + " + ".join(CELLS) + ") / 5.0"
    ss = " + ".join(f"({c} - m) * ({c} - m)" for c in CELLS)
    return f"""{STATE_CELLS_SQL},
sc2 AS (SELECT doe_number, instance_number, cycling_substate, cycle, {cleaned} FROM sc WHERE {notnull}),
sc3 AS (SELECT *, {mean} AS m FROM sc2),
cellstd AS (SELECT * EXCLUDE (m), round_even(sqrt(({ss}) / 4.0) * 1000.0, 0) AS std_mv FROM sc3)"""


CELL_COLS = KC + ", cycling_substate:s, cycle:i, " + ", ".join(f"{c}:d" for c in CELLS)


@register("cell_voltage_std", CELL_COLS + ", std_mv:d", W(ad.CYCLE_SQL, cell_std_ctes()) + "\nSELECT * FROM cellstd",
          ids=["T6", "X2", "X3", "A9", "P9", "P10"])
def q_cell_std(spark, sf):
    return vo.cell_voltage_std(ad.cycle_view(spark, sf))


@register("cell_std_series", "cycling_substate:s, cycle:i, " + CI_COLS,
          W(ad.CYCLE_SQL, cell_std_ctes()) + mean_ci_sql("cellstd", "cycle", "std_mv", ["cycling_substate"]),
          ids=["T12", "A26"])
def q_cell_std_series(spark, sf):
    return vo.cell_std_series(ad.cycle_view(spark, sf))


@register("row_modulo_filter", "cycling_substate:s, cycle:i, " + CI_COLS,
          W(ad.CYCLE_SQL.replace("FROM cyc_base)", "FROM cyc_base WHERE cycle BETWEEN 1 AND 350 AND cycle % 10 <> 0)"),
            cell_std_ctes()) + mean_ci_sql("cellstd", "cycle", "std_mv", ["cycling_substate"]),
          ids=["P11", "E5", "T12"])
def q_modulo(spark, sf):
    c = fl.cycle_window_filter(ad.cycle_view(spark, sf), 1, 350, skip_every=10)
    return vo.cell_std_series(c)


def cell_long_sql(src: str, name: str = "lng") -> str:
    return f"{name} AS (" + " UNION ALL ".join(
        f"SELECT doe_number, instance_number, cycling_substate, cycle, 'cell{i}' AS cell, cell{i}_voltage_v AS voltage "
        f"FROM {src} WHERE {' AND '.join(c + ' IS NOT NULL' for c in CELLS)} AND cycle IS NOT NULL"
        for i in range(1, 6)) + f""")
SELECT doe_number, instance_number, cycling_substate, cycle, cell,
       {w1('voltage', K + ', cycling_substate, cell', 'cycle', 5, 0.1)} AS voltage
FROM {name}"""


CELL_LONG_COLS = KC + ", cycling_substate:s, cycle:i, cell:s, voltage:d"


@register("cell_voltage_long", CELL_LONG_COLS, W(ad.CYCLE_SQL, STATE_CELLS_SQL, cell_long_sql("sc")),
          ids=["T13", "X1", "F6", "E4"])
def q_cell_long(spark, sf):
    return vo.cell_voltage_long(ad.cycle_view(spark, sf), raw_data=False)


@register("cell_voltage_one_pack", CELL_LONG_COLS, W(ad.CYCLE_SQL, STATE_CELLS_SQL, """one AS (
  SELECT * FROM sc WHERE instance_number = (SELECT arg_min(instance_number, (md5('5|' || instance_number), instance_number)) FROM cyc))""",
          cell_long_sql("one")), ids=["T13", "P19", "E4"])
def q_cell_one(spark, sf):
    return vo.cell_voltage_long(vo.pick_instance(ad.cycle_view(spark, sf), seed=5), raw_data=False)


POL = [f"cell{i}_delta_voltage" for i in range(1, 6)] + ["pack_delta_voltage"]
POL_SQL = "pol AS (SELECT doe_number, instance_number, cycle, cycling_substate, " + ", ".join(
    [f"max_cell{i}_voltage_v - min_cell{i}_voltage_v AS cell{i}_delta_voltage" for i in range(1, 6)]
    + ["max_rest_voltage_v - min_rest_voltage_v AS pack_delta_voltage"]) + \
    " FROM cyc WHERE cycling_substate IN ('CHARGE REST', 'DISCHARGE REST'))"
POL_COLS = KC + ", cycle:i, cycling_substate:s, " + ", ".join(f"{c}:d" for c in POL)


@register("polarization", POL_COLS, W(ad.CYCLE_SQL, POL_SQL) + "\nSELECT * FROM pol", ids=["T7", "A10", "P9"])
def q_pol(spark, sf):
    return vo.polarization(ad.cycle_view(spark, sf))


@register("polarization_clean", POL_COLS, W(ad.CYCLE_SQL, POL_SQL) + "\nSELECT doe_number, instance_number, cycle, "
          "cycling_substate, " + ", ".join(f"{w1(c, K + ', cycling_substate', 'cycle', 5, 0.1)} AS {c}" for c in POL)
          + " FROM pol", ids=["T8", "W2"])
def q_pol_clean(spark, sf):
    return vo.polarization_clean(ad.cycle_view(spark, sf))


@register("temperature_series", "cycling_substate:s, doe_number:s, cycle:i, " + CI_COLS, W(ad.CYCLE_SQL, f"""
t0 AS (SELECT doe_number, instance_number, cycling_substate, cycle, max_temp FROM cyc
       WHERE cycling_substate IN ('CHARGE', 'CHARGE REST', 'DISCHARGE', 'DISCHARGE REST') AND max_temp IS NOT NULL)""",
            "tm AS (SELECT cycling_substate, median(max_temp) AS emd FROM t0 WHERE cycle < 5 GROUP BY cycling_substate)",
            """t1 AS (SELECT t0.doe_number, t0.instance_number, t0.cycling_substate, t0.cycle,
                     CASE WHEN t0.cycle < 5 THEN tm.emd ELSE t0.max_temp END AS max_temp
              FROM t0 LEFT JOIN tm USING (cycling_substate))""",
            f"t2 AS (SELECT doe_number, cycling_substate, cycle, {w1('max_temp', K + ', cycling_substate', 'cycle', 7, 0.5)}"
            " AS max_temp FROM t1)")
          + mean_ci_sql("t2", "cycle", "max_temp", ["cycling_substate", "doe_number"]),
          ids=["T14", "P17", "A26", "E7"])
def q_temperature(spark, sf):
    return vo.temperature_series(ad.cycle_view(spark, sf), hue="doe_number")


@register("histogram_probability", "doe_number:s, bin:i, count:l, bin_low:d, probability:d",
          W(ad.CYCLE_SQL, DCIR_SQL, f"""
hb AS (SELECT doe_number, CAST(floor((dcir - {lit(30.0)}) / {lit(0.5)}) AS INTEGER) AS bin, count(*) AS count
       FROM dcir_t WHERE dcir IS NOT NULL GROUP BY ALL)""") + f"""
SELECT doe_number, bin, count, {lit(30.0)} + bin * {lit(0.5)} AS bin_low,
       count / sum(count) OVER (PARTITION BY doe_number) AS probability FROM hb""", ids=["A24"])
def q_hist(spark, sf):
    return stt.histogram(vo.dcir_table(ad.cycle_view(spark, sf)), "dcir", 30.0, 0.5, by=["doe_number"])


def auto_bins_sql(src, value, by):
    g = ", ".join(by)
    return f"""
hs AS (SELECT {g}, CAST(count(*) AS DOUBLE) AS n, min({value}) AS lo, max({value}) AS hi,
         quantile_cont({value}, 0.75) - quantile_cont({value}, 0.25) AS iqr FROM {src} WHERE {value} IS NOT NULL GROUP BY ALL),
hw AS (SELECT *, (hi - lo) / (ln(n) / {lit(math.log(2.0))} + 1.0) AS sturges, 2.0 * iqr / pow(n, {lit(1.0 / 3.0)}) AS fd FROM hs),
hn AS (SELECT *, CASE WHEN hi > lo THEN CAST(ceil((hi - lo) / (CASE WHEN fd > 0 THEN least(fd, sturges) ELSE sturges END)) AS INTEGER)
         ELSE 1 END AS bins FROM hw),
hc AS (SELECT {g}, n, lo, hi, bins, CASE WHEN hi > lo THEN least(CAST(floor(({value} - lo) / (hi - lo) * bins) AS INTEGER), bins - 1)
         ELSE 0 END AS bin FROM {src} JOIN hn USING ({g}) WHERE {value} IS NOT NULL)
SELECT {g}, bins, bin, count(*) AS count, lo + bin * ((hi - lo) / bins) AS bin_low, (hi - lo) / bins AS bin_width,
       count(*) / n AS probability FROM hc GROUP BY {g}, n, lo, hi, bins, bin"""


BINS = ", bins:i, bin:i, count:l, bin_low:d, bin_width:d, probability:d"


@register("histogram_auto", "doe_number:s" + BINS, W(ad.CYCLE_SQL, DCIR_SQL) + "," + auto_bins_sql("dcir_t", "dcir", ["doe_number"]),
          ids=["A24", "T28"])
def q_hist_auto(spark, sf):
    return stt.histogram_auto(vo.dcir_table(ad.cycle_view(spark, sf)), "dcir", by=["doe_number"])


@register("temperature_histograms", "doe_number:s, cycling_substate:s" + BINS,
          W(ad.CYCLE_SQL, "rise AS (SELECT doe_number, cycling_substate, max_temp - min_temp AS delta_temp FROM cyc "
                          "WHERE cycling_substate IN ('CHARGE', 'DISCHARGE') AND max_temp - min_temp > 0)") + ","
          + auto_bins_sql("rise", "delta_temp", ["doe_number", "cycling_substate"]), ids=["A24", "P16", "T28"])
def q_hist_temperature(spark, sf):
    """Temperature rise of each test's charges and discharges, in bins of its own."""
    d = vo.delta_temperature(ad.cycle_view(spark, sf).where(F.col("cycling_substate").isin("CHARGE", "DISCHARGE")))
    return stt.histogram_auto(d.where(F.col("delta_temp") > 0), "delta_temp", by=["doe_number", "cycling_substate"])
