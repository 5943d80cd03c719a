"""Registered queries: cohorts, recipes, key filters, summaries, message log, density."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from packspark.operators import cohorts as co
from packspark.operators import filters as fl
from packspark.operators import stats as stt
from packspark.operators.voltage import dcir_table
from packspark.plans import adapters as ad
from packspark.plans import sqltext as sq
from packspark.plans.registry import register
from packspark.plans.sqltext import lit
from packspark.sources import files as fi
from packspark.session import fresh_path
from packspark.sources import logs as lg
from packspark.sources.sinks import export, load_file_to_table

W = sq.with_

# ------------------------------------------------------------------ cohorts
COHORT_MED_SQL = """cm AS (
  SELECT split_part(instance_number, '_', 1) AS cohort, split_part(instance_number, '_', 2) AS pack, instance_number,
         cycling_substate, median(capacity) AS median_capacity
  FROM cohort_rows WHERE cycling_substate IN ('CHARGE', 'DISCHARGE')
  GROUP BY instance_number, cycling_substate)"""


@register("cohort_medians", "cohort:s, pack:s, instance_number:s, cycling_substate:s, median_capacity:d",
          W(ad.CYCLE_SQL, ad.COHORT_SQL, COHORT_MED_SQL) + "\nSELECT * FROM cm", ids=["T28", "X4", "A16", "F5"])
def q_cohort_medians(spark, sf):
    return co.cohort_medians(ad.cohort_rows(spark, sf), "capacity")


@register("cohort_delta", "pack:s, cycling_substate:s, test_median:d, reference_median:d, delta:d",
          W(ad.CYCLE_SQL, ad.COHORT_SQL, COHORT_MED_SQL) + """
SELECT coalesce(t.pack, r.pack) AS pack, coalesce(t.cycling_substate, r.cycling_substate) AS cycling_substate,
       t.median_capacity AS test_median, r.median_capacity AS reference_median,
       t.median_capacity - r.median_capacity AS delta
FROM (SELECT * FROM cm WHERE cohort = 'MOD40C') t
FULL OUTER JOIN (SELECT * FROM cm WHERE cohort = 'REG40C') r
  ON t.pack = r.pack AND t.cycling_substate = r.cycling_substate""", ids=["T28", "J9", "A16", "E10"])
def q_cohort_delta(spark, sf):
    return co.cohort_delta(ad.cohort_rows(spark, sf), "MOD40C", "REG40C", "capacity")


# ------------------------------------------------------------------ recipes
CLEAN_SQL = f"""rc0 AS (
  SELECT *, CASE substr(instance_number, 1, 1) WHEN 'd' THEN 'modified_65min' WHEN 'e' THEN 'fast_60min'
                 WHEN 'f' THEN 'slow_70min' END AS recipe
  FROM recipe_rows WHERE cycling_substate = 'CHARGE' AND time >= {lit(52.0)}),
rc1 AS (
  SELECT *, median(time) OVER (PARTITION BY instance_number) AS median_time,
         coalesce(stddev_samp(time) OVER (PARTITION BY instance_number),
                  {lit(0.02)} * median(time) OVER (PARTITION BY instance_number)) AS std_time
  FROM rc0),
clean AS (SELECT *, median_time - {lit(3.0)} * std_time AS lower_time FROM rc1
          WHERE time > median_time - {lit(3.0)} * std_time)"""


@register("recipe_clean_time", "instance_number:s, cycle:i, time:d, capacity:d, recipe:s, median_time:d, std_time:d, "
          "lower_time:d", W(ad.CYCLE_SQL, ad.RECIPE_SQL, CLEAN_SQL) + "\nSELECT * FROM clean",
          ids=["T29", "J2", "A17", "J5", "N11"])
def q_recipe_clean(spark, sf):
    return co.recipe_clean_time(ad.recipe_rows(spark, sf))


@register("recipe_pair_delta", "pair_kind:s, pair:s, median:d, mean:d, std:d",
          W(ad.CYCLE_SQL, ad.RECIPE_SQL, CLEAN_SQL) + """,
pr0 AS (SELECT substr(instance_number, 1, 1) AS letter, substr(instance_number, 2) AS pack, cycle, time FROM clean),
fp AS (SELECT DISTINCT pack FROM pr0 WHERE letter = 'f'),
pr1 AS (SELECT 'd-e' AS pair_kind, pack, cycle, time FROM pr0 WHERE letter IN ('d', 'e')
        UNION ALL SELECT 'e-f', pack, cycle, time FROM pr0 WHERE letter IN ('e', 'f')
        UNION ALL SELECT 'd-f', pack, cycle, time FROM pr0 WHERE letter IN ('d', 'f')),
pr2 AS (SELECT pair_kind, pack, cycle, max(time) - min(time) AS delta FROM pr1
        WHERE pack IN (SELECT pack FROM fp) GROUP BY pair_kind, pack, cycle HAVING count(*) = 2)
SELECT pair_kind, substr(pair_kind, 1, 1) || pack || '-' || substr(pair_kind, 3, 1) || pack AS pair,
       median(delta) AS median, avg(delta) AS mean, stddev_samp(delta) AS std
FROM pr2 GROUP BY pair_kind, pack""", ids=["T30", "J8", "A18", "A27", "F8", "E14"])
def q_recipe_pairs(spark, sf):
    return co.recipe_pair_summary(co.recipe_pair_delta(co.recipe_clean_time(ad.recipe_rows(spark, sf))))


@register("charge_time_label", "instance_number:s, median_time:i, instance_time:s",
          W(ad.CYCLE_SQL, ad.RECIPE_SQL) + """
SELECT instance_number, median_time, instance_number || '_' || CAST(median_time AS VARCHAR) || 'min' AS instance_time
FROM (SELECT instance_number, CAST(trunc(median(time)) AS INTEGER) AS median_time FROM recipe_rows
      WHERE cycling_substate = 'CHARGE' GROUP BY instance_number)""", ids=["T31", "A16", "F7", "N10", "E13"])
def q_label(spark, sf):
    return co.charge_time_label(ad.recipe_rows(spark, sf))


@register("charge_by_label", "instance_time:s, cycle:i, n:l, mean_time:d, mean_capacity:d",
          W(ad.CYCLE_SQL, ad.RECIPE_SQL) + """,
lab AS (SELECT instance_number, instance_number || '_' || CAST(CAST(trunc(median(time)) AS INTEGER) AS VARCHAR) || 'min'
          AS instance_time FROM recipe_rows WHERE cycling_substate = 'CHARGE' GROUP BY instance_number)
SELECT instance_time, cycle, count(*) AS n, avg(time) AS mean_time, avg(capacity) AS mean_capacity
FROM recipe_rows LEFT JOIN lab USING (instance_number) WHERE cycling_substate = 'CHARGE'
GROUP BY instance_time, cycle""", ids=["J2", "T31", "E13"])
def q_charge_by_label(spark, sf):
    return co.charge_by_label(ad.recipe_rows(spark, sf))


@register("energy_by_label", "instance_time:s, cycle:i, n:l, mean_energy:d, mean_norm_energy:d",
          W(ad.CYCLE_SQL, """named AS (SELECT * REPLACE (doe_number || instance_number AS instance_number) FROM cyc)""",
            sq.discharge_energy_ctes(7, 0.1, src="named"), """lab AS (
  SELECT instance_number, instance_number || '_' || CAST(CAST(trunc(median(time)) AS INTEGER) AS VARCHAR) || 'min' AS instance_time
  FROM named WHERE cycling_substate = 'CHARGE' GROUP BY instance_number)""") + """
SELECT instance_time, cycle, count(*) AS n, avg(discharge_energy) AS mean_energy, avg(norm_discharge_energy) AS mean_norm_energy
FROM energy LEFT JOIN lab USING (instance_number) GROUP BY instance_time, cycle""", ids=["T1", "T31", "E13"])
def q_energy_by_label(spark, sf):
    rows = ad.cycle_view(spark, sf)
    return co.energy_by_label(rows.withColumn("instance_number", F.concat("doe_number", "instance_number")))


@register("recipe_density", "recipe:s, point:i, x:d, density:d",
          W(ad.CYCLE_SQL, ad.RECIPE_SQL, CLEAN_SQL) + f""",
ds AS (SELECT recipe, count(capacity) AS n, stddev_samp(capacity) AS sd, min(capacity) AS lo, max(capacity) AS hi
       FROM clean WHERE capacity IS NOT NULL GROUP BY recipe),
ds2 AS (SELECT *, pow(CAST(n AS DOUBLE), {lit(-0.2)}) * sd AS bw FROM ds),
pts AS (SELECT ds2.*, CAST(p.range AS INTEGER) AS point FROM ds2, range(50) p),
kd AS (
  SELECT g.recipe, g.point, g.lo + CAST(g.point AS DOUBLE) * ((g.hi - g.lo) / {lit(49.0)}) AS x, c.capacity AS v, g.bw, g.n
  FROM pts g JOIN clean c ON c.recipe = g.recipe WHERE c.capacity IS NOT NULL)
SELECT recipe, point, x,
       sum(exp({lit(-0.5)} * ((x - v) / nullif(bw, 0)) * ((x - v) / nullif(bw, 0)))
           / (bw * {lit(math.sqrt(2 * math.pi))})) / any_value(n) AS density
FROM kd GROUP BY recipe, point, x""", ids=["A25"])
def q_density(spark, sf):
    return stt.density(co.recipe_clean_time(ad.recipe_rows(spark, sf)), "capacity", by=["recipe"], points=50)


@register("recipe_density_binned", "recipe:s, point:i, x:d, density:d, error_bound:d",
          W(ad.CYCLE_SQL, ad.RECIPE_SQL, CLEAN_SQL) + f""",
ds AS (SELECT recipe, count(capacity) AS n, stddev_samp(capacity) AS sd, min(capacity) AS lo, max(capacity) AS hi
       FROM clean WHERE capacity IS NOT NULL GROUP BY recipe),
ds2 AS (SELECT *, nullif(pow(CAST(n AS DOUBLE), {lit(-0.2)}) * sd, 0) AS bw FROM ds),
placed AS (SELECT g.*, coalesce((c.capacity - g.lo) / (g.bw / {lit(64.0)}), {lit(0.0)}) AS pos
       FROM clean c JOIN ds2 g ON c.recipe IS NOT DISTINCT FROM g.recipe WHERE c.capacity IS NOT NULL),
ends AS (
  SELECT recipe, n, lo, hi, bw, floor(pos) AS node, 1.0::DOUBLE - (pos - floor(pos)) AS share FROM placed
  UNION ALL
  SELECT recipe, n, lo, hi, bw, floor(pos) + 1.0::DOUBLE AS node, pos - floor(pos) AS share FROM placed),
nodes AS (SELECT recipe, n, lo, hi, bw, node, sum(share) AS mass FROM ends GROUP BY recipe, n, lo, hi, bw, node),
kd AS (SELECT nodes.*, CAST(p.range AS INTEGER) AS point,
              lo + CAST(p.range AS DOUBLE) * ((hi - lo) / {lit(49.0)}) AS x FROM nodes, range(50) p)
SELECT recipe, point, x,
       sum(mass * exp({lit(-0.5)} * ((x - lo) / bw - node / {lit(64.0)}) * ((x - lo) / bw - node / {lit(64.0)})))
         / (any_value(n) * any_value(bw) * {lit(math.sqrt(2 * math.pi))}) AS density,
       1.0::DOUBLE / (8.0 * 64.0 * 64.0 * {lit(math.sqrt(2 * math.pi))}) / any_value(bw) AS error_bound
FROM kd GROUP BY recipe, point, x""", ids=["A25"])
def q_density_binned(spark, sf):
    return stt.density_binned(co.recipe_clean_time(ad.recipe_rows(spark, sf)), "capacity", by=["recipe"], points=50)


# ------------------------------------------------------------------ key filters over read_data
FIL_COLS = "doe:s, instance:s, cycle_num:i, charging_state_name:s, energy:d"
RD_SQL = """rd AS (SELECT doe_number AS doe, instance_number AS instance, cycle AS cycle_num,
                   cycling_substate AS charging_state_name, energy FROM cyc)"""


def _rd(spark, sf):
    return fi.read_data(spark, ad.cycle_view(spark, sf)).select(
        "doe", "instance", "cycle_num", "charging_state_name", "energy")


@register("filter_doe", FIL_COLS, W(ad.CYCLE_SQL, RD_SQL) + "\nSELECT * FROM rd WHERE doe IN ('A', 'R')",
          ids=["P4", "S8", "P15", "T34", "E1"])
def q_f_doe(spark, sf):
    return fl.filter_by_doe(_rd(spark, sf), ["A", "R"])


@register("filter_instance", FIL_COLS, W(ad.CYCLE_SQL, RD_SQL) + "\nSELECT * FROM rd WHERE instance IN ('1', '5', '10', '42')",
          ids=["P5", "S8"])
def q_f_inst(spark, sf):
    return fl.filter_by_instance(_rd(spark, sf), [1, 5, "10", "42"])


@register("filter_cycle", FIL_COLS, W(ad.CYCLE_SQL, RD_SQL) + "\nSELECT * FROM rd WHERE cycle_num IN (1, 3, 20)",
          ids=["P6", "S8"])
def q_f_cycle(spark, sf):
    return fl.filter_by_cycle(_rd(spark, sf), [1, 3, 20])


@register("filter_doe_instance", FIL_COLS, W(ad.CYCLE_SQL, RD_SQL) + """
SELECT rd.* FROM rd JOIN (VALUES ('A', '1'), ('R', '5'), ('A', '1')) p(doe, instance)
  ON rd.doe = p.doe AND rd.instance = p.instance""", ids=["P7"])
def q_f_pairs(spark, sf):
    return fl.filter_by_doe_instance(_rd(spark, sf), [("A", 1), ("R", "5"), ("A", "1")])


@register("content_summary", "column:s, n_distinct:l, min_value:s, max_value:s", W(ad.CYCLE_SQL, RD_SQL) + "\n" +
          "\nUNION ALL\n".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct, CAST(min({c}) AS VARCHAR) "
                               f"AS min_value, CAST(max({c}) AS VARCHAR) AS max_value FROM rd"
                               for c in ("doe", "instance", "cycle_num")), ids=["A19", "A20", "S8"])
def q_summary(spark, sf):
    return fi.content_summary(_rd(spark, sf))


# ------------------------------------------------------------------ message log
def _msg_case() -> str:
    whens = " ".join(f"WHEN {k} THEN '{v}'" for k, v in lg.MSG_TYPES.items())
    return f"CASE msg_type {whens} ELSE CAST(msg_type AS VARCHAR) END"


@register("log_flatten_map", "msg_type:s, time_stamp_us:l, k:i, seq:l, reading:d",
          W(ad.LOG_SQL) + f"""
SELECT {_msg_case()} AS msg_type, epoch_us(time_stamp) AS time_stamp_us, k, seq, reading FROM log_rows""",
          ids=["T15", "P20", "J1", "O1", "S5", "F12"])
def q_log(spark, sf):
    d = lg.parse_log(ad.log_rows(spark, sf))
    return d.withColumn("time_stamp_us",
                        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', time_stamp)"))


# ------------------------------------------------------------------ files written and read back
@register("log_file_read", "msg_type:s, time_stamp:l, k:i, seq:l, reading:d",
          W(ad.LOG_SQL) + f"""
SELECT {_msg_case()} AS msg_type, epoch_us(time_stamp) AS time_stamp, k, seq, reading FROM log_rows""",
          ids=["S5", "T15", "P20"])
def q_log_file(spark, sf):
    """Messages as compressed JSON lines in a fresh folder, read with a schema and flattened."""
    path = fresh_path(spark, "log")
    rows = ad.log_rows(spark, sf).withColumn("time_stamp", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', time_stamp)"))
    rows.write.option("compression", "bzip2").json(path)
    schema = "msg_type int, time_stamp bigint, data struct<k: int, seq: bigint, reading: double>"
    return lg.read_log(spark, path, schema=schema, sort=False)


@register("csv_export_read", "doe_number:s, instance_number:s, cycle:i, dcir:d",
          W(ad.CYCLE_SQL) + """
SELECT doe_number, instance_number, cycle, round_even(dcir * 1000.0, 1) AS dcir FROM cyc WHERE dcir IS NOT NULL""",
          ids=["S6", "K5"])
def q_csv(spark, sf):
    """The resistance table exported as CSV files and read back with a schema."""
    path = fresh_path(spark, "dcir")
    export(dcir_table(ad.cycle_view(spark, sf)), path)
    return fi.read_csv(spark, path, schema="doe_number string, instance_number string, cycle int, dcir double")



@register("csv_table_load", "doe_number:s, instance_number:s, cycle:i, dcir:d",
          W(ad.CYCLE_SQL) + """
SELECT doe_number, instance_number, cycle, round_even(dcir * 1000.0, 1) AS dcir FROM cyc WHERE dcir IS NOT NULL""",
          ids=["K1", "T35", "E15"])
def q_csv_table(spark, sf):
    """A folder of CSV files loaded into a catalog table, twice (the second load replaces the first), and read back."""
    path = fresh_path(spark, "dcir-load")
    export(dcir_table(ad.cycle_view(spark, sf)), path)
    table = "packspark_dcir_" + path.rpartition("-")[2]
    schema = "doe_number string, instance_number string, cycle int, dcir double"
    for _ in range(2):
        name = load_file_to_table(spark, path, table, schema=schema, fmt="csv")
    return spark.table(name)


@register("content_lists", "column:s, value:s", W(ad.CYCLE_SQL, RD_SQL, "few AS (SELECT * FROM rd WHERE cycle_num < 5)") + "".join(
    f"""{'' if i == 0 else ' UNION ALL '}
SELECT DISTINCT '{c}' AS "column", CAST({c} AS VARCHAR) AS value FROM rd WHERE {c} IS NOT NULL"""
    for i, c in enumerate(("doe", "instance"))) + """
UNION ALL SELECT 'cycle_num', min(cycle_num) || ' - ' || max(cycle_num) FROM rd HAVING count(DISTINCT cycle_num) > 6
UNION ALL SELECT DISTINCT 'cycle_num', CAST(cycle_num AS VARCHAR) FROM few WHERE (SELECT count(DISTINCT cycle_num) FROM few) <= 6""",
          ids=["A19", "S8", "T29"])
def q_content_lists(spark, sf):
    """Both forms of the cycle column: its range for all rows, its values for the first cycles."""
    rd = _rd(spark, sf)
    return fi.content_lists(rd).unionByName(fi.content_lists(rd.where(F.col("cycle_num") < 5), every=()))


# ------------------------------------------------------------------ scans
@register("read_cycles_core", "doe_number:s, instance_number:s, cycle:i, cycling_substate:s, energy:d, "
          "energy_rest:d, time:d, mean_mean_voltage:d, dcir:d, min_temp:d",
          W(ad.CYCLE_SQL) + """
SELECT doe_number, instance_number, cycle, cycling_substate, energy, energy_rest, time, mean_mean_voltage, dcir, min_temp
FROM cyc WHERE doe_number = 'N' AND cycle <> 0 AND cycle IN (1, 2, 3, 5, 8, 13, 21, 34)
  AND (cycling_substate IN ('CHARGE', 'DCIR') AND cycle BETWEEN 2 AND 30)""", ids=["S1", "P1", "P2", "P3", "P12"])
def q_read_core(spark, sf):
    from packspark.sources.cycles import read_cycles
    return read_cycles(spark, ad.cycle_view(spark, sf), doe="N", cycles=[1, 2, 3, 5, 8, 13, 21, 34], columns="core",
                       where="cycling_substate IN ('CHARGE', 'DCIR') AND cycle BETWEEN 2 AND 30")


@register("custom_sql_scan", "doe_number:s, instance_number:s, cycle:i, energy:d",
          W(ad.CYCLE_SQL) + """
SELECT doe_number, instance_number, cycle, energy FROM cyc WHERE cycling_substate = 'DISCHARGE' AND cycle < 10""",
          ids=["S2"])
def q_custom_sql(spark, sf):
    from packspark.sources.cycles import read_sql
    return read_sql(spark, "SELECT doe_number, instance_number, cycle, energy FROM {cycles} "
                           "WHERE cycling_substate = 'DISCHARGE' AND cycle < 10", cycles=ad.cycle_view(spark, sf))


@register("instance_order", "doe:s, instance:s, position:i",
          W(ad.SERIES_SQL, "ids AS (SELECT DISTINCT doe, 'p' || instance AS instance FROM samples "
                          "UNION SELECT DISTINCT doe, instance FROM samples)") + """
SELECT doe, instance,
       CAST(row_number() OVER (PARTITION BY doe ORDER BY TRY_CAST(instance AS BIGINT) NULLS LAST, instance) AS INTEGER)
         AS position
FROM ids""", ids=["S4", "F10", "O1", "A20"])
def q_instance_order(spark, sf):
    from packspark.operators.ordering import series_position
    from packspark.schema import instance_sort_cols
    r = ad.series_view(spark, sf).select("doe", "instance")
    # numeric ids and a prefixed (non-numeric) twin of each, from one scan
    ids = r.select("doe", F.explode(F.array(F.col("instance"), F.concat(F.lit("p"), "instance"))).alias("instance")) \
        .distinct()
    # one test may hold all packs: positions are counted over range partitions, not in one task
    order = instance_sort_cols("instance")
    placed = series_position(ids, ["doe"], order, "_ps_at", method="range")
    return placed.withColumn("position", F.col("_ps_at") + 1)


@register("state_labels", "cycling_substate:s, state_label:s, metric_label:s, n:l",
          W(ad.CYCLE_SQL) + """
SELECT cycling_substate,
  list_aggregate(list_transform(string_split(lower(replace(cycling_substate, '_', ' ')), ' '),
                                lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') AS state_label,
  'Max Temp' AS metric_label, count(*) AS n
FROM cyc GROUP BY cycling_substate""", ids=["F9"])
def q_labels(spark, sf):
    from packspark.functions.columns import title_label
    c = ad.cycle_view(spark, sf)
    return (c.groupBy("cycling_substate").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("state_label", title_label("cycling_substate"))
            .withColumn("metric_label", title_label(F.lit("max_temp"))))
