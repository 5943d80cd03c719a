"""Deterministic views that map the driver's test tables onto the battery data model.

Each view is written twice: once with the DataFrame API (what the queries run) and once
as DuckDB SQL text (the independent oracle).  Both read only the given tables, so their
work grows with the tables.  Series lengths do not grow with the scale factor: a
cycle-table series is one (``l_returnflag``, ``l_suppkey``) pair (~200 rows, ~40 cycles)
and a time series is one (block of 30 users, day, state) with ~66 samples; more data means
more series, which is how a fleet of test packs grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packspark.schema import STATES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- cycle table
def cycle_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (doe_number, instance_number, cycle, cycling_substate)."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey",
        "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    # number rows per pack on the key columns themselves, so that the hash partitioning of
    # this window is reused by every later per-pack aggregation and window (no re-shuffle)
    li = li.withColumn("doe_number", F.col("l_returnflag")) \
           .withColumn("instance_number", F.col("l_suppkey").cast("string"))
    w = Window.partitionBy("doe_number", "instance_number").orderBy(
        "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    rn = F.row_number().over(w)
    states = F.array(*[F.lit(s) for s in STATES])
    d = (li.withColumn("_rn", rn)
         .withColumn("cycle", (F.floor((F.col("_rn") - 1) / 5) + 1).cast("int"))
         .withColumn("cycling_substate", F.element_at(states, ((F.col("_rn") - 1) % 5 + 1).cast("int"))))
    disc, tax, qty, cyc = F.col("l_discount"), F.col("l_tax"), F.col("l_quantity"), F.col("cycle")
    cols = {
        "energy": F.lit(20.0) / (F.lit(1.0) + F.lit(0.0005) * cyc)
        + F.lit(0.3) * ((F.floor(cyc / 12) % 2).cast("double")) + F.lit(0.2) * disc
        + F.when(cyc < 3, F.lit(2.0) * tax).otherwise(F.lit(0.0)),
        "energy_rest": F.lit(0.1) + tax,
        "dcir": F.when(F.col("cycling_substate") == "DCIR", F.lit(0.03) + F.lit(0.1) * tax),
        "capacity": F.lit(4.0) + disc,
        "time": F.lit(55.0) + qty / 5.0,
        "min_temp": F.lit(25.0) + tax * 10.0,
        # continuous part: integer-valued temperatures would put exact ties |x - md| = k·sd
        # into the rolling filter, where the last bit of a float sum decides
        "max_temp": F.lit(30.0) + qty / 2.0 + F.col("l_extendedprice") / 1000000.0,
        "min_rest_voltage_v": F.lit(15.0) + tax,
        "max_rest_voltage_v": F.lit(16.0) + disc,
        "mean_mean_voltage": F.lit(3.7) + disc,
    }
    for i in range(1, 6):
        step = float(f"0.0{i}")
        cols[f"min_cell{i}_voltage_v"] = F.lit(3.0) + F.lit(step) * tax
        cols[f"max_cell{i}_voltage_v"] = F.lit(4.1) + F.lit(step) * disc
    d = d.withColumns(cols)
    keep = ["doe_number", "instance_number", "cycle", "cycling_substate", "energy", "energy_rest", "dcir",
            "capacity", "time", "min_temp", "max_temp", "min_rest_voltage_v", "max_rest_voltage_v",
            "mean_mean_voltage"] + [f"{k}_cell{i}_voltage_v" for i in range(1, 6) for k in ("min", "max")]
    return d.select(*keep)


CYCLE_SQL = """
cyc_base AS (
  SELECT *, CAST((rn - 1) // 5 + 1 AS INTEGER) AS cycle,
         (['CHARGE','CHARGE REST','DISCHARGE','DISCHARGE REST','DCIR'])[CAST((rn - 1) % 5 AS INTEGER) + 1]
           AS cycling_substate
  FROM (SELECT l_returnflag, l_suppkey, l_quantity, l_discount, l_tax, l_extendedprice,
               row_number() OVER (PARTITION BY l_returnflag, l_suppkey
                                  ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS rn
        FROM lineitem)),
cyc AS (
  SELECT l_returnflag AS doe_number, CAST(l_suppkey AS VARCHAR) AS instance_number, cycle, cycling_substate,
         20.0::DOUBLE / (1.0::DOUBLE + 0.0005::DOUBLE * cycle)
           + 0.3::DOUBLE * CAST((cycle // 12) % 2 AS DOUBLE) + 0.2::DOUBLE * l_discount
           + (CASE WHEN cycle < 3 THEN 2.0::DOUBLE * l_tax ELSE 0.0::DOUBLE END) AS energy,
         0.1::DOUBLE + l_tax AS energy_rest,
         CASE WHEN cycling_substate = 'DCIR' THEN 0.03::DOUBLE + 0.1::DOUBLE * l_tax END AS dcir,
         4.0::DOUBLE + l_discount AS capacity,
         55.0::DOUBLE + l_quantity / 5.0::DOUBLE AS time,
         25.0::DOUBLE + l_tax * 10.0::DOUBLE AS min_temp,
         30.0::DOUBLE + l_quantity / 2.0::DOUBLE + l_extendedprice / 1000000.0::DOUBLE AS max_temp,
         15.0::DOUBLE + l_tax AS min_rest_voltage_v,
         16.0::DOUBLE + l_discount AS max_rest_voltage_v,
         3.7::DOUBLE + l_discount AS mean_mean_voltage,
         3.0::DOUBLE + 0.01::DOUBLE * l_tax AS min_cell1_voltage_v, 4.1::DOUBLE + 0.01::DOUBLE * l_discount AS max_cell1_voltage_v,
         3.0::DOUBLE + 0.02::DOUBLE * l_tax AS min_cell2_voltage_v, 4.1::DOUBLE + 0.02::DOUBLE * l_discount AS max_cell2_voltage_v,
         3.0::DOUBLE + 0.03::DOUBLE * l_tax AS min_cell3_voltage_v, 4.1::DOUBLE + 0.03::DOUBLE * l_discount AS max_cell3_voltage_v,
         3.0::DOUBLE + 0.04::DOUBLE * l_tax AS min_cell4_voltage_v, 4.1::DOUBLE + 0.04::DOUBLE * l_discount AS max_cell4_voltage_v,
         3.0::DOUBLE + 0.05::DOUBLE * l_tax AS min_cell5_voltage_v, 4.1::DOUBLE + 0.05::DOUBLE * l_discount AS max_cell5_voltage_v
  FROM cyc_base)"""


# ---------------------------------------------------------------- dense time series
USERS_PER_PACK = 30   # ~66 samples per (pack, day) at every scale factor


def series_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sample; series key (doe, instance, cycle_num, charging_state_name).

    A pack is a block of 30 users, a cycle is one day, elapsed minutes count from midnight
    (computed on the time-zone-free timestamp, so the session time zone does not matter).
    """
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    day_us = F.expr("timestampdiff(MICROSECOND, date_trunc('DAY', ts), ts)")
    d = ev.withColumn("elapsed_minutes", day_us.cast("double") / 60000000.0)
    el = F.col("elapsed_minutes")
    level = (F.when(el < 360.0, F.lit(-4.0)).when(el < 720.0, F.lit(-2.0))
             .when(el < 1080.0, F.lit(-1.2)).otherwise(F.lit(-0.7)))
    cols = {
        "doe": F.lit("E1"),
        "instance": F.floor(F.col("user_id") / USERS_PER_PACK).cast("string"),
        "cycle_num": F.dayofmonth("ts").cast("int"),
        "charging_state_name": F.when(F.col("event_type") == "error", "DISCHARGE").otherwise("CHARGE"),
        "sample_id": F.col("event_id"),
        "cccv_state": F.when(el >= 1080.0, 2).otherwise(1).cast("int"),
        "avg_current_a": F.when(F.col("event_id") % 97 == 0, F.lit(None).cast("double"))
        .otherwise(level - F.col("value") / 10000.0),
        "avg_voltage_v": F.lit(15.0) + el / 480.0,
        "avail_battery_capacity_ah": el / 288.0,
        "battery_temperature_deg_c": F.lit(20.0) + F.col("value") / 5.0,
    }
    for i in range(1, 6):
        cols[f"cell{i}_voltage_v"] = F.lit(3.6) + F.lit(0.65) * el / 1440.0 + F.lit(float(f"0.00{i}"))
    d = d.withColumns(cols)
    keep = ["doe", "instance", "cycle_num", "charging_state_name", "sample_id", "elapsed_minutes", "cccv_state",
            "avg_current_a", "avg_voltage_v", "avail_battery_capacity_ah", "battery_temperature_deg_c"] + \
           [f"cell{i}_voltage_v" for i in range(1, 6)]
    return d.select(*keep)


SERIES_SQL = """
smp_base AS (
  SELECT *, CAST(epoch_us(ts) - epoch_us(date_trunc('day', ts)) AS DOUBLE) / 60000000.0::DOUBLE AS elapsed_minutes
  FROM events),
samples AS (
  SELECT 'E1' AS doe, CAST(user_id // 30 AS VARCHAR) AS instance, CAST(day(ts) AS INTEGER) AS cycle_num,
         CASE WHEN event_type = 'error' THEN 'DISCHARGE' ELSE 'CHARGE' END AS charging_state_name,
         event_id AS sample_id, elapsed_minutes,
         CAST(CASE WHEN elapsed_minutes >= 1080.0 THEN 2 ELSE 1 END AS INTEGER) AS cccv_state,
         CASE WHEN event_id % 97 = 0 THEN NULL ELSE
           (CASE WHEN elapsed_minutes < 360.0 THEN -4.0::DOUBLE WHEN elapsed_minutes < 720.0 THEN -2.0::DOUBLE
                 WHEN elapsed_minutes < 1080.0 THEN -1.2::DOUBLE ELSE -0.7::DOUBLE END) - value / 10000.0::DOUBLE
         END AS avg_current_a,
         15.0::DOUBLE + elapsed_minutes / 480.0::DOUBLE AS avg_voltage_v,
         elapsed_minutes / 288.0::DOUBLE AS avail_battery_capacity_ah,
         20.0::DOUBLE + value / 5.0::DOUBLE AS battery_temperature_deg_c,
         3.6::DOUBLE + 0.65::DOUBLE * elapsed_minutes / 1440.0::DOUBLE + 0.001::DOUBLE AS cell1_voltage_v,
         3.6::DOUBLE + 0.65::DOUBLE * elapsed_minutes / 1440.0::DOUBLE + 0.002::DOUBLE AS cell2_voltage_v,
         3.6::DOUBLE + 0.65::DOUBLE * elapsed_minutes / 1440.0::DOUBLE + 0.003::DOUBLE AS cell3_voltage_v,
         3.6::DOUBLE + 0.65::DOUBLE * elapsed_minutes / 1440.0::DOUBLE + 0.004::DOUBLE AS cell4_voltage_v,
         3.6::DOUBLE + 0.65::DOUBLE * elapsed_minutes / 1440.0::DOUBLE + 0.005::DOUBLE AS cell5_voltage_v
  FROM smp_base)"""


# ---------------------------------------------------------------- message log rows
def log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw log records: ``msg_type`` code, ``time_stamp`` and a nested ``data`` object."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "value", "props")
    data = F.struct(F.from_json("props", "k INT")["k"].alias("k"), F.col("event_id").alias("seq"),
                    F.col("value").alias("reading"))
    return ev.select(data["k"].alias("msg_type"), F.col("ts").alias("time_stamp"), data.alias("data"))


LOG_SQL = """
log_rows AS (
  SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS msg_type, ts AS time_stamp,
         CAST(json_extract(props, '$.k') AS INTEGER) AS k, event_id AS seq, value AS reading
  FROM events)"""


# ---------------------------------------------------------------- recipe and cohort rows
def recipe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHARGE cycle rows whose instance carries a recipe letter: d/e/f + pack number."""
    c = cycle_view(spark, sf_dir)
    letter = F.when(F.col("doe_number") == "A", "d").when(F.col("doe_number") == "N", "e").otherwise("f")
    return (c.where(F.col("cycling_substate") == "CHARGE")
            .select(F.lit("RP").alias("doe_number"),
                    F.concat(letter, F.col("instance_number")).alias("instance_number"),
                    "cycle", "cycling_substate", "time", "capacity", "energy", "energy_rest"))


RECIPE_SQL = """
recipe_rows AS (
  SELECT 'RP' AS doe_number,
         (CASE WHEN doe_number = 'A' THEN 'd' WHEN doe_number = 'N' THEN 'e' ELSE 'f' END) || instance_number
           AS instance_number, cycle, cycling_substate, time, capacity, energy, energy_rest
  FROM cyc WHERE cycling_substate = 'CHARGE')"""


def cohort_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycle rows whose instance is ``<cohort>_<pack>``; cohorts from the return flag."""
    c = cycle_view(spark, sf_dir)
    cohort = (F.when(F.col("doe_number") == "A", "RPT25C").when(F.col("doe_number") == "N", "REG40C")
              .otherwise("MOD40C"))
    return c.withColumn("instance_number", F.concat_ws("_", cohort, F.col("instance_number"))) \
            .withColumn("doe_number", F.lit("C1"))


COHORT_SQL = """
cohort_rows AS (
  SELECT * REPLACE ('C1' AS doe_number,
         (CASE WHEN doe_number = 'A' THEN 'RPT25C' WHEN doe_number = 'N' THEN 'REG40C' ELSE 'MOD40C' END)
           || '_' || instance_number AS instance_number)
  FROM cyc)"""
