"""Rules for scale: no jobs while plans are built, frames that only grow, hot groups, types that survive."""

import datetime as dt
import re
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from packspark.operators import clean, energy, trend, ttest, voltage
from packspark.operators.median import group_median
from packspark.plans.catalog import REGISTRY
from packspark.sources.files import read_data

from conftest import SF_SMALL


def test_no_frame_starts_at_a_moving_row_and_never_ends(spark):
    for name, q in REGISTRY.items():
        plan = q.spark(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString().lower()
        for low, high in re.findall(r"specifiedwindowframe\(\w+, ([^,]+), ([^,]+?)\)\)", plan):
            assert "unboundedfollowing" not in high or "unboundedpreceding" in low, (name, low, high)


def test_jump_time_grows_about_linearly(spark):
    def run(n):
        df = spark.range(n).select(F.lit("T").alias("doe_number"), F.lit("1").alias("instance_number"),
                                   (F.col("id") + 1).cast("int").alias("cycle"),
                                   (1 + (F.col("id") % 97 == 0).cast("int") * 0.1).alias("norm_discharge_energy"))
        t = time.perf_counter()
        trend.energy_jump_removed(df).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t

    run(1000)
    assert run(40_000) < 3.2 * run(20_000) + 1


def test_group_median_of_one_hot_group(spark):
    df = spark.range(200_001).select((F.col("id") % 3 == 0).cast("int").alias("g"), F.pow(F.col("id") % 1009, F.lit(3)).alias("v"))
    got = {r.g: r.median for r in group_median(df, "v", ["g"]).collect()}
    want = {r.g: r.m for r in df.groupBy("g").agg(F.median("v").alias("m")).collect()}
    assert got == want
    plan = group_median(df, "v", ["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert "median(" not in plan and "percentile(" not in plan
    odd = spark.createDataFrame([(None, 1.0), (None, 4.0), ("a", None), ("b", 2.0), ("b", 2.0), ("b", 9.0)], "g string, v double")
    assert {r.g: r.median for r in group_median(odd, "v", ["g"]).collect()} == {None: 2.5, "b": 2.0}


@pytest.mark.parametrize("window", [3, 40])
def test_blocked_rolling_equals_native_and_keeps_other_columns(spark, window):
    rows = [("a" if i % 2 else None, i, (i * 37) % 101 if i % 9 else None, 9007199254740993 + i if i % 5 else None,
             dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), Decimal(i) / 4) for i in range(1200)]
    df = spark.createDataFrame(rows, "k string, t int, x int, big bigint, at timestamp, d decimal(12,2)")
    got = {}
    for method in ("native", "blocked"):
        out = clean.rolling_outlier_replace(df, "x", ["k"], "t", window, 0.5, out="c", method=method,
                                            **({"block_rows": 100} if method == "blocked" else {}))
        got[method] = sorted(map(str, out.select(*sorted(out.columns)).withColumn("c", F.round("c", 9)).collect()))
    assert got["native"] == got["blocked"]


def test_readings_of_undefined_statistics_are_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 3.0)], "s string, v double")
    r = ttest.welch_ttest(df, "v", "s", "a", "b").first()
    assert [r[c] for c in ("significance", "bayes_support", "effect_size", "power_reading")] == [None] * 4


def test_polarization_takes_one_row_per_key(spark):
    cols = [f"{k}_cell{i}_voltage_v" for i in range(1, 6) for k in ("min", "max")] + ["min_rest_voltage_v", "max_rest_voltage_v"]
    row = ("T", "1", 3, "CHARGE REST")
    df = spark.createDataFrame([(*row, 2, *[float(j % 2) for j in range(12)]), (*row, 1, *[j % 2 * 2.0 for j in range(12)])],
                               ["doe_number", "instance_number", "cycle", "cycling_substate", "start_time", *cols])
    out = voltage.polarization(df).collect()
    assert len(out) == 1 and out[0]["cell1_delta_voltage"] == 2.0


def test_temperature_hue_may_name_the_pack(spark):
    df = spark.createDataFrame([("T", str(p), c, "CHARGE", 20.0 + c + p) for p in (1, 2) for c in range(1, 9)],
                               "doe_number string, instance_number string, cycle int, cycling_substate string, max_temp double")
    out = voltage.temperature_series(df, hue="doe_instance")
    assert {r.doe_instance for r in out.collect()} == {"T_1", "T_2"}


def test_early_block_of_more_than_six_cycles_is_spread(spark):
    df = spark.createDataFrame([("T", "1", c, 13.0 * (2 if c == 3 else 1)) for c in range(9)],
                               "doe_number string, instance_number string, cycle int, raw_discharge_energy double")
    out = energy.early_cycle_adjust(df, before_cycle=7).orderBy("cycle").collect()
    early = [r.adjusted_raw_discharge_energy for r in out if r.cycle < 7]
    assert len(set(early)) == 7 and early == sorted(early, reverse=True)


def test_a_folder_of_files_is_read(spark, tmp_path):
    path = str(tmp_path / "series")
    spark.range(5).withColumnRenamed("id", "cycle").write.parquet(path)
    assert read_data(spark, path, fmt="parquet").count() == 5
    with pytest.raises(ValueError):
        read_data(spark, path)


def test_early_median_leaves_packs_spread(spark):
    """The packs of a state used to be in one task after the median of the state was joined."""
    df = spark.range(4000).select(F.lit("T").alias("doe_number"), (F.col("id") % 200).cast("string").alias("instance_number"),
                                  (F.col("id") / 200).cast("int").alias("cycle"), F.lit("CHARGE").alias("cycling_substate"),
                                  F.col("id").cast("double").alias("max_temp"))
    held = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = voltage.temperature_clean(df)
        assert out.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held)
    early = out.where("cycle < 5").agg(F.min("max_temp"), F.max("max_temp")).first()
    assert early[0] == early[1] == 499.5
