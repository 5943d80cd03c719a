import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from packspark.operators.median import group_median, group_quantiles, order_key


def test_matches_builtin_median_with_a_hot_group(spark):
    rng = np.random.default_rng(11)
    rows = [("hot", float(v)) for v in rng.normal(0, 1, 3000)]
    rows += [(f"g{i}", float(v)) for i in range(40) for v in rng.normal(i, 1, int(rng.integers(1, 9)))]
    rows += [("ties", 1.0)] * 5 + [("ties", 2.0)] * 5 + [("nulls", None), ("nulls", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = group_median(df, "v", ["g"]).toPandas().set_index("g")["median"]
    ref = df.groupBy("g").agg(F.median("v").alias("m")).toPandas().set_index("g")["m"]
    assert set(got.index) == set(ref.index)
    for g in ref.index:
        assert got[g] == pytest.approx(ref[g], abs=1e-12), g


def test_global_median(spark):
    df = spark.createDataFrame([(float(v),) for v in [5, 1, 4, 2, 3, 6]], "v double")
    assert group_median(df, "v").collect()[0]["median"] == 3.5


def test_band_methods_agree(spark):
    from packspark.operators.energy import cycle_band
    rng = np.random.default_rng(5)
    rows = [("D", str(i), c, float(v)) for i in range(30) for c in range(1, 6) for v in [rng.normal(20, 1)]]
    df = spark.createDataFrame(rows, "doe_number string, instance_number string, cycle int, x double")
    a = cycle_band(df, "x", ["doe_number", "cycle"], "window").toPandas().sort_values(["instance_number", "cycle"])
    b = cycle_band(df, "x", ["doe_number", "cycle"], "distributed").toPandas().sort_values(["instance_number", "cycle"])
    assert np.allclose(a.mean_energy, b.mean_energy) and np.allclose(a.std_energy, b.std_energy)


def test_order_key_keeps_the_order_of_doubles(spark):
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 1 << 63, 4000, dtype=np.uint64) | (rng.integers(0, 2, 4000, dtype=np.uint64) << np.uint64(63))
    v = bits.view(np.float64)
    v = np.concatenate([v[~np.isnan(v)], [0.0, -0.0, 5e-324, -5e-324, 1e-310, 2.0 ** -1022, np.inf, -np.inf, 1.7976931348623157e308],
                        2.0 ** np.arange(-1074, 1024), np.nextafter(2.0 ** np.arange(-1021, 1024), 0), rng.normal(0, 1, 2000)])
    r = spark.createDataFrame([(float(x),) for x in v], "v double").select("v", order_key(F.col("v")).alias("k")).toPandas()
    want = np.where(v < 0, -(np.abs(v).view(np.uint64).astype(np.int64)), np.abs(v).view(np.uint64).astype(np.int64))
    assert (r.k.to_numpy() == want).all()


def test_far_values_and_quantiles(spark):
    df = spark.range(300_000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") == 7, 1e300).when(F.col("id") == 8, -1e300)
                                     .otherwise(F.sin(F.col("id").cast("double"))).alias("v"))
    got = group_quantiles(df, "v", ["g"], {"m": 0.5, "a": 0.25, "b": 0.9}).orderBy("g").collect()
    want = df.groupBy("g").agg(F.median("v").alias("m"), F.percentile("v", 0.25).alias("a"), F.percentile("v", 0.9).alias("b")) \
        .orderBy("g").collect()
    assert [r.m for r in got] == [r.m for r in want]
    assert np.allclose([[r.a, r.b] for r in got], [[r.a, r.b] for r in want], rtol=1e-12)
    assert group_median(df, "v").collect()[0]["median"] == df.agg(F.median("v")).collect()[0][0]


def test_empty_and_null_groups(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 4.0), ("a", None), ("b", float("nan"))], "g string, v double")
    got = {r.g: r["median"] for r in group_median(df, "v", ["g"]).collect()}
    assert got[None] == 2.5 and math.isnan(got["b"]) and "a" not in got
    assert group_median(df.limit(0), "v", ["g"]).count() == 0 and group_median(df.limit(0), "v").count() == 0
