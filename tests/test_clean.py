import math

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from packspark.operators.clean import (clamp_early_global, clamp_early_series, group_screen,
                                       rolling_outlier_replace, segment_clean, sigma_band_filter)


def numpy_rolling_replace(values: np.ndarray, window: int, k: float) -> np.ndarray:
    """Sequential reference implementation (tests only)."""
    s = pd.Series(values, dtype="float64")
    r = s.rolling(window, min_periods=1)
    md, sd = r.median(), r.std(ddof=0)
    hit = ((s - md).abs() > k * sd).fillna(False).to_numpy()
    out = s.to_numpy(copy=True)
    out[hit] = md.to_numpy()[hit]
    return out


def _series(spark, rows):
    return spark.createDataFrame(rows, "k string, t int, x double")


def test_constant_series_unchanged(spark):
    df = _series(spark, [("a", i, 3.0) for i in range(10)])
    out = rolling_outlier_replace(df, "x", ["k"], "t", 5, 0.1).orderBy("t").toPandas()
    assert (out.x == 3.0).all()


def test_spike_replaced_by_median_and_null_kept(spark):
    vals = [1.0, 1.1, 0.9, 10.0, 1.0, None, 1.05]
    df = _series(spark, [("a", i, v) for i, v in enumerate(vals)])
    out = rolling_outlier_replace(df, "x", ["k"], "t", 3, 0.5).orderBy("t").toPandas().x.tolist()
    ref = numpy_rolling_replace(np.array([np.nan if v is None else v for v in vals]), 3, 0.5)
    for a, b in zip(out, ref):
        assert (a is None or (isinstance(a, float) and math.isnan(a))) and math.isnan(b) or abs(a - b) < 1e-12
    assert out[3] != 10.0


def test_native_blocked_and_pandas_agree(spark):
    rng = np.random.default_rng(7)
    rows = []
    for k in range(4):
        n = int(rng.integers(5, 120))
        x = np.cumsum(rng.normal(0, 1, n)) + rng.normal(0, 0.3, n) * (rng.random(n) < 0.2) * 10
        x[rng.random(n) < 0.05] = np.nan
        rows += [(f"s{k}", i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)]
    df = _series(spark, rows)
    for window, k in [(5, 0.1), (7, 0.5), (20, 1.0)]:
        nat = rolling_outlier_replace(df, "x", ["k"], "t", window, k, out="c", method="native").toPandas()
        blk = rolling_outlier_replace(df, "x", ["k"], "t", window, k, out="c", method="blocked",
                                      block_rows=max(window, 24)).toPandas()
        m = nat.merge(blk, on=["k", "t"], suffixes=("_n", "_b"))
        assert len(m) == len(rows)
        assert np.allclose(m.c_n.astype(float), m.c_b.astype(float), equal_nan=True, atol=1e-12)
        for key, g in nat.sort_values("t").groupby("k"):
            ref = numpy_rolling_replace(g.x.astype(float).to_numpy(), window, k)
            assert np.allclose(g.c.astype(float).to_numpy(), ref, equal_nan=True, atol=1e-12)


def test_window_longer_than_series_and_single_row(spark):
    df = _series(spark, [("a", 0, 2.0), ("b", 0, 1.0), ("b", 1, 5.0)])
    out = rolling_outlier_replace(df, "x", ["k"], "t", 50, 0.1).toPandas().sort_values(["k", "t"])
    assert out.x.tolist() == [2.0, 1.0, 3.0]


def test_segment_clean_leaves_test_cycles(spark):
    rows = [("a", c, 1.0 + (5.0 if c in (4, 5) else 0.0)) for c in range(1, 10)]
    df = spark.createDataFrame(rows, "k string, cycle int, x double")
    out = segment_clean(df, "x", ["k"], "cycle", split_cycle=5, window=3, sigma_multiplier=0.1) \
        .orderBy("cycle").toPandas().x.tolist()
    assert out[3] == 6.0 and out[4] == 6.0


def test_sigma_band_closed(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 4, 100]], "k string, x double")
    kept = sigma_band_filter(df, "x", ["k"], 1.0).toPandas().x.tolist()
    assert 100.0 not in kept and 3.0 in kept


def test_clamps(spark):
    df = spark.createDataFrame([("CHARGE", 1, 10.0), ("CHARGE", 2, 30.0), ("CHARGE", 6, 5.0), ("REST", 1, 1.0)],
                               "s string, cycle int, y double")
    out = clamp_early_global(df, "y", ["s"], "cycle", 5).orderBy("s", "cycle").toPandas().y.tolist()
    assert out == [20.0, 20.0, 5.0, 1.0]
    ts = spark.createDataFrame([("a", 0.2, -1.0), ("a", 0.5, -3.0), ("a", 2.0, -4.0)], "k string, e double, i double")
    out = clamp_early_series(ts, "i", ["k"], "e", 1.0).orderBy("e").toPandas().i.tolist()
    assert out == [-2.0, -2.0, -4.0]


def test_group_screen_keeps_whole_groups(spark):
    rows = [("a", c, 0.9) for c in range(1, 300)] + [("b", c, 0.5 if c == 3 else 0.9) for c in range(1, 300)]
    df = spark.createDataFrame(rows, "instance_number string, cycle int, norm_discharge_energy double")
    out = group_screen(df, ["instance_number"]).groupBy("instance_number").count().toPandas()
    assert out.instance_number.tolist() == ["a"] and out["count"].iloc[0] == 299


def test_median_of_lags_equals_the_framed_percentile(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(30):
        for t in range(int(rng.integers(1, 40))):
            v = [None, math.nan, math.inf, -0.0, 0.0][int(rng.integers(0, 5))] if rng.random() < 0.3 else float(rng.integers(-3, 4)) / 10
            rows.append((f"s{k}", t, v))
    df = _series(spark, rows).withColumn("y", F.when(F.abs("x") < 9, F.round(F.col("x") * 7)).cast("int"))
    for window, k in [(1, 0.1), (2, 0.5), (5, 0.5), (16, 1.0)]:
        w = Window.partitionBy("k").orderBy("t").rowsBetween(-(window - 1), 0)
        want = df
        for v in ("x", "y"):
            md, sd = F.percentile(v, F.lit(0.5)).over(w), F.stddev_pop(v).over(w)
            want = want.withColumn(f"c{v}", F.when(F.abs(F.col(v) - md) > F.lit(k) * sd, md).otherwise(F.col(v)))
        out = rolling_outlier_replace(df, ["x", "y"], ["k"], "t", window, k, out=["cx", "cy"], method="native")
        assert out.columns == want.columns and out.schema["cy"].dataType == want.schema["cy"].dataType
        assert sorted(map(str, out.collect())) == sorted(map(str, want.collect()))
        assert "percentile" not in out._jdf.queryExecution().optimizedPlan().toString()
