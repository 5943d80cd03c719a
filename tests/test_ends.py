"""Exact k smallest / largest of groups: brute force, hot group, ties, nulls, empty frames; binned density against exact sums."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from packspark.operators import stats as stt
from packspark.operators import uncertainty as un
from packspark.operators.ends import array_median, group_ends


@pytest.mark.parametrize("k", [1, 2, 10])
def test_ends_equal_brute_force(spark, k):
    rng = random.Random(k)
    rows = []
    for g, n in [("hot", 5000), ("few", 3), ("ties", 400), ("none", 4)]:
        for i in range(n):
            v = None if g == "none" or rng.random() < 0.05 else (float(rng.randint(0, 3)) if g == "ties" else rng.gauss(0, 1))
            rows.append((g, rng.randrange(1 << 41) if g == "hot" else i, v, -i))
    rows.append((None, None, 7.0, None))
    df = spark.createDataFrame(rows, "g string, at long, x double, y int").repartition(7)
    got = {r.g: r for r in group_ends(df, {"x": "x", "y": "y"}, k, ["g"], "at").collect()}
    assert set(got) == {r[0] for r in rows}
    for g, r in got.items():
        for name, i in (("x", 2), ("y", 3)):
            want = sorted(v[i] for v in rows if v[0] == g and v[i] is not None)
            assert r[f"{name}_low"] == want[:k] and r[f"{name}_high"] == want[-k:]


def test_ends_lists_are_bounded(spark):
    # one group of 300,000 rows: no list before the last merge holds more than a stretch
    df = spark.range(300_000).select(F.lit("g").alias("g"), F.col("id").alias("at"), (F.col("id") * 7919 % 300_007).alias("x"))
    r = group_ends(df, {"x": "x"}, 5, ["g"], "at").collect()
    assert len(r) == 1 and len(r[0].x_low) == 5 and r[0].x_low[0] == 0
    want = sorted(i * 7919 % 300_007 for i in range(300_000))
    assert r[0].x_low == want[:5] and r[0].x_high == want[-5:]


def test_ends_of_nothing_and_bad_arguments(spark):
    df = spark.createDataFrame([], "g string, at long, x double")
    assert group_ends(df, {"x": "x"}, 3, ["g"], "at").count() == 0
    with pytest.raises(ValueError):
        group_ends(df, {"x": "x"}, 0, ["g"], "at")
    with pytest.raises(ValueError):
        group_ends(df, {"x": "x"}, 1, ["g"], "at", bits=(20, 10))


def test_median_of_an_ascending_array(spark):
    df = spark.createDataFrame([([],), ([2.0],), ([1.0, 2.0],), ([1.0, 5.0, 9.0],)], "a array<double>")
    assert [r[0] for r in df.select(array_median(F.col("a"))).collect()] == [None, 2.0, 1.5, 5.0]


def test_regimes_equal_ranking_by_hand(spark):
    rng = random.Random(3)
    rows = [("D", s, 1, i, e, float(i), *(rng.gauss(4, 1) for _ in range(3)))
            for s in ("1", "2") for i, e in enumerate(rng.choices([1.0, 2.0, None], k=90))]
    df = spark.createDataFrame(rows, "doe string, instance string, cycle_num int, sample_id long, error_pc double, "
                                     "elapsed_minutes double, capacity_upper_bound double, capacity double, "
                                     "capacity_lower_bound double")
    got = un.regime_breakdown(df, top=10).toPandas()
    assert len(got) == 4
    p = df.toPandas()
    for r in got.itertuples():
        part = p[(p.instance == r.instance) & (p.error_pc == r.error_pc)]
        for out, c in un.REGIME_COLS.items():
            v = np.sort(part[c].to_numpy())
            assert getattr(r, out) == pytest.approx(np.median(v[-10:]) - np.median(v[:10]), abs=1e-12)


def test_binned_density_keeps_its_bound(spark):
    rng = random.Random(11)
    rows = [(g, rng.gauss(m, s)) for g, m, s, n in [("a", 0, 1, 4000), ("b", 50, 0.01, 300)] for _ in range(n)]
    rows += [("a", 40.0), ("a", None), ("one", 1.0), ("same", 2.0), ("same", 2.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    exact = {(r.g, r.point): r for r in stt.density(df, "x", ["g"], 50).collect() if r.g in ("a", "b")}
    for cells in (8, 64):
        got = {(r.g, r.point): r for r in stt.density_binned(df, "x", ["g"], 50, cells).collect()}
        assert set(exact) == {k for k in got if k[0] in ("a", "b")}
        for key, e in exact.items():
            assert got[key].x == pytest.approx(e.x)
            assert abs(got[key].density - e.density) <= got[key].error_bound
    for g in ("one", "same"):                      # no spread: no bandwidth, as in the exact density
        assert all(r.density is None for k, r in got.items() if k[0] == g)
    whole = stt.density_binned(df.where("g = 'a'"), "x", points=50, cells_per_bandwidth=64).collect()
    assert {r.point: r.density for r in whole} == pytest.approx({k[1]: r.density for k, r in got.items() if k[0] == "a"})
    assert math.isclose(got[("a", 0)].error_bound, stt.binning_error(64) / _bandwidth(rows, "a"), rel_tol=1e-9)


def _bandwidth(rows, g):
    x = np.array([v for k, v in rows if k == g and v is not None])
    return len(x) ** -0.2 * x.std(ddof=1)
