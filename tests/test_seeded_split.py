"""Seeded early-cycle draws and the ranges of a split warehouse read."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from packspark.functions.columns import normal_draw
from packspark.operators import energy as en
from packspark.operators.voltage import pick_instance
from packspark.sources.cycles import split_ranges

COLS = "doe_number string, instance_number string, cycle int, raw_discharge_energy double"


def test_draws_are_normal_and_free_of_partitions(spark):
    d = spark.range(20000).select(F.col("id"), normal_draw(["id"], 3).alias("z"))
    a = d.orderBy("id").toPandas()["z"].to_numpy()
    b = d.repartition(7, F.rand(1)).orderBy("id").toPandas()["z"].to_numpy()
    assert (a == b).all() and abs(a.mean()) < 0.03 and abs(a.std() - 1) < 0.03
    assert abs((a < -1.0).mean() - 0.1587) < 0.01 and abs((a > 2.0).mean() - 0.0228) < 0.005
    other = spark.range(20000).select(normal_draw(["id"], 4).alias("z")).toPandas()["z"].to_numpy()
    assert abs(np.corrcoef(a, other)[0, 1]) < 0.03


def test_seeded_fill_is_sorted_and_scaled(spark):
    rows = [("D", s, c, 100.0 + (5.0 if c == 2 and s == "1" else 0.0)) for s in ("1", "2") for c in range(1, 10)]
    df = spark.createDataFrame(rows, COLS)
    got = en.early_cycle_adjust(df, mode="seeded", seed=11).orderBy("instance_number", "cycle").toPandas()
    one = got[got.instance_number == "1"].adjusted_raw_discharge_energy.to_numpy()
    z = spark.createDataFrame([("D", "1", c) for c in range(1, 6)], "doe_number string, instance_number string, cycle int") \
        .select(normal_draw(["doe_number", "instance_number", "cycle"], 11).alias("z")).toPandas()["z"].to_numpy()
    assert np.allclose(one[:5], 100.0 * (1 + 0.00025 * np.sort(z)[::-1]), rtol=0, atol=1e-12)
    assert (one[5:] == 100.0).all()
    assert (got[got.instance_number == "2"].adjusted_raw_discharge_energy == 100.0).all()
    with pytest.raises(ValueError):
        en.early_cycle_adjust(df, mode="other")


@settings(max_examples=60, deadline=None)
@given(st.integers(-50, 50), st.integers(0, 60), st.integers(1, 20))
def test_ranges_hold_every_value_once(low, width, parts):
    ranges = split_ranges("c", low, low + width, parts)
    assert 1 <= len(ranges) <= parts
    for v in [None, *range(low - 5, low + width + 6)]:
        hits = 0
        for r in ranges:
            if r == "1 = 1":
                hits += 1
            elif "IS NULL" in r:
                hits += v is None or v < int(r.split("<")[1].split()[0])
            else:
                hits += v is not None and all(v >= int(t[5:]) if ">=" in t else v < int(t[4:]) for t in r.split(" AND "))
        assert hits == 1


def test_ranges_filter_alike_in_spark(spark):
    d = spark.createDataFrame([(v,) for v in [None, *range(100)]], "c int")
    ranges = split_ranges("c", 10, 80, 4)
    counts = [d.where(r).count() for r in ranges]
    assert len(ranges) == 4 and sum(counts) == 101
    assert split_ranges("c", None, None, 8) == ["1 = 1"]


def test_one_pack_is_picked(spark):
    df = spark.createDataFrame([(str(i % 7), i) for i in range(70)] + [(None, 1)], "instance_number string, v int")
    assert {r[0] for r in pick_instance(df).select("instance_number").collect()} == {"0"}
    picks = {s: pick_instance(df, seed=s).select("instance_number").distinct().collect() for s in range(12)}
    assert all(len(p) == 1 for p in picks.values()) and len({p[0][0] for p in picks.values()}) > 2
    assert pick_instance(df.repartition(9), seed=3).select("instance_number").first() == picks[3][0]
    assert pick_instance(df.where("v < 0"), seed=3).count() == 0
