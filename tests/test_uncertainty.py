import pytest
from pyspark.sql import functions as F

from packspark.functions.columns import bin_right_closed, pct_text
from packspark.operators import uncertainty as un

SAMPLE_COLS = ("doe string, instance string, cycle_num int, charging_state_name string, sample_id long, "
         "elapsed_minutes double, cccv_state int, avg_current_a double")


def test_bins_are_right_closed(spark):
    df = spark.createDataFrame([(v,) for v in [-5.0, -3.0, -2.9, -1.5, -1.2, -1.0, -0.5, 0.0, 0.1]], "i double")
    ups = [u for u, _ in un.ERROR_LIMITS]
    labs = [p for _, p in un.ERROR_LIMITS]
    got = df.select(bin_right_closed("i", ups, labs).alias("e")).toPandas().e.tolist()
    assert got[:8] == [1.0, 1.0, 1.5, 1.5, 2.0, 2.0, 8.0, 8.0]
    assert got[8] is None or got[8] != got[8]


# Six rows of the published capacity-uncertainty example
# (capacity, lower bound, upper bound, lower %, upper %, uncertainty %).
GOLDEN = [
    (4.629662693482794, 4.549140887927098, 4.71018449903769, "98.26%", "101.74%", "3.48%"),
    (4.598197809306038, 4.518384262880351, 4.67801135573099, "98.26%", "101.74%", "3.47%"),
    (4.626579516348513, 4.546634010282238, 4.706525022414166, "98.27%", "101.73%", "3.46%"),
    (4.521049818567482, 4.4420174330683, 4.600082204065759, "98.25%", "101.75%", "3.5%"),
    (4.560626882548162, 4.485121333375906, 4.636132431719648, "98.34%", "101.66%", "3.31%"),
    (4.460817544284368, 4.381687850974357, 4.539947237593796, "98.23%", "101.77%", "3.55%"),
]


def test_golden_percent_texts(spark):
    df = spark.createDataFrame([g[:3] for g in GOLDEN], "c double, lo double, hi double")
    out = df.select(pct_text(F.col("lo") * 100.0 / F.col("c")).alias("a"), pct_text(F.col("hi") * 100.0 / F.col("c")).alias("b"),
                    pct_text((F.col("hi") - F.col("lo")) * 100.0 / F.col("c")).alias("u")).toPandas()
    assert list(zip(out.a, out.b, out.u)) == [g[3:] for g in GOLDEN]


def _charge(spark):
    rows = []
    for s in range(3):
        for t in range(90):
            cur = -4.0 if t < 30 else (-1.2 if t < 60 else -0.6 + 0.005 * (t - 60))
            rows.append(("D", str(s), 1 + s, "CHARGE", s * 100 + t, float(t), 2 if t >= 60 else 1, cur))
    return spark.createDataFrame(rows, SAMPLE_COLS)


def test_bounds_bracket_capacity_and_shares_sum(spark):
    b = un.capacity_bounds(_charge(spark)).toPandas().dropna(subset=["capacity"])
    assert (b.capacity_lower_bound <= b.capacity).all() and (b.capacity <= b.capacity_upper_bound).all()
    r = un.regime_breakdown(un.capacity_bounds(_charge(spark))).toPandas()
    for _, g in r.groupby(["doe", "instance", "cycle_num"]):
        assert g.time_pc.sum() == pytest.approx(100.0)


def test_time_uncertainty_closest_samples(spark):
    t = un.time_uncertainty(_charge(spark), -0.5, 8.0).orderBy("instance").toPandas()
    assert t.charge_time.tolist() == [89.0, 89.0, 89.0]
    # CV currents -0.6 .. -0.455; max * 1.08 = -0.4914 -> closest sample t = 82 (-0.49)
    assert t.charge_time_lower_bound.iloc[0] == 82.0
    assert t.charge_time_uncertainty.iloc[0] == "15.73%"


def test_drop_outlier_cycles_scopes(spark):
    rows = []
    for s in range(8):
        for t in range(5):
            cur = -1.0 if s != 7 else -9.0
            rows.append(("D", str(s), s % 4, "CHARGE", s * 10 + t, float(t), 1, cur))
    b = un.capacity_bounds(spark.createDataFrame(rows, SAMPLE_COLS))
    kept_all = un.drop_outlier_cycles(b, sigma_multiplier=2.0).select("instance").distinct().toPandas()
    kept_series = un.drop_outlier_cycles(b, sigma_multiplier=2.0, scope="series").select("instance").distinct().toPandas()
    assert sorted(kept_all.instance) == ["0", "1", "2", "4", "5", "6"]     # cycle 3 dropped everywhere
    assert sorted(kept_series.instance) == ["0", "1", "2", "3", "4", "5", "6"]
