import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from packspark.operators.clean import rolling_outlier_replace
from packspark.operators.ordering import prefix_scan, range_cells, series_position
from packspark.operators.uncertainty import capacity_bounds


def _data(spark):
    rng = np.random.default_rng(2)
    rows = [("hot", int(t), float(v)) for t, v in enumerate(rng.normal(0, 1, 4000))]
    rows += [(f"s{i}", int(t), float(rng.normal())) for i in range(30) for t in range(int(rng.integers(1, 20)))]
    return spark.createDataFrame(rows, "k string, t long, x double")


def test_range_positions_equal_row_number(spark):
    df = _data(spark)
    a = series_position(df, ["k"], "t", "p", method="range", partitions=12).toPandas()
    b = df.withColumn("p", F.row_number().over(Window.partitionBy("k").orderBy("t")) - 1).toPandas()
    m = a.merge(b, on=["k", "t"], suffixes=("_a", "_b"))
    assert len(m) == len(b) and (m.p_a == m.p_b).all()


def test_blocked_rolling_with_range_positions(spark):
    df = _data(spark)
    a = rolling_outlier_replace(df, "x", ["k"], "t", 25, 0.5, out="c", method="blocked", block_rows=200,
                                position_method="range").toPandas()
    b = rolling_outlier_replace(df, "x", ["k"], "t", 25, 0.5, out="c", method="native").toPandas()
    m = a.merge(b, on=["k", "t"], suffixes=("_a", "_b"))
    assert len(m) == len(b) and np.allclose(m.c_a, m.c_b, atol=1e-12)


def test_range_positions_keep_null_keys(spark):
    df = spark.createDataFrame([(None, t) for t in range(20)] + [("a", t) for t in range(20)], "k string, t long")
    got = series_position(df, ["k"], "t", "p", method="range", partitions=5)
    assert got.count() == 40 and got.where("p <> t").count() == 0


def test_prefix_scan_equals_windows(spark):
    rng = np.random.default_rng(4)
    rows = [(k, t, None if rng.random() < 0.4 else float(rng.normal())) for k, n in (("a", 3000), ("b", 40), (None, 25), ("c", 1))
            for t in range(n)]
    df = spark.createDataFrame(rows, "k string, t long, x double")
    got = prefix_scan(range_cells(df, ["k"], "t", 16), ["k"], "t", lags={"before": "x"}, sums={"total": "x"}, lasts={"seen": "x"})
    w = Window.partitionBy("k").orderBy("t")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumns({"before": F.lag("x").over(w), "total": F.sum("x").over(run), "seen": F.last("x", True).over(run)})
    a, b = (d.drop("_ps_pid").orderBy("k", "t").toPandas() for d in (got, want))
    assert list(a.columns) == list(b.columns) and len(a) == len(rows)
    for c in ("before", "seen"):
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c
    assert (a.total.isna() == b.total.isna()).all() and np.allclose(a.total.fillna(0), b.total.fillna(0), atol=1e-9)


def test_capacity_of_one_series_of_a_million_rows(spark):
    """Step ids and charge of one series over at least eight tasks, none of which holds more than a fifth of it."""
    n = 1_000_000
    df = spark.range(n).select(F.lit("D").alias("doe"), F.lit("1").alias("instance"), F.lit(1).alias("cycle_num"),
                               F.lit("CHARGE").alias("charging_state_name"), F.col("id").alias("sample_id"),
                               (F.col("id") / 10).alias("elapsed_minutes"),
                               (-3.0 + F.floor(F.col("id") / 1000) % 5 * 0.5).alias("avg_current_a"))
    keys, order = ["doe", "instance", "cycle_num"], ["elapsed_minutes", "sample_id"]
    cells = range_cells(df.repartition(8, "sample_id"), keys, order, 12)
    sizes = [r["count"] for r in cells.groupBy("_ps_pid").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < n / 5
    d = prefix_scan(cells, keys, order, lags={"i0": "avg_current_a"}) \
        .withColumn("jump", (F.abs(F.col("avg_current_a") - F.col("i0")) > 0.1).cast("long"))
    d = prefix_scan(d, keys, order, sums={"step": "jump"})
    wrong = d.where(F.coalesce("step", F.lit(0)) != F.floor(F.col("sample_id") / 1000)).count()
    assert wrong == 0
    got = capacity_bounds(df, method="range", partitions=12).agg(F.count("*"), F.max("capacity"), F.count("capacity")).first()
    i = -3.0 + np.arange(n) // 1000 % 5 * 0.5
    assert got[0] == n and got[2] == n - 1
    assert abs(got[1] - float(np.max(np.cumsum(-i[1:] * 0.1) / 60))) < 1e-4
