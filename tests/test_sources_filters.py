import bz2
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from packspark.operators import filters as fl
from packspark.schema import instance_sort_cols
from packspark.sources import cycles, files, logs, sinks
from packspark.streaming.logs import stream_log  # noqa: E402


def test_read_data_csv_renames_and_rejects_other_extensions(spark):
    d = tempfile.mkdtemp(prefix="ps-csv-")
    p = os.path.join(d, "cyc.csv")
    with open(p, "w") as f:
        f.write("doe_number,instance_number,cycle,cycling_substate,energy\nA,1,1,CHARGE,2.5\nA,1,2,CHARGE,\n")
    df = files.read_data(spark, p)
    assert df.columns[:4] == ["doe", "instance", "cycle_num", "charging_state_name"]
    assert df.where(F.col("energy").isNull()).count() == 1
    with pytest.raises(ValueError):
        files.read_data(spark, os.path.join(d, "cyc.xlsx"))


def test_log_reader_bz2_flatten_and_map(spark):
    d = tempfile.mkdtemp(prefix="ps-log-")
    p = os.path.join(d, "log.json.bz2")
    msgs = [{"msg_type": 54, "time_stamp": 3.0, "data": {"v": 1.5}},
            {"msg_type": 14, "time_stamp": 1.0, "data": {"v": 2.5}},
            {"msg_type": 99, "time_stamp": 2.0, "data": {"v": 3.5}}]
    with bz2.open(p, "wt") as f:
        f.write("\n".join(json.dumps(m) for m in msgs))
    out = logs.read_log(spark, p).toPandas()
    assert out.msg_type.tolist() == ["ERROR", "99", "CHARGE"]
    assert "data" not in out.columns and out.v.tolist() == [2.5, 3.5, 1.5]
    q = stream_log(spark, d, schema="msg_type int, time_stamp double, data struct<v:double>", sink="memory", query_name="ps_logs")
    q.processAllAvailable()
    got = spark.sql("SELECT msg_type, v FROM ps_logs ORDER BY v").toPandas()
    q.stop()
    assert got.msg_type.tolist() == ["CHARGE", "ERROR", "99"]


def test_table_sink_replace_append(spark):
    wh = tempfile.mkdtemp(prefix="ps-wh-")
    db = "ps_test_db"
    sinks.ensure_database(spark, db, location=wh)
    assert sinks.database_exists(spark, db)
    df = spark.createDataFrame([(1, "a")], "id int, s string")
    sinks.write_table(df, "t1", database=db, if_exists="replace")
    sinks.write_table(df, "t1", database=db, if_exists="append")
    assert spark.table(f"{db}.t1").count() == 2
    sinks.write_table(df, "t1", database=db, if_exists="replace")
    assert spark.table(f"{db}.t1").count() == 1
    out = os.path.join(wh, "export")
    sinks.export(df, out, fmt="csv")
    assert spark.read.option("header", True).csv(out).count() == 1
    csv = os.path.join(wh, "in.csv")
    with open(csv, "w") as f:
        f.write("id,s\n1,a\n2,b\n")
    sinks.load_file_to_table(spark, csv, "t2", database=db)
    assert spark.table(f"{db}.t2").count() == 2
    with pytest.raises(ValueError):
        sinks.load_file_to_table(spark, os.path.join(wh, "in.xlsx"), "t3", database=db)


def test_read_cycles_pushes_filters_and_prunes(spark):
    d = tempfile.mkdtemp(prefix="ps-cyc-")
    rows = [("A", str(i), c, "CHARGE", 1.0 * c) for i in range(3) for c in range(0, 4)]
    spark.createDataFrame(rows, "doe_number string, instance_number string, cycle int, cycling_substate string, "
                                "energy double").write.parquet(d + "/t")
    df = cycles.read_cycles(spark, d + "/t", doe="A", instances=[1, 2], cycles=[1, 3], columns=["doe_number",
                            "instance_number", "cycle", "energy"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "doe_number" in plan
    assert df.count() == 4 and set(df.columns) == {"doe_number", "instance_number", "cycle", "energy"}


def test_filters(spark):
    df = spark.createDataFrame([("A", "1", 1), ("A", "2", 1), ("B", "1", 2)], "doe string, instance string, cycle_num int")
    assert fl.filter_by_doe_instance(df, [("A", 1), ("B", "1"), ("A", "1")]).count() == 3
    assert fl.filter_by_instance(df, [1]).count() == 2
    assert fl.filter_by_cycle(df, [2]).count() == 1
    assert fl.filter_by_doe(df, ["B"]).count() == 1


def test_mixed_id_sort_order(spark):
    df = spark.createDataFrame([("d49",), ("10",), ("2",)], "instance_number string")
    assert [r[0] for r in df.orderBy(*instance_sort_cols()).collect()] == ["2", "10", "d49"]


def test_read_sql_normalise_ids_and_csv_schema(spark):
    d = tempfile.mkdtemp(prefix="ps-ids-")
    p = os.path.join(d, "t.csv")
    with open(p, "w") as f:
        f.write("instance_number,metric\n7,1.5\nd49,n/a\n")
    df = files.read_csv(spark, p, schema="instance_number string, metric string")
    out = cycles.normalise_ids(df, numeric_text=["metric"]).orderBy(*instance_sort_cols()).toPandas()
    assert out.instance_number.tolist() == ["7", "d49"]
    assert out.metric.iloc[0] == 1.5 and out.metric.isna().iloc[1]
    df.createOrReplaceTempView("ps_ids")
    assert cycles.read_sql(spark, "SELECT count(*) AS n FROM ps_ids").collect()[0]["n"] == 2


def test_cluster_conf_sizes_partitions():
    from packspark.session import cluster_conf
    c = cluster_conf(100 * 1024 ** 4)
    assert int(c["spark.sql.shuffle.partitions"]) == 409600
    assert c["spark.sql.adaptive.skewJoin.enabled"] == "true"


def test_missing_columns_are_typed_nulls_or_named(spark):
    from packspark.schema import CORE_COLUMNS
    from packspark.sources.cycles import read_cycles
    df = spark.createDataFrame([("T", "1", 3, 2.5)], "doe_number string, instance_number string, cycle int, energy double")
    out = read_cycles(spark, df, columns="core")
    assert out.columns == list(CORE_COLUMNS) and dict(out.dtypes)["dcir"] == "double" and dict(out.dtypes)["cycling_substate"] == "string"
    assert out.first().energy == 2.5 and out.first().dcir is None
    with pytest.raises(ValueError, match="cycling_substate"):
        read_cycles(spark, df, columns="core", strict=True)


def test_a_failed_load_leaves_the_old_table(spark):
    import uuid

    from pyspark.sql import functions as F

    from packspark.sources.sinks import write_table
    table = f"packspark_staged_{uuid.uuid4().hex[:8]}"
    before = {t.name for t in spark.catalog.listTables()}
    write_table(spark.range(5), table)
    bad = spark.range(9).withColumn("id", F.when(F.col("id") == 7, F.raise_error(F.lit("broken file"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="broken file"):
        write_table(bad, table)
    assert spark.table(table).count() == 5
    write_table(spark.table(table).where("id > 1"), table)          # reads the table it replaces
    assert sorted(r.id for r in spark.table(table).collect()) == [2, 3, 4]
    assert {t.name for t in spark.catalog.listTables()} == before | {table}
    spark.sql(f"DROP TABLE {table}")


@pytest.mark.parametrize("by", [[], ["g"]])
def test_bins_chosen_by_the_data(spark, by):
    import numpy as np

    from packspark.operators.stats import histogram_auto
    rng = np.random.default_rng(2)
    groups = {"a": rng.normal(0, 1, 400), "b": np.append(np.zeros(50), [1.0, 9.0]), None: np.array([3.0, 3.0]), "c": rng.exponential(2, 77)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None)]
    got = histogram_auto(spark.createDataFrame(rows, "g string, v double"), "v", by).toPandas()
    want = groups if by else {None: np.concatenate(list(groups.values()))}
    for k, v in want.items():
        r = got[got.g.isna() if k is None else got.g == k] if by else got
        fd, sturges = 2 * np.subtract(*np.percentile(v, [75, 25])) / len(v) ** (1 / 3), np.ptp(v) / (np.log2(len(v)) + 1)
        bins = 1 if v.min() == v.max() else int(np.ceil(np.ptp(v) / (min(fd, sturges) if fd > 0 else sturges)))
        assert (r.bins == bins).all() and r["count"].sum() == len(v) and abs(r.probability.sum() - 1) < 1e-12
        counts = np.zeros(bins, int)
        counts[r.bin] = r["count"]
        if bins > 1:
            assert counts.tolist() == np.histogram(v, bins)[0].tolist()


def test_content_summary_counts_without_sorting_all_rows(spark):
    rows = [("B", "2", 10), ("A", None, 9), ("A", "10", 10), (None, "10", None)]
    df = spark.createDataFrame(rows, "doe string, instance string, cycle_num int")
    got = {r["column"]: tuple(r)[1:] for r in files.content_summary(df).collect()}
    assert got == {"doe": (2, "A", "B"), "instance": (2, "10", "2"), "cycle_num": (2, "9", "10")}
    empty = files.content_summary(df.where("false")).collect()
    assert sorted(r["column"] for r in empty) == ["cycle_num", "doe", "instance"]
    assert {tuple(r)[1:] for r in empty} == {(0, None, None)}
    plan = files.content_summary(df)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("HashAggregate") >= 2, plan
