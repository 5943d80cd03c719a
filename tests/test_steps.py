import pytest

from packspark.operators import steps as stp

COLS = ("doe string, instance string, cycle_num int, charging_state_name string, sample_id long, "
        "elapsed_minutes double, cccv_state int, avg_current_a double, avg_voltage_v double, "
        "avail_battery_capacity_ah double, cell1_voltage_v double, cell2_voltage_v double, cell3_voltage_v double, "
        "cell4_voltage_v double, cell5_voltage_v double")


def _series(inst="1", cv=True):
    rows = []
    for t in range(21):
        cur = -4.0 if t < 5 else (-2.0 if t < 10 else (-0.8 if t < 15 else -0.5))
        cccv = 2 if (cv and t >= 15) else 1
        cell = 4.25 if t >= 12 else 4.0
        rows.append(("D", inst, 1, "CHARGE", int(t), float(t), cccv, cur, 15.0 + t / 10.0, t / 10.0,
                     cell, cell, cell, cell, cell))
    return rows


def test_state_variant_known_table(spark):
    df = spark.createDataFrame(_series() + _series("2", cv=False), COLS)
    out = stp.charge_steps_state(df, window=3).orderBy("instance", "step").toPandas()
    assert out.instance.unique().tolist() == ["1"]          # no constant-voltage sample -> no table
    assert out.step_type.tolist() == ["cc", "cc", "cc", "cv"]
    assert out.step_avg_current_a.tolist()[:3] == [-4.0, -2.0, -0.8]
    assert out.step_time_length_min.tolist() == [5.0, 5.0, 5.0, 5.0]   # boundary samples shared
    assert out.min_avg_voltage_v.tolist() == pytest.approx([15.0, 15.5, 16.0, 16.5])
    assert out.max_avg_voltage_v.tolist() == pytest.approx([15.5, 16.0, 16.5, 17.0])
    assert out.min_capacity_ah.tolist() == pytest.approx([0.0, 0.5, 1.0, 1.5])
    assert not out.short_step.any()


def test_voltage_variant_cc_end_from_cells(spark):
    df = spark.createDataFrame(_series(), COLS)
    out = stp.charge_steps_voltage(df, window=3, first_n_high=3).orderBy("step").toPandas()
    # first three samples at >= 4.20 V are t = 12, 13, 14 -> CC part ends at 14
    assert out.step_type.tolist() == ["cc", "cc", "cc", "cv"]
    assert out.step_time_length_min.tolist() == [5.0, 5.0, 4.0, 6.0]


def test_reconcile(spark):
    df = spark.createDataFrame(_series(), COLS)
    r = stp.step_reconcile(stp.charge_steps_state(df, window=3), df).toPandas()
    assert r.charge_time.iloc[0] == 20.0 and r.charge_time_steps.iloc[0] == 20.0
    assert r.difference.iloc[0] == 0.0


def test_reconcile_single_pass_equals_two_pass(spark):
    df = spark.createDataFrame(_series() + _series("3"), COLS)
    a = stp.step_reconcile(stp.charge_steps_state(df, window=3, keep_series_end=True)).orderBy("instance").toPandas()
    b = stp.step_reconcile(stp.charge_steps_state(df, window=3), df).orderBy("instance").toPandas()
    assert a[["charge_time_steps", "charge_time", "difference"]].values.tolist() == \
        b[["charge_time_steps", "charge_time", "difference"]].values.tolist()
