import pytest
from pyspark.sql import functions as F

from packspark.operators import energy as en

COLS = "doe_number string, instance_number string, cycle int, cycling_substate string, energy double, energy_rest double"


def _rows(n, base=20.0, early=None, dcir=True):
    out = []
    for c in range(1, n + 1):
        e = base - 0.01 * c + (early.get(c, 0.0) if early else 0.0)
        out.append(("D1", "7", c, "DISCHARGE", e, None))
        if dcir:
            out.append(("D1", "7", c, "DCIR", None, 0.1))
        out.append(("D1", "7", c, "CHARGE", 99.0, 99.0))
    return out


def test_raw_energy_sums_discharge_and_dcir_rest(spark):
    df = spark.createDataFrame(_rows(3), COLS)
    r = en.raw_discharge_energy(df).orderBy("cycle").toPandas()
    assert r.raw_discharge_energy.round(9).tolist() == [20.09, 20.08, 20.07]


def test_no_dcir_state_at_all(spark):
    df = spark.createDataFrame(_rows(3, dcir=False), COLS)
    r = en.discharge_energy(df, raw=True).orderBy("cycle").toPandas()
    assert r.raw_discharge_energy.round(9).tolist() == [19.99, 19.98, 19.97]


def test_early_cycles_untouched_without_jump(spark):
    df = spark.createDataFrame(_rows(10), COLS)
    r = en.discharge_energy(df, raw=True).toPandas()
    assert (r.raw_discharge_energy == r.adjusted_raw_discharge_energy).all()


def test_early_cycles_refilled_after_jump(spark):
    df = spark.createDataFrame(_rows(10, early={2: 1.0}), COLS)
    r = en.discharge_energy(df, raw=True).orderBy("cycle").toPandas()
    early = r[r.cycle < 6]
    md = early.raw_discharge_energy.median()
    z = en.EXPECTED_NORMAL_ORDER[5]
    assert early.adjusted_raw_discharge_energy.round(9).tolist() == [round(md * (1 + 0.00025 * v), 9) for v in z]
    late = r[r.cycle >= 6]
    assert (late.raw_discharge_energy == late.adjusted_raw_discharge_energy).all()


def test_single_row_series_normalises_to_null(spark):
    df = spark.createDataFrame(_rows(1), COLS)
    r = en.discharge_energy(df).toPandas()
    assert r.norm_discharge_energy.isna().all()


def test_gain_tie_takes_first_cycle(spark):
    rows = []
    for c in range(1, 41):
        x = 1.0 if c < 20 else (1.05 if c < 30 else 1.0)
        rows += [("D1", "1", c, "DISCHARGE", 20.0 * x, None)]
    df = spark.createDataFrame(rows, COLS)
    g = en.rpt_gain(df, rpt_cycle=20, neighbors_cycle=5, window=3, sigma_multiplier=10.0).toPandas()
    # cycles 30..40 are all exactly at the before-mean: the first of them wins
    assert g.gain_in_cycle.iloc[0] == 30 - 18
    assert g.gain_in_energy.iloc[0] == pytest.approx(0.05)


def test_gain_null_without_after_rows(spark):
    rows = [("D1", "1", c, "DISCHARGE", 20.0, None) for c in range(1, 19)]
    df = spark.createDataFrame(rows, COLS)
    g = en.rpt_gain(df, rpt_cycle=20, neighbors_cycle=5).toPandas()
    assert g.gain_in_cycle.isna().all()
