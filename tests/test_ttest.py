import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from packspark.functions import tdist as td
from packspark.operators.ttest import welch_stats, welch_ttest

import tdist_reference as tdist


def test_t_distribution_values():
    assert 2 * tdist.t_sf(2.228138852, 10) == pytest.approx(0.05, abs=1e-9)
    assert tdist.t_ppf(0.975, 10) == pytest.approx(2.228138852, abs=1e-8)
    assert tdist.t_cdf(1.0, 1) == pytest.approx(0.75, abs=1e-12)
    assert tdist.t_ppf(0.95, 1e6) == pytest.approx(1.644854, abs=1e-5)


def test_noncentral_reduces_to_central():
    assert 1 - tdist.nct_cdf(1.812461, 10, 0.0) == pytest.approx(0.05, abs=1e-5)


def test_bayes_factor_direction():
    two = tdist.bf10_jzs(2.5, 20, 20)
    assert two > 1
    assert tdist.bf10_jzs(2.5, 20, 20, alternative="greater") == pytest.approx(2 * two)
    assert tdist.bf10_jzs(-2.5, 20, 20, alternative="greater") == pytest.approx(1 / (2 * two))
    assert tdist.bf10_jzs(0.0, 30, 30) < 1


def test_welch_against_numpy(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(1.0, 1.0, 40), rng.normal(0.5, 2.0, 25)
    rows = [("g", "x", float(v)) for v in a] + [("g", "y", float(v)) for v in b]
    df = spark.createDataFrame(rows, "grp string, s string, v double")
    r = welch_ttest(df, "v", "s", "x", "y", by=["grp"]).toPandas().iloc[0]
    va, vb = a.var(ddof=1) / len(a), b.var(ddof=1) / len(b)
    t = (a.mean() - b.mean()) / math.sqrt(va + vb)
    dof = (va + vb) ** 2 / (va ** 2 / (len(a) - 1) + vb ** 2 / (len(b) - 1))
    assert r["T"] == pytest.approx(t) and r["dof"] == pytest.approx(dof)
    assert r["p_val"] == pytest.approx(2 * tdist.t_sf(abs(t), dof))
    se = math.sqrt(va + vb)
    tc = tdist.t_ppf(0.975, dof)
    assert r["ci95_low"] == pytest.approx((t - tc) * se) and r["ci95_high"] == pytest.approx((t + tc) * se)
    assert 0 < r["power"] < 1 and r["bf10"] > 0
    assert r["significance"] in ("statistically significant", "not statistically significant")


def test_small_samples_give_null(spark):
    df = spark.createDataFrame([("g", "x", 1.0), ("g", "y", 2.0), ("g", "y", 3.0)], "grp string, s string, v double")
    r = welch_stats(df, "v", "s", "x", "y", by=["grp"]).toPandas().iloc[0]
    assert r["n1"] == 1 and (r["T"] is None or math.isnan(r["T"]))
    assert welch_ttest(df, "v", "s", "x", "y", by=["grp"]).first()["p_val"] is None


def test_columns_against_the_numpy_reference(spark):
    cases = [(t, nu, d) for t in (-3.1, -0.2, 0.0, 0.7, 2.4, 9.0) for nu in (1.0, 2.7, 18.0, 240.5, 30000.0) for d in (-1.5, 0.0, 2.2)]
    df = spark.createDataFrame(cases, "t double, nu double, d double")
    got = df.select("*", td.t_sf(F.col("t"), F.col("nu")).alias("sf"),
                    td.t_upper_quantile(0.025, F.col("nu")).alias("q"), td.t_upper_quantile(0.05, F.col("nu")).alias("q5"),
                    td.normal_sf(F.col("t")).alias("z"), td.log_gamma(F.col("nu") / 2).alias("lg"),
                    td.noncentral_sf(F.abs("t"), F.col("nu"), F.col("d")).alias("nc")).collect()
    assert len(got) == len(cases)
    for r in got:
        assert r.sf == pytest.approx(tdist.t_sf(r.t, r.nu), rel=1e-8)
        assert r.q == pytest.approx(tdist.t_ppf(0.975, r.nu), rel=1e-8) and r.q5 == pytest.approx(tdist.t_ppf(0.95, r.nu), rel=1e-8)
        assert r.z == pytest.approx(0.5 * math.erfc(r.t / math.sqrt(2)), abs=1e-14)
        assert r.lg == pytest.approx(math.lgamma(r.nu / 2), rel=1e-11, abs=1e-11)
        assert r.nc == pytest.approx(1 - tdist.nct_cdf(abs(r.t), r.nu, r.d), abs=2e-6 if r.nu < 2 else 1e-8)


@pytest.mark.parametrize("alternative", ["two-sided", "greater", "less"])
def test_finish_against_the_numpy_reference(spark, alternative):
    rng = np.random.default_rng(8)
    rows = [(g, s, float(v)) for g in range(6) for s, n, m in (("x", 5 + 9 * g, 0.2 * g - 0.4), ("y", 30 - 4 * g, 0.0))
            for v in rng.normal(m, 1.0 + 0.3 * g, n)]
    rows += [(9, "x", 1.0), (9, "y", 1.0), (9, "y", 1.0), (10, "x", 2.0), (10, "x", 2.0), (10, "y", 2.0), (10, "y", 2.0)]
    got = welch_ttest(spark.createDataFrame(rows, "g int, s string, v double"), "v", "s", "x", "y", by=["g"],
                      alternative=alternative).collect()
    assert len(got) == 8
    for r in got:
        if r["g"] > 8:
            assert [r[c] for c in ("p_val", "ci95_low", "ci95_high", "power", "bf10", "significance")] == [None] * 6
            continue
        want = tdist.welch_finish(r["T"], r["dof"], r["se"], r["n1"], r["n2"], r["d_signed"], alternative)
        for name, value in want.items():
            assert r[name] == pytest.approx(value, rel=1e-7, abs=1e-9), name
