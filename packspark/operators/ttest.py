"""Welch two-sample t-test per group.

The data pass is one aggregation (count, mean, variance of each sample per group, partial
aggregated before the shuffle).  t, Welch–Satterthwaite dof and Cohen's d are column
expressions, and so are p-value, interval, power and Bayes factor (``functions.tdist``): no Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packspark.functions import tdist as td


def welch_stats(df: DataFrame, value: str, sample: str, first, second, by: Sequence[str] = ()) -> DataFrame:
    """n, mean, var (ddof=1) of both samples; T, dof, |Cohen's d|; NULL when a sample has < 2 rows."""
    x = F.col(value)
    s1, s2 = F.col(sample) == F.lit(first), F.col(sample) == F.lit(second)
    aggs = [F.count(F.when(s1, x)).alias("n1"), F.avg(F.when(s1, x)).alias("mean1"),
            F.var_samp(F.when(s1, x)).alias("var1"),
            F.count(F.when(s2, x)).alias("n2"), F.avg(F.when(s2, x)).alias("mean2"),
            F.var_samp(F.when(s2, x)).alias("var2")]
    g = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    a, b = F.col("var1") / n1, F.col("var2") / n2
    ok = (F.col("n1") > 1) & (F.col("n2") > 1)
    se = F.sqrt(a + b)
    pooled = F.sqrt(((n1 - 1) * F.col("var1") + (n2 - 1) * F.col("var2")) / (n1 + n2 - 2))
    return (g.withColumn("se", F.when(ok, se))
            .withColumn("T", F.when(ok, F.try_divide(F.col("mean1") - F.col("mean2"), se)))
            .withColumn("dof", F.when(ok, F.try_divide((a + b) * (a + b),
                                                       a * a / (n1 - 1) + b * b / (n2 - 1))))
            .withColumn("d_signed", F.when(ok, F.try_divide(F.col("mean1") - F.col("mean2"), pooled)))
            .withColumn("cohen_d", F.abs(F.col("d_signed"))))


def finish(df: DataFrame, alternative: str, confidence: float = 0.95, alpha: float = 0.05) -> DataFrame:
    """p_val, ci95_low, ci95_high, power and bf10 beside ``welch_stats``; NULL where T is NULL.

    The interval is that of the mean difference; the power is that of the pooled test at level ``alpha`` for the effect seen."""
    if alternative not in ("two-sided", "greater", "less"):
        raise ValueError("alternative must be 'two-sided', 'greater' or 'less'")
    sides = 2 if alternative == "two-sided" else 1
    t, dof, se = F.col("T"), F.col("dof"), F.col("se")
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    shift = F.col("d_signed") / F.sqrt(1 / n1 + 1 / n2)
    known = t.isNotNull() & dof.isNotNull()
    pooled = n1 + n2 - 2
    out = df.withColumn("_ps_tc", F.when(known, td.t_upper_quantile((1 - confidence) / sides, dof))) \
        .withColumn("_ps_ta", F.when(known, td.t_upper_quantile(alpha / sides, pooled)))
    tc, ta = F.col("_ps_tc"), F.col("_ps_ta")
    p = {"two-sided": 2 * td.t_sf(F.abs(t), dof), "greater": td.t_sf(t, dof), "less": td.t_sf(-t, dof)}[alternative]
    up, down = td.noncentral_sf(ta, pooled, shift), td.noncentral_sf(ta, pooled, -shift)
    power = {"two-sided": up + down, "greater": up, "less": down}[alternative]
    low = F.lit(float("-inf")) if alternative == "less" else (t - tc) * se
    high = F.lit(float("inf")) if alternative == "greater" else (t + tc) * se
    for name, value in (("p_val", p), ("ci95_low", low), ("ci95_high", high), ("power", power),
                        ("bf10", td.bayes_factor(t, n1, n2, alternative))):
        out = out.withColumn(name, F.when(known, value))
    return out.drop("_ps_tc", "_ps_ta")


def interpret(df: DataFrame) -> DataFrame:
    """Plain-language reading of p, BF10, |d| and power; a reading is NULL where its number is undefined."""
    def known(c):
        return F.col(c).isNotNull() & ~F.isnan(c)

    return (df.withColumn("significance", F.when(known("p_val"), F.when(F.col("p_val") < 0.05, "statistically significant")
                          .otherwise("not statistically significant")))
            .withColumn("bayes_support", F.when(known("bf10"), F.when(F.col("bf10") >= 1.0, "change").otherwise("no change")))
            .withColumn("effect_size", F.when(known("cohen_d"), F.when(F.col("cohen_d") < 0.2, "a very small impact")
                        .when(F.col("cohen_d") < 0.5, "a small impact")
                        .when(F.col("cohen_d") < 0.8, "a moderate impact").otherwise("a substantial impact")))
            .withColumn("power_reading", F.when(known("power"), F.when(F.col("power") >= 0.8, "detects a true difference")
                        .otherwise("might not detect a true difference"))))


def welch_ttest(df: DataFrame, value: str, sample: str, first, second, by: Sequence[str] = (),
                alternative: str = "two-sided", interprete: bool = True) -> DataFrame:
    """Welch t-test of ``first`` vs ``second`` sample (optionally per group)."""
    st = welch_stats(df, value, sample, first, second, by)
    out = finish(st, alternative)
    out = out.withColumn("alternative", F.lit(alternative))
    return interpret(out) if interprete else out
