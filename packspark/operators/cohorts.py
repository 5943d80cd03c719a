"""Cohort and charge-recipe comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packspark.operators.energy import discharge_energy
from packspark.schema import CHARGE

# Recipe per instance prefix letter.
RECIPES = {"d": "modified_65min", "e": "fast_60min", "f": "slow_70min"}
# The three recipe pairings (first letter, second letter).
RECIPE_PAIRS = (("d", "e"), ("e", "f"), ("d", "f"))


def cohort_col(instance: str = "instance_number"):
    return F.split(F.col(instance), "_").getItem(0)


def pack_col(instance: str = "instance_number"):
    return F.split(F.col(instance), "_").getItem(1)


def cohort_medians(df: DataFrame, value: str = "capacity", states=("CHARGE", "DISCHARGE")) -> DataFrame:
    """Median ``value`` per (cohort, instance, state); cohort = id prefix before ``_``."""
    return (df.where(F.col("cycling_substate").isin(*states))
            .withColumn("cohort", cohort_col()).withColumn("pack", pack_col())
            .groupBy("cohort", "pack", "instance_number", "cycling_substate")
            .agg(F.median(value).alias(f"median_{value}")))


def cohort_delta(df: DataFrame, test: str, reference: str, value: str = "capacity",
                 states=("CHARGE", "DISCHARGE")) -> DataFrame:
    """Test − reference median per pack number and state (packs missing on one side give NULL)."""
    m = cohort_medians(df, value, states).where(F.col("cohort").isin(test, reference))
    col = F.col(f"median_{value}")
    # one instance per (cohort, pack): a conditional aggregate pairs both sides without a join
    return (m.groupBy("pack", "cycling_substate")
            .agg(F.max(F.when(F.col("cohort") == test, col)).alias("test_median"),
                 F.max(F.when(F.col("cohort") == reference, col)).alias("reference_median"))
            .withColumn("delta", F.col("test_median") - F.col("reference_median")))


def recipe_label(instance: str = "instance_number"):
    """Recipe name from the instance's first letter; NULL when unknown."""
    m = F.create_map(*[F.lit(x) for kv in RECIPES.items() for x in kv])
    return m[F.substring(F.col(instance), 1, 1)]


def recipe_clean_time(df: DataFrame, min_time: float = 52.0, sigma_multiplier: float = 3.0,
                      fallback_pc: float = 0.02) -> DataFrame:
    """CHARGE rows with ``time >= min_time`` above their instance's ``median − k·std`` bound.

    ``std`` is the sample std per instance, or ``fallback_pc`` × median when undefined.
    """
    d = (df.where((F.col("cycling_substate") == CHARGE) & (F.col("time") >= min_time))
         .withColumn("recipe", recipe_label()))
    w = Window.partitionBy("instance_number")
    md = F.median("time").over(w)
    sd = F.coalesce(F.stddev_samp("time").over(w), F.lit(float(fallback_pc)) * md)
    d = d.withColumn("median_time", md).withColumn("std_time", sd)
    d = d.withColumn("lower_time", F.col("median_time") - F.lit(float(sigma_multiplier)) * F.col("std_time"))
    return d.where(F.col("time") > F.col("lower_time"))


def recipe_pair_delta(clean: DataFrame) -> DataFrame:
    """Per recipe pairing, pack and cycle: max − min charge time when both packs have the cycle.

    Only packs whose slow-recipe (``f``) instance is present take part.  Each row is sent to
    the two pairings of its letter (a fixed fan-out), so no row pairs are enumerated.
    """
    d = clean.withColumn("letter", F.substring("instance_number", 1, 1)) \
             .withColumn("pack", F.substring("instance_number", 2, 1000))
    pair_of = {}
    for a, b in RECIPE_PAIRS:
        for x in (a, b):
            pair_of.setdefault(x, []).append(f"{a}-{b}")
    m = F.create_map(*[y for k, v in pair_of.items() for y in (F.lit(k), F.array(*[F.lit(p) for p in v]))])
    has_f = F.max((F.col("letter") == "f").cast("int")).over(Window.partitionBy("pack")) == 1
    d = d.withColumn("_ps_has_f", has_f).where(F.col("_ps_has_f"))
    d = d.where(F.col("letter").isin(*pair_of)).withColumn("pair_kind", F.explode(m[F.col("letter")]))
    g = (d.groupBy("pair_kind", "pack", "cycle")
         .agg(F.count(F.lit(1)).alias("_n"), (F.max("time") - F.min("time")).alias("delta"))
         .where(F.col("_n") == 2).drop("_n"))
    return g.withColumn("pair", F.concat(F.substring("pair_kind", 1, 1), F.col("pack"), F.lit("-"),
                                         F.substring("pair_kind", 3, 1), F.col("pack")))


def recipe_pair_summary(deltas: DataFrame) -> DataFrame:
    """Median, mean and sample std of the per-cycle deltas of each pair."""
    return deltas.groupBy("pair_kind", "pair").agg(F.median("delta").alias("median"), F.avg("delta").alias("mean"),
                                                   F.stddev_samp("delta").alias("std"))


def with_charge_time_label(df: DataFrame) -> DataFrame:
    """Rows with their instance's ``median_time`` and ``instance_time`` label (NULL without CHARGE rows)."""
    return df.join(charge_time_label(df), on="instance_number", how="left")


def charge_by_label(df: DataFrame) -> DataFrame:
    """Mean time, capacity and row count of CHARGE per label and cycle."""
    d = with_charge_time_label(df).where(F.col("cycling_substate") == CHARGE)
    return d.groupBy("instance_time", "cycle").agg(F.count(F.lit(1)).alias("n"), F.avg("time").alias("mean_time"),
                                                   F.avg("capacity").alias("mean_capacity"))


def charge_time_label(df: DataFrame) -> DataFrame:
    """Per instance: median CHARGE time truncated to minutes and the label ``<instance>_<min>min``."""
    m = (df.where(F.col("cycling_substate") == CHARGE).groupBy("instance_number")
         .agg(F.median("time").cast("int").alias("median_time")))
    return m.withColumn("instance_time", F.concat(F.col("instance_number"), F.lit("_"),
                                                  F.col("median_time").cast("string"), F.lit("min")))


def energy_by_label(df: DataFrame, window: int = 7, sigma_multiplier: float = 0.1) -> DataFrame:
    """Mean discharge energy, cleaned and normalised, per charge-time label and cycle, from whole cycle rows.

    Packs without a charge row have a NULL label."""
    energy = discharge_energy(df, window, sigma_multiplier)
    return (energy.join(charge_time_label(df).select("instance_number", "instance_time"), "instance_number", "left")
            .groupBy("instance_time", "cycle")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("discharge_energy").alias("mean_energy"),
                 F.avg("norm_discharge_energy").alias("mean_norm_energy")))
