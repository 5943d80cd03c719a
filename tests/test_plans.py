"""Plan-shape guards for every registered query (what the physical plans must not contain)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

from plan_stats import stats  # noqa: E402

from packspark.plans.catalog import REGISTRY  # noqa: E402

from conftest import SF_SMALL  # noqa: E402

# Python appears only in the blocked rolling filter (Arrow batches over bounded blocks).
PYTHON_OK = {"rolling_outlier_wide", "rolling_outlier_blocked", "charge_steps_state", "charge_steps_voltage",
             "step_reconcile"}


# Source scans of more than two: the rounds of a radix selection read one shuffle (reused when the plan runs); content lists
# read one pruned column a list.
SCANS = {"content_lists": 8, "temperature_series": 4, "histogram_auto": 5, "temperature_histograms": 5}


def test_the_guard_sees_python_and_subqueries(spark):
    from pyspark.sql import functions as F
    assert stats(spark.range(3).mapInArrow(lambda b: b, "id bigint"))["python"] == 1
    d = spark.read.parquet(f"{SF_SMALL}/nation.parquet")
    assert stats(d.where(F.col("n_nationkey") > d.agg(F.avg("n_nationkey").alias("m")).select("m").scalar()))["scan"] >= 2


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_plan_shape(spark, name):
    s = stats(REGISTRY[name].spark(spark, SF_SMALL))
    assert s["bnlj"] == 0 and s["cartesian"] == 0, s
    assert s["scan"] <= SCANS.get(name, 2), s
    if name not in PYTHON_OK:
        assert s["python"] == 0, s
