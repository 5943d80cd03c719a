"""Count scans, exchanges, sorts, windows and join kinds in each registered query's physical plan."""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from packspark.plans.catalog import REGISTRY  # noqa: E402
from packspark.session import get_spark  # noqa: E402


def stats(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    # tree lines end with their node's number, also in subqueries; the details below each tree begin with it
    head = "\n".join(x for x in buf.getvalue().split("\n") if re.search(r"\(\d+\)\s*$", x) and not x.startswith("("))
    count = lambda p: len(re.findall(p, head))
    # scans of source tables, each listed once with its place; tables written on the way lie in the checkpoint folder
    own = df.sparkSession.conf.get("spark.checkpoint.dir", None) or "\0"
    scans = [x for x in re.findall(r"Location: (.*)", buf.getvalue()) if own not in x]
    return {"scan": len(scans), "exchange": count(r"\bExchange\b"), "reused": count(r"ReusedExchange"),
            "sort": count(r"\bSort\b"), "window": count(r"\bWindow\b"), "bhj": count(r"BroadcastHashJoin"),
            "smj": count(r"SortMergeJoin"), "bnlj": count(r"BroadcastNestedLoopJoin"),
            "cartesian": count(r"CartesianProduct"), "python": count(r"MapInPandas|MapInArrow|ArrowEvalPython|BatchEvalPython|FlatMapGroupsIn\w+")}


if __name__ == "__main__":
    spark = get_spark(shuffle_partitions=16)
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(REGISTRY)
    for n in names:
        print(n, stats(REGISTRY[n].spark(spark, sf)))
