"""Row positions within a series that also work when one series is huge.

``row_number()`` over ``Window.partitionBy(series)`` sorts each series in one task.  For a
series too large for one task, rows are range-partitioned by (series, order) - a long
series is spread over many partitions in order - and ranked inside each (partition,
series) cell, which is at most one partition; the offset of each cell is the number of
rows of the same series in earlier partitions, taken from a small per-cell count table.
The order must be unique within a series, which also makes positions deterministic when
a lost partition is recomputed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packspark.session import cut_lineage


def _cols(order) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in ([order] if isinstance(order, (str, Column)) else order)]


def series_position(df: DataFrame, keys: Sequence[str], order, out: str = "_ps_idx", method: str = "window",
                    partitions: int | None = None) -> DataFrame:
    """Adds ``out``: 0-based position of the row within its series in ``order``.

    ``method``: ``'window'`` (one spilling sort per series, lazy) or ``'range'`` (range-partitioned, so a
    series may span many tasks; the numbered frame is written to the checkpoint folder at once).
    Both give the same positions.
    """
    keys = list(keys)
    if method == "window":
        return df.withColumn(out, (F.row_number().over(Window.partitionBy(*keys).orderBy(*_cols(order))) - 1)
                             .cast("long"))
    cells = range_cells(df, keys, order, partitions).withColumn("_ps_one", F.lit(1))
    return prefix_scan(cells, keys, order, sums={out: "_ps_one"}).withColumn(out, (F.col(out) - 1).cast("long")) \
        .drop("_ps_pid", "_ps_one")


def range_cells(df: DataFrame, keys: Sequence[str], order, partitions: int | None = None) -> DataFrame:
    """``df`` range-partitioned by (keys, order), with its partition as ``_ps_pid``, written to the checkpoint folder at once.

    A cell is the rows of a series in one partition.  Cells of a series follow one another by ``_ps_pid``.  The frame is
    written because range bounds come from sampling: two branches that each re-planned the exchange could disagree on
    which partition a row belongs to."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.repartitionByRange(n, *[F.col(k) for k in keys], *_cols(order))
                       .withColumn("_ps_pid", F.spark_partition_id()))


def prefix_scan(cells: DataFrame, keys: Sequence[str], order, lags: Mapping[str, str] | None = None,
                sums: Mapping[str, str] | None = None, lasts: Mapping[str, str] | None = None) -> DataFrame:
    """Running columns over series of any length, from ``range_cells``: new column -> source column.

    ``lags``: value of the previous row; ``sums``: sum up to this row (NULLs add nothing, NULL before the first value);
    ``lasts``: last value up to this row that isn't NULL.  Two levels: each cell is scanned alone, and what it hands on (its total, its
    last row, its last value) is carried to later cells by a window over one row per cell, at most one per partition and
    series.  No task reads more of a series than one cell."""
    keys, order = list(keys), _cols(order)
    lags, sums, lasts = dict(lags or {}), dict(sums or {}), dict(lasts or {})
    place = F.struct(*order)
    inside = Window.partitionBy("_ps_pid", *keys).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    along = Window.partitionBy(*keys).orderBy("_ps_pid")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    totals = [F.max_by(F.struct(F.col(c)), place)[c].alias(f"_ps_c_{o}") for o, c in lags.items()]
    totals += [F.sum(c).alias(f"_ps_c_{o}") for o, c in sums.items()]
    totals += [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), place)).alias(f"_ps_c_{o}") for o, c in lasts.items()]
    carried = cells.groupBy("_ps_pid", *keys).agg(*totals).select(
        F.col("_ps_pid").alias("_ps_j"), *[F.col(k).alias(f"_ps_j{i}") for i, k in enumerate(keys)], *[F.lag(f"_ps_c_{o}").over(along).alias(f"_ps_c_{o}") for o in lags],
        *[F.sum(f"_ps_c_{o}").over(earlier).alias(f"_ps_c_{o}") for o in sums],
        *[F.last(f"_ps_c_{o}", ignorenulls=True).over(earlier).alias(f"_ps_c_{o}") for o in lasts])
    local = cells.withColumns({"_ps_first": F.row_number().over(inside) == 1,
                               **{o: F.lag(c).over(inside) for o, c in lags.items()},
                               **{o: F.sum(c).over(upto) for o, c in sums.items()},
                               **{o: F.last(c, ignorenulls=True).over(upto) for o, c in lasts.items()}})
    same = [F.col("_ps_pid") == F.col("_ps_j"), *[F.col(k).eqNullSafe(F.col(f"_ps_j{i}")) for i, k in enumerate(keys)]]
    both = local.join(carried, same, "left").drop("_ps_j", *[f"_ps_j{i}" for i in range(len(keys))])
    out = {o: F.when(F.col("_ps_first"), F.col(f"_ps_c_{o}")).otherwise(F.col(o)) for o in lags}
    out.update({o: F.when(F.col(o).isNotNull() | F.col(f"_ps_c_{o}").isNotNull(),
                          F.coalesce(o, F.lit(0)) + F.coalesce(f"_ps_c_{o}", F.lit(0))) for o in sums})
    out.update({o: F.coalesce(o, f"_ps_c_{o}") for o in lasts})
    return both.withColumns(out).drop("_ps_first", *[f"_ps_c_{o}" for o in out])
