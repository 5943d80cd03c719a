"""Series cleaning: rolling-median outlier replacement and sigma bands.

All functions are lazy ``DataFrame -> DataFrame`` transforms.  Rolling statistics are
computed over an explicit row frame ``Window.partitionBy(keys).orderBy(order)`` so the
result never depends on file order; ``order`` must be unique within a series.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnOrName = Column | str

# Above this frame width the per-row frame re-aggregation of the native path
# (O(rows * window)) loses to a vectorised rolling median over bounded row blocks
# (measured crossover at window 12-16 on long series, local[8]).
NATIVE_MAX_WINDOW = 16


def _as_list(x) -> list:
    if x is None:
        return []
    if isinstance(x, (str, Column)):
        return [x]
    return list(x)


def _order_cols(order) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in _as_list(order)]


def outlier_replace_expr(value: str, md: Column, sd: Column, sigma_multiplier: float) -> Column:
    """Replace ``x`` by the rolling median where ``|x - md| / sd > k``.

    The multiplied form needs no division and is equal: with ``sd = 0`` every value of
    the frame equals ``x``, so ``x = md`` and nothing is replaced.  NULL stays NULL.
    """
    x = F.col(value)
    return F.when(F.abs(x - md) > F.lit(float(sigma_multiplier)) * sd, md).otherwise(x)


def rolling_outlier_replace(df: DataFrame, value: str | Sequence[str], keys: Sequence[str], order,
                            window: int = 5, sigma_multiplier: float = 0.1,
                            out: str | Sequence[str] | None = None, method: str = "auto",
                            block_rows: int | None = None, position_method: str = "window",
                            restore_partitioning: Sequence[str] | None = None) -> DataFrame:
    """Rolling outlier replacement of one or more columns, per series.

    ``md``/``sd`` come from the original series (not recursive).  ``method``:
    ``'native'`` – built-in functions only: up to NATIVE_MAX_WINDOW rows the frame's values come from ``lag``
    (``_lagged_median``), wider frames are a framed ``percentile``/``stddev_pop`` window;
    ``'blocked'`` – rows numbered per series, cut into blocks of ``block_rows`` plus a
    ``window-1`` halo from the previous block, and each bounded block cleaned with a
    vectorised rolling median in an Arrow batch; ``'auto'`` picks by window width.
    ``position_method`` (blocked only): ``'window'`` or ``'range'``,
    see ``ordering.series_position``; ``'range'`` lets one huge series use many tasks, and
    the result is then repartitioned by ``restore_partitioning`` (default ``keys``).
    """
    values = _as_list(value)
    outs = _as_list(out) or values
    keys = list(keys)
    if window < 1:
        raise ValueError("window must be >= 1")
    if method == "auto":
        method = "native" if window <= NATIVE_MAX_WINDOW else "blocked"
    if method == "native" and window <= NATIVE_MAX_WINDOW:
        d = _lagged_median(df, values, Window.partitionBy(*keys).orderBy(*_order_cols(order)), window)
        cleaned = {o: outlier_replace_expr(v, F.col(f"_ps_md{i}"), F.col(f"_ps_sd{i}"), sigma_multiplier)
                   for i, (v, o) in enumerate(zip(values, outs))}
        return d.withColumns(cleaned).drop(*d.columns[len(df.columns):])
    if method == "native":
        w = Window.partitionBy(*keys).orderBy(*_order_cols(order)).rowsBetween(-(window - 1), 0)
        cols = {}
        for v, o in zip(values, outs):
            x = F.col(v)
            md = F.percentile(x, F.lit(0.5)).over(w)
            sd = F.stddev_pop(x).over(w)
            cols[o] = outlier_replace_expr(v, md, sd, sigma_multiplier)
        return df.withColumns(cols)
    if method == "blocked":
        return _blocked_rolling(df, values, outs, keys, order, window, sigma_multiplier, block_rows,
                                position_method=position_method, restore=restore_partitioning)
    raise ValueError(f"unknown method {method!r}")


def _lagged_median(df: DataFrame, values: Sequence[str], series: WindowSpec, window: int) -> DataFrame:
    """``df`` with the median and the population deviation of the last ``window`` rows of each value column: _ps_md0, _ps_sd0, ...

    A framed ``percentile`` fills and sorts a hash map of its own at every row.  Here the frame's values come by ``lag`` into a
    sorted array, and only count and deviation are framed aggregates.  The median equals ``percentile(x, 0.5)``.
    NaN in place of NULL sorts behind the values, so the first n places hold these (and an array without NULLs sorts faster)."""
    frame = series.rowsBetween(-(window - 1), 0)
    helpers, held, medians = {}, {}, {}
    for i, v in enumerate(values):
        x = F.col(v).cast("double")
        lags = {f"_ps_l{i}_{k}": F.lag(x, k).over(series) if k else x for k in range(window)}
        helpers |= lags | {f"_ps_n{i}": F.count(x).over(frame).cast("int"), f"_ps_sd{i}": F.stddev_pop(x).over(frame)}
        held[f"_ps_s{i}"] = F.sort_array(F.array(*[F.coalesce(c, F.lit(float("nan"))) for c in lags]))
        low, high = (F.get(f"_ps_s{i}", F.shiftright(F.col(f"_ps_n{i}") - k, 1)) for k in (1, 0))
        medians[f"_ps_md{i}"] = F.when(low == high, low).otherwise(low * 0.5 + high * 0.5)
    return df.withColumns(helpers).withColumns(held).withColumns(medians)


def _blocked_rolling(df, values, outs, keys, order, window, k, block_rows, position_method="window",
                     restore=None):
    """Blocked rolling filter.

    Rows are numbered per series, cut into blocks of ``b`` rows and each block gets the
    previous ``window-1`` rows as a halo, so every block is cleaned on its own; sorted
    blocks are streamed through ``mapInArrow`` (vectorised grouped rolling median; memory
    per task is one Arrow batch plus at most one block).  Only the value columns (as doubles) are
    looked at; the others pass through as they are.

    With ``position_method='window'`` the blocks stay where the numbering put them (no extra shuffle; the
    numbering sorts with spilling).  With ``'range'`` a series is numbered over many tasks and its blocks are
    hash-spread.  The result is repartitioned by ``restore`` when given (and by the series keys
    after a spread), so that later stages keyed by it share one exchange.
    """
    from packspark.operators.ordering import series_position
    b = int(block_rows or max(8 * window, 4096))
    if b < window - 1:
        raise ValueError("block_rows must be at least window - 1")
    spread = position_method == "range"
    d = series_position(df, keys, order, "_ps_idx", method=position_method)
    blk = F.floor(F.col("_ps_idx") / b)
    in_halo = (F.col("_ps_idx") % b) >= (b - (window - 1)) if window > 1 else F.lit(False)
    d = d.withColumn("_ps_own", blk).withColumn(
        "_ps_blk", F.explode(F.when(in_halo, F.array(blk, blk + 1)).otherwise(F.array(blk))))
    d = d.withColumns({o: F.col(v).cast("double") for v, o in zip(values, outs)})
    out_schema = T.StructType(d.schema.fields)
    gcols = [*keys, "_ps_blk"]
    if spread:
        d = d.repartition(*gcols)
    d = d.sortWithinPartitions(*gcols, "_ps_idx")
    res = d.mapInArrow(_block_cleaner(list(outs), window, k), out_schema).drop("_ps_idx", "_ps_own", "_ps_blk")
    if spread or restore:
        # Spark does not carry a partitioning through mapInPandas: one explicit repartition
        # lets every later stage keyed by ``restore`` reuse it instead of shuffling per stage
        res = res.repartition(*(restore or keys))
    return res


def _block_cleaner(out_cols, window, k):
    """Cleans sorted rows block by block.  A block starts where the block number changes or the position in
    the series doesn't grow."""
    def starts(t: pa.Table) -> np.ndarray:
        blk, idx = t.column("_ps_blk").to_numpy(), t.column("_ps_idx").to_numpy()
        return np.append(True, (blk[1:] != blk[:-1]) | (idx[1:] <= idx[:-1]))

    def process(t: pa.Table) -> Iterator[pa.RecordBatch]:
        group = np.cumsum(starts(t))
        for o in out_cols:
            s = pd.Series(t.column(o).to_numpy(), dtype="float64")
            r = s.groupby(group, sort=False).rolling(window, min_periods=1)
            md, sd = r.median().to_numpy(), r.std(ddof=0).to_numpy()
            x = s.to_numpy()
            hit = np.abs(x - md) > k * sd
            t = t.set_column(t.schema.get_field_index(o), t.schema.field(o),
                             pa.array(np.where(hit, md, x), pa.float64(), mask=np.isnan(x)))
        own = pc.equal(t.column("_ps_blk"), t.column("_ps_own"))
        yield from t.filter(own).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            if not t.num_rows:
                continue
            last = int(np.flatnonzero(starts(t))[-1])
            if last:
                yield from process(t.slice(0, last))
            held = t.slice(last)
        if held is not None and held.num_rows:
            yield from process(held)

    return run


def segment_clean(df: DataFrame, value: str, keys: Sequence[str], cycle: str = "cycle",
                  split_cycle: int = 201, window: int = 5, sigma_multiplier: float = 0.1,
                  out: str | None = None) -> DataFrame:
    """Clean cycles ``< split-1`` and ``> split`` separately; ``split-1..split`` untouched."""
    out = out or value
    c = F.col(cycle)
    seg = F.when(c < split_cycle - 1, 0).when(c <= split_cycle, 1).when(c > split_cycle, 2)
    d = df.withColumn("_ps_seg", seg)
    cleaned = rolling_outlier_replace(d, value, [*keys, "_ps_seg"], cycle, window, sigma_multiplier,
                                      out="_ps_clean", method="native")
    return cleaned.withColumn(out, F.when(F.col("_ps_seg") == 1, F.col(value))
                              .otherwise(F.col("_ps_clean"))).drop("_ps_seg", "_ps_clean")


def sigma_band_filter(df: DataFrame, value: str, keys: Sequence[str], sigma_multiplier: float = 3.0,
                      ddof: int = 0) -> DataFrame:
    """Keep rows within ``median ± k·std`` of their group (closed band)."""
    w = Window.partitionBy(*keys)
    x = F.col(value)
    md = F.median(x).over(w)
    sd = (F.stddev_pop(x) if ddof == 0 else F.stddev_samp(x)).over(w)
    k = F.lit(float(sigma_multiplier))
    return (df.withColumn("_ps_md", md).withColumn("_ps_sd", sd)
            .where((x >= F.col("_ps_md") - k * F.col("_ps_sd")) & (x <= F.col("_ps_md") + k * F.col("_ps_sd")))
            .drop("_ps_md", "_ps_sd"))


def clamp_early_global(df: DataFrame, value: str, by: Sequence[str], order: str = "cycle",
                       first_n: int = 5, few_groups: bool = False) -> DataFrame:
    """Rows with ``order < first_n`` take the median of all such rows of their ``by`` group.

    The median table has one row per ``by`` group (e.g. one per cycling state); it is an
    exact median, found by radix selection over counted values (no task holds a group).  It is joined
    back without a hint: adaptive execution measures
    the materialised table and turns the join into a broadcast only when it is below
    the broadcast threshold, otherwise it stays a shuffle join.  That shuffle has gone by then: all rows of a group are
    in one task, also in later windows on finer keys.  A caller whose groups are few and fixed says so with ``few_groups``:
    the table is broadcast and the rows stay where they are.
    """
    from packspark.operators.median import group_median
    early = F.col(order) < first_n
    med = group_median(df.where(early), value, list(by), out="_ps_early_md")
    d = df.join(F.broadcast(med) if few_groups else med, on=list(by), how="left")
    return d.withColumn(value, F.when(early, F.col("_ps_early_md")).otherwise(F.col(value))).drop("_ps_early_md")


def clamp_early_series(df: DataFrame, value: str, keys: Sequence[str], order: str = "elapsed_minutes",
                       below: float = 1.0) -> DataFrame:
    """Within each series, values with ``order < below`` take the median of those values."""
    early = F.col(order) < below
    md = F.median(F.when(early, F.col(value))).over(Window.partitionBy(*keys))
    return df.withColumn(value, F.when(early, md).otherwise(F.col(value)))


def group_screen(df: DataFrame, keys: Sequence[str], value: str = "norm_discharge_energy",
                 order: str = "cycle", min_above: float = 0.64, max_below: float = 1.05,
                 min_last_order: float = 250) -> DataFrame:
    """Keep whole groups with ``min(value) > a``, ``max(value) < b`` and ``max(order) > c``."""
    w = Window.partitionBy(*keys)
    ok = ((F.min(value).over(w) > min_above) & (F.max(value).over(w) < max_below)
          & (F.max(order).over(w) > min_last_order))
    return df.withColumn("_ps_ok", ok).where(F.col("_ps_ok")).drop("_ps_ok")
