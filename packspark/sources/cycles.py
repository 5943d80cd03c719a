"""Cycle-table scan: filters and column lists are part of the plan, so they reach the source."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packspark.schema import ALL_COLUMNS, CORE_COLUMNS, instance_sort_cols, nan_to_null

# columns that aren't doubles
_TYPES = {"doe_number": "string", "instance_number": "string", "cycling_substate": "string", "cycle": "int",
          "start_time": "timestamp", "end_time": "timestamp"}


def _load(spark: SparkSession, source: str | DataFrame, fmt: str | None, options: dict | None) -> DataFrame:
    if isinstance(source, DataFrame):
        return source
    if fmt == "jdbc":
        return _load_jdbc(spark, source, dict(options or {}))
    if fmt is None and ("/" in source or source.endswith(".parquet")):
        return spark.read.parquet(source)
    if fmt is None:
        return spark.table(source)
    return spark.read.format(fmt).options(**(options or {})).load(source)


def split_ranges(column: str, low: int | None, high: int | None, parts: int) -> list[str]:
    """Predicates that cut a table by an integer column into ``parts`` ranges or fewer: every value in exactly one (also
    values outside ``low``..``high``, as rows may come in after these were asked for), nulls in the first."""
    if low is None or high is None or parts < 2 or high <= low:
        return ["1 = 1"]
    parts = min(int(parts), high - low + 1)
    edges = [low + (high - low + 1) * k // parts for k in range(1, parts)]
    lows, highs = [None, *edges], [*edges, None]
    out = []
    for a, b in zip(lows, highs):
        both = [f"{column} >= {a}"] * (a is not None) + [f"{column} < {b}"] * (b is not None)
        out.append(" AND ".join(both) if a is not None else f"({both[0]} OR {column} IS NULL)")
    return out


def _load_jdbc(spark: SparkSession, source: str, options: dict) -> DataFrame:
    """A warehouse table (or subquery) by JDBC.  With the options ``splitColumn`` (an integer column) and ``splits`` one
    small query asks for the column's bounds and the table is read by as many tasks, a range each."""
    column, parts = options.pop("splitColumn", None), int(options.pop("splits", 1))
    reader = spark.read.format("jdbc").options(**options)
    if column is None or parts < 2:
        return reader.option("dbtable", source).load()
    bounds = reader.option("query", f"SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM {source}").load().first()
    low, high = (None if v is None else int(v) for v in bounds)
    own = {k: v for k, v in options.items() if k != "url"}
    return spark.read.jdbc(options["url"], source, predicates=split_ranges(column, low, high, parts), properties=own)


def read_cycles(spark: SparkSession, source: str | DataFrame, doe: str | None = None,
                instances: Iterable | None = None, cycles: Iterable | None = None,
                columns: str | Sequence[str] = "all", fmt: str | None = None,
                options: dict | None = None, sort: bool = False, where: str | None = None,
                strict: bool = False) -> DataFrame:
    """Cycle summary rows of one test (``doe``), optional instance and cycle lists.

    ``cycle = 0`` rows are excluded.  ``columns`` is ``'all'``, ``'core'`` or a list.  The
    columns of the first two that the source lacks are typed NULLs (``strict``: an error that names them).  The
    predicates are typed (string ids are compared as strings), so they push down to
    parquet / JDBC.  ``where`` adds a SQL predicate text.  Rows are sorted (numeric-first
    instance order) only when ``sort``.  ``fmt='jdbc'`` takes the options ``splitColumn`` and ``splits`` to read in ranges.
    """
    df = _load(spark, source, fmt, options)
    cond = F.col("cycle") != 0
    if doe is not None:
        cond = cond & (F.col("doe_number") == str(doe))
    if instances is not None:
        cond = cond & F.col("instance_number").isin([str(i) for i in instances])
    if cycles is not None:
        cond = cond & F.col("cycle").isin([int(c) for c in cycles])
    if columns in ("all", "core"):
        wanted = ALL_COLUMNS if columns == "all" else CORE_COLUMNS
        missing = [c for c in wanted if c not in df.columns]
        if missing and strict:
            raise ValueError(f"the source lacks the columns {missing}")
        cols = [F.col(c) if c in df.columns else F.lit(None).cast(_TYPES.get(c, "double")).alias(c)
                for c in wanted]
    else:
        cols = list(columns)
    if where:
        cond = cond & F.expr(where)
    out = nan_to_null(df.where(cond).select(*cols))
    if sort:
        out = out.orderBy(F.col("doe_number"), *instance_sort_cols(), F.col("cycle"))
    return out


def read_sql(spark: SparkSession, query: str, **tables: DataFrame) -> DataFrame:
    """A user query over catalog tables, or over DataFrames passed by name and referenced as
    ``{name}`` in the text (bound to private views, so concurrent queries cannot collide)."""
    return spark.sql(query, **tables) if tables else spark.sql(query)


def normalise_ids(df: DataFrame, id_cols: Sequence[str] = ("instance_number",),
                  numeric_text: Sequence[str] = ()) -> DataFrame:
    """Ids as strings (all-digit ids keep their digits); numeric text columns to double."""
    cols = {c: F.col(c).cast("string") for c in id_cols if c in df.columns}
    cols.update({c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in numeric_text if c in df.columns})
    return df.withColumns(cols)
