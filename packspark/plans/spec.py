"""Output contracts of registered queries.

A query's output is pinned to named, typed columns.  The same contract wraps the Spark
DataFrame and the DuckDB oracle text, so both engines return identical names and types.

Doubles are snapped to the nearest multiple of 2^-24 (~6e-8) with the same IEEE
operations in both engines (a power-of-two scale is exact), so last-bit differences of
sums or interpolations do not change the value.  A binary grid is used rather than
decimal rounding: decimal-derived data often lands exactly on a decimal half (e.g. the
median of two 6-decimal values), where engines round differently, but practically
never on a binary half.

Type ``g`` keeps 21 binary digits (six decimal ones) of a double instead, at any magnitude: for values such as
variances, p-values or Bayes factors that are small or large and don't come from cancelling differences.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SPARK_T = {"s": "string", "i": "int", "l": "bigint", "d": "double", "g": "double", "b": "boolean"}
_DUCK_T = {"s": "VARCHAR", "i": "INTEGER", "l": "BIGINT", "d": "DOUBLE", "g": "DOUBLE", "b": "BOOLEAN"}
GRID = 16777216.0  # 2^24
DIGITS = 20        # binary digits after the first that ``g`` keeps


def parse_cols(spec: str) -> list[tuple[str, str]]:
    out = []
    for part in spec.replace("\n", " ").split(","):
        part = part.strip()
        if part:
            name, t = part.rsplit(":", 1)
            out.append((name.strip(), t.strip()))
    return out


def finish_spark(df: DataFrame, spec: str) -> DataFrame:
    cols = []
    for name, t in parse_cols(spec):
        c = F.col(f"`{name}`").cast(_SPARK_T[t])
        if t == "d":
            c = F.when(F.abs(c) < 1e15, F.floor(c * GRID + 0.5).cast("double") / GRID).otherwise(c)
        elif t == "g":
            unit = F.pow(F.lit(2.0), F.floor(F.log2(F.abs(c))) - DIGITS)
            c = F.when(F.abs(c) < 1e-290, F.lit(0.0)).when(F.abs(c) < 1e290, F.floor(c / unit + 0.5).cast("double") * unit) \
                .otherwise(c)
        cols.append(c.alias(name))
    return df.select(*cols)


def finish_sql(inner: str, spec: str) -> str:
    cols = []
    for name, t in parse_cols(spec):
        c = f'CAST("{name}" AS {_DUCK_T[t]})'
        if t == "d":
            c = f"(CASE WHEN abs({c}) < 1e15 THEN floor({c} * {GRID!r} + 0.5) / {GRID!r} ELSE {c} END)"
        elif t == "g":
            unit = f"pow(2.0::DOUBLE, floor(log2(abs({c}))) - {DIGITS})"
            c = (f"(CASE WHEN abs({c}) < 1e-290 THEN 0.0::DOUBLE WHEN abs({c}) < 1e290 THEN floor({c} / {unit} + 0.5) * {unit} "
                 f"ELSE {c} END)")
        cols.append(f'{c} AS "{name}"')
    return f"SELECT {', '.join(cols)}\nFROM (\n{inner.strip()}\n) AS q"


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    cols: str
    sql: str | None = None          # DuckDB text of the inner query (None: no SQL twin)
    ids: list[str] = field(default_factory=list)   # inventory ids covered

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return finish_spark(self.build(spark, sf_dir), self.cols)

    def oracle(self) -> str | None:
        return None if self.sql is None else finish_sql(self.sql, self.cols)
