"""Side-by-side check of a registered query against its DuckDB twin (tests and scripts)."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck_conn(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (0, "")
        return (1, repr(v))
    return (1, str(v))


def compare(sp, dk) -> str | None:
    """Order-insensitive comparison of two pandas frames; an error text or None."""
    if sorted(sp.columns) != sorted(dk.columns):
        return f"columns differ: spark={sorted(sp.columns)} duck={sorted(dk.columns)}"
    cols = sorted(sp.columns)
    if len(sp) != len(dk):
        return f"row count spark={len(sp)} duck={len(dk)}"
    a = sorted(tuple(_norm(v) for v in r) for r in sp[cols].astype(object).itertuples(index=False))
    b = sorted(tuple(_norm(v) for v in r) for r in dk[cols].astype(object).itertuples(index=False))
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        x, y = bad[0]
        diff = {c: (xx, yy) for c, xx, yy in zip(cols, x, y) if xx != yy}
        return f"{len(bad)} rows differ; first: {diff}"
    return None
