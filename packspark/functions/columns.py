"""Scalar and window column expressions used across operators.

Everything here returns a ``Column`` built from ``pyspark.sql.functions`` so that
it stays inside whole-stage code generation.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_div(num: ColumnOrName, den: ColumnOrName) -> Column:
    """Division that yields NULL for a zero or NULL divisor (ANSI mode raises otherwise)."""
    return F.try_divide(_c(num), _c(den))


def second_row(x: ColumnOrName, keys: Sequence[str], order: Sequence[ColumnOrName]) -> Column:
    """Value of the second row of the group in ``order`` (NULL when the group has one row).

    A NULL in the second row stays NULL: nulls are counted as rows.
    """
    w = (Window.partitionBy(*keys).orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.nth_value(_c(x), 2).over(w)


def bin_right_closed(x: ColumnOrName, uppers: Sequence[float], labels: Sequence[float]) -> Column:
    """Right-closed binning ``(-inf, u0], (u0, u1], ...``; above the last bound -> NULL.

    ``uppers`` ascending.  Spark's ``Bucketizer`` is left-closed, so it is not used.
    """
    col = _c(x)
    expr = None
    for u, lab in zip(uppers, labels):
        cond = col <= F.lit(float(u))
        expr = F.when(cond, F.lit(float(lab))) if expr is None else expr.when(cond, F.lit(float(lab)))
    return expr


def pct_text(x: ColumnOrName, digits: int = 2) -> Column:
    """Percent as text: half-to-even rounding then ``'%'`` (e.g. ``98.26%``, ``3.5%``)."""
    return F.concat(F.bround(_c(x), digits).cast("string"), F.lit("%"))


def title_label(x: ColumnOrName) -> Column:
    """``'max_temp'`` -> ``'Max Temp'``; ``'CHARGE REST'`` -> ``'Charge Rest'``."""
    return F.initcap(F.regexp_replace(_c(x), "_", " "))


def rowwise_mean(cols: Sequence[str]) -> Column:
    total = None
    for c in cols:
        total = F.col(c) if total is None else total + F.col(c)
    return total / F.lit(float(len(cols)))


def rowwise_std(cols: Sequence[str], ddof: int = 1) -> Column:
    """Standard deviation across columns of one row (two-pass, numerically stable)."""
    m = rowwise_mean(cols)
    ss = None
    for c in cols:
        d = (F.col(c) - m) * (F.col(c) - m)
        ss = d if ss is None else ss + d
    return F.sqrt(ss / F.lit(float(len(cols) - ddof)))


def ci95_bounds(mean: Column, std: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Normal-approximation 95 % interval of a mean."""
    half = F.lit(z) * safe_div(std, F.sqrt(n.cast("double")))
    return mean - half, mean + half


def normal_draw(parts: Sequence[str], seed: int) -> Column:
    """A standard normal number that depends on the values of ``parts`` and the seed alone, not on partitions or order: two
    uniform numbers from the first 26 hex digits of an MD5, turned normal by Box and Muller's rule."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts]).cast("binary"))
    u1, u2 = ((F.conv(F.substring(digest, at, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(2.0 ** 52) for at in (1, 14))
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
