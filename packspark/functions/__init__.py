"""Column-level helpers (JVM-side expressions only)."""

from packspark.functions.columns import (  # noqa: F401
    bin_right_closed,
    ci95_bounds,
    pct_text,
    rowwise_mean,
    rowwise_std,
    safe_div,
    second_row,
    title_label,
)
