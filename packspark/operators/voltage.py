"""Resistance, voltage, polarization and temperature tables of the cycle table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packspark.functions.columns import rowwise_std
from packspark.operators.clean import clamp_early_global, rolling_outlier_replace
from packspark.operators.stats import mean_ci
from packspark.schema import CHARGE, CHARGE_REST, CYCLE_KEYS, DISCHARGE, DISCHARGE_REST

# Which per-cell column a state uses (max while charging / after discharge).
STATE_CELL_KIND = {CHARGE: "max", CHARGE_REST: "min", DISCHARGE: "min", DISCHARGE_REST: "max"}
CELL_OUT = [f"cell{i}_voltage_v" for i in range(1, 6)]
REST_STATES = (CHARGE_REST, DISCHARGE_REST)


def dcir_table(df: DataFrame) -> DataFrame:
    """Rows with a resistance value, in milliohm rounded half-to-even to 0.1."""
    return (df.where(F.col("dcir").isNotNull())
            .select(*CYCLE_KEYS, "cycle", F.bround(F.col("dcir") * 1000.0, 1).alias("dcir")))


def dcir_series(df: DataFrame, hue: str = "instance_number") -> DataFrame:
    """Mean and 95 % interval of DCIR (mΩ) per cycle and hue."""
    return mean_ci(dcir_table(df), "cycle", "dcir", [hue])


def mean_voltage_series(df: DataFrame, hue: str = "instance_number", state: str = CHARGE,
                        raw_data: bool = True, window: int = 5, sigma_multiplier: float = 0.2) -> DataFrame:
    """Mean charge voltage per cycle and hue; cleaned per (doe, instance) unless ``raw_data``."""
    d = df.where(F.col("cycling_substate") == state)
    if not raw_data:
        d = rolling_outlier_replace(d, "mean_mean_voltage", CYCLE_KEYS, "cycle", window, sigma_multiplier)
    return mean_ci(d, "cycle", "mean_mean_voltage", [hue])


def state_cells(df: DataFrame, states: Sequence[str] = tuple(STATE_CELL_KIND)) -> DataFrame:
    """Rows of the four charge/rest states with the state's five cell voltages as ``cell{i}_voltage_v``."""
    st = F.col("cycling_substate")
    cols = {}
    for i in range(1, 6):
        mx, mn = F.col(f"max_cell{i}_voltage_v"), F.col(f"min_cell{i}_voltage_v")
        cols[f"cell{i}_voltage_v"] = F.when(st.isin(CHARGE, DISCHARGE_REST), mx).otherwise(mn)
    return (df.where(st.isin(*states)).withColumns(cols)
            .select(*CYCLE_KEYS, "cycling_substate", "cycle", *CELL_OUT))


def cell_voltage_std(df: DataFrame, window: int = 5, sigma_multiplier: float = 0.1) -> DataFrame:
    """Per state: drop incomplete rows, clean each cell per (doe, instance, state), spread in mV.

    ``std_mv`` = sample standard deviation of the five cleaned cells × 1000, rounded
    half-to-even to an integer.
    """
    d = state_cells(df).dropna(subset=[*CYCLE_KEYS, "cycling_substate", "cycle", *CELL_OUT])
    d = rolling_outlier_replace(d, CELL_OUT, [*CYCLE_KEYS, "cycling_substate"], "cycle", window,
                                sigma_multiplier)
    return d.withColumn("std_mv", F.bround(rowwise_std(CELL_OUT, ddof=1) * 1000.0, 0))


def cell_std_series(df: DataFrame, window: int = 5, sigma_multiplier: float = 0.1) -> DataFrame:
    """Mean and 95 % interval of the five-cell spread per cycle and state."""
    return mean_ci(cell_voltage_std(df, window, sigma_multiplier), "cycle", "std_mv", ["cycling_substate"])


def pick_instance(df: DataFrame, seed: int | None = None, instance: str = "instance_number") -> DataFrame:
    """Rows of one pack of ``df``: the smallest id, or with a ``seed`` the pack whose id and seed have the smallest MD5, which
    is any pack with equal chance and the same one on every run.  The id is found by one aggregation that combines before the
    shuffle; an empty frame stays empty."""
    order = F.col(instance) if seed is None else F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(instance)).cast("binary"))
    pick = df.where(F.col(instance).isNotNull()).agg(F.min_by(instance, F.struct(order, instance)).alias("_ps_pick"))
    return df.where(F.col(instance) == pick.select("_ps_pick").scalar())


def cell_voltage_long(df: DataFrame, raw_data: bool = True, window: int = 5,
                      sigma_multiplier: float = 0.1, instance: str | None = None) -> DataFrame:
    """Long table (doe, instance, state, cycle, cell, voltage); cleaned per cell unless ``raw_data``.

    ``instance`` restricts the table to one pack; by default every pack is returned
    (cleaning is per pack and cell either way).  ``pick_instance`` chooses one where none is named.
    """
    if instance is not None:
        df = df.where(F.col("instance_number") == str(instance))
    d = state_cells(df).dropna(subset=["cycle", *CELL_OUT])
    if not raw_data:
        # each cell is its own series: cleaning the five columns per (pack, state) in one
        # window pass equals cleaning per (pack, state, cell) after the melt, and shuffles
        # five times fewer rows
        d = rolling_outlier_replace(d, CELL_OUT, [*CYCLE_KEYS, "cycling_substate"], "cycle", window,
                                    sigma_multiplier)
    long = d.unpivot([*CYCLE_KEYS, "cycling_substate", "cycle"], CELL_OUT, "cell_col", "voltage")
    return long.withColumn("cell", F.regexp_extract("cell_col", r"(cell\d)", 1)).drop("cell_col")


POLARIZATION_COLS = [f"cell{i}_delta_voltage" for i in range(1, 6)] + ["pack_delta_voltage"]


def polarization(df: DataFrame) -> DataFrame:
    """Max − min cell and pack voltage of the rest states, one row per (doe, instance, cycle, state).

    The cycle table holds one row per key; of several rows the first one is used: the smallest
    ``start_time`` when there is that column, ties by the values themselves.
    """
    d = df.where(F.col("cycling_substate").isin(*REST_STATES))
    cols = {f"cell{i}_delta_voltage": F.col(f"max_cell{i}_voltage_v") - F.col(f"min_cell{i}_voltage_v")
            for i in range(1, 6)}
    cols["pack_delta_voltage"] = F.col("max_rest_voltage_v") - F.col("min_rest_voltage_v")
    keys = [*CYCLE_KEYS, "cycle", "cycling_substate"]
    at = [F.col("start_time")] if "start_time" in d.columns else []
    row = F.struct(*[c.alias(n) for n, c in cols.items()])
    one = d.groupBy(*keys).agg(F.min_by(row, F.struct(*at, row)).alias("_ps_row"))
    return one.select(*keys, *[F.col("_ps_row")[n].alias(n) for n in cols])


def polarization_clean(df: DataFrame, window: int = 5, sigma_multiplier: float = 0.1) -> DataFrame:
    """Polarization with each delta column cleaned per (doe, instance, state)."""
    return rolling_outlier_replace(polarization(df), POLARIZATION_COLS, [*CYCLE_KEYS, "cycling_substate"],
                                   "cycle", window, sigma_multiplier)


def temperature_clean(df: DataFrame, y: str = "max_temp", x: str = "cycle", clean_first_n_cycles: int = 5,
                      window: int = 7, sigma_multiplier: float = 0.5, extra: Sequence[str] = ()) -> DataFrame:
    """Per state: drop NULL ``y``, early cycles to the state-wide median, then clean per pack.

    ``extra`` columns are carried along; ``doe_instance`` is made from the pack key when it is missing."""
    d = df.where(F.col("cycling_substate").isin(*STATE_CELL_KIND)).where(F.col(y).isNotNull())
    more = [c for c in extra if c not in (*CYCLE_KEYS, "cycling_substate", x, y)]
    if "doe_instance" in more and "doe_instance" not in d.columns:
        d = d.withColumn("doe_instance", F.concat_ws("_", *[F.col(k).cast("string") for k in CYCLE_KEYS]))
    d = d.select(*CYCLE_KEYS, "cycling_substate", x, y, *more)
    # four states at most; a join by state would put all packs of a state into one task, and the windows below with them
    d = clamp_early_global(d, y, ["cycling_substate"], x, clean_first_n_cycles, few_groups=True)
    return rolling_outlier_replace(d, y, [*CYCLE_KEYS, "cycling_substate"], x, window, sigma_multiplier)


def temperature_series(df: DataFrame, y: str = "max_temp", x: str = "cycle", hue: str = "instance_number",
                       clean_first_n_cycles: int = 5, window: int = 7, sigma_multiplier: float = 0.5) -> DataFrame:
    """Mean and 95 % interval of the cleaned temperature per state, x and hue."""
    t = temperature_clean(df, y, x, clean_first_n_cycles, window, sigma_multiplier, extra=[hue])
    return mean_ci(t, x, y, ["cycling_substate", hue])


# Metrics of the dense series that can be plotted.
SERIES_METRICS = ("avg_current_a", "avg_voltage_v", "avail_battery_capacity_ah", "battery_temperature_deg_c",
                 "min_current_a", "max_current_a", "min_voltage_v", "max_voltage_v", "current_a", "voltage_v")


def series_metric_means(df: DataFrame, metrics: Sequence[str], state: str = CHARGE, x: str = "elapsed_minutes",
                        hue: str = "doe_instance") -> DataFrame:
    """Mean and 95 % interval of the chosen metrics per ``hue`` and ``x``, as the series plots show them."""
    carried = [] if hue in ("doe_instance", x) else [hue]
    return mean_ci(series_metrics(df, metrics, state, x, extra=carried), x, "value", [hue, "metric"])


def series_metrics(df: DataFrame, metrics: Sequence[str], state: str = CHARGE, x: str = "elapsed_minutes",
                  extra: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Long table (doe_instance, x, metric, value) of the chosen metrics for one charging state.

    Current is made positive.  An unknown state gives an empty table.
    """
    bad = [m for m in metrics if m not in SERIES_METRICS]
    if bad:
        raise ValueError(f"unknown metrics {bad}; choose from {SERIES_METRICS}")
    d = (df.where(F.col("charging_state_name") == state)
         .withColumn("doe_instance", F.concat_ws("_", F.col("doe").cast("string"), F.col("instance").cast("string"))))
    if "avg_current_a" in d.columns:
        d = d.withColumn("avg_current_a", F.abs("avg_current_a"))
    keep = ["doe_instance", x, *[e for e in extra if e != x]]
    return d.unpivot(keep, list(metrics), "metric", "value")


def delta_temperature(df: DataFrame, low: str = "min_temp", high: str = "max_temp", out: str = "delta_temp") -> DataFrame:
    """Adds the temperature rise of each row, ``high - low``; NULL where either is."""
    return df.withColumn(out, F.col(high) - F.col(low))
