"""Key dialects, states and schema helpers shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The two naming dialects for the same keys.
CYCLE_KEYS = ("doe_number", "instance_number")
CYCLE_ORDER = "cycle"
CYCLE_STATE = "cycling_substate"
SERIES_KEYS = ("doe", "instance", "cycle_num", "charging_state_name")
SERIES_ORDER = "elapsed_minutes"
CYCLE_TO_SERIES = {
    "doe_number": "doe",
    "instance_number": "instance",
    "cycle": "cycle_num",
    "cycling_substate": "charging_state_name",
}

# Cycling substates.
CHARGE = "CHARGE"
CHARGE_REST = "CHARGE REST"
DISCHARGE = "DISCHARGE"
DISCHARGE_REST = "DISCHARGE REST"
DCIR = "DCIR"
STATES = (CHARGE, CHARGE_REST, DISCHARGE, DISCHARGE_REST, DCIR)

# The short column list of the cycle summary table.
CORE_COLUMNS = ("doe_number", "instance_number", "cycle", "cycling_substate", "energy",
                "energy_rest", "time", "mean_mean_voltage", "dcir", "min_temp")

CELLS = (1, 2, 3, 4, 5)


def cell_cols(kind: str) -> list[str]:
    """``kind`` is ``'min'`` or ``'max'``: per-cell voltage columns of the cycle table."""
    return [f"{kind}_cell{i}_voltage_v" for i in CELLS]


# All columns of the cycle summary table.
ALL_COLUMNS = (
    "doe_number", "instance_number", "cycle", "cycling_substate", "start_time", "end_time", "capacity", "soc_5_min",
    "time", "energy", "energy_rest", "capacity_charge_cc", "capacity_charge_cv", "time_charge_cc", "time_charge_cv",
    "energy_charge_cc", "energy_charge_cv", "avg_temp", "max_temp", "min_temp", "mean_mean_voltage", "min_mean_voltage",
    "max_mean_voltage", "mean_min_voltage", "min_min_voltage", "max_min_voltage", "mean_max_voltage", "min_max_voltage",
    "max_max_voltage", "mean_mean_current", "min_mean_current", "max_mean_current", "mean_min_current",
    "min_min_current", "max_min_current", "mean_max_current", "min_max_current", "max_max_current",
    "avg_sum_cell_voltage_v", "avg_cell1_voltage_v", "min_cell1_voltage_v", "max_cell1_voltage_v",
    "avg_cell2_voltage_v", "max_cell2_voltage_v", "min_cell2_voltage_v", "avg_cell3_voltage_v", "min_cell3_voltage_v",
    "max_cell3_voltage_v", "avg_cell4_voltage_v", "min_cell4_voltage_v", "max_cell4_voltage_v", "avg_cell5_voltage_v",
    "min_cell5_voltage_v", "max_cell5_voltage_v", "avg_cell6_voltage_v", "min_cell6_voltage_v", "max_cell6_voltage_v",
    "avg_rest_current_a", "min_rest_current_a", "max_rest_current_a", "avg_rest_voltage_v", "min_rest_voltage_v",
    "max_rest_voltage_v", "dcir")


def instance_sort_cols(col: str = "instance_number") -> list[Column]:
    """Ids are strings; all-digit ids sort numerically first, others by text."""
    c = F.col(col)
    return [F.expr(f"try_cast(`{col}` AS BIGINT)").asc_nulls_last(), c.asc()]


def nan_to_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Missing values are NULL in Spark; a NaN from a source would poison avg/sort."""
    dbl = [f.name for f in df.schema.fields
           if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and (cols is None or f.name in cols)]
    if not dbl:
        return df
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast(T.DoubleType())) for c in dbl})


def rename_cycle_to_series(df: DataFrame) -> DataFrame:
    present = {k: v for k, v in CYCLE_TO_SERIES.items() if k in df.columns}
    return df.withColumnsRenamed(present)
