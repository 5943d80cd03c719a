"""Registered queries: capacity bounds, outlier-cycle drop, capacity/time uncertainty, regimes."""

from __future__ import annotations

from packspark.operators import uncertainty as un
from packspark.plans import adapters as ad
from packspark.plans import sqltext as sq
from packspark.plans.registry import register
from packspark.plans.sqltext import lit

W = sq.with_
SER = "doe, instance, cycle_num"
ORD = "elapsed_minutes, sample_id"
SER_COLS = "doe:s, instance:s, cycle_num:i"
CB_COLS = (SER_COLS + ", sample_id:l, elapsed_minutes:d, avg_current_a:d, error_pc:d, avg_current_a_lower_bound:d, "
           "avg_current_a_upper_bound:d, capacity:d, capacity_lower_bound:d, capacity_upper_bound:d")


def _cum(expr: str) -> str:
    return (f"CASE WHEN ({expr}) IS NOT NULL THEN sum({expr}) OVER (PARTITION BY {SER} ORDER BY {ORD} "
            f"ROWS UNBOUNDED PRECEDING) / 60.0 END")


def _pick(a: str, b: str, low: bool) -> str:
    x, y = (a, b) if low else (b, a)
    return f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN (CASE WHEN {a} <= {b} THEN {x} ELSE {y} END) END"


CB_CTES = f"""
cb0 AS (
  SELECT doe, instance, cycle_num, sample_id, elapsed_minutes, avg_current_a,
         CASE WHEN avg_current_a <= {lit(-3.0)} THEN {lit(1.0)} WHEN avg_current_a <= {lit(-1.5)} THEN {lit(1.5)}
              WHEN avg_current_a <= {lit(-1.0)} THEN {lit(2.0)} WHEN avg_current_a <= {lit(0.0)} THEN {lit(8.0)} END AS error_pc
  FROM samples WHERE charging_state_name = 'CHARGE' AND avg_current_a IS NOT NULL),
cb1 AS (
  SELECT *, avg_current_a * (1.0::DOUBLE + error_pc * 0.01::DOUBLE) + 0.0::DOUBLE AS avg_current_a_lower_bound,
         avg_current_a * (1.0::DOUBLE - error_pc * 0.01::DOUBLE) - 0.0::DOUBLE AS avg_current_a_upper_bound,
         elapsed_minutes - lag(elapsed_minutes) OVER (PARTITION BY {SER} ORDER BY {ORD}) AS dt
  FROM cb0),
cb2 AS (
  SELECT *, {_cum('(-avg_current_a) * dt')} AS capacity, {_cum('(-avg_current_a_lower_bound) * dt')} AS ca,
         {_cum('(-avg_current_a_upper_bound) * dt')} AS cb
  FROM cb1),
cbounds AS (
  SELECT * EXCLUDE (ca, cb, dt), {_pick('ca', 'cb', True)} AS capacity_lower_bound,
         {_pick('ca', 'cb', False)} AS capacity_upper_bound
  FROM cb2)"""

KEPT_CTES = CB_CTES + f""",
mx AS (SELECT {SER}, max(capacity) AS m FROM cbounds GROUP BY {SER}),
band AS (SELECT median(m) AS md, stddev_samp(m) AS sd FROM mx),
bad AS (SELECT DISTINCT cycle_num FROM mx, band
        WHERE NOT coalesce(m BETWEEN md - {lit(3.0)} * sd AND md + {lit(3.0)} * sd, false)),
kept AS (SELECT * FROM cbounds WHERE cycle_num NOT IN (SELECT cycle_num FROM bad))"""


def _bounds(spark, sf):
    return un.capacity_bounds(ad.series_view(spark, sf))


def _kept(spark, sf):
    return un.drop_outlier_cycles(_bounds(spark, sf), "capacity", 3.0)


@register("capacity_bounds", CB_COLS, W(ad.SERIES_SQL, CB_CTES) + "\nSELECT * FROM cbounds",
          ids=["T16", "F1", "F2", "W6", "W8", "P8", "P10"])
def q_bounds(spark, sf):
    return _bounds(spark, sf)


@register("capacity_bounds_range", CB_COLS, W(ad.SERIES_SQL, CB_CTES) + "\nSELECT * FROM cbounds",
          ids=["T16", "F2", "W6", "W8"])
def q_bounds_range(spark, sf):
    return un.capacity_bounds(ad.series_view(spark, sf), method="range", partitions=12)


@register("drop_outlier_cycles", CB_COLS, W(ad.SERIES_SQL, KEPT_CTES) + "\nSELECT * FROM kept",
          ids=["T17", "A11", "A12", "P14", "J4"])
def q_drop(spark, sf):
    return _kept(spark, sf)


def _pct(expr: str) -> str:
    return f"CAST(round_even({expr}, 2) AS VARCHAR) || '%'"


@register("capacity_uncertainty", SER_COLS + ", capacity:d, capacity_lower_bound:d, capacity_upper_bound:d, "
          "capacity_lower_bound_pc:s, capacity_upper_bound_pc:s, capacity_uncertainty_pc:s",
          W(ad.SERIES_SQL, KEPT_CTES) + f""",
cu0 AS (SELECT {SER}, max(capacity) AS capacity, max(capacity_lower_bound) AS capacity_lower_bound,
               max(capacity_upper_bound) AS capacity_upper_bound FROM kept GROUP BY {SER}),
cu1 AS (SELECT *, median(capacity) OVER (PARTITION BY doe, instance) AS md,
               stddev_pop(capacity) OVER (PARTITION BY doe, instance) AS sd FROM cu0)
SELECT {SER}, capacity, capacity_lower_bound, capacity_upper_bound,
  {_pct('capacity_lower_bound * 100.0 / nullif(capacity, 0)')} AS capacity_lower_bound_pc,
  {_pct('capacity_upper_bound * 100.0 / nullif(capacity, 0)')} AS capacity_upper_bound_pc,
  {_pct('(capacity_upper_bound - capacity_lower_bound) * 100.0 / nullif(capacity, 0)')} AS capacity_uncertainty_pc
FROM cu1 WHERE capacity >= md - {lit(3.0)} * sd AND capacity <= md + {lit(3.0)} * sd""",
          ids=["T18", "A13", "F3", "A11", "E11"])
def q_cap_unc(spark, sf):
    return un.capacity_uncertainty(_kept(spark, sf))


_U = 1.0 + 8.0 / 100.0
_CUT = -0.5 * _U


TU_COLS = (SER_COLS + ", charge_time:d, charge_time_lower_bound:d, avg_current_below_delta_time:d, avg_current_a_cut_off:d, "
           "avg_current_lower_bound:d, charge_time_uncertainty:s")


def time_sql(where: str = "") -> str:
    return f"""
tu0 AS (SELECT * FROM samples WHERE charging_state_name = 'CHARGE' AND avg_current_a IS NOT NULL AND cccv_state = 2 {where}),
tu1 AS (SELECT *, max(elapsed_minutes) OVER s AS tmax, max(avg_current_a) OVER s AS imax FROM tu0
        WINDOW s AS (PARTITION BY {SER})),
ts AS (SELECT {SER}, arg_min(elapsed_minutes, (abs(avg_current_a - {lit(_CUT)}), elapsed_minutes, sample_id)) AS tstar
       FROM tu1 GROUP BY {SER}),
tu2 AS (SELECT tu1.*, ts.tstar FROM tu1 JOIN ts USING (doe, instance, cycle_num)),
tu3 AS (
  SELECT {SER}, max(elapsed_minutes) AS charge_time,
    arg_min(elapsed_minutes, (abs(avg_current_a - imax * {lit(_U)}), elapsed_minutes, sample_id)) AS charge_time_lower_bound,
    arg_min(avg_current_a, (abs(elapsed_minutes - (tstar - (tmax - tstar))), elapsed_minutes, sample_id))
      AS avg_current_below_delta_time
  FROM tu2 GROUP BY {SER})
SELECT *, {lit(-0.5)} AS avg_current_a_cut_off, {lit(_CUT)} AS avg_current_lower_bound,
  {_pct('(charge_time - charge_time_lower_bound) * 200.0 / nullif(charge_time, 0)')} AS charge_time_uncertainty
FROM tu3"""


@register("time_uncertainty", TU_COLS, W(ad.SERIES_SQL, time_sql()), ids=["T19", "J7", "O5", "F3"])
def q_time_unc(spark, sf):
    return un.time_uncertainty(ad.series_view(spark, sf), -0.5, 8.0)


@register("time_uncertainty_kept", TU_COLS,
          W(ad.SERIES_SQL, KEPT_CTES, time_sql("AND cycle_num NOT IN (SELECT cycle_num FROM bad)")), ids=["T17", "T19", "E11"])
def q_time_unc_kept(spark, sf):
    return un.time_uncertainty(_kept(spark, sf), -0.5, 8.0)


def _rank_cols():
    out = []
    for name, c in un.REGIME_COLS.items():
        out.append(f"row_number() OVER (PARTITION BY {SER}, error_pc ORDER BY {c} DESC NULLS LAST) AS h_{name}")
        out.append(f"row_number() OVER (PARTITION BY {SER}, error_pc ORDER BY {c} ASC NULLS LAST) AS l_{name}")
    return ", ".join(out)


def _span(name, c):
    return (f"median(CASE WHEN {c} IS NOT NULL AND h_{name} <= 10 THEN {c} END) "
            f"- median(CASE WHEN {c} IS NOT NULL AND l_{name} <= 10 THEN {c} END) AS {name}")


@register("regime_breakdown", SER_COLS + ", error_pc:d, time_min:d, capacity_upper:d, capacity:d, capacity_lower:d, "
          "time_pc:d, capacity_pc:d", W(ad.SERIES_SQL, KEPT_CTES) + f""",
rb0 AS (SELECT *, {_rank_cols()} FROM kept WHERE error_pc IS NOT NULL),
rb1 AS (SELECT {SER}, error_pc, {', '.join(_span(n, c) for n, c in un.REGIME_COLS.items())}
        FROM rb0 GROUP BY {SER}, error_pc)
SELECT *, time_min * 100.0 / nullif(sum(time_min) OVER (PARTITION BY {SER}), 0) AS time_pc,
       capacity * 100.0 / nullif(sum(capacity) OVER (PARTITION BY {SER}), 0) AS capacity_pc
FROM rb1""", ids=["T20", "A14", "A15", "O3", "N2"])
def q_regime(spark, sf):
    return un.regime_breakdown(_kept(spark, sf))


@register("drop_outlier_series", CB_COLS, W(ad.SERIES_SQL, CB_CTES) + f""",
mx AS (SELECT {SER}, max(capacity) AS m FROM cbounds GROUP BY {SER}),
band AS (SELECT median(m) AS md, stddev_samp(m) AS sd FROM mx),
bad AS (SELECT doe, instance, cycle_num FROM mx, band
        WHERE NOT coalesce(m BETWEEN md - {lit(3.0)} * sd AND md + {lit(3.0)} * sd, false))
SELECT * FROM cbounds c WHERE NOT EXISTS (
  SELECT 1 FROM bad b WHERE b.doe = c.doe AND b.instance = c.instance AND b.cycle_num = c.cycle_num)""",
          ids=["T17", "P14", "J4"])
def q_drop_series(spark, sf):
    return un.drop_outlier_cycles(_bounds(spark, sf), "capacity", 3.0, scope="series")
