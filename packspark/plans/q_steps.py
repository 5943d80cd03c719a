"""Registered queries: charge step tables and their reconciliation."""

from __future__ import annotations

from packspark.operators import steps as stp
from packspark.plans import adapters as ad
from packspark.plans import sqltext as sq
from packspark.plans.registry import register
from packspark.plans.sqltext import lit, w1

W = sq.with_
S = "doe, instance, cycle_num, charging_state_name"
ORD = "elapsed_minutes, sample_id"
STEP_COLS = ("doe:s, instance:s, cycle_num:i, charging_state_name:s, step:i, step_type:s, step_avg_current_a:d, "
             "step_time_length_min:d, min_avg_voltage_v:d, max_avg_voltage_v:d, min_capacity_ah:d, max_capacity_ah:d, "
             "short_step:b")


def steps_ctes(cc_end: str, thr: float, window: int, k: float, min_len: float | None, prefix: str = "st") -> str:
    p = prefix
    if cc_end == "state":
        cc = f"min(CASE WHEN cccv_state = 2 THEN elapsed_minutes END) OVER (PARTITION BY {S})"
        base = f"{p}_s0 AS (SELECT * FROM samples WHERE charging_state_name = 'CHARGE')"
    else:
        hi = ("coalesce(greatest(cell1_voltage_v, cell2_voltage_v, cell3_voltage_v, cell4_voltage_v, cell5_voltage_v)"
              f" >= {lit(4.2)}, false)")
        base = (f"{p}_h AS (SELECT *, {hi} AS hi FROM samples WHERE charging_state_name = 'CHARGE'),\n"
                f"{p}_s0 AS (SELECT *, row_number() OVER (PARTITION BY {S}, hi ORDER BY {ORD}) AS hrk FROM {p}_h)")
        cc = f"max(CASE WHEN hi AND hrk <= 50 THEN elapsed_minutes END) OVER (PARTITION BY {S})"
    fv = f"OVER (PARTITION BY {S} ORDER BY {ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    out = f"""{base},
{p}_s1 AS (
  SELECT *, {cc} AS cc, max(elapsed_minutes) OVER (PARTITION BY {S}) AS tmax,
         first_value(avg_voltage_v IGNORE NULLS) {fv} AS v0,
         first_value(avail_battery_capacity_ah IGNORE NULLS) {fv} AS c0
  FROM {p}_s0),
{p}_c0 AS (SELECT {S}, elapsed_minutes, sample_id, avg_current_a FROM {p}_s1
           WHERE elapsed_minutes BETWEEN 0.0 AND cc AND avg_current_a IS NOT NULL),
{p}_c1 AS (SELECT {S}, elapsed_minutes, sample_id,
           CASE WHEN elapsed_minutes < 1.0 THEN median(CASE WHEN elapsed_minutes < 1.0 THEN avg_current_a END)
                OVER (PARTITION BY {S}) ELSE avg_current_a END AS cur FROM {p}_c0),
{p}_c2 AS (SELECT *, {w1('cur', S, ORD, window, k)} AS cl FROM {p}_c1),
{p}_c3 AS (SELECT *, coalesce(abs(cl - lag(cl) OVER (PARTITION BY {S} ORDER BY {ORD})) > {lit(thr)}, false) AS chg
           FROM {p}_c2),
{p}_c4 AS (SELECT *, sum(CAST(chg AS INTEGER)) OVER (PARTITION BY {S} ORDER BY {ORD} ROWS UNBOUNDED PRECEDING) AS sid
           FROM {p}_c3),
{p}_mem AS (SELECT {S}, sid AS step, cl, elapsed_minutes FROM {p}_c4
            UNION ALL SELECT {S}, sid - 1 AS step, cl, elapsed_minutes FROM {p}_c4 WHERE chg),
{p}_st AS (SELECT {S}, step, median(cl) AS step_avg_current_a, max(elapsed_minutes) - min(elapsed_minutes) AS len
           FROM {p}_mem GROUP BY {S}, step),
{p}_st2 AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY {S} ORDER BY step
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS t0,
                   max(step) OVER (PARTITION BY {S}) AS last_step FROM {p}_st),
{p}_ser AS (SELECT {S}, any_value(cc) AS cc, any_value(tmax) AS tmax, any_value(v0) AS v0, any_value(c0) AS c0
            FROM {p}_s1 WHERE cc IS NOT NULL GROUP BY {S}),
{p}_ser2 AS (SELECT {p}_ser.*, coalesce(n.m, 0) AS m FROM {p}_ser
             LEFT JOIN (SELECT {S}, count(*) AS m FROM {p}_st GROUP BY {S}) n USING (doe, instance, cycle_num, charging_state_name)),
{p}_iv AS (
  SELECT {S}, step AS j, t0 AS lo, t0 + len AS hi FROM {p}_st2
  UNION ALL
  SELECT a.doe, a.instance, a.cycle_num, a.charging_state_name, a.step + 1, a.t0 + a.len, b.tmax
  FROM {p}_st2 a JOIN {p}_ser b USING (doe, instance, cycle_num, charging_state_name) WHERE a.step = a.last_step
  UNION ALL
  SELECT {S}, 0, 0.0, tmax FROM {p}_ser2 WHERE m = 0),
{p}_im AS (
  SELECT i.doe, i.instance, i.cycle_num, i.charging_state_name, i.j, max(r.avg_voltage_v) AS vmax,
         max(r.avail_battery_capacity_ah) AS cmax
  FROM {p}_iv i JOIN {p}_s1 r
    ON r.doe = i.doe AND r.instance = i.instance AND r.cycle_num = i.cycle_num
   AND r.charging_state_name = i.charging_state_name AND r.elapsed_minutes BETWEEN i.lo AND i.hi
  GROUP BY i.doe, i.instance, i.cycle_num, i.charging_state_name, i.j),
{p}_rows AS (
  SELECT {S}, step, 'cc' AS step_type, step_avg_current_a, len AS step_time_length_min FROM {p}_st2
  UNION ALL
  SELECT {S}, m, 'cv', NULL, tmax - cc FROM {p}_ser2),
{p}_res AS (
  SELECT r.*, im.vmax, im.cmax, s.v0, s.c0 FROM {p}_rows r
  LEFT JOIN {p}_im im ON im.doe = r.doe AND im.instance = r.instance AND im.cycle_num = r.cycle_num
                     AND im.charging_state_name = r.charging_state_name AND im.j = r.step
  JOIN {p}_ser s ON s.doe = r.doe AND s.instance = r.instance AND s.cycle_num = r.cycle_num
                AND s.charging_state_name = r.charging_state_name),
{p} AS (
  SELECT {S}, step, step_type, step_avg_current_a, step_time_length_min,
    CASE WHEN step = 0 THEN v0 ELSE lag(vmax) OVER (PARTITION BY {S} ORDER BY step) END AS min_avg_voltage_v,
    vmax AS max_avg_voltage_v,
    CASE WHEN step = 0 THEN c0 ELSE lag(cmax) OVER (PARTITION BY {S} ORDER BY step) END AS min_capacity_ah,
    cmax AS max_capacity_ah, step_time_length_min < 1.0 AS short_step
  FROM {p}_res)"""
    if min_len is not None:
        out += f",\n{p}_f AS (SELECT * FROM {p} WHERE step_time_length_min > {lit(min_len)})"
    return out


@register("charge_steps_state", STEP_COLS,
          W(ad.SERIES_SQL, steps_ctes("state", 1.0, 200, 3.0, 0.2)) + "\nSELECT * FROM st_f",
          ids=["T22", "T23", "W10", "W9", "W13", "W14", "J6", "U2", "P18", "A22"])
def q_steps_state(spark, sf):
    return stp.charge_steps_state(ad.series_view(spark, sf))


@register("charge_steps_voltage", STEP_COLS,
          W(ad.SERIES_SQL, steps_ctes("cell_voltage", 0.6, 300, 3.0, None)) + "\nSELECT * FROM st",
          ids=["T21", "T23", "W12", "W10", "J6", "U2"])
def q_steps_voltage(spark, sf):
    return stp.charge_steps_voltage(ad.series_view(spark, sf))


@register("step_reconcile", "doe:s, instance:s, cycle_num:i, charging_state_name:s, charge_time_steps:d, "
          "charge_time:d, difference:d", W(ad.SERIES_SQL, steps_ctes("state", 1.0, 200, 3.0, 0.2)) + f""",
tot AS (SELECT {S}, sum(step_time_length_min) AS charge_time_steps FROM st_f GROUP BY {S}),
raw AS (SELECT {S}, max(elapsed_minutes) AS charge_time FROM samples WHERE charging_state_name = 'CHARGE' GROUP BY {S})
SELECT tot.*, raw.charge_time, tot.charge_time_steps - raw.charge_time AS difference
FROM tot JOIN raw USING (doe, instance, cycle_num, charging_state_name)""", ids=["T24", "A22", "E12"])
def q_reconcile(spark, sf):
    return stp.step_reconcile(stp.charge_steps_state(ad.series_view(spark, sf), keep_series_end=True))
