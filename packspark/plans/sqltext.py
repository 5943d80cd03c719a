"""DuckDB text fragments for the oracle side of registered queries."""

from __future__ import annotations

from packspark.operators.energy import EXPECTED_NORMAL_ORDER

K = "doe_number, instance_number"


def lit(x: float) -> str:
    return f"{float(x)!r}::DOUBLE"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes)


def w1(x: str, part: str, order: str, window: int, k: float) -> str:
    """Rolling outlier replacement (trailing window incl. current row, min_periods=1)."""
    f = f"(PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)"
    md = f"quantile_cont({x}, 0.5) OVER {f}"
    sd = f"stddev_pop({x}) OVER {f}"
    return f"(CASE WHEN abs({x} - {md}) > {lit(k)} * {sd} THEN {md} ELSE {x} END)"


def second(x: str, part: str = K, order: str = "cycle") -> str:
    return (f"nth_value({x}, 2) OVER (PARTITION BY {part} ORDER BY {order} "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")


def z_table() -> str:
    rows = [EXPECTED_NORMAL_ORDER[n] for n in range(1, 7)]
    return "[" + ", ".join("[" + ", ".join(f"{z!r}::DOUBLE" for z in r) + "]" for r in rows) + "]"


def raw_energy_cte(src: str = "cyc", name: str = "e_raw") -> str:
    return f"""
{name} AS (
  SELECT doe_number, instance_number, cycle,
         coalesce(sum(CASE WHEN cycling_substate = 'DISCHARGE' THEN energy END), 0.0::DOUBLE)
         + coalesce(sum(CASE WHEN cycling_substate = 'DCIR' THEN energy_rest END), 0.0::DOUBLE) AS raw_discharge_energy
  FROM {src} WHERE cycling_substate IN ('DISCHARGE', 'DCIR')
  GROUP BY doe_number, instance_number, cycle)"""


def normal_draw(parts: list[str], seed: int) -> str:
    """Standard normal number of a key and a seed: two uniforms from the first 26 hex digits of an MD5, Box and Muller."""
    digest = f"md5(concat_ws('|', '{seed}', {', '.join(f'CAST({p} AS VARCHAR)' for p in parts)}))"
    u1, u2 = (f"((CAST('0x' || substr({digest}, {at}, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)" for at in (1, 14))
    return f"(sqrt(-2.0::DOUBLE * ln({u1})) * cos(2.0::DOUBLE * pi() * {u2}))"


def early_cte(src: str = "e_raw", name: str = "e_adj", seed: int | None = None) -> str:
    x = "raw_discharge_energy"
    z = (f"CASE WHEN p_n BETWEEN 1 AND 6 AND p_i <= p_n THEN ({z_table()})[p_n][p_i] ELSE 0.0::DOUBLE END" if seed is None
         else "p_draws[p_i]")
    draws = "" if seed is None else (
        f",\n    list_reverse_sort(list(CASE WHEN cycle < 6 THEN {normal_draw(['doe_number', 'instance_number', 'cycle'], seed)} END) "
        f"FILTER (WHERE cycle < 6) OVER (PARTITION BY {K})) AS p_draws")
    return f"""
{name}_0 AS (
  SELECT *,
    CASE WHEN cycle < 6 THEN abs({x} / nullif(lag({x}) OVER (PARTITION BY {K} ORDER BY cycle), 0) - 1.0::DOUBLE) END AS p_pct,
    row_number() OVER (PARTITION BY {K} ORDER BY cycle) AS p_i,
    count(CASE WHEN cycle < 6 THEN 1 END) OVER (PARTITION BY {K}) AS p_n,
    median(CASE WHEN cycle < 6 THEN {x} END) OVER (PARTITION BY {K}) AS p_md{draws}
  FROM {src}),
{name}_1 AS (
  SELECT *, max(CASE WHEN p_pct > 0.005::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY {K}) AS p_hit FROM {name}_0),
{name} AS (
  SELECT doe_number, instance_number, cycle, {x},
    CASE WHEN cycle < 6 AND p_hit = 1
         THEN p_md * (1.0::DOUBLE + 0.00025::DOUBLE * ({z}))
         ELSE {x} END AS adjusted_raw_discharge_energy
  FROM {name}_1)"""


def discharge_energy_ctes(window: int = 7, k: float = 0.1, src: str = "cyc", name: str = "energy") -> str:
    return f"""{raw_energy_cte(src, name + '_r')},
{early_cte(name + '_r', name + '_a')},
{name}_c1 AS (
  SELECT *, {w1('adjusted_raw_discharge_energy', K, 'cycle', window, k)} AS discharge_energy FROM {name}_a),
{name}_c2 AS (
  SELECT *, median(discharge_energy) OVER (PARTITION BY doe_number, cycle) AS mean_energy,
            stddev_samp(discharge_energy) OVER (PARTITION BY doe_number, cycle) AS std_energy FROM {name}_c1),
{name}_c3 AS (SELECT *, mean_energy - 3.0::DOUBLE * std_energy AS lower_energy_bound FROM {name}_c2),
{name}_c4 AS (
  SELECT *, discharge_energy / nullif({second('discharge_energy')}, 0) AS p_norm0,
            mean_energy / nullif({second('mean_energy')}, 0) AS norm_mean_energy,
            lower_energy_bound / nullif({second('lower_energy_bound')}, 0) AS norm_lower_energy
  FROM {name}_c3),
{name} AS (
  SELECT *, {w1('p_norm0', K, 'cycle', window, k)} AS norm_discharge_energy FROM {name}_c4)"""
