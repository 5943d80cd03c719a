"""Student-t numerics in NumPy (no SciPy in the image): CDF, quantile, non-central CDF, JZS BF10.

Used only on one-row-per-group results (inside an Arrow UDF), never per data row.
"""

from __future__ import annotations

import math

import numpy as np


def _betacf(a: float, b: float, x: float, itmax: int = 500, eps: float = 1e-15) -> float:
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, itmax + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        de = d * c
        h *= de
        if abs(de - 1.0) < eps:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    bt = math.exp(lbt)
    if x < (a + 1.0) / (a + b + 2.0):
        return bt * _betacf(a, b, x) / a
    return 1.0 - bt * _betacf(b, a, 1.0 - x) / b


def t_cdf(t: float, df: float) -> float:
    if math.isnan(t) or math.isnan(df) or df <= 0:
        return float("nan")
    if math.isinf(t):
        return 1.0 if t > 0 else 0.0
    tail = 0.5 * betainc(df / 2.0, 0.5, df / (df + t * t))
    return 1.0 - tail if t > 0 else tail


def t_sf(t: float, df: float) -> float:
    return t_cdf(-t, df)


def t_ppf(q: float, df: float) -> float:
    if not (0.0 < q < 1.0) or math.isnan(df) or df <= 0:
        return float("nan")
    lo, hi = -1.0, 1.0
    while t_cdf(lo, df) > q:
        lo *= 2.0
    while t_cdf(hi, df) < q:
        hi *= 2.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if t_cdf(mid, df) < q:
            lo = mid
        else:
            hi = mid
        if hi - lo < 1e-13 * max(1.0, abs(mid)):
            break
    return 0.5 * (lo + hi)


def _phi(z: np.ndarray) -> np.ndarray:
    return 0.5 * np.frompyfunc(math.erfc, 1, 1)(-z / math.sqrt(2.0)).astype(float)


def nct_cdf(t: float, df: float, nc: float, points: int = 4001) -> float:
    """P(T' <= t) of the non-central t: E[Phi(t·V - nc)] with V = sqrt(chi2_df / df)."""
    if math.isnan(t) or math.isnan(df) or math.isnan(nc) or df <= 0:
        return float("nan")
    half = min(12.0, 10.0 / math.sqrt(2.0 * df) + 0.5)
    s = np.linspace(-half * (2.5 if df < 4 else 1.0), half, points)   # s = log v
    v = np.exp(s)
    logf = (math.log(2.0) + (df / 2.0) * math.log(df / 2.0) - math.lgamma(df / 2.0)
            + (df - 1.0) * s - df * v * v / 2.0)
    w = np.exp(logf + s)          # density in s (Jacobian v)
    vals = _phi(t * v - nc) * w
    return float(np.trapezoid(vals, s) / np.trapezoid(w, s))


def bf10_jzs(t: float, nx: int, ny: int, r: float = 0.707, alternative: str = "two-sided") -> float:
    """JZS Bayes factor for a two-sample t statistic (Rouder et al. 2009), Cauchy scale ``r``.

    One-sided alternatives double the factor, and invert it when the effect points the
    other way and the factor exceeds 1.
    """
    if any(math.isnan(float(v)) for v in (t, nx, ny)) or nx < 2 or ny < 2:
        return float("nan")
    n = nx * ny / (nx + ny)
    df = nx + ny - 2.0
    s = np.linspace(-30.0, 30.0, 30001)
    g = np.exp(s)
    a = 1.0 + n * g * r * r
    logf = (-0.5 * np.log(a) - (df + 1.0) / 2.0 * np.log1p(t * t / (a * df))
            - 0.5 * math.log(2.0 * math.pi) - 1.5 * s - 1.0 / (2.0 * g) + s)
    mx = float(np.max(logf))
    log_integ = mx + math.log(float(np.trapezoid(np.exp(logf - mx), s)))
    log_bf = log_integ + (df + 1.0) / 2.0 * math.log1p(t * t / df)
    bf = math.exp(log_bf) if log_bf < 700.0 else float("inf")
    if alternative != "two-sided":
        bf *= 2.0
        if ((alternative == "greater" and t < 0) or (alternative == "less" and t > 0)) and bf > 1:
            bf = 1.0 / bf
    return bf


def welch_finish(t: float, dof: float, se: float, nx: int, ny: int, d: float, alternative: str = "two-sided",
                 confidence: float = 0.95, alpha: float = 0.05) -> dict:
    """p-value, confidence interval of the mean difference, power and BF10 for one test."""
    nan = float("nan")
    if any(v is None or (isinstance(v, float) and math.isnan(v)) for v in (t, dof, nx, ny)):
        return {"p_val": nan, "ci95_low": nan, "ci95_high": nan, "power": nan, "bf10": nan}
    if alternative == "two-sided":
        p = 2.0 * t_sf(abs(t), dof)
        tc = t_ppf(1.0 - (1.0 - confidence) / 2.0, dof)
        ci = (t - tc) * se, (t + tc) * se
    elif alternative == "greater":
        p = t_sf(t, dof)
        tc = t_ppf(confidence, dof)
        ci = (t - tc) * se, float("inf")
    elif alternative == "less":
        p = t_cdf(t, dof)
        tc = t_ppf(confidence, dof)
        ci = float("-inf"), (t + tc) * se
    else:
        raise ValueError("alternative must be 'two-sided', 'greater' or 'less'")
    tdof = nx + ny - 2.0
    nc = d / math.sqrt(1.0 / nx + 1.0 / ny) if d is not None and not math.isnan(d) else nan
    if alternative == "two-sided":
        tcrit = t_ppf(1.0 - alpha / 2.0, tdof)
        power = (1.0 - nct_cdf(tcrit, tdof, nc)) + nct_cdf(-tcrit, tdof, nc)
    elif alternative == "greater":
        power = 1.0 - nct_cdf(t_ppf(1.0 - alpha, tdof), tdof, nc)
    else:
        power = nct_cdf(t_ppf(alpha, tdof), tdof, nc)
    return {"p_val": min(max(p, 0.0), 1.0), "ci95_low": ci[0], "ci95_high": ci[1], "power": power,
            "bf10": bf10_jzs(t, nx, ny, alternative=alternative)}
