"""Sampling distributions without scipy: Student t, normal, F-free helpers.

The t CDF uses the regularised incomplete beta function evaluated with a
continued fraction (modified Lentz); quantiles are found by bisection.
Vectorised with numpy so they can run inside pandas UDFs.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_N = NormalDist()


def norm_cdf(x):
    return np.vectorize(_N.cdf, otypes=[float])(x) if np.ndim(x) else _N.cdf(float(x))


def norm_ppf(p: float) -> float:
    return _N.inv_cdf(p)


def _betacf(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = tiny if abs(d) < tiny else d
    d = 1.0 / d
    h = d
    for m in range(1, 400):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = tiny if abs(d) < tiny else d
        c = 1.0 + aa / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = tiny if abs(d) < tiny else d
        c = 1.0 + aa / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 3e-16:
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


def t_sf2(t: float, dof: float) -> float:
    """Two-sided p-value P(|T| > |t|) for Student t with ``dof`` degrees of freedom."""
    if t is None or dof is None or t != t or dof != dof or dof <= 0:
        return float("nan")
    if math.isinf(t):
        return 0.0
    x = dof / (dof + t * t)
    return betainc(dof / 2.0, 0.5, x)


def t_cdf(t: float, dof: float) -> float:
    p2 = t_sf2(t, dof)
    return 1.0 - p2 / 2.0 if t >= 0 else p2 / 2.0


def t_ppf(p: float, dof: float) -> float:
    """Quantile of Student t by bisection on the CDF."""
    if dof is None or dof <= 0 or not math.isfinite(dof):
        return norm_ppf(p)
    if dof > 1e7:
        return norm_ppf(p)
    lo, hi = -1e3, 1e3
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if t_cdf(mid, dof) < p:
            lo = mid
        else:
            hi = mid
        if hi - lo < 1e-13:
            break
    return 0.5 * (lo + hi)


def z_sf2(z: float) -> float:
    return 2.0 * (1.0 - _N.cdf(abs(z)))


def welch(m1, v1, n1, m0, v0, n0):
    """Welch two-sample t: (diff, se, t, dof, p)."""
    se2 = v1 / n1 + v0 / n0
    diff = m1 - m0
    if not se2 or se2 <= 0:
        return diff, float("nan"), float("nan"), float("nan"), float("nan")
    se = math.sqrt(se2)
    t = diff / se
    dof = se2 ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v0 / n0) ** 2 / (n0 - 1))
    return diff, se, t, dof, t_sf2(t, dof)
