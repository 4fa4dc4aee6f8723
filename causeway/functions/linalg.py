"""Small dense solvers used on aggregated statistics (never on raw rows).

* ``ols_from_moments``: least squares from a (p+1)x(p+1) moment matrix.
* ``simplex_ls``: min ||y - Y w||^2 s.t. w >= 0, sum(w) = 1, from a Gram matrix.
* ``ridge_from_moments``: ridge regression from moments (augmented synth).
"""

from __future__ import annotations

import math

import numpy as np

from .dist import t_ppf, t_sf2


def ols_core(XtX: np.ndarray, Xty: np.ndarray, yty: float, n_eff: float, alpha: float = 0.05,
             with_se: bool = True) -> dict:
    """Least squares from X'X, X'y, y'y (min-norm on rank deficiency)."""
    pinv = np.linalg.pinv(XtX, rcond=1e-12)
    beta = pinv @ Xty
    rank = int(np.linalg.matrix_rank(XtX)) if XtX.size else 0
    rss = max(float(yty - 2.0 * beta @ Xty + beta @ XtX @ beta), 0.0)
    dof = n_eff - rank
    out = {"beta": beta, "dof": dof, "rss": rss, "rank": rank, "n": n_eff}
    if with_se:
        sigma2 = rss / dof if dof > 0 else float("nan")
        out["cov"] = sigma2 * pinv
        _finish(out, alpha)
    return out


def _finish(out: dict, alpha: float) -> None:
    b, cov, dof = out["beta"], out["cov"], out["dof"]
    se = np.sqrt(np.clip(np.diag(cov), 0.0, None))
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(se > 0, b / se, np.nan)
    crit = t_ppf(1.0 - alpha / 2.0, dof) if dof > 0 else float("nan")
    out.update({
        "se": se, "t": t,
        "p": np.array([t_sf2(float(x), dof) if np.isfinite(x) else float("nan") for x in t]),
        "ci_lower": b - crit * se, "ci_upper": b + crit * se,
    })


def ols_from_moments(M: np.ndarray, shifts: np.ndarray, n_eff: float, alpha: float = 0.05,
                     with_se: bool = True, intercept: bool = True) -> dict:
    """Solve OLS from raw moments of shifted columns.

    ``M`` is the moment matrix over [1, x_1..x_k, y] where every non-constant
    column was shifted by ``shifts`` (for x_1..x_k, y) before the products were
    summed.  Coefficients are reported on the original scale.  With
    ``intercept=False`` the shifts must be zero and row/column 0 is ignored.
    """
    p = M.shape[0] - 1
    if not intercept:
        return ols_core(M[1:p, 1:p], M[1:p, p], M[p, p], n_eff, alpha, with_se)
    out = ols_core(M[:p, :p], M[:p, p], M[p, p], n_eff, alpha, False)
    beta = out["beta"]
    cx, cy = shifts[:-1], shifts[-1]
    b = beta.copy()
    b[0] = beta[0] + cy - float(beta[1:] @ cx)
    out["beta"] = b
    if with_se:
        pinv = np.linalg.pinv(M[:p, :p], rcond=1e-12)
        sigma2 = out["rss"] / out["dof"] if out["dof"] > 0 else float("nan")
        cov = sigma2 * pinv
        a = np.concatenate([[1.0], -cx])
        cov0 = cov.copy()
        v0 = float(a @ cov @ a)
        cov0[0, 0] = v0
        out["cov"] = cov0
        _finish(out, alpha)
    return out


def project_simplex(v: np.ndarray) -> np.ndarray:
    """Euclidean projection onto {w >= 0, sum w = 1} (sort-based).

    Adding a constant to ``v`` changes nothing, so its largest value is made 0: beside large values the 1 would be rounded away."""
    n = v.size
    v = v - v.max()
    u = np.sort(v)[::-1]
    css = np.cumsum(u) - 1.0
    idx = np.arange(1, n + 1)
    cond = u - css / idx > 0
    r = idx[cond][-1]
    theta = css[r - 1] / r
    return np.maximum(v - theta, 0.0)


def simplex_ls(G: np.ndarray, c: np.ndarray, iters: int = 20000, tol: float = 1e-12, start: np.ndarray | None = None, top: float | None = None
               ) -> np.ndarray:
    """Minimise w'Gw - 2c'w over the probability simplex (accelerated projected gradient).

    ``G`` = Y_D'Y_D (donor Gram over the pre period), ``c`` = Y_D'y_treated.  ``start``: weights to start from
    (equal ones otherwise); ``top``: the largest eigenvalue of G where it is known.
    """
    k = G.shape[0]
    if k == 1:
        return np.ones(1)
    L = 2.0 * float(np.linalg.eigvalsh(G)[-1] if top is None else top)
    if not np.isfinite(L) or L <= 0:
        return np.full(k, 1.0 / k)
    step = 1.0 / L
    w = np.full(k, 1.0 / k) if start is None else start.copy()
    z = w.copy()
    tk = 1.0
    f_old = float(w @ G @ w - 2 * c @ w)
    for it in range(iters):
        grad = 2.0 * (G @ z - c)
        w_new = project_simplex(z - step * grad)
        t_new = 0.5 * (1.0 + math.sqrt(1.0 + 4.0 * tk * tk))
        z = w_new + ((tk - 1.0) / t_new) * (w_new - w)
        w, tk = w_new, t_new
        if it % 50 == 49:
            f = float(w @ G @ w - 2 * c @ w)
            if abs(f_old - f) <= tol * max(1.0, abs(f)):
                break
            f_old = f
    return w


def ridge_from_moments(XtX: np.ndarray, Xty: np.ndarray, lam: float) -> np.ndarray:
    k = XtX.shape[0]
    return np.linalg.solve(XtX + lam * np.eye(k), Xty)
