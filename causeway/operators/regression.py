"""Regression front-ends: OLS effect rows and IRLS logistic regression.

Logistic regression is Newton/IRLS where every iteration is one Gram
aggregate of the weighted design (k x k partials per partition); only the
k-vector of coefficients crosses the driver between iterations.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dist import norm_ppf, z_sf2
from ..session import remove_written, written, written_at
from .gram import ols
from .results import EFFECT_SCHEMA, effect_df, effect_row


def coef_to_effect(coef: DataFrame, term: str, method: str, treatment: str, outcome: str) -> DataFrame:
    """Select the coefficient row of ``term`` and lay it out as an ``effect`` row."""
    c = coef.filter(F.col("term") == term)
    return c.select(
        F.lit(method).alias("method"), F.lit(treatment).alias("treatment"), F.lit(outcome).alias("outcome"),
        F.col("n").cast("long").alias("n"), F.col("estimate"), F.col("std_error"), F.col("stat"),
        F.col("p_value"), F.col("ci_lower"), F.col("ci_upper"),
        *[F.lit(None).cast("double").alias(k) for k in ("odds_ratio", "risk_diff", "rd_lower", "rd_upper")],
        F.lit(None).cast("string").alias("error"))


def ols_effect(df: DataFrame, treatment: str, outcome: str, confounders: Sequence[str] = (),
               method: str = "OLS", alpha: float = 0.05, keys: Sequence[str] = ()) -> DataFrame:
    """EST1: ``Y ~ 1 + T + X``; with no confounders this is the difference in means."""
    xs = [treatment] + [c for c in confounders if c != treatment]
    coef = ols(df, outcome, xs, keys=keys, alpha=alpha, terms=[treatment])
    if keys:
        return coef
    return coef_to_effect(coef, treatment, method, treatment, outcome)


def _eta(beta: np.ndarray, xs: list[Column]) -> Column:
    e = F.lit(float(beta[0]))
    for b, x in zip(beta[1:], xs):
        e = e + F.lit(float(b)) * x
    return e


def logit_fit(df: DataFrame, y: str | Column, xs: dict[str, Column] | Sequence[str], max_iter: int = 35,
              tol: float = 1e-10, persist: bool = True) -> dict:
    """Unpenalised logistic regression by IRLS.

    Returns dict(beta, cov, names, n, converged, error).  Each iteration is
    one aggregate, over the distinct design rows with their counts where the design is discrete (written once), over the
    persisted rows where it is not.
    """
    if not isinstance(xs, dict):
        xs = {x: F.col(x) for x in xs}
    names = ["const"] + list(xs)
    ycol = F.col(y) if isinstance(y, str) else y
    data = df.select(ycol.cast("double").alias("_y"),
                     *[c.cast("double").alias(f"_x{i}") for i, c in enumerate(xs.values())]).dropna()
    discrete = is_discrete(data)
    if discrete:
        data, persist = written(design_rows(data, data.columns), "design"), False
    else:
        data = data.withColumn("_w", F.lit(1))
    if persist:
        data = data.persist(StorageLevel.MEMORY_AND_DISK)
    k = len(names)
    X = [F.lit(1.0)] + [F.col(f"_x{i}") for i in range(k - 1)]
    beta = np.zeros(k)
    err = None
    converged = False
    n = 0
    cov = np.full((k, k), np.nan)
    try:
        for it in range(max_iter):
            eta = _eta(beta, X[1:])
            p = F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))
            row = data.agg(*_newton_sums(eta, p, X)).collect()[0]
            n = int(row["n"] or 0)
            if n == 0:
                err = "no rows"
                break
            g = np.array([row[f"g{i}"] for i in range(k)], dtype=float)
            H = np.empty((k, k))
            for i in range(k):
                for j in range(i, k):
                    H[i, j] = H[j, i] = row[f"h{i}_{j}"]
            Hinv = np.linalg.pinv(H, rcond=1e-13)
            step = Hinv @ g
            cov = Hinv
            # complete separation: extreme linear predictors *and* an (almost) perfect fit; a few
            # extreme rows alone are legitimate at scale
            if row["maxeta"] is not None and row["maxeta"] > 35 and row["ll"] > -1e-6 * n:
                err = "Perfect separation detected, results not available"
                break
            beta = beta + step
            if np.max(np.abs(step)) < tol * max(1.0, float(np.max(np.abs(beta)))):
                converged = True
                # covariance at the converged point
                break
        if np.linalg.matrix_rank(cov) < k and err is None:
            err = "Singular matrix"
    finally:
        if persist:
            data.unpersist()
    if not converged and err is None:
        err = "did not converge"
    return {"beta": beta, "cov": cov, "names": names, "n": n, "converged": converged, "error": err}


def is_discrete(data: DataFrame, fewer: int = 4) -> bool:
    """Whether ``data`` has at least ``fewer`` rows for every distinct one."""
    r = data.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64(*data.columns), 0.02).alias("d")).first()
    return r["n"] > 0 and r["d"] * fewer <= r["n"]


def design_rows(data: DataFrame, columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """Distinct rows of ``columns`` with their frequency _w."""
    w = F.col(weight) if weight else F.lit(1)
    return data.groupBy(*columns).agg(F.sum(w).alias("_w"))


def _newton_sums(eta: Column, p: Column, X: list[Column]) -> list[Column]:
    """n, log-likelihood, largest linear predictor, gradient and Hessian of weighted rows (_y, _w) as aggregates."""
    w, r = F.col("_w") * p * (F.lit(1.0) - p), F.col("_w") * (F.col("_y") - p)
    aggs = [F.sum("_w").alias("n"), F.sum(F.col("_w") * (F.col("_y") * eta - F.log1p(F.exp(eta)))).alias("ll"), F.max(F.abs(eta)).alias("maxeta")]
    for i in range(len(X)):
        aggs.append(F.sum(X[i] * r).alias(f"g{i}"))
        aggs += [F.sum(w * X[i] * X[j]).alias(f"h{i}_{j}") for j in range(i, len(X))]
    return aggs


DESIGN_IN_TASK = 50_000  # distinct design rows of one key that a task fits by itself
KEYS_TO_BROADCAST = 200_000  # rows of coefficients that are sent to the tasks; more are joined by key


def logit_by_key(rows: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str], weight: str | None = None, max_iter: int = 35,
                 tol: float = 1e-10, discrete: bool | None = None, in_task: int | None = None) -> DataFrame:
    """keys, n, beta (array), converged, error: an unpenalised logistic regression for every key, in jobs that serve all keys.

    Discrete designs are reduced to distinct weighted rows first (``discrete``: None measures); where no key has more than ``in_task``
    of these, each key is fitted in a task.  Otherwise a job makes one Newton step of all keys: it joins each key's coefficients to its rows
    and adds gradient and Hessian by key; keys that have settled or failed leave, the coefficients are written, those of the step before
    removed.  Nothing passes through the driver but the number of keys that go on."""
    keys, xs = list(keys), list(xs)
    k = len(xs) + 1
    spark = rows.sparkSession
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    data = rows.select(*keys, F.col(y).cast("double").alias("_y"), *[F.col(x).cast("double").alias(f"_x{i}") for i, x in enumerate(xs)], w.alias("_w")).dropna()
    used = []
    if discrete or (discrete is None and is_discrete(data.drop("_w"))):
        data, path = written_at(design_rows(data, [c for c in data.columns if c != "_w"], "_w"), "design")
        used.append(path)
    schema = "".join(f"`{c}` {data.schema[c].dataType.simpleString()}, " for c in keys) + "n double, beta array<double>, converged boolean, error string"
    if used and (data.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) <= (DESIGN_IN_TASK if in_task is None else in_task):
        state = written(data.groupBy(*keys).applyInPandas(_newton_in_task(keys, k, max_iter, tol), schema), "coefficients")
    else:
        state = _newton_jobs(data, keys, k, schema, max_iter, tol)
    remove_written(spark, *used)
    late = ~F.col("converged") & F.col("error").isNull()
    return state.withColumn("error", F.when(late, "did not converge").otherwise(F.col("error")))


def _newton_step(beta: np.ndarray, n: float, ll: float, largest: float, g: np.ndarray, H: np.ndarray, tol: float) -> tuple[np.ndarray, bool, str | None]:
    """(next coefficients, settled, error) from the sums at ``beta``."""
    if not n > 0 or not np.isfinite(H).all() or not np.isfinite(g).all():
        return beta, False, "no rows" if not n > 0 else "did not converge"
    if largest > 35 and ll > -1e-6 * n:
        return beta, False, "Perfect separation detected, results not available"
    inverse = np.linalg.pinv(H, rcond=1e-13)
    move = inverse @ g
    beta = beta + move
    done = bool(np.max(np.abs(move)) < tol * max(1.0, float(np.max(np.abs(beta)))))
    return beta, done, "Singular matrix" if done and np.linalg.matrix_rank(inverse) < len(beta) else None


def _newton_in_task(keys: list[str], k: int, max_iter: int, tol: float):
    """All steps of one key over its distinct design rows."""
    def fit(f: pd.DataFrame) -> pd.DataFrame:
        X = np.column_stack([np.ones(len(f))] + [f[f"_x{i}"].to_numpy(float) for i in range(k - 1)])
        y, w = f["_y"].to_numpy(float), f["_w"].to_numpy(float)
        beta, done, error = np.zeros(k), False, None
        for _ in range(max_iter):
            eta = X @ beta
            with np.errstate(over="ignore", invalid="ignore"):
                p = 1.0 / (1.0 + np.exp(-eta))
                ll = float(w @ (y * eta - np.log1p(np.exp(eta))))
            beta, done, error = _newton_step(beta, w.sum(), ll, np.abs(eta).max(), X.T @ (w * (y - p)), (X * (w * p * (1 - p))[:, None]).T @ X, tol)
            if done or error:
                break
        return pd.DataFrame([[*[f[c].iloc[0] for c in keys], w.sum(), beta.tolist(), done, error]], columns=[*keys, "n", "beta", "converged", "error"])

    return fit


def _newton_jobs(data: DataFrame, keys: list[str], k: int, schema: str, max_iter: int, tol: float) -> DataFrame:
    """A job a step for all keys."""
    spark = data.sparkSession
    X = [F.lit(1.0)] + [F.col(f"_x{i}") for i in range(k - 1)]
    eta = reduce(lambda a, b: a + b, [F.col("beta")[0]] + [F.col("beta")[i] * X[i] for i in range(1, k)])
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))
    names = ["n", "ll", "maxeta"] + [f"g{i}" for i in range(k)] + [f"h{i}_{j}" for i in range(k) for j in range(i, k)]

    def step(frames):
        for f in frames:
            out = []
            for row in f.to_dict("records"):
                H = np.empty((k, k))
                for i in range(k):
                    for j in range(i, k):
                        H[i, j] = H[j, i] = row[f"h{i}_{j}"]
                beta, done, error = _newton_step(np.asarray(row["beta"], float), row["n"], row["ll"], row["maxeta"], np.array([row[f"g{i}"] for i in range(k)], float), H, tol)
                out.append([*[row[c] for c in keys], row["n"], beta.tolist(), done, error])
            yield pd.DataFrame(out, columns=[*keys, "n", "beta", "converged", "error"])

    start = data.select(*keys).distinct().select(*keys, F.lit(0.0).alias("n"), F.array(*[F.lit(0.0)] * k).alias("beta"), F.lit(False).alias("converged"),
                                                 F.lit(None).cast("string").alias("error"))
    state, path = written_at(start, "coefficients")
    goes_on = ~F.col("converged") & F.col("error").isNull()
    for _ in range(max_iter):
        left = state.filter(goes_on).count()
        if not left:
            break
        betas = state.filter(goes_on).select(*keys, "beta")
        sums = data.join(F.broadcast(betas) if left <= KEYS_TO_BROADCAST else betas, keys).groupBy(*keys).agg(F.first("beta").alias("beta"), *_newton_sums(eta, p, X))
        after, new = written_at(sums.select(*keys, "beta", *names).mapInPandas(step, schema).unionByName(state.filter(~goes_on)), "coefficients")
        remove_written(spark, path)
        state, path = after, new
    return state


def logit_effect(df: DataFrame, treatment: str, outcome: str, confounders: Sequence[str] = (),
                 method: str = "Logit", alpha: float = 0.05, term: str | None = None,
                 extra: dict[str, Column] | None = None) -> DataFrame:
    """EST2 (+EST3): log-odds coefficient of ``term`` (default the treatment), z test, CI,
    odds ratio, and the risk difference implied at the control-arm base rate."""
    spark = df.sparkSession
    xs = {treatment: F.col(treatment)}
    for c in confounders:
        if c != treatment:
            xs[c] = F.col(c)
    if extra:
        xs.update(extra)
    term = term or treatment
    fit = logit_fit(df, outcome, xs)
    if fit["error"] and fit["error"] != "did not converge":
        return effect_df(spark, [effect_row(method=method, treatment=treatment, outcome=outcome,
                                            n=fit["n"], error=fit["error"])])
    i = fit["names"].index(term)
    b = float(fit["beta"][i])
    se = math.sqrt(max(float(fit["cov"][i, i]), 0.0))
    z = b / se if se > 0 else float("nan")
    crit = norm_ppf(1 - alpha / 2)
    lo, hi = b - crit * se, b + crit * se
    p0 = (df.filter(F.col(treatment) == 0).select(F.avg(F.col(outcome).cast("double"))).collect()[0][0])
    rd = rd_lo = rd_hi = None
    if p0 is not None and 0 < p0 < 1:
        rd, rd_lo, rd_hi = (or_to_rd(math.exp(v), p0) for v in (b, lo, hi))
    return effect_df(spark, [effect_row(method=method, treatment=treatment, outcome=outcome, n=fit["n"],
                                        estimate=b, std_error=se, stat=z, p_value=z_sf2(z), ci_lower=lo,
                                        ci_upper=hi, odds_ratio=math.exp(b), risk_diff=rd, rd_lower=rd_lo,
                                        rd_upper=rd_hi, error=fit["error"])])


def or_to_rd(odds_ratio: float, p0: float) -> float:
    """EST3: risk difference implied by an odds ratio at base rate p0."""
    return odds_ratio * p0 / (1 - p0 + odds_ratio * p0) - p0


def or_to_rd_col(or_col: Column, p0: Column) -> Column:
    return or_col * p0 / (F.lit(1.0) - p0 + or_col * p0) - p0


__all__ = ["ols_effect", "logit_fit", "logit_effect", "or_to_rd", "or_to_rd_col", "coef_to_effect",
           "EFFECT_SCHEMA"]
