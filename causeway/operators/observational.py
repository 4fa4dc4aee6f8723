"""Observational ATE estimators (EST4-EST14).

Saturated ("cell") mode uses discrete confounders: every nuisance function is
a cell mean computed by ``groupBy(cells)`` and joined back, so a hot cell is
combined map-side rather than held by one task.  Logistic propensities use
the distributed IRLS in ``regression``; forests are grown
from cell sums in ``forest``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import dlit, exact_quantiles, one_row, rnd, uniform
from ..functions.dist import norm_ppf, t_ppf, t_sf2, z_sf2
from ..session import written
from . import forest
from .regression import logit_fit
from .cells import dml_cells, iptw_cells, period_columns, t_learner_cells
from .results import effect_df, effect_row

# EST4 ---------------------------------------------------------------------------------------------


def join_cells(df: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with the columns of ``cells`` (one row per cell); null keys are cells like any other."""
    right = cells.select(*[F.col(k).alias(f"_cell_{i}") for i, k in enumerate(keys)], *[c for c in cells.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_cell_{i}")) for i, k in enumerate(keys)], F.lit(True))
    return df.join(right, on, "left").drop(*[f"_cell_{i}" for i in range(len(keys))])


def with_propensity(df: DataFrame, treatment: str, confounders: Sequence[str], mode: str = "saturated",
                    name: str = "propensity") -> DataFrame:
    """Adds e(x) = P(T=1 | X).

    saturated: arm share within each confounder cell (aggregate + join back);
    logistic: unpenalised logistic regression (IRLS) evaluated as a column expression.
    """
    if mode == "saturated":
        cells = df.groupBy(*confounders).agg(F.avg(F.col(treatment).cast("double")).alias(name))
        return join_cells(df, cells, confounders)
    if mode == "logistic":
        fit = logit_fit(df, treatment, list(confounders))
        eta = F.lit(float(fit["beta"][0]))
        for b, c in zip(fit["beta"][1:], confounders):
            eta = eta + F.lit(float(b)) * F.col(c).cast("double")
        return df.withColumn(name, F.lit(1.0) / (F.lit(1.0) + F.exp(-eta)))
    raise ValueError(mode)


# EST5 ---------------------------------------------------------------------------------------------

def iptw(df: DataFrame, treatment: str, outcome: str, propensity: str = "propensity",
         normalized: bool = False, clip: tuple[float, float] | None = None) -> DataFrame:
    """Inverse-propensity-weighted ATE (Horvitz-Thompson, or Hajek when ``normalized``).

    The SE comes from the influence terms: of the contrast for Horvitz-Thompson, centred at the arm
    means for Hajek (a second aggregate).  Rows with e(x) in {0, 1} have no weight; ``error`` says how many.
    """
    e = F.col(propensity)
    if clip:
        e = F.least(F.greatest(e, F.lit(clip[0])), F.lit(clip[1]))
    t = F.col(treatment).cast("double")
    y = F.col(outcome).cast("double")
    # positivity: rows with e(x) in {0, 1} have no inverse weight and are excluded
    rows = df.select(t.alias("t"), y.alias("y"), e.alias("e")).dropna()
    base = rows.filter((F.col("e") > 0) & (F.col("e") < 1))
    lost = one_row(rows.agg(F.count(F.when((F.col("e") <= 0) | (F.col("e") >= 1), 1)).alias("n")))["n"]
    note = f"{lost} rows without overlap were left out" if lost else None
    a1 = F.col("t") * F.col("y") / F.col("e")
    a0 = (F.lit(1.0) - F.col("t")) * F.col("y") / (F.lit(1.0) - F.col("e"))
    w1 = F.col("t") / F.col("e")
    w0 = (F.lit(1.0) - F.col("t")) / (F.lit(1.0) - F.col("e"))
    agg = base.agg(F.count(F.lit(1)).alias("n"), F.sum(a1).alias("a1"), F.sum(a0).alias("a0"),
                   F.sum(w1).alias("w1"), F.sum(w0).alias("w0"),
                   F.var_samp(a1 - a0).alias("v"))
    if normalized:
        est = F.try_divide(F.col("a1"), F.col("w1")) - F.try_divide(F.col("a0"), F.col("w0"))
        method = "IPTW (Hajek)"
    else:
        est = F.try_divide(F.col("a1") - F.col("a0"), F.col("n"))
        method = "IPTW"
    se = F.sqrt(F.try_divide(F.col("v"), F.col("n")))
    if normalized:
        s = one_row(agg)
        mu1, mu0 = (s["a1"] / s["w1"] if s["w1"] else None), (s["a0"] / s["w0"] if s["w0"] else None)
        part = F.try_divide(w1 * (F.col("y") - dlit(mu1)), dlit(s["w1"])) - F.try_divide(w0 * (F.col("y") - dlit(mu0)), dlit(s["w0"]))
        se = dlit(one_row(base.agg(F.sqrt(F.sum(part * part)).alias("se")))["se"])
    z = norm_ppf(0.975)
    return agg.select(F.lit(method).alias("method"), F.lit(treatment).alias("treatment"),
                      F.lit(outcome).alias("outcome"), F.col("n").cast("long").alias("n"),
                      est.alias("estimate"), se.alias("std_error"), F.try_divide(est, se).alias("stat"),
                      F.lit(None).cast("double").alias("p_value"),
                      (est - z * se).alias("ci_lower"), (est + z * se).alias("ci_upper"),
                      *[F.lit(None).cast("double").alias(k) for k in ("odds_ratio", "risk_diff", "rd_lower", "rd_upper")],
                      F.lit(note).cast("string").alias("error"))


# EST6 ---------------------------------------------------------------------------------------------

def score_cells(df: DataFrame, treatment: str, outcome: str, propensity: str = "propensity",
                digits: int | None = None) -> DataFrame:
    """(arm, score, n, mean_y): rows of an arm with the same score (rounded to ``digits`` if given)."""
    score = F.col(propensity) if digits is None else rnd(propensity, digits)
    return (df.select(F.col(treatment).cast("int").alias("arm"), score.alias("score"),
                      F.col(outcome).cast("double").alias("y")).dropna()
            .groupBy("arm", "score").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean_y")))


def nearest_scores(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Each score cell with ``matched_y``: the mean outcome of the nearest cell of the other arm (lower score on a tie), within its ``keys``.

    Cells are laid out by key and score over range partitions and written.  Inside a partition two windows find the
    last cell of the other arm before a cell and the first after it; one row per partition and key carries the
    ends of the partitions around it.  No arm or key is held by a task or the driver."""
    keys = list(keys)
    laid = written(cells.repartitionByRange(*keys, "score").withColumn("_p", F.spark_partition_id()), "scores")

    def of(arm):
        return F.when(F.col("arm") == arm, F.struct("score", "mean_y"))
    ends = laid.groupBy(*keys, "_p").agg(*[f(of(a)).alias(f"{n}{a}") for a in (0, 1) for f, n in ((F.max, "last"), (F.min, "first"))])
    by = Window.partitionBy(*keys).orderBy("_p")  # a row per partition
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(1, Window.unboundedFollowing)
    carried = ends.select(*keys, "_p", *[F.last(f"last{a}", ignorenulls=True).over(before).alias(f"_b{a}") for a in (0, 1)],
                          *[F.first(f"first{a}", ignorenulls=True).over(after).alias(f"_a{a}") for a in (0, 1)])
    inside = Window.partitionBy(*keys, "_p").orderBy("score", "arm")
    up, down = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(0, Window.unboundedFollowing)
    j = laid.join(carried if keys else F.broadcast(carried), [*keys, "_p"]).select(
        *keys, "arm", "score", "n", "mean_y",
        *[F.coalesce(F.last(of(a), ignorenulls=True).over(up), F.col(f"_b{a}")).alias(f"below{a}") for a in (0, 1)],
        *[F.coalesce(F.first(of(a), ignorenulls=True).over(down), F.col(f"_a{a}")).alias(f"above{a}") for a in (0, 1)])
    below = F.when(F.col("arm") == 1, F.col("below0")).otherwise(F.col("below1"))
    above = F.when(F.col("arm") == 1, F.col("above0")).otherwise(F.col("above1"))
    right = below.isNull() | (above["score"] - F.col("score") < F.col("score") - below["score"])
    return j.select(*keys, "arm", "score", "n", "mean_y", F.when(above.isNotNull() & right, above["mean_y"]).otherwise(below["mean_y"]).alias("matched_y"))


def psm(df: DataFrame, treatment: str, outcome: str, propensity: str = "propensity", digits: int | None = None) -> DataFrame:
    """1-nearest-neighbour matching on the propensity score, with replacement, both directions.

    Rows of one arm with the same score form a cell, matched to the nearest score cell of the other
    arm (``nearest_scores``), whose mean outcome is the counterfactual.  Returns ATT, ATC and ATE
    rows; null estimates when an arm is empty."""
    m = nearest_scores(score_cells(df, treatment, outcome, propensity, digits))
    d = F.when(F.col("arm") == 1, F.col("mean_y") - F.col("matched_y")).otherwise(F.col("matched_y") - F.col("mean_y"))
    agg = m.agg(F.sum(F.when(F.col("arm") == 1, F.col("n") * d)).alias("s1"),
                F.sum(F.when(F.col("arm") == 1, F.col("n"))).alias("n1"),
                F.sum(F.when(F.col("arm") == 0, F.col("n") * d)).alias("s0"),
                F.sum(F.when(F.col("arm") == 0, F.col("n"))).alias("n0"))
    att, atc = F.try_divide("s1", "n1"), F.try_divide("s0", "n0")
    ate = F.try_divide(F.col("s1") + F.col("s0"), F.col("n1") + F.col("n0"))
    items = [F.struct(F.lit(k).alias("estimand"), v.alias("estimate"), n.cast("long").alias("n"))
             for k, v, n in (("ATT", att, F.col("n1")), ("ATC", atc, F.col("n0")),
                             ("ATE", ate, F.col("n1") + F.col("n0")))]
    return agg.select(F.explode(F.array(*items)).alias("s")).select(
        F.lit("PSM").alias("method"), "s.estimand", "s.estimate", "s.n")


# EST14 --------------------------------------------------------------------------------------------

def cell_means(df: DataFrame, treatment: str, outcome: str, cells: Sequence[str]) -> DataFrame:
    """Per confounder cell: n, arm counts and arm means (one aggregate, conditional sums)."""
    t = F.col(treatment).cast("int")
    y = F.col(outcome).cast("double")
    return (df.filter(t.isNotNull() & y.isNotNull()).groupBy(*cells)
            .agg(F.count(F.lit(1)).alias("n"), F.count(F.when(t == 1, 1)).alias("n1"),
                 F.count(F.when(t == 0, 1)).alias("n0"),
                 F.avg(F.when(t == 1, y)).alias("mu1"), F.avg(F.when(t == 0, y)).alias("mu0")))


def standardization(df: DataFrame, treatment: str, outcome: str, cells: Sequence[str]) -> DataFrame:
    """g-formula ATE = sum_x (E[Y|T=1,x] - E[Y|T=0,x]) P(x) over cells with both arms; reports
    how many rows sit in cells missing an arm (positivity)."""
    c = cell_means(df, treatment, outcome, cells)
    ok = (F.col("n1") > 0) & (F.col("n0") > 0)
    return c.agg(
        F.try_divide(F.sum(F.when(ok, (F.col("mu1") - F.col("mu0")) * F.col("n"))), F.sum(F.when(ok, F.col("n")))).alias("estimate"),
        F.sum(F.when(ok, F.col("n"))).cast("long").alias("n"),
        F.count(F.when(~ok, 1)).cast("long").alias("cells_without_overlap"),
        F.coalesce(F.sum(F.when(~ok, F.col("n"))), F.lit(0)).cast("long").alias("rows_without_overlap"),
    ).select(F.lit("Standardization (g-formula)").alias("method"), "*")


def positivity_report(df: DataFrame, treatment: str, cells: Sequence[str]) -> DataFrame:
    """Cells that miss one arm (identification check of the star DAG)."""
    t = F.col(treatment).cast("int")
    c = df.groupBy(*cells).agg(F.count(F.when(t == 1, 1)).alias("n1"), F.count(F.when(t == 0, 1)).alias("n0"))
    return c.filter((F.col("n1") == 0) | (F.col("n0") == 0))


# EST9 / EST10 / HTE1: meta-learners -----------------------------------------------------------------

def t_learner_saturated(df: DataFrame, treatment: str, outcome: str, cells: Sequence[str],
                        ite_col: str = "Estimated_ITE") -> DataFrame:
    """T-learner with cell-mean base learners: ITE(x) = mu1(x) - mu0(x) scored on every row.
    (The saturated S-learner on (X, T) cells gives the same function.)"""
    c = cell_means(df, treatment, outcome, cells).select(*cells, (F.col("mu1") - F.col("mu0")).alias(ite_col))
    return join_cells(df, c, cells)


def ate_from_ite(scored: DataFrame, ite_col: str = "Estimated_ITE", method: str = "T-Learner") -> DataFrame:
    s = scored.filter(F.col(ite_col).isNotNull())
    return s.agg(F.lit(method).alias("method"), F.avg(ite_col).alias("estimate"),
                 F.stddev_samp(ite_col).alias("ite_sd"), F.count(F.lit(1)).cast("long").alias("n"))


def _forest_rows(df: DataFrame, treatment: str, outcome: str, features: Sequence[str], row_id: str | None, bins: int) -> tuple[DataFrame, list[str]]:
    """``df`` with _id (a hash of all columns where there is no row id: equal rows then share their weights), _t, _y and cells."""
    known = df.withColumns({"_id": F.xxhash64(*df.columns) if row_id is None else F.col(row_id), "_t": F.col(treatment).cast("double"), "_y": F.col(outcome).cast("double")})
    return forest.with_cells(known, features, bins)


def t_learner_rf(df: DataFrame, treatment: str, outcome: str, features: Sequence[str], binary: bool = False,
                 ite_col: str = "Estimated_ITE", seed: int = 42, trees: int = forest.TREES, bins: int = forest.BINS,
                 row_id: str | None = None) -> DataFrame:
    """T-learner: a forest of unlimited depth for each arm; ITE = mu1 - mu0 (P(Y=1) for binary Y), null where an arm has no rows."""
    rows, xs = _forest_rows(df, treatment, outcome, features, row_id, bins)
    means = forest.arm_table(rows, xs, binary=binary, trees=trees, seed=seed)
    return rows.join(means, xs, "left").select(*[F.col(c) for c in df.columns], (F.col("_mu1") - F.col("_mu0")).alias(ite_col))


def s_learner_rf(df: DataFrame, treatment: str, outcome: str, features: Sequence[str], binary: bool = False,
                 ite_col: str = "Estimated_ITE", seed: int = 42, trees: int = forest.TREES, bins: int = forest.BINS,
                 row_id: str | None = None) -> DataFrame:
    """S-learner: one forest of unlimited depth on (X, T); ITE = f(x, 1) - f(x, 0)."""
    rows, xs = _forest_rows(df, treatment, outcome, features, row_id, bins)
    means = forest.treated_table(rows, xs, binary=binary, trees=trees, seed=seed)
    return rows.join(means, xs, "left").select(*[F.col(c) for c in df.columns], (F.col("_mu1") - F.col("_mu0")).alias(ite_col))


# EST7 / EST8: double machine learning ------------------------------------------------------------

def crossfit_folds(df: DataFrame, row_id: str, k: int = 3, seed: int = 42) -> DataFrame:
    """fold = floor(u(row_id, seed, 'fold') * k): deterministic, partition independent."""
    return df.withColumn("_fold", F.floor(uniform(F.col(row_id), F.lit(seed), F.lit("fold")) * k).cast("int"))


def crossfit_saturated(df: DataFrame, treatment: str, outcome: str, cells: Sequence[str], k: int = 3) -> DataFrame:
    """Out-of-fold cell means m(x) = E[Y|x], e(x) = E[T|x] fitted on the other folds.

    One aggregate by (fold, cell) and one by cell; other-fold sums are
    differences, joined back on (fold, cell).  A cell unseen in the other
    folds falls back to the other folds' grand mean.
    """
    y, t = F.col(outcome).cast("double"), F.col(treatment).cast("double")
    fc = df.groupBy("_fold", *cells).agg(F.sum(y).alias("_sy"), F.sum(t).alias("_st"), F.count(F.lit(1)).alias("_n"))
    tot = df.groupBy(*cells).agg(F.sum(y).alias("_ty"), F.sum(t).alias("_tt"), F.count(F.lit(1)).alias("_tn"))
    fold_tot = df.groupBy("_fold").agg(F.sum(y).alias("_fy"), F.sum(t).alias("_ft"), F.count(F.lit(1)).alias("_fn"))
    from ..functions.columns import dlit, one_row
    tot_row = one_row(df.agg(F.sum(y).alias("y"), F.sum(t).alias("t"), F.count(F.lit(1)).alias("n")))
    all_y, all_t, all_n = dlit(tot_row["y"]), dlit(tot_row["t"]), dlit(tot_row["n"])
    j = join_cells(fc, tot, cells).join(F.broadcast(fold_tot), "_fold")
    n_other = F.col("_tn") - F.col("_n")
    gm_y = F.try_divide(all_y - F.col("_fy"), all_n - F.col("_fn"))
    gm_t = F.try_divide(all_t - F.col("_ft"), all_n - F.col("_fn"))
    nuis = j.select("_fold", *cells,
                    F.when(n_other > 0, (F.col("_ty") - F.col("_sy")) / n_other).otherwise(gm_y).alias("_m"),
                    F.when(n_other > 0, (F.col("_tt") - F.col("_st")) / n_other).otherwise(gm_t).alias("_e"))
    return join_cells(df, nuis, ["_fold", *cells])


def crossfit_linear(df: DataFrame, treatment: str, outcome: str, features: Sequence[str], k: int = 3) -> DataFrame:
    """Out-of-fold OLS nuisances (one moment aggregate per fold, coefficients as literals)."""
    from .gram import moments
    from ..functions.linalg import ols_from_moments
    from .gram import moment_matrix
    parts = []
    for f in range(k):
        train = df.filter(F.col("_fold") != f)
        preds = {}
        for target, name in ((outcome, "_m"), (treatment, "_e")):
            exprs = {c: F.col(c) for c in features}
            exprs["__y"] = F.col(target)
            g, names = moments(train, exprs)
            row = g.collect()[0].asDict()
            M, shifts = moment_matrix(row, len(names))
            beta = ols_from_moments(M, shifts, float(row["_sw"]), with_se=False)["beta"]
            e = F.lit(float(beta[0]))
            for b, c in zip(beta[1:], features):
                e = e + F.lit(float(b)) * F.col(c).cast("double")
            preds[name] = e
        parts.append(df.filter(F.col("_fold") == f).select("*", preds["_m"].alias("_m"), preds["_e"].alias("_e")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def linear_dml(df: DataFrame, treatment: str, outcome: str, confounders: Sequence[str], row_id: str,
               nuisance: str = "saturated", modifiers: Sequence[str] | None = None, k: int = 3, seed: int = 42,
               binary_outcome: bool = False, alpha: float = 0.05, trees: int = forest.TREES, bins: int = forest.BINS) -> DataFrame:
    """LinearDML: cross-fitted residuals y~ = y - m(x), t~ = t - e(x); final stage
    y~ = t~ * (theta0 + theta' (x - xbar)) by least squares without intercept (one Gram aggregate);
    ATE = theta0.  HC1 standard error from a second aggregate of the score outer products."""
    spark = df.sparkSession
    modifiers = list(confounders if modifiers is None else modifiers)
    cols = list(dict.fromkeys([treatment, outcome, row_id, *confounders, *modifiers]))
    d = crossfit_folds(df.select(*cols).dropna(subset=[treatment, outcome, *confounders]), row_id, k, seed)
    if nuisance == "saturated":
        r = crossfit_saturated(d, treatment, outcome, confounders, k)
    elif nuisance == "linear":
        r = crossfit_linear(d, treatment, outcome, confounders, k)
    elif nuisance == "rf":
        rows, xs = _forest_rows(d, treatment, outcome, confounders, row_id, bins)
        rows = written(forest.dealt(rows, xs), "rows")  # several jobs read them
        r = forest.with_nuisances(rows, xs, k=k, binary=binary_outcome, trees=trees, seed=seed, deal=False)
    else:
        raise ValueError(nuisance)
    from ..functions.columns import dlit, one_row
    means = one_row(r.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(modifiers)])) \
        if modifiers else {}
    yt = F.col(outcome).cast("double") - F.col("_m")
    tt = F.col(treatment).cast("double") - F.col("_e")
    z = [tt] + [tt * (F.col(c).cast("double") - dlit(means[f"m{i}"])) for i, c in enumerate(modifiers)]
    res = r.select(*[zi.alias(f"_z{i}") for i, zi in enumerate(z)], yt.alias("_yt"))
    try:
        res.persist()
        p = len(z)
        aggs = [F.count(F.lit(1)).alias("n"), F.sum(F.col("_yt") * F.col("_yt")).alias("yy")]
        for i in range(p):
            aggs.append(F.sum(F.col(f"_z{i}") * F.col("_yt")).alias(f"zy{i}"))
            for j in range(i, p):
                aggs.append(F.sum(F.col(f"_z{i}") * F.col(f"_z{j}")).alias(f"zz{i}_{j}"))
        row = res.agg(*aggs).collect()[0]
        n = int(row["n"])
        ZZ = np.empty((p, p))
        for i in range(p):
            for j in range(i, p):
                ZZ[i, j] = ZZ[j, i] = row[f"zz{i}_{j}"]
        Zy = np.array([row[f"zy{i}"] for i in range(p)])
        inv = np.linalg.pinv(ZZ)
        theta = inv @ Zy
        resid = F.col("_yt") - sum((F.lit(float(theta[i])) * F.col(f"_z{i}") for i in range(p)), F.lit(0.0))
        meat_aggs = []
        for i in range(p):
            for j in range(i, p):
                meat_aggs.append(F.sum(F.col(f"_z{i}") * F.col(f"_z{j}") * resid * resid).alias(f"m{i}_{j}"))
        mrow = res.agg(*meat_aggs).collect()[0]
    finally:
        res.unpersist()
    meat = np.empty((p, p))
    for i in range(p):
        for j in range(i, p):
            meat[i, j] = meat[j, i] = mrow[f"m{i}_{j}"]
    cov = inv @ meat @ inv * (n / max(n - p, 1))
    est = float(theta[0])
    se = math.sqrt(max(cov[0, 0], 0.0))
    crit = norm_ppf(1 - alpha / 2)
    return effect_df(spark, [effect_row(method=f"LinearDML ({nuisance})", treatment=treatment, outcome=outcome, n=n,
                                        estimate=est, std_error=se, stat=est / se if se > 0 else None,
                                        p_value=z_sf2(est / se) if se > 0 else None,
                                        ci_lower=est - crit * se, ci_upper=est + crit * se)])


def causal_forest(df: DataFrame, treatment: str, outcome: str, confounders: Sequence[str], row_id: str,
                  k: int = 3, seed: int = 42, binary_outcome: bool = False, trees: int = forest.TREES,
                  ite_col: str = "Estimated_ITE", bins: int = forest.BINS, least: int = 5) -> tuple[DataFrame, DataFrame]:
    """EST8: honest causal forest on cross-fitted residuals.  Returns (scored rows, importances).

    Residuals of outcome and treatment come from cross-fitted forests.  Every tree of a little bag finds its splits on one half of its
    rows, by the gradient of the local moment, and fills its leaves from the other half; a row's effect is the ratio of its leaves' mean
    moments, its standard error (``<ite_col>_se``) comes from the variance between bags.  Rows without the treatment, the outcome or a confounder
    teach nothing; all rows are scored."""
    every, xs = _forest_rows(df, treatment, outcome, confounders, row_id, bins)
    rows = crossfit_folds(every.dropna(subset=[treatment, outcome, *confounders]), row_id, k, seed).select("_id", "_t", "_y", "_fold", *xs)
    rows = written(forest.dealt(rows, xs), "rows")  # several jobs read them
    rows = forest.with_nuisances(rows, xs, k=k, binary=binary_outcome, trees=trees, seed=seed, deal=False)
    rows = rows.select("_id", *xs, (F.col("_t") - F.col("_e")).alias("_tt"), (F.col("_y") - F.col("_m")).alias("_yt")).dropna()
    grown = written(forest.honest_trees(forest.bag_sums(rows, xs, trees=trees, seed=seed, deal=False), xs, least=least), "trees")
    scored = every.join(forest.forest_effects(grown, xs, ite_col), xs, "left").select(*[F.col(c) for c in df.columns], ite_col, f"{ite_col}_se")
    parts = grown.filter("importance IS NOT NULL").select(F.posexplode("importance").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"))
    names = F.element_at(F.array(*[F.lit(c) for c in confounders]), F.col("k") + 1)
    total = one_row(parts.agg(F.sum("v").alias("s")))["s"]
    importances = parts.select(names.alias("feature"), (F.try_divide(F.col("v"), dlit(total or 1.0))).alias("importance"))
    return scored, importances


def causal_ate(scored: DataFrame, ite_col: str = "Estimated_ITE", alpha: float = 0.05, method: str = "CausalForestDML") -> DataFrame:
    """method, estimate, std_error (root of the mean squared error of the effects: an upper bound), ci_lower, ci_upper, n."""
    s = scored.filter(F.col(ite_col).isNotNull())
    z = norm_ppf(1 - alpha / 2)
    se = F.sqrt(F.avg(F.col(f"{ite_col}_se") * F.col(f"{ite_col}_se")))
    return s.agg(F.avg(ite_col).alias("estimate"), se.alias("std_error"), F.count(F.lit(1)).cast("long").alias("n")).select(
        F.lit(method).alias("method"), "estimate", "std_error", (F.col("estimate") - z * F.col("std_error")).alias("ci_lower"),
        (F.col("estimate") + z * F.col("std_error")).alias("ci_upper"), "n")


# EST11 --------------------------------------------------------------------------------------------

def effect_by_period(df: DataFrame, treatment: str, outcome: str, confounders: Sequence[str], period: str,
                     min_rows: int = 20, alpha: float = 0.05) -> DataFrame:
    """OLS effect per period in one grouped moment aggregate; periods with < ``min_rows`` rows
    are skipped.  Columns: period, ATE, CI_Lower, CI_Upper, std_error, n."""
    from .gram import ols
    coef = ols(df, outcome, [treatment, *confounders], keys=[period], alpha=alpha, terms=[treatment])
    return (coef.filter(F.col("n") >= min_rows)
            .select(F.col(period), F.col("estimate").alias("ATE"), F.col("ci_lower").alias("CI_Lower"),
                    F.col("ci_upper").alias("CI_Upper"), "std_error", "n"))


def iptw_by_period(df: DataFrame, treatment: str, outcome: str, cells: Sequence[str], period: str,
                   min_rows: int = 20) -> DataFrame:
    """Saturated-propensity IPTW per period, from the cell sums of one grouped aggregate."""
    return period_columns(iptw_cells(df, treatment, outcome, cells, keys=[period]), period, min_rows)


# EST12 --------------------------------------------------------------------------------------------

def _replicate_moments(df: DataFrame, treatment: str, outcome: str, confounders: Sequence[str], row_id: str,
                       replicates: int, seed: int):
    from ..functions.columns import explode_replicates, poisson1, row_seed
    from .gram import moments, solve_moments
    xs = [treatment, *confounders]
    base = df.select(F.col(row_id), *[F.col(c) for c in xs], F.col(outcome)).dropna()
    rep = explode_replicates(base, row_seed(F.col(row_id), F.lit(seed)), replicates, 1)
    exprs = {c: F.col(c) for c in xs}
    exprs["__y"] = F.col(outcome)
    g, names = moments(rep.withColumn("_w", poisson1(F.col("_u0"))), exprs, keys=["_rep"], weight="_w",
                       shift_from=base)
    per = solve_moments(g, names, "__y", xs, keys=["_rep"], with_se=False, terms=[treatment])
    return base, xs, per


def bootstrap(df: DataFrame, treatment: str, outcome: str, confounders: Sequence[str], row_id: str,
              replicates: int = 50, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """Poisson(1) bootstrap of the OLS/difference-in-means effect.

    Each row carries a Lehmer stream seeded by md5(row_id, seed); replicate r's
    weight is the Poisson(1) inverse-CDF of the stream's r-th uniform.  Rows are
    exploded over the replicates straight into a partial aggregate, so only B
    small moment rows per partition are shuffled; every replicate is solved in
    ``mapInPandas``.  Returns estimate, boot_mean, boot_se (ddof 1), percentile
    bounds and the number of successful replicates.
    """
    from .gram import ols
    if not 10 <= replicates <= 500:
        raise ValueError("replicates must be within [10, 500]")
    base, xs, per = _replicate_moments(df, treatment, outcome, confounders, row_id, replicates, seed)
    point = ols(base, outcome, xs, terms=[treatment]).select("estimate").scalar()
    lo, hi = alpha / 2, 1 - alpha / 2
    s = per.filter(F.col("estimate").isNotNull() & ~F.isnan("estimate")).agg(
        F.avg("estimate").alias("boot_mean"), F.stddev_samp("estimate").alias("boot_se"),
        F.percentile("estimate", F.array(F.lit(lo), F.lit(hi))).alias("_q"),
        F.count(F.lit(1)).cast("long").alias("replicates_ok"))
    return s.select(point.alias("estimate"), "boot_mean", "boot_se",
                    F.col("_q")[0].alias("ci_lower"), F.col("_q")[1].alias("ci_upper"), "replicates_ok")


def bootstrap_replicates(df: DataFrame, treatment: str, outcome: str, confounders: Sequence[str], row_id: str,
                         replicates: int = 50, seed: int = 42) -> DataFrame:
    """Per-replicate estimates (rep, estimate) of the Poisson bootstrap."""
    _, _, per = _replicate_moments(df, treatment, outcome, confounders, row_id, replicates, seed)
    return per.select(F.col("_rep").alias("rep"), "estimate")


# ARC2 / REF4 --------------------------------------------------------------------------------------

def welch_table(df: DataFrame, treatment: str, cols: Sequence[str]) -> DataFrame:
    """Per column: arm means, difference, Welch t, dof, two-sided p, standardized mean difference.
    One conditional aggregate; the p-values are computed on the (#columns)-row result."""
    t = F.col(treatment).cast("int")
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.avg(F.when(t == 1, x)).alias(f"m1_{i}"), F.avg(F.when(t == 0, x)).alias(f"m0_{i}"),
                 F.var_samp(F.when(t == 1, x)).alias(f"v1_{i}"), F.var_samp(F.when(t == 0, x)).alias(f"v0_{i}"),
                 F.count(F.when(t == 1, x)).alias(f"n1_{i}"), F.count(F.when(t == 0, x)).alias(f"n0_{i}")]
    a = df.agg(*aggs)
    items = [F.struct(F.lit(c).alias("covariate"), *[F.col(f"{k}_{i}").alias(k) for k in ("m1", "m0", "v1", "v0", "n1", "n0")])
             for i, c in enumerate(cols)]
    long = a.select(F.explode(F.array(*items)).alias("s")).select("s.*")
    q1, q0 = F.try_divide(F.col("v1"), F.col("n1")), F.try_divide(F.col("v0"), F.col("n0"))
    se = F.sqrt(q1 + q0)
    diff = F.col("m1") - F.col("m0")
    tstat = F.try_divide(diff, se)
    dof = F.try_divide((q1 + q0) * (q1 + q0),
                       F.try_divide(q1 * q1, F.col("n1") - 1) + F.try_divide(q0 * q0, F.col("n0") - 1))
    smd = F.try_divide(diff, F.sqrt((F.col("v1") + F.col("v0")) / 2))
    out = long.select("covariate", F.col("m1").alias("mean_treated"), F.col("m0").alias("mean_control"),
                      diff.alias("diff"), tstat.alias("t_stat"), dof.alias("dof"), smd.alias("smd"),
                      F.col("n1").cast("long").alias("n_treated"), F.col("n0").cast("long").alias("n_control"))
    return add_t_pvalue(out, "t_stat", "dof", "p_value")


def add_t_pvalue(df: DataFrame, tcol: str, dofcol: str, out: str = "p_value") -> DataFrame:
    """Two-sided Student-t p-value column computed in Arrow batches (no scipy in the image)."""
    from pyspark.sql.types import DoubleType, StructField, StructType
    schema = StructType(df.schema.fields + [StructField(out, DoubleType())])

    def fn(batches):
        for pdf in batches:
            pdf[out] = [t_sf2(float(t), float(d)) if pd.notna(t) and pd.notna(d) else None
                        for t, d in zip(pdf[tcol], pdf[dofcol])]
            yield pdf
    return df.mapInPandas(fn, schema)


def ab_test(df: DataFrame, group: str, outcome: str, treat, control) -> DataFrame:
    """ARC2: difference in means with a Welch test between two groups of a categorical column."""
    from .clean import encode_treatment
    enc = encode_treatment(df, group, treat, control, "_arm")
    return welch_table(enc, "_arm", [outcome])


__all__ = ["with_propensity", "iptw", "psm", "standardization", "positivity_report", "t_learner_saturated",
           "ate_from_ite", "t_learner_rf", "linear_dml", "causal_forest", "effect_by_period", "bootstrap",
           "welch_table", "ab_test", "t_ppf"]


def dml_by_period(df: DataFrame, treatment: str, outcome: str, cells: Sequence[str], period: str, row_id: str,
                  k: int = 3, seed: int = 42, min_rows: int = 20, alpha: float = 0.05) -> DataFrame:
    """EST11 with LinearDML (saturated nuisances, constant effect, HC1) for every period, from cell sums."""
    return period_columns(dml_cells(df, treatment, outcome, cells, row_id, [period], k, seed), period, min_rows, alpha)


def tlearner_by_period(df: DataFrame, treatment: str, outcome: str, cells: Sequence[str], period: str,
                       min_rows: int = 20) -> DataFrame:
    """EST11 with the saturated T-learner for every period, from cell sums."""
    g = t_learner_cells(df, treatment, outcome, cells, [period])
    return g.filter(F.col("n") >= min_rows).select(period, F.col("estimate").alias("ATE"), "ite_sd", "n")


def bootstrap_standardization(df: DataFrame, treatment: str, outcome: str, cells: Sequence[str], row_id: str,
                              replicates: int = 50, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """EST12 for the saturated g-formula (= IPTW with empirical cell propensities) in one job.

    Poisson(1) weights from the md5-seeded Lehmer streams; weighted arm sums by (replicate,
    cell), then the per-replicate standardized contrast over cells with both arms, then the
    summary -- three aggregates, no Python."""
    from ..functions.columns import explode_replicates, poisson1, row_seed
    t = F.col(treatment).cast("int")
    y = F.col(outcome).cast("double")
    base = df.select(F.col(row_id), *cells, t.alias("_t"), y.alias("_y")).dropna(subset=["_t", "_y"])
    rep = explode_replicates(base, row_seed(F.col(row_id), F.lit(seed)), replicates, 1)
    w = poisson1(F.col("_u0"))
    c = rep.select("_rep", *cells, w.alias("_w"), "_t", "_y").groupBy("_rep", *cells).agg(
        F.sum(F.when(F.col("_t") == 1, F.col("_w")).otherwise(0)).alias("w1"),
        F.sum(F.when(F.col("_t") == 0, F.col("_w")).otherwise(0)).alias("w0"),
        F.sum(F.when(F.col("_t") == 1, F.col("_w") * F.col("_y")).otherwise(0.0)).alias("wy1"),
        F.sum(F.when(F.col("_t") == 0, F.col("_w") * F.col("_y")).otherwise(0.0)).alias("wy0"))
    ok = (F.col("w1") > 0) & (F.col("w0") > 0)
    contrast = (F.try_divide(F.col("wy1"), F.col("w1")) - F.try_divide(F.col("wy0"), F.col("w0"))) \
        * (F.col("w1") + F.col("w0"))
    per = c.groupBy("_rep").agg(F.try_divide(F.sum(F.when(ok, contrast)), F.sum(F.when(ok, F.col("w1") + F.col("w0"))))
                                .alias("estimate"))
    point = standardization(df, treatment, outcome, cells).select("estimate").scalar()
    lo, hi = alpha / 2, 1 - alpha / 2
    s = per.filter(F.col("estimate").isNotNull()).agg(
        F.avg("estimate").alias("boot_mean"), F.stddev_samp("estimate").alias("boot_se"),
        F.percentile("estimate", F.array(F.lit(lo), F.lit(hi))).alias("_q"),
        F.count(F.lit(1)).cast("long").alias("replicates_ok"))
    return s.select(point.alias("estimate"), "boot_mean", "boot_se", F.col("_q")[0].alias("ci_lower"),
                    F.col("_q")[1].alias("ci_upper"), "replicates_ok")
