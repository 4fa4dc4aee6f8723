"""One dispatcher over the effect estimators (EST11, EST12, REF1, REF2).

``effects`` estimates a method's effect for every value of some key columns in one job: keys are periods, bootstrap replicates, or
replicates of a refutation.  Rows are weighted by frequencies (bootstrap draws).  Keys for which the method has no answer keep their row
with a null estimate.

method            nuisance
``ols``           linear in the confounders
``iptw``          logistic propensity, fitted for all keys together by Newton steps
``iptw_cells``    share of the treated in the confounder cell
``psm``           logistic propensity, nearest score of the other arm
``psm_cells``     share in the cell, nearest score of the other arm
``g_formula``     mean of each arm in the confounder cell
``dml_cells``     cross-fitted cell means
``dml``           cross-fitted forests
``t_learner``, ``s_learner``   forests
``t_learner_cells``            cell means
``causal_forest``              honest causal forest on cross-fitted forest residuals
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import explode_replicates, poisson1, row_seed, std_normal, uniform
from ..functions.dist import norm_ppf
from ..session import written
from . import cells, forest
from .gram import moments, solve_moments
from .observational import nearest_scores
from .permute import permuted
from .regression import is_discrete, logit_by_key

FORESTS = ("dml", "t_learner", "s_learner", "causal_forest")
CELLS = ("iptw_cells", "psm_cells", "g_formula", "dml_cells", "t_learner_cells")
LOGISTIC = ("iptw", "psm")
METHODS = ("ols", *LOGISTIC, *CELLS, *FORESTS)


def rows_of(df: DataFrame, method: str, treatment: str, outcome: str, confounders: Sequence[str], row_id: str, keep: Sequence[str] = (),
            bins: int = forest.BINS) -> tuple[DataFrame, list[str]]:
    """Rows as ``effects`` takes them: _id, _t, _y, ``keep`` and the confounders (forests: their cells), and the confounders' names.

    Rows without treatment, outcome or a key are left out, for regressions also those without a confounder."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; one of {', '.join(METHODS)}")
    df = df.withColumns({"_id": F.col(row_id), "_t": F.col(treatment).cast("double"), "_y": F.col(outcome).cast("double")})
    df = df.dropna(subset=["_id", "_t", "_y", *keep])
    names = list(confounders)
    if method in FORESTS:
        df, names = forest.with_cells(df, names, bins)
    elif method not in CELLS:
        df = df.dropna(subset=names) if names else df
    return df.select("_id", "_t", "_y", *keep, *names), names


def effects(rows: DataFrame, method: str, confounders: Sequence[str], keys: Sequence[str], weight: str | None = None, seed: int = 42,
            k: int = 3, trees: int = forest.TREES, clip: tuple[float, float] | None = None, binary: bool = False,
            discrete: bool | None = None) -> DataFrame:
    """keys, n, estimate, std_error (null where the method has none) for every value of ``keys``.

    Logistic methods reduce rows to cells of equal treatment and confounders first where that makes them fewer (``discrete``: None measures)."""
    keys, xs = list(keys), list(confounders)
    if method in LOGISTIC:
        if discrete is None:
            discrete = is_discrete(rows.select(*keys, *xs, "_t"))
        rows = _reduced(rows, xs, keys, weight, discrete)
        weight = "_w"
    w = F.col(weight) if weight else F.lit(1)
    found = _ESTIMATORS[method](rows, xs, keys, weight, {"seed": seed, "k": k, "trees": trees, "clip": clip, "binary": binary, "discrete": discrete})
    t = F.when(w > 0, F.col("_t"))
    every = rows.groupBy(*keys).agg(F.sum(w).cast("long").alias("n"), (F.min(t) < F.max(t)).alias("_both"))  # one arm alone has no effect
    found = found.select(*[F.col(c).alias(f"_key_{c}") for c in keys], "estimate", "std_error")
    on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_key_{c}") for c in keys])
    return every.join(found, on, "left").select(*keys, "n", *[F.when(F.col("_both"), _finite(c)).alias(c) for c in ("estimate", "std_error")])


def _reduced(rows: DataFrame, xs: Sequence[str], keys: Sequence[str], weight: str | None, discrete: bool) -> DataFrame:
    """keys, xs, _t, _w (frequency), _y (mean), _yy (sum of squares): cells of equal keys, confounders and treatment, or the rows themselves."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    if not discrete:
        return rows.select(*keys, *xs, "_t", w.alias("_w"), "_y", (w * F.col("_y") * F.col("_y")).alias("_yy"))
    g = rows.select(*keys, *xs, "_t", w.alias("_w"), "_y").filter("_w > 0").groupBy(*keys, *xs, "_t").agg(
        F.sum("_w").alias("_w"), F.sum(F.col("_w") * F.col("_y")).alias("_s"), F.sum(F.col("_w") * F.col("_y") * F.col("_y")).alias("_yy"))
    return written(g.select(*keys, *xs, "_t", "_w", (F.col("_s") / F.col("_w")).alias("_y"), "_yy"), "cells")


def _finite(name: str):
    c = F.col(name)
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def _none(name: str = "std_error"):
    return F.lit(None).cast("double").alias(name)


def _ols(rows, xs, keys, weight, options):
    exprs = {"_t": F.col("_t"), **{x: F.col(x) for x in xs}, "__y": F.col("_y")}
    g, names = moments(rows, exprs, keys=keys, weight=weight)
    return solve_moments(g, names, "__y", ["_t", *xs], keys=keys, terms=["_t"])


def _with_logistic(rows, xs, keys, options):
    """``rows`` (reduced) with _e from one logistic fit a key; keys whose fit failed are left out."""
    clip = options["clip"]
    fits = logit_by_key(rows, "_t", xs, keys, "_w", discrete=options["discrete"]).filter(F.col("error").isNull()).select(*keys, "beta")
    eta = F.col("beta")[0]
    for i, x in enumerate(xs):
        eta = eta + F.col("beta")[i + 1] * F.col(x).cast("double")
    e = F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))
    if clip:
        e = F.least(F.greatest(e, F.lit(clip[0])), F.lit(clip[1]))
    return rows.join(fits, keys).withColumn("_e", e).drop("beta")


def _iptw(rows, xs, keys, weight, options):
    t, e = F.col("_t"), F.col("_e")
    scored = _with_logistic(rows, xs, keys, options).filter((e > 0) & (e < 1))
    factor = t / e - (F.lit(1.0) - t) / (F.lit(1.0) - e)  # of an outcome
    g = scored.select(*keys, "_t", "_w", (F.col("_w") * factor * F.col("_y")).alias("d"), (factor * factor * F.col("_yy")).alias("dd")).groupBy(*keys).agg(
        F.sum("_w").alias("n"), F.sum("d").alias("s"), F.sum("dd").alias("ss"), *[F.sum(F.when(t == a, F.col("_w"))).alias(f"n{a}") for a in (0, 1)])
    mean = F.try_divide("s", "n")
    variance = F.try_divide(F.greatest(F.col("ss") - F.col("n") * mean * mean, F.lit(0.0)), F.col("n") - 1)
    return g.select(*keys, F.when((F.col("n0") > 0) & (F.col("n1") > 0), mean).alias("estimate"), F.sqrt(F.try_divide(variance, F.col("n"))).alias("std_error"))


def _iptw_cells(rows, xs, keys, weight, options):
    return cells.iptw_cells(rows, "_t", "_y", xs, keys=keys, weight=weight)


def _matched(scored, keys, weight):
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    by_score = (scored.select(*keys, F.col("_t").cast("int").alias("arm"), F.col("_e").alias("score"), w.alias("w"), "_y").dropna()
                .filter(F.col("w") > 0).groupBy(*keys, "arm", "score")
                .agg(F.sum("w").alias("n"), (F.sum(F.col("w") * F.col("_y")) / F.sum("w")).alias("mean_y")))
    m = nearest_scores(by_score, keys)
    d = F.when(F.col("arm") == 1, F.col("mean_y") - F.col("matched_y")).otherwise(F.col("matched_y") - F.col("mean_y"))
    return m.groupBy(*keys).agg(F.try_divide(F.sum(F.col("n") * d), F.sum(F.when(F.col("matched_y").isNotNull(), F.col("n")))).alias("estimate")).select(*keys, "estimate", _none())


def _psm(rows, xs, keys, weight, options):
    return _matched(_with_logistic(rows, xs, keys, options), keys, weight)


def _psm_cells(rows, xs, keys, weight, options):
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    arms = rows.groupBy(*keys, *xs, "_t").agg(F.sum(w).alias("n"), (F.sum(w * F.col("_y")) / F.sum(w)).alias("_y")).filter(F.col("n") > 0)
    shares = cells.with_propensity(arms.withColumn("t", F.col("_t")), [*keys, *xs]).withColumnRenamed("e", "_e")
    return _matched(shares, keys, "n")


def _g_formula(rows, xs, keys, weight, options):
    return cells.t_learner_cells(rows, "_t", "_y", xs, keys, weight).select(*keys, "estimate", _none())


def _dml_cells(rows, xs, keys, weight, options):
    return cells.dml_cells(rows, "_t", "_y", xs, "_id", keys, options["k"], options["seed"], weight)


def _folded(rows, options):
    fold = F.floor(uniform(F.col("_id"), F.lit(options["seed"]), F.lit("fold")) * options["k"]).cast("int")
    return rows.withColumn("_fold", fold)


def _residuals(rows, xs, keys, weight, options):
    r = forest.with_nuisances(_folded(rows, options), xs, keys, options["k"], options["binary"], options["trees"], options["seed"], weight)
    return r.withColumns({"_tt": F.col("_t") - F.col("_e"), "_yt": F.col("_y") - F.col("_m")}).dropna(subset=["_tt", "_yt"])


def _dml(rows, xs, keys, weight, options):
    """Constant effect on cross-fitted residuals, HC1 error; all sums in one aggregate."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    tt, yt = F.col("_tt"), F.col("_yt")
    r = _residuals(rows, xs, keys, weight, options).select(*keys, w.alias("w"), (tt * yt).alias("b"), (tt * tt).alias("a"))
    s = r.groupBy(*keys).agg(F.sum("w").alias("n"), *[F.sum(F.col("w") * e).alias(c) for c, e in {
        "sa": F.col("a"), "sb": F.col("b"), "aa": F.col("a") * F.col("a"), "ab": F.col("a") * F.col("b"), "bb": F.col("b") * F.col("b")}.items()])
    s = s.withColumn("estimate", F.try_divide("sb", "sa"))
    th = F.col("estimate")
    meat = F.greatest(F.col("bb") - 2 * th * F.col("ab") + th * th * F.col("aa"), F.lit(0.0))
    return s.select(*keys, "estimate", F.sqrt(F.try_divide(meat, F.col("sa") * F.col("sa")) * F.try_divide("n", F.col("n") - 1)).alias("std_error"))


def _mean_ite(rows, table, xs, keys, weight):
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    ite = F.col("_mu1") - F.col("_mu0")
    j = rows.join(table, [*keys, *xs], "left").select(*keys, F.when(ite.isNotNull(), w).alias("w"), ite.alias("ite"))
    return j.groupBy(*keys).agg(F.try_divide(F.sum(F.col("w") * F.col("ite")), F.sum("w")).alias("estimate")).select(*keys, "estimate", _none())


def _t_learner(rows, xs, keys, weight, options):
    return _mean_ite(rows, forest.arm_table(rows, xs, keys, options["binary"], options["trees"], options["seed"], weight), xs, keys, weight)


def _s_learner(rows, xs, keys, weight, options):
    return _mean_ite(rows, forest.treated_table(rows, xs, keys, options["binary"], options["trees"], options["seed"], weight), xs, keys, weight)


def _causal_forest(rows, xs, keys, weight, options):
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    r = _residuals(rows, xs, keys, weight, options)
    grown = forest.honest_trees(forest.bag_sums(r, xs, keys, options["trees"], options["seed"], weight), xs, keys)
    scored = rows.join(forest.forest_effects(grown, xs, "_ite", keys), [*keys, *xs], "left").filter("_ite IS NOT NULL")
    s = scored.select(*keys, w.alias("w"), "_ite", "_ite_se").groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("w") * F.col("_ite")), F.sum("w")).alias("estimate"),
        F.sqrt(F.try_divide(F.sum(F.col("w") * F.col("_ite_se") * F.col("_ite_se")), F.sum("w"))).alias("std_error"))
    return s


_ESTIMATORS = {"ols": _ols, "iptw": _iptw, "iptw_cells": _iptw_cells, "psm": _psm, "psm_cells": _psm_cells, "g_formula": _g_formula,
               "dml_cells": _dml_cells, "dml": _dml, "t_learner": _t_learner, "s_learner": _s_learner,
               "t_learner_cells": _g_formula, "causal_forest": _causal_forest}


# EST11 --------------------------------------------------------------------------------------------

def by_period(df: DataFrame, method: str, treatment: str, outcome: str, confounders: Sequence[str], period: str, row_id: str,
              min_rows: int = 20, alpha: float = 0.05, **options) -> DataFrame:
    """period, ATE, CI_Lower, CI_Upper, std_error, n: the effect of every period with at least ``min_rows`` rows, in one job.

    Periods without an answer (one arm only, separation) keep their row with nulls; rows without a period are left out."""
    rows, xs = rows_of(df, method, treatment, outcome, confounders, row_id, [period], options.pop("bins", forest.BINS))
    e = effects(rows, method, xs, [period], **options).filter(F.col("n") >= min_rows)
    z = norm_ppf(1 - alpha / 2)
    return e.select(period, F.col("estimate").alias("ATE"), (F.col("estimate") - z * F.col("std_error")).alias("CI_Lower"),
                    (F.col("estimate") + z * F.col("std_error")).alias("CI_Upper"), "std_error", "n")


# EST12 --------------------------------------------------------------------------------------------

def replicate_effects(df: DataFrame, method: str, treatment: str, outcome: str, confounders: Sequence[str], row_id: str,
                      replicates: int = 50, seed: int = 42, with_original: bool = False, **options) -> DataFrame:
    """rep, estimate, n of every Poisson(1) bootstrap replicate, in one job; null where a replicate has no answer.  ``with_original``: rep 0 is
    the effect over the rows themselves."""
    rows, xs = rows_of(df, method, treatment, outcome, confounders, row_id, (), options.pop("bins", forest.BINS))
    rep = explode_replicates(rows, row_seed(F.col("_id"), F.lit(seed)), replicates, 1).withColumn("_w", poisson1(F.col("_u0"))).drop("_u0").filter(F.col("_w") > 0)
    if method in LOGISTIC and "discrete" not in options:
        options["discrete"] = is_discrete(rows.select(*xs, "_t"))
    if with_original:
        rep = rep.unionByName(rows.withColumns({"_rep": F.lit(0), "_w": F.lit(1)}))
    return effects(rep, method, xs, ["_rep"], weight="_w", seed=seed, **options).select(F.col("_rep").alias("rep"), "estimate", "n")


def bootstrap(df: DataFrame, method: str, treatment: str, outcome: str, confounders: Sequence[str], row_id: str, replicates: int = 50,
              seed: int = 42, alpha: float = 0.05, **options) -> DataFrame:
    """estimate, boot_mean, boot_se (ddof 1), percentile bounds and the number of replicates with an answer, for any method."""
    if not 10 <= replicates <= 500:
        raise ValueError("replicates must be within [10, 500]")
    per = replicate_effects(df, method, treatment, outcome, confounders, row_id, replicates, seed, with_original=True, **options)
    drawn = F.when(F.col("rep") > 0, F.col("estimate"))
    s = per.filter("estimate IS NOT NULL").agg(
        F.max(F.when(F.col("rep") == 0, F.col("estimate"))).alias("estimate"), F.avg(drawn).alias("boot_mean"), F.stddev_samp(drawn).alias("boot_se"),
        F.percentile(drawn, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("_q"), F.count(drawn).cast("long").alias("replicates_ok"))
    return s.select("estimate", "boot_mean", "boot_se", F.col("_q")[0].alias("ci_lower"), F.col("_q")[1].alias("ci_upper"), "replicates_ok")


def original_effect(df: DataFrame, method: str, treatment: str, outcome: str, confounders: Sequence[str], row_id: str, **options) -> DataFrame:
    """One row with the method's ``estimate`` over all rows."""
    rows, xs = rows_of(df, method, treatment, outcome, confounders, row_id, (), options.pop("bins", forest.BINS))
    return effects(rows.withColumn("_all", F.pmod(F.xxhash64("_id"), F.lit(1))), method, xs, ["_all"], **options).select("estimate")


# REF1 / REF2 --------------------------------------------------------------------------------------

def refuted(df: DataFrame, method: str, refuter: str, treatment: str, outcome: str, confounders: Sequence[str], row_id: str,
            replicates: int = 100, seed: int = 42, **options) -> DataFrame:
    """rep, estimate under a random common cause or a placebo (permuted) treatment, for any method, in one job.

    The common cause is a N(0, 1) draw a row and replicate; methods on cells take its eighths as a confounder."""
    bins = options.pop("bins", forest.BINS)
    rows, xs = rows_of(df, method, treatment, outcome, confounders, row_id, (), bins)
    if refuter == "random_common_cause":
        rep = explode_replicates(rows, row_seed(F.col("_id"), F.lit(seed)), replicates, 2)
        z = std_normal(F.col("_u0"), F.col("_u1"))
        if method in CELLS:
            z = (z > 0).cast("int")
        elif method in FORESTS:
            z = F.floor(z * 8) / 8
        rep, xs = rep.withColumn("_rcc", z), [*xs, "_rcc"]
    elif refuter == "placebo":
        rep = permuted(rows, "_t", "_id", replicates, seed).withColumn("_t", F.col("_placebo")).drop("_placebo")
    else:
        raise ValueError(f"unknown refuter {refuter!r}")
    rep = rep.select("_rep", "_id", "_t", "_y", *xs)
    if method in LOGISTIC and "discrete" not in options:
        options["discrete"] = refuter == "placebo" and is_discrete(rows.select(*xs, "_t"))
    if refuter == "placebo" and (method in FORESTS or options.get("discrete") is False):
        rep = written(rep, "placebo")  # read by every Newton step or forest stage
    return effects(rep, method, xs, ["_rep"], seed=seed, **options).select(F.col("_rep").alias("rep"), "estimate")
