"""Refutation tests (REF1-REF3).

Replicates are a grouping key, never a driver loop: every replicate's
regression comes out of one grouped moment aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import dlit, explode_replicates, row_seed, std_normal
from ..session import remove_written, shared_path
from . import effects
from .gram import moments, ols, solve_moments
from .permute import permuted


def _summary(per: DataFrame, original, about_zero: bool = False) -> DataFrame:
    """original, new_effect (mean over replicates), new_sd, z, p, passed = p > 0.05.

    A random common cause should not move the estimate: z compares the original with the
    replicates.  A placebo treatment has no effect: z compares the replicates with 0."""
    s = per.agg(F.avg("estimate").alias("new_effect"), F.stddev_samp("estimate").alias("new_sd"),
                F.count(F.lit(1)).cast("long").alias("replicates"))
    # ``original`` (a sub-query) is referenced once, then used by name
    out = s.select(original.alias("original_effect"), "new_effect", "new_sd", "replicates")
    gap = F.col("new_effect") if about_zero else F.col("original_effect") - F.col("new_effect")
    out = out.select("*", F.try_divide(F.abs(gap), F.col("new_sd")).alias("z"))
    # two-sided normal tail 2 * (1 - Phi(z)), computed in Arrow batches
    import pandas as pd
    from statistics import NormalDist
    nd = NormalDist()

    def pv(batches):
        for pdf in batches:
            p = [None if pd.isna(v) else 2.0 * (1.0 - nd.cdf(float(v))) for v in pdf["z"]]
            pdf["p_value"] = p
            pdf["passed"] = [None if x is None else bool(x > 0.05) for x in p]
            yield pdf
    return out.mapInPandas(pv, "original_effect double, new_effect double, new_sd double, replicates long, z double, "
                               "p_value double, passed boolean")


def random_common_cause(df: DataFrame, treatment: str, outcome: str, confounders: Sequence[str], row_id: str,
                        replicates: int = 100, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """REF1: add an independent N(0,1) covariate (md5 Box-Muller per row and replicate) and
    re-estimate; returns (per-replicate estimates, summary)."""
    xs = [treatment, *confounders]
    base = df.select(F.col(row_id), *[F.col(c) for c in xs], F.col(outcome)).dropna()
    rep = explode_replicates(base, row_seed(F.col(row_id), F.lit(seed)), replicates, 2)
    noise = std_normal(F.col("_u0"), F.col("_u1"))
    exprs = {c: F.col(c) for c in xs}
    exprs["_rcc"] = noise
    exprs["__y"] = F.col(outcome)
    # replicate-keyed single-pass covariance moments
    g, names = moments(rep, exprs, keys=["_rep"])
    per = solve_moments(g, names, "__y", [*xs, "_rcc"], keys=["_rep"], with_se=False, terms=[treatment])
    per = per.select(F.col("_rep").alias("rep"), "estimate")
    original = ols(base, outcome, xs, terms=[treatment]).select("estimate").scalar()
    return per, _summary(per, original)


def placebo_treatment(df: DataFrame, treatment: str, outcome: str, confounders: Sequence[str], row_id: str,
                      replicates: int = 100, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """REF2: permute the treatment (:func:`permute.permuted`) and re-estimate; returns (per-replicate estimates, summary).

    The placebo is independent of (Y, X) and has the original values as often as the treatment; the moments of all replicates come
    from one grouped aggregate."""
    xs = [treatment, *confounders]
    base = df.select(F.col(row_id), *[F.col(c) for c in xs], F.col(outcome)).dropna()
    perm = permuted(base, treatment, row_id, replicates, seed)
    exprs = {"_placebo": F.col("_placebo"), **{c: F.col(c) for c in confounders}}
    exprs["__y"] = F.col(outcome)
    g, names = moments(perm, exprs, keys=["_rep"])
    per = solve_moments(g, names, "__y", ["_placebo", *confounders], keys=["_rep"], with_se=False,
                        terms=["_placebo"])
    per = per.select(F.col("_rep").alias("rep"), "estimate")
    original = ols(base, outcome, xs, terms=[treatment]).select("estimate").scalar()
    return per, _summary(per, original, about_zero=True)


def re_estimated(df: DataFrame, treatment: str, outcome: str, confounders: Sequence[str], row_id: str, estimator,
                 refuter: str, replicates: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """REF1 / REF2 for any ``estimator(df, treatment, outcome, confounders) -> row(s) with estimate``: one job per replicate.

    The common cause is a normal per row and replicate; the placebo permutes the treatment, whatever values it has.  The rows of all
    replicates are written once, by replicate.  Replicates without an estimate are left out."""
    spark = df.sparkSession
    first = estimator(df, treatment, outcome, list(confounders)).select("estimate").first()
    original = first["estimate"] if first else None
    rows = df.dropna(subset=[treatment, row_id])
    if refuter == "random_common_cause":
        rep = explode_replicates(rows, row_seed(F.col(row_id), F.lit(seed)), replicates, 2).withColumn("_rcc", std_normal(F.col("_u0"), F.col("_u1")))
        xs = [*confounders, "_rcc"]
    else:
        kind = df.schema[treatment].dataType
        rep = permuted(rows, treatment, row_id, replicates, seed).withColumn(treatment, F.col("_placebo").cast(kind))
        xs = list(confounders)
    path = shared_path(spark, "replicates")
    rep.write.partitionBy("_rep").parquet(path)
    rep = spark.read.parquet(path)
    found = []
    for r in range(1, replicates + 1):
        row = estimator(rep.filter(F.col("_rep") == r), treatment, outcome, xs).select("estimate").first()
        if row is not None and row["estimate"] is not None:
            found.append((r, float(row["estimate"])))
    remove_written(spark, path)
    per = spark.createDataFrame(found, "rep int, estimate double")
    return per, _summary(per, dlit(original), about_zero=refuter != "random_common_cause")


def refutation_supported(method: str, binary_outcome_logit: bool = False) -> str | None:
    """REF3: refutation is not offered for DiD or logit-outcome models; returns the reason or None."""
    if method.lower().startswith("did") or "difference" in method.lower():
        return "Refutation is not available for Difference-in-Differences"
    if binary_outcome_logit:
        return "Refutation is not available for logistic-outcome models"
    return None


def refute_effect(df: DataFrame, treatment: str, outcome: str, confounders: Sequence[str], row_id: str,
                  method: str = "OLS", refuter: str = "random_common_cause", binary_outcome_logit: bool = False,
                  replicates: int = 100, seed: int = 42, post: str | None = None, estimator=None, **options) -> DataFrame:
    """Refutation dispatcher with the REF3 support rule.

    OLS and every method of ``effects`` are refuted in one job for all replicates.  Another method needs its ``estimator(df, treatment,
    outcome, confounders)``, which is run again for every replicate; without one, and for methods that cannot be refuted (DiD,
    logit outcomes), the row carries the reason in ``error``."""
    reason = refutation_supported(method, binary_outcome_logit)
    if reason is not None:
        if post is not None:
            from .did import did_ols
            est = did_ols(df, treatment, post, outcome, confounders)
        else:
            from .regression import ols_effect
            est = ols_effect(df, treatment, outcome, confounders)
        return est.select(F.lit(method).alias("method"), F.lit(refuter).alias("refuter"),
                          F.col("estimate").alias("original_effect"), F.lit(None).cast("double").alias("new_effect"),
                          F.lit(None).cast("double").alias("p_value"), F.lit(None).cast("boolean").alias("passed"),
                          F.lit(reason).alias("error"))
    if refuter not in ("random_common_cause", "placebo"):
        raise ValueError(f"unknown refuter {refuter!r}")
    if estimator is not None:
        _, s = re_estimated(df, treatment, outcome, confounders, row_id, estimator, refuter, replicates, seed)
    elif method.lower() in ("ols", "linear regression", "ols (adjusted)"):
        fn = random_common_cause if refuter == "random_common_cause" else placebo_treatment
        _, s = fn(df, treatment, outcome, confounders, row_id, replicates=replicates, seed=seed)
    elif method in effects.METHODS:
        per = effects.refuted(df, method, refuter, treatment, outcome, confounders, row_id, replicates, seed, **options)
        original = effects.original_effect(df, method, treatment, outcome, confounders, row_id, seed=seed, **options)
        s = _summary(per.filter("estimate IS NOT NULL"), original.scalar(), about_zero=refuter != "random_common_cause")
    else:
        none = F.lit(None)
        return df.sparkSession.range(1).select(
            F.lit(method).alias("method"), F.lit(refuter).alias("refuter"), none.cast("double").alias("original_effect"), none.cast("double").alias("new_effect"),
            none.cast("double").alias("p_value"), none.cast("boolean").alias("passed"), F.lit(f"refuting {method} needs its estimator").alias("error"))
    return s.select(F.lit(method).alias("method"), F.lit(refuter).alias("refuter"), "original_effect", "new_effect",
                    "p_value", "passed", F.lit(None).cast("string").alias("error"))
