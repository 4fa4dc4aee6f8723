"""Heterogeneity scans (HTE1-HTE5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gram import moments, solve_specs
from .observational import add_t_pvalue


def univariate_scan(scored: DataFrame, ite_col: str, features: Sequence[str]) -> DataFrame:
    """HTE2: ``ITE ~ feature`` for every feature in one aggregate (regr_slope / regr_r2 /
    regr_count); t from r^2, p from Student t, significant at 0.05, sorted by p."""
    y = F.col(ite_col).cast("double")
    aggs = []
    for i, f in enumerate(features):
        x = F.col(f).cast("double")
        aggs += [F.regr_slope(y, x).alias(f"b{i}"), F.regr_r2(y, x).alias(f"r{i}"), F.regr_count(y, x).alias(f"n{i}")]
    a = scored.agg(*aggs)
    items = [F.struct(F.lit(f).alias("feature"), F.col(f"b{i}").alias("slope"), F.col(f"r{i}").alias("r2"),
                      F.col(f"n{i}").alias("n")) for i, f in enumerate(features)]
    long = a.select(F.explode(F.array(*items)).alias("s")).select("s.*")
    t = F.signum(F.col("slope")) * F.sqrt(F.try_divide(F.col("r2") * (F.col("n") - 2), F.lit(1.0) - F.col("r2")))
    long = long.select("feature", "slope", "r2", F.col("n").cast("long").alias("n"), t.alias("t_stat"),
                       (F.col("n") - 2).cast("double").alias("dof"))
    out = add_t_pvalue(long, "t_stat", "dof")
    return out.select("*", (F.col("p_value") < 0.05).alias("significant")).orderBy("p_value")


def interaction_scan(df: DataFrame, treatment: str, outcome: str, features: Sequence[str],
                     confounders: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """HTE3: for each feature X_j, ``Y ~ T + X_j + T*X_j + other confounders``; coefficient and p of
    T*X_j.  One moment aggregate over [T, X*, T*X*, Y]; each model solves a sub-matrix."""
    T = F.col(treatment).cast("double")
    exprs = {"T": T}
    for c in dict.fromkeys([*features, *confounders]):
        exprs[f"X:{c}"] = F.col(c).cast("double")
    for f in features:
        exprs[f"TX:{f}"] = T * F.col(f).cast("double")
    exprs["__y"] = F.col(outcome).cast("double")
    g, names = moments(df, exprs)
    specs = []
    for f in features:
        others = [f"X:{c}" for c in confounders if c != f]
        specs.append((f, "__y", ["T", f"X:{f}", f"TX:{f}", *others], f"TX:{f}"))
    coef = solve_specs(g, names, specs, alpha=alpha)
    return coef.select(F.col("label").alias("feature"), F.col("estimate").alias("interaction"), "std_error",
                       F.col("stat").alias("t_stat"), "p_value", "ci_lower", "ci_upper", "n").orderBy("p_value")


def best_feature(scan: DataFrame) -> DataFrame:
    """Most significant feature of a scan (smallest p)."""
    return scan.orderBy("p_value").limit(1)


def ranked_importances(importances: DataFrame) -> DataFrame:
    """HTE5: forest feature importances ranked (descending)."""
    from pyspark.sql import Window
    # one row per feature: an unpartitioned window over #features rows
    return importances.select("*", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")).alias("rank"))
