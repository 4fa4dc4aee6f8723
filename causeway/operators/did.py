"""Difference-in-differences (QX1-QX3) and the triple-difference scan (HTE4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gram import ols
from .regression import coef_to_effect, logit_effect

INTERACTION = "DiD_Interaction"


def did_ols(df: DataFrame, treatment: str, post: str, outcome: str, confounders: Sequence[str] = (),
            alpha: float = 0.05) -> DataFrame:
    """QX1: ``Y ~ 1 + T + Post + T*Post + X``; effect row of the interaction."""
    xs = {treatment: F.col(treatment), post: F.col(post),
          INTERACTION: F.col(treatment) * F.col(post)}
    for c in confounders:
        xs[c] = F.col(c)
    coef = ols(df, outcome, xs, alpha=alpha, terms=[INTERACTION])
    return coef_to_effect(coef, INTERACTION, "DiD (OLS)", treatment, outcome)


def did_logit(df: DataFrame, treatment: str, post: str, outcome: str, confounders: Sequence[str] = (),
              alpha: float = 0.05) -> DataFrame:
    """QX2: logit of the same design; log-odds of the interaction, odds ratio, risk difference."""
    extra = {post: F.col(post), INTERACTION: F.col(treatment) * F.col(post)}
    return logit_effect(df, treatment, outcome, confounders, method="DiD (Logit)", alpha=alpha,
                        term=INTERACTION, extra=extra)


def did_cells(df: DataFrame, treatment: str, post: str, outcome: str) -> DataFrame:
    """QX3: four-cell table E[Y | T, Post] with counts and the DiD contrast.

    One row per (T, Post) cell plus the two within-group differences and the
    DiD computed over the 4-row aggregate with conditional aggregates.
    """
    cells = (df.select(F.col(treatment).cast("int").alias("treated"), F.col(post).cast("int").alias("post"),
                       F.col(outcome).cast("double").alias("y"))
             .dropna().groupBy("treated", "post")
             .agg(F.avg("y").alias("mean_outcome"), F.count(F.lit(1)).alias("n")))
    return cells


def did_summary(df: DataFrame, treatment: str, post: str, outcome: str) -> DataFrame:
    """QX3 contrast row: treated/control pre/post means, their changes and the DiD."""
    c = did_cells(df, treatment, post, outcome)

    def m(t, p):
        return F.max(F.when((F.col("treated") == t) & (F.col("post") == p), F.col("mean_outcome")))

    s = c.agg(m(1, 0).alias("treated_pre"), m(1, 1).alias("treated_post"),
              m(0, 0).alias("control_pre"), m(0, 1).alias("control_post"))
    return s.select("*", (F.col("treated_post") - F.col("treated_pre")).alias("treated_change"),
                    (F.col("control_post") - F.col("control_pre")).alias("control_change"),
                    ((F.col("treated_post") - F.col("treated_pre"))
                     - (F.col("control_post") - F.col("control_pre"))).alias("did"))


def triple_diff_scan(df: DataFrame, treatment: str, post: str, outcome: str, features: Sequence[str],
                     confounders: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """HTE4: for each feature X, ``Y ~ T + P + TP + X + TX + PX + TPX + conf``; row per feature
    with the triple-interaction coefficient, sorted by p-value.

    All features share one moment aggregate: the design holds every feature's
    interaction columns and each regression reads its sub-matrix.
    """
    from .gram import moments, solve_specs
    T, P = F.col(treatment), F.col(post)
    exprs = {"T": T, "P": P, "TP": T * P}
    for c in confounders:
        exprs[f"c:{c}"] = F.col(c)
    for f in features:
        X = F.col(f)
        exprs[f"X:{f}"] = X
        exprs[f"TX:{f}"] = T * X
        exprs[f"PX:{f}"] = P * X
        exprs[f"TPX:{f}"] = T * P * X
    exprs["__y"] = F.col(outcome)
    g, names = moments(df, exprs)
    base = ["T", "P", "TP"] + [f"c:{c}" for c in confounders]
    specs = [(f, "__y", base + [f"X:{f}", f"TX:{f}", f"PX:{f}", f"TPX:{f}"], f"TPX:{f}") for f in features]
    coef = solve_specs(g, names, specs, alpha=alpha)
    return coef.select(F.col("label").alias("feature"), "estimate", "std_error", "stat", "p_value",
                       "ci_lower", "ci_upper", "n")
