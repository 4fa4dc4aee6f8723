"""Saturated estimators from cell sums (EST4, EST5, EST7, EST10, EST11).

With discrete confounders every estimator is a function of n, mean and variance of the outcome in each
(confounder cell, treatment value): one grouped aggregate over one scan, with no join back to rows.  The table of
cells is written, as totals are joined back to it: no window spans all cells.
Cells are grouped, so rows with a null confounder form cells of their own and are never lost.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import uniform
from ..functions.dist import norm_ppf
from ..session import written


def arm_cells(df: DataFrame, treatment: str, outcome: str, cells: Sequence[str], keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """keys, cells, t, n, m (mean), v (population variance) of rows with treatment and outcome, ``weight`` times each."""
    t, y = F.col(treatment).cast("double"), F.col(outcome).cast("double")
    rows = df.select(*keys, *cells, t.alias("t"), y.alias("_y"), *([F.col(weight).cast("double").alias("_w")] if weight else []))
    g = rows.filter(F.col("t").isNotNull() & F.col("_y").isNotNull()).groupBy(*keys, *cells, "t")
    if not weight:
        return g.agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("m"), F.var_pop("_y").alias("v"))
    g = g.agg(F.sum("_w").alias("n"), F.sum(F.col("_w") * F.col("_y")).alias("s"), F.sum(F.col("_w") * F.col("_y") * F.col("_y")).alias("ss")).filter(F.col("n") > 0)
    m = F.col("s") / F.col("n")
    return g.select(*keys, *cells, "t", "n", m.alias("m"), F.greatest(F.col("ss") / F.col("n") - m * m, F.lit(0.0)).alias("v"))


def propensity_cells(df: DataFrame, treatment: str, cells: Sequence[str]) -> DataFrame:
    """EST4: one row per cell with its arm share e(x)."""
    return df.groupBy(*cells).agg(F.avg(F.col(treatment).cast("double")).alias("propensity"))


def with_propensity(g: DataFrame, group: Sequence[str]) -> DataFrame:
    """``g`` (rows of a cell: one an arm) with e, the cell's share of the treated."""
    w = Window.partitionBy(*group)
    return g.withColumn("e", F.sum(F.col("n") * F.col("t")).over(w) / F.sum("n").over(w))


def _with_totals(g: DataFrame, keys: Sequence[str], totals: dict) -> DataFrame:
    """``g`` with sums over all its rows of a key (of all rows without keys): an aggregate joined back, so that no task holds all cells."""
    keys = list(keys)
    if not keys:  # one row of totals: joined on a column that is 0 in every row
        g, keys = g.withColumn("_one", F.pmod(F.xxhash64("n"), F.lit(1))), ["_one"]
    sums = g.groupBy(*keys).agg(*[F.sum(e).alias(c) for c, e in totals.items()]).withColumnsRenamed({k: f"_of_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return g.join(F.broadcast(sums) if keys == ["_one"] else sums, on).drop(*[f"_of_{k}" for k in keys], "_one")


def iptw_cells(df: DataFrame, treatment: str, outcome: str, cells: Sequence[str], normalized: bool = False,
               keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """EST5 / EST11: keys, n, estimate, std_error, excluded (rows of cells that lack an arm).

    Horvitz-Thompson: SE of the mean of the weighted outcomes.  Hajek (``normalized``): SE from the centred
    influence terms w1 (y - mu1) / W1 and w0 (y - mu0) / W0."""
    g = with_propensity(written(arm_cells(df, treatment, outcome, cells, keys, weight), "cells"), [*keys, *cells])  # read for the totals, too
    inside = (F.col("e") > 0) & (F.col("e") < 1)
    g = g.withColumn("w", F.when(inside, F.when(F.col("t") == 1, F.lit(1.0) / F.col("e")).otherwise(F.lit(1.0) / (F.lit(1.0) - F.col("e")))))
    g = g.withColumn("s", F.when(F.col("t") == 1, 1.0).otherwise(-1.0))
    n, w, m, v, s = (F.col(c) for c in ("n", "w", "m", "v", "s"))
    counts = [F.coalesce(F.sum(F.when(~inside, n)), F.lit(0)).cast("long").alias("excluded")]
    if normalized:
        g = _with_totals(g, keys, {"W1": F.when(s == 1.0, n * w), "W0": F.when(s == -1.0, n * w), "Y1": F.when(s == 1.0, n * w * m), "Y0": F.when(s == -1.0, n * w * m)})
        total = F.when(s == 1.0, F.col("W1")).otherwise(F.col("W0"))
        mean = F.when(s == 1.0, F.try_divide("Y1", "W1")).otherwise(F.try_divide("Y0", "W0"))
        part = n * F.pow(F.try_divide(w, total), 2) * (v + F.pow(m - mean, 2))
        estimate = F.first(F.try_divide("Y1", "W1") - F.try_divide("Y0", "W0"), ignorenulls=True)
        return g.groupBy(*keys).agg(F.sum(F.when(inside, n)).cast("long").alias("n"), estimate.alias("estimate"), F.sqrt(F.sum(part)).alias("std_error"), *counts)
    g = _with_totals(g, keys, {"total": n * w * m * s, "n_all": F.when(inside, n)}).withColumn("est", F.try_divide("total", "n_all"))
    part = n * (w * w * v + F.pow(w * m * s - F.col("est"), 2))
    return g.groupBy(*keys).agg(F.max("n_all").cast("long").alias("n"), F.max("est").alias("estimate"),
                                F.sqrt(F.try_divide(F.try_divide(F.sum(part), F.max("n_all") - 1), F.max("n_all"))).alias("std_error"), *counts)


def t_learner_cells(df: DataFrame, treatment: str, outcome: str, cells: Sequence[str], keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """EST10 / EST11: keys, estimate (mean ITE over rows of cells with both arms), ite_sd, n."""
    g = written(arm_cells(df, treatment, outcome, cells, keys, weight), "cells")
    c = (g.groupBy(*keys, *cells).agg(F.sum("n").alias("n"), F.max(F.when(F.col("t") == 1, F.col("m"))).alias("m1"), F.max(F.when(F.col("t") == 0, F.col("m"))).alias("m0"))
         .select(*keys, "n", (F.col("m1") - F.col("m0")).alias("ite")).filter(F.col("ite").isNotNull()))
    c = _with_totals(c, keys, {"total": F.col("n") * F.col("ite"), "n_all": F.col("n")}).withColumn("mean", F.col("total") / F.col("n_all"))
    sd = F.sqrt(F.try_divide(F.sum(F.col("n") * F.pow(F.col("ite") - F.col("mean"), 2)), F.sum("n") - 1))
    return c.groupBy(*keys).agg(F.max("mean").alias("estimate"), sd.alias("ite_sd"), F.sum("n").cast("long").alias("n"))


def dml_cells(df: DataFrame, treatment: str, outcome: str, cells: Sequence[str], row_id: str, keys: Sequence[str] = (),
              k: int = 3, seed: int = 42, weight: str | None = None) -> DataFrame:
    """EST7 / EST11: keys, n, estimate, std_error (HC1) of the cross-fitted residual regression with cell-mean nuisances.

    Folds come from md5 uniforms of ``row_id``.  A cell unseen in the other folds takes their grand mean."""
    fold = F.floor(uniform(F.col(row_id), F.lit(seed), F.lit("fold")) * k).cast("int")
    g = written(arm_cells(df.withColumn("_fold", fold), treatment, outcome, ["_fold", *cells], keys, weight), "cells")
    n, t, m = F.col("n"), F.col("t"), F.col("m")
    sums = {"cn": n, "cy": n * m, "ct": n * t}
    by_fold = _with_totals(g.groupBy("_fold").agg(*[F.sum(e).alias(c) for c, e in {"n": n, "fy": n * m, "ft": n * t}.items()]), [],
                           {"an": F.col("n"), "ay": F.col("fy"), "at": F.col("ft")})  # a row a fold
    others = by_fold.select(F.col("_fold"), *[F.try_divide(F.col(a) - F.col(f), F.col("an") - F.col("n")).alias(c) for c, a, f in (("gy", "ay", "fy"), ("gt", "at", "ft"))])
    cell, folded = Window.partitionBy(*keys, *cells), Window.partitionBy(*keys, *cells, "_fold")  # at most a row an arm and fold
    g = g.select("*", *[(F.sum(e).over(cell) - F.sum(e).over(folded)).alias(c) for c, e in sums.items()]).join(F.broadcast(others), "_fold")
    seen = F.col("cn") > 0
    g = g.select("*", F.when(seen, F.try_divide("cy", "cn")).otherwise(F.col("gy")).alias("mx"),
                 (t - F.when(seen, F.try_divide("ct", "cn")).otherwise(F.col("gt"))).alias("tt"))
    g = _with_totals(g, keys, {"_b": n * F.col("tt") * (m - F.col("mx")), "_a": n * F.col("tt") * F.col("tt")}).withColumn("theta", F.try_divide("_b", "_a"))
    c = F.col("mx") + F.col("theta") * F.col("tt")
    meat = n * F.col("tt") * F.col("tt") * (F.col("v") + F.pow(m - c, 2))
    out = g.groupBy(*keys).agg(F.sum("n").cast("long").alias("n"), F.max("theta").alias("estimate"), F.sum(meat).alias("meat"), F.sum(n * F.col("tt") * F.col("tt")).alias("stt"))
    se = F.sqrt(F.try_divide("meat", F.col("stt") * F.col("stt")) * F.try_divide("n", F.col("n") - 1))
    return out.select(*keys, "n", "estimate", se.alias("std_error"))


def period_columns(out: DataFrame, period: str, min_rows: int = 20, alpha: float = 0.05) -> DataFrame:
    """EST11 columns (ATE, CI_Lower, CI_Upper, std_error, n) of a per-period result."""
    z = norm_ppf(1 - alpha / 2)
    return out.filter(F.col("n") >= min_rows).select(period, F.col("estimate").alias("ATE"), (F.col("estimate") - z * F.col("std_error")).alias("CI_Lower"),
                                                     (F.col("estimate") + z * F.col("std_error")).alias("CI_Upper"), "std_error", "n")
