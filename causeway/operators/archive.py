"""Archive-only estimators (ARC1, ARC3): two-way fixed effects, sharp RD and Wald IV."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import dlit, one_row
from ..session import remove_written, written_at
from .gram import ols


MOST_PERIODS = 100_000  # the effects of the periods are vectors on the driver


def _without_singletons(cells: DataFrame) -> DataFrame:
    """``cells`` (_u, _t, n, ...) without units and periods that have one row: they fit themselves and tell nothing.  Repeated until none is left."""
    before = None
    while True:
        for side in ("_u", "_t"):
            many = cells.groupBy(side).agg(F.sum("n").alias("_rows")).filter("_rows > 1").select(side)
            cells = cells.join(many, side, "left_semi")
        cells, path = written_at(cells, "panel")
        left = cells.agg(F.sum("n").alias("n")).first()["n"]
        if before is not None:
            remove_written(cells.sparkSession, before[1])
        if before is not None and before[0] == left or not left:
            return cells
        before = (left, path)


def twoway_fixed_effects(panel: DataFrame, unit: str, time: str, y: str, x: str, tol: float = 1e-12, max_iter: int = 500) -> DataFrame:
    """ARC1: slope of y on x with entity and time fixed effects, on any panel, with entity-clustered SE
    (sum over units of the squared score, G/(G-1) correction).

    Rows become (unit, period) cells of counts and central moments, so a hot unit is combined map-side; singletons go.  The period effects
    solve the normal equations left after projecting on the units: each step projects a vector over the periods on the units and back on the
    periods, one aggregate over the units' cells, and conjugate gradients choose the next vector until the residual has settled.  A balanced panel needs one
    step; parts of the panel that share no unit or period are solved side by side.  The slope is null if x does not vary within."""
    spark = panel.sparkSession
    d = panel.select(F.col(unit).alias("_u"), F.col(time).alias("_t"), F.col(y).cast("double").alias("_y"), F.col(x).cast("double").alias("_x")).dropna()
    cells = _without_singletons(d.groupBy("_u", "_t").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg("_y").alias("my"), F.avg("_x").alias("mx"),
        (F.var_pop("_x") * F.count(F.lit(1))).alias("cxx"), (F.covar_pop("_x", "_y") * F.count(F.lit(1))).alias("cxy")))
    periods = sorted(r[0] for r in cells.select("_t").distinct().limit(MOST_PERIODS + 1).collect())
    if len(periods) > MOST_PERIODS:
        raise ValueError(f"more than {MOST_PERIODS} periods; swap unit and time")
    size = len(periods)
    number = spark.createDataFrame([(t, k) for k, t in enumerate(periods)], T.StructType([cells.schema["_t"], T.StructField("k", T.IntegerType())]))
    # a row per unit: its cells, at most one a period, with each cell's mean less the unit's
    units = (cells.join(F.broadcast(number), "_t").groupBy("_u")
             .agg(F.collect_list(F.struct("k", "n", "my", "mx", "cxx", "cxy")).alias("c"), F.sum("n").alias("nu"),
                  (F.sum(F.col("n") * F.col("my")) / F.sum("n")).alias("uy"), (F.sum(F.col("n") * F.col("mx")) / F.sum("n")).alias("ux")))
    units, path = written_at(units, "units")
    counts, ry, rx = np.zeros(size), np.zeros(size), np.zeros(size)
    first = units.select("uy", "ux", F.explode("c").alias("c")).groupBy("c.k").agg(
        F.sum("c.n").alias("n"), F.sum(F.col("c.n") * (F.col("c.my") - F.col("uy"))).alias("y"), F.sum(F.col("c.n") * (F.col("c.mx") - F.col("ux"))).alias("x"))
    for r in first.collect():
        counts[r["k"]], ry[r["k"]], rx[r["k"]] = r["n"], r["y"], r["x"]

    def literal(v):
        return F.from_json(F.lit(json.dumps([float(a) for a in v])), "array<double>")

    def project(vectors):
        """Period sums less what their unit means bring back, for each vector over the periods."""
        def unit_mean(v):
            return F.aggregate("c", F.lit(0.0), lambda s, c: s + c["n"] * F.get(literal(v), c["k"])) / F.col("nu")
        of = [unit_mean(v) for v in vectors]
        q = units.select("c", *[a.alias(f"a{i}") for i, a in enumerate(of)]).select(F.explode("c").alias("c"), *[f"a{i}" for i in range(len(vectors))])
        out = np.array([counts * v for v in vectors])
        for r in q.groupBy("c.k").agg(*[F.sum(F.col("c.n") * F.col(f"a{i}")).alias(f"a{i}") for i in range(len(vectors))]).collect():
            for i in range(len(vectors)):
                out[i, r["k"]] -= r[f"a{i}"]
        return out

    effects = _conjugate_gradients(project, np.array([ry, rx]), counts, tol, max_iter) if size else np.zeros((2, 0))
    by, bx = effects
    # what is left of each cell: its mean less its period's effect, less the unit's mean of that
    left = F.transform("c", lambda c: F.struct(c["n"].alias("n"), (c["my"] - F.get(literal(by), c["k"])).alias("y"), (c["mx"] - F.get(literal(bx), c["k"])).alias("x"),
                                               c["cxx"].alias("cxx"), c["cxy"].alias("cxy")))
    w = units.select("_u", "nu", left.alias("c"))
    mean = lambda f: F.aggregate("c", F.lit(0.0), lambda s, c: s + c["n"] * c[f]) / F.col("nu")
    w = w.select("_u", F.explode("c").alias("c"), mean("y").alias("uy"), mean("x").alias("ux"))
    yd, xd, n = F.col("c.y") - F.col("uy"), F.col("c.x") - F.col("ux"), F.col("c.n")
    per = w.groupBy("_u").agg(F.sum(F.col("c.cxx") + n * xd * xd).alias("xx"), F.sum(F.col("c.cxy") + n * xd * yd).alias("xy"))
    spread = units.select(F.explode("c").alias("c")).agg(F.sum(F.col("c.cxx") + F.col("c.n") * F.col("c.mx") * F.col("c.mx")).alias("s")).first()["s"]
    per, per_path = written_at(per, "scores")
    s = one_row(per.agg(F.sum("xy").alias("xy"), F.sum("xx").alias("xx"), F.count(F.lit(1)).alias("G")))
    remove_written(spark, path)
    varies = s["xx"] is not None and s["xx"] > 1e-12 * max(spread or 0.0, 1e-300)
    beta, sxx = dlit(s["xy"] / s["xx"] if varies else None), dlit(s["xx"] if varies else None)
    g = per.agg(F.count(F.lit(1)).alias("G"), F.sum(F.pow(F.col("xy") - beta * F.col("xx"), 2)).alias("ss"))
    se = F.try_divide(F.sqrt(F.try_divide(F.col("ss") * F.col("G"), F.col("G") - 1)), sxx)
    return g.select(F.lit("TwoWayFE").alias("method"), beta.alias("estimate"), se.alias("std_error"),
                    F.try_divide(beta, se).alias("stat"), F.col("G").cast("long").alias("clusters"))


def _conjugate_gradients(project, right: np.ndarray, scale: np.ndarray, tol: float, max_iter: int) -> np.ndarray:
    """Solutions of project(v) = right, a row each, by conjugate gradients preconditioned with ``scale``; the singular directions
    (a constant in each part of the panel) stay zero."""
    v, r = np.zeros_like(right), right.copy()
    z = r / scale
    p, rho = z.copy(), (r * z).sum(axis=1)
    goal = tol ** 2 * np.maximum((right * right / scale).sum(axis=1), 1e-300)
    for _ in range(max_iter):
        if (rho <= goal).all():
            return v
        ap = project(list(p))
        bottom = (p * ap).sum(axis=1)
        step = np.divide(rho, bottom, out=np.zeros_like(rho), where=(bottom > 0) & (rho > goal))
        v, r = v + step[:, None] * p, r - step[:, None] * ap
        z = r / scale
        after = (r * z).sum(axis=1)
        p = z + np.divide(after, rho, out=np.zeros_like(rho), where=rho > 0)[:, None] * p
        if (after >= rho).all() and (after <= 1e-16 * np.maximum((right * right / scale).sum(axis=1), 1e-300)).all():
            return v
        rho = after
    raise ValueError(f"the fixed effects did not settle in {max_iter} steps")


def regression_discontinuity(df: DataFrame, running: str, outcome: str, cutoff: float, bandwidth: float) -> DataFrame:
    """ARC3 sharp RD: local linear on each side within the bandwidth,
    Y ~ 1 + D + (x - c) + D (x - c); the D coefficient is the jump at the cutoff."""
    x = F.col(running).cast("double") - F.lit(float(cutoff))
    d = df.filter(F.abs(x) <= bandwidth).select(F.col(outcome).cast("double").alias("_y"), x.alias("_xc"))
    D = (F.col("_xc") >= 0).cast("double")
    coef = ols(d, "_y", {"D": D, "xc": F.col("_xc"), "Dxc": D * F.col("_xc")}, terms=["D"])
    return coef.select(F.lit("RD (sharp)").alias("method"), "estimate", "std_error", "stat", "p_value", "n")


def wald_iv(df: DataFrame, instrument: str, treatment: str, outcome: str) -> DataFrame:
    """ARC3 IV: Wald / 2SLS with one instrument, cov(Z, Y) / cov(Z, D) in one aggregate."""
    z, t, y = (F.col(c).cast("double") for c in (instrument, treatment, outcome))
    return df.agg(F.try_divide(F.covar_samp(z, y), F.covar_samp(z, t)).alias("estimate"),
                  F.covar_samp(z, t).alias("first_stage_cov"), F.count(F.lit(1)).alias("n")) \
        .select(F.lit("IV (Wald)").alias("method"), "*")
