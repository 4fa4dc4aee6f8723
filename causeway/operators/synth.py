"""Synthetic control family (QX6-QX15, QX19, QX20).

Physical plan
-------------
1. The long panel (unit, date, y) is indexed by date position (dense rank over
   the distinct-date table, whose size is the number of dates).
2. Donor Gram: the pre-period panel is self-joined on date and reduced by
   (unit_a, unit_b) -> sum(y_a * y_b).  Every treated unit's simplex problem
   needs only this units x units matrix, so no estimator re-reads the panel.
3. Solves: the Gram rows are replicated to ``buckets`` solve groups with
   ``explode(sequence)`` (no join) and each ``applyInPandas`` task solves the
   treated units hashed to it.  A task holds units^2 numbers, never rows.
4. Counterfactuals are a join of the weights with the panel on the donor and
   a grouped sum; the conformal (cyclic-shift) test and the CI inversion are
   grouped aggregates over (unit, shift) and (unit, grid value).

Fixed effects (QX7) demean every unit by its pre-period mean before the fit
and add the treated unit's mean back.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import rnd
from ..functions.linalg import simplex_ls


# Panel indexing -------------------------------------------------------------------------------------

def index_dates(panel: DataFrame, date: str = "date") -> DataFrame:
    """Adds 0-based ``idx`` of the date among the panel's distinct dates.  The window runs over
    the distinct-date table only; the join back carries no broadcast hint, because the number of
    dates is not bounded by the library (AQE broadcasts it when its runtime size is small)."""
    dates = panel.select(date).distinct()
    idx = dates.select(date, (F.dense_rank().over(Window.orderBy(date)) - 1).alias("idx"))
    return panel.join(idx, date)


def complete_units(panel: DataFrame) -> DataFrame:
    """Rows of the units that have every date of the panel (weights must sum to 1 on every date)."""
    n = panel.select("date").distinct().count()
    return panel.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("unit"))).filter(F.col("_n") == n).drop("_n")


def with_fixed_effects(panel: DataFrame, pre: F.Column, y: str = "y", keys: Sequence[str] = ()) -> DataFrame:
    """QX7: ``y_fit`` = y - pre-period mean of the unit (``mu``); without FE y_fit = y, mu = 0."""
    mu = panel.filter(pre).groupBy(*keys, "unit").agg(F.avg(y).alias("mu"))
    return panel.join(mu, [*keys, "unit"], "left").withColumn("y_fit", F.col(y) - F.coalesce("mu", F.lit(0.0)))


# Gram ---------------------------------------------------------------------------------------------

def panel_units(panel: DataFrame) -> list[str]:
    """Sorted distinct units: the names of the Gram matrix's rows."""
    return [r[0] for r in panel.select("unit").distinct().orderBy("unit").collect()]


DATES_AT_ONCE = 256
PAIR_FIELDS = ["n", "sa", "sb", "saa", "sbb", "sab"]


def pair_moments(panel: DataFrame, y: str = "y_fit", keys: Sequence[str] = (), units: list[str] | None = None,
                 fields: Sequence[str] = ("sab",)) -> DataFrame:
    """Pairwise moments of unit series over common dates, without emitting unit pairs per date.

    Each (keys, date) becomes one vector of at most #units values; every task
    accumulates its partial units x units matrices in numpy (n = co-presence
    count, sa = sum y_a where b present, saa, sab = sum y_a y_b) and one
    aggregate sums the partials: rows (keys, a, b, fields...).
    """
    units = units if units is not None else panel_units(panel)
    pos = {u: i for i, u in enumerate(units)}
    U = len(units)
    numbers = panel.sparkSession.createDataFrame(list(pos.items()), "unit string, _i int")
    vec = (panel.select(*keys, "date", "unit", F.col(y).cast("double").alias("_v")).join(numbers, "unit")
           .select(*keys, "date", "_i", "_v").dropna().groupBy(*keys, "date").agg(F.collect_list(F.struct("_i", "_v")).alias("_vec"))
           .select(*keys, F.col("_vec._i").alias("_i"), F.col("_vec._v").alias("_v")))
    key_fields = [vec.schema[k] for k in keys]
    key_ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in key_fields)
    schema = (key_ddl + ", " if key_ddl else "") + "a string, b string, " + ", ".join(f"{f} double" for f in fields)
    ua = np.array(units, dtype=object)

    def accumulate(batches):
        acc = {}
        for pdf in batches:
            parts = pdf.groupby(list(keys), sort=False) if keys else [((), pdf)]
            for k, part in parts:
                k = k if isinstance(k, tuple) else (k,)
                st = acc.setdefault(k, {f: np.zeros((U, U)) for f in fields})
                for lo in range(0, len(part), DATES_AT_ONCE):  # dense dates x units blocks, one matrix product each
                    block = part.iloc[lo:lo + DATES_AT_ONCE]
                    v, m = np.zeros((len(block), U)), np.zeros((len(block), U))
                    row = np.repeat(np.arange(len(block)), [len(i) for i in block["_i"]])
                    at = np.concatenate(block["_i"].to_list())
                    v[row, at], m[row, at] = np.concatenate(block["_v"].to_list()), 1.0
                    sides = {"n": (m, m), "sa": (v, m), "sb": (m, v), "saa": (v * v, m), "sbb": (m, v * v), "sab": (v, v)}
                    for f in st:
                        st[f] += sides[f][0].T @ sides[f][1]
        for k, st in acc.items():
            A, B = np.meshgrid(np.arange(U), np.arange(U), indexing="ij")
            out = {"a": ua[A.ravel()], "b": ua[B.ravel()]}
            for f in fields:
                out[f] = st[f].ravel()
            frame = pd.DataFrame(out)
            for j, kname in enumerate(keys):
                frame.insert(j, kname, k[j])
            yield frame

    partial = vec.mapInPandas(accumulate, schema)
    return partial.groupBy(*keys, "a", "b").agg(*[F.sum(f).alias(f) for f in fields])


def donor_gram(panel_pre: DataFrame, y: str = "y_fit", keys: Sequence[str] = (), units: list[str] | None = None
               ) -> DataFrame:
    """(keys, a, b, g = sum_t y_a,t * y_b,t) over the given (pre-period) rows (Gramian partials
    per task, summed by one aggregate; output units^2 rows per key)."""
    pm = pair_moments(panel_pre, y, keys, units, ("sab",))
    return pm.select(*keys, "a", "b", F.col("sab").alias("g"))


def unit_correlations(panel_pre: DataFrame, y: str = "y") -> DataFrame:
    """QX15: Pearson correlation of every unit pair over their common pre-period dates."""
    pm = pair_moments(panel_pre, y, (), None, PAIR_FIELDS).filter(F.col("a") < F.col("b"))
    num = F.col("n") * F.col("sab") - F.col("sa") * F.col("sb")
    den = F.sqrt((F.col("n") * F.col("saa") - F.col("sa") ** 2) * (F.col("n") * F.col("sbb") - F.col("sb") ** 2))
    return pm.select("a", "b", F.try_divide(num, den).alias("corr"), F.col("n").cast("long").alias("n"))


def _dtw_many(x: np.ndarray, zs: np.ndarray, window: int | None = None, stop_above: float = np.inf) -> np.ndarray:
    """DTW distances (absolute differences) of ``x`` to every row of ``zs`` by anti-diagonals, all rows at once.

    Abandoned (inf) as soon as no row can stay below ``stop_above``: two neighbouring diagonals bound every path from below."""
    n, m = len(x), zs.shape[1]
    w = max(window if window is not None else max(n, m), abs(n - m))
    before, last = np.full((len(zs), n + 2), np.inf), np.full((len(zs), n + 2), np.inf)
    last[:, 0] = 0.0  # cell (0, 0); column i of a diagonal holds cell (i, diagonal - i)
    for d in range(2, n + m + 1):
        lo, hi = max(1, d - m, -(-(d - w) // 2)), min(n, d - 1, (d + w) // 2)
        now = np.full((len(zs), n + 2), np.inf)
        if lo <= hi:
            i = np.arange(lo, hi + 1)
            # at diagonal d: (i-1, j-1) lies on d - 2, (i-1, j) and (i, j-1) on d - 1
            diagonal = last[:, i - 1] if d == 2 else before[:, i - 1]
            step = np.minimum(diagonal, np.minimum(now[:, i] if d == 2 else last[:, i - 1], now[:, i] if d == 2 else last[:, i]))
            now[:, lo:hi + 1] = np.abs(x[i - 1] - zs[:, d - i - 1]) + step
        if d > 2 and np.minimum(now.min(axis=1), last.min(axis=1)).min() > stop_above:
            return np.full(len(zs), np.inf)
        before, last = (np.full_like(now, np.inf), now) if d == 2 else (last, now)
    return last[:, n]


def _envelope(x: np.ndarray, window: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest value of ``x`` within ``window`` of every position."""
    if window is None:
        return np.full(len(x), x.min()), np.full(len(x), x.max())
    lo = np.lib.stride_tricks.sliding_window_view(np.pad(x, window, constant_values=np.inf), 2 * window + 1).min(axis=1)
    hi = np.lib.stride_tricks.sliding_window_view(np.pad(x, window, constant_values=-np.inf), 2 * window + 1).max(axis=1)
    return lo, hi


def _nearest_dtw(x: np.ndarray, zs: np.ndarray, top: int, window: int | None, at_once: int = 32) -> list[tuple[int, float]]:
    """(row of ``zs``, distance) of the ``top`` nearest, exact: candidates by their envelope bound, until the bound exceeds the worst kept."""
    lo, hi = _envelope(x, window)
    bound = np.maximum(np.maximum(zs - hi, lo - zs), 0.0).sum(axis=1)
    order, best = np.argsort(bound, kind="stable"), []
    for at in range(0, len(order), at_once):
        part = order[at:at + at_once]
        worst = best[top - 1][0] if len(best) >= top else np.inf
        part = part[bound[part] <= worst]
        if not len(part):
            break
        best = sorted(best + [(d, k) for d, k in zip(_dtw_many(x, zs[part], window, worst).tolist(), part.tolist(), strict=True) if np.isfinite(d)])[:max(top, 1) + at_once]
    return [(k, d) for d, k in best[:top]]


def _series(panel: DataFrame, y: str) -> DataFrame:
    """unit and v: its values by date, one array a unit."""
    return (panel.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("date", F.col(y).cast("double").alias("v")))).alias("s"))
            .select("unit", F.col("s.v").alias("v")))


def unit_dtw(panel_pre: DataFrame, treated: Sequence[str], y: str = "y", window: int | None = None) -> DataFrame:
    """QX15 (DTW): dynamic-time-warping distance between each treated unit and every other unit.

    Each unit's (date-ordered) series is one array -- its length is the number
    of dates, not rows.  Donor series rows are replicated to the treated units
    with ``explode`` and matched by an equi-join; the recursion (optional
    Sakoe-Chiba ``window``) runs over whole anti-diagonals in Arrow batches of pairs."""
    from pyspark.sql.functions import pandas_udf
    from pyspark.sql.types import DoubleType

    series = _series(panel_pre, y)
    a = series.filter(F.col("unit").isin(list(treated))).select(F.col("unit").alias("a"), F.col("v").alias("va"))
    b = series.select(F.col("unit").alias("b"), F.col("v").alias("vb"),
                      F.explode(F.array(*[F.lit(t) for t in treated])).alias("a")).filter(F.col("a") != F.col("b"))

    def dist(va: pd.Series, vb: pd.Series) -> pd.Series:
        return pd.Series([float(_dtw_many(np.asarray(x, float), np.asarray(z, float)[None, :], window)[0]) for x, z in zip(va, vb, strict=True)])

    udf = pandas_udf(dist, DoubleType())
    return a.join(b, "a").select("a", "b", udf(F.col("va"), F.col("vb")).alias("dtw"))


def neighbours(panel: DataFrame, top: int, measure: str = "corr", y: str = "y", window: int | None = None, block: int = 256) -> DataFrame:
    """QX15: unit, other, score, rank of the ``top`` most similar units of every unit, over series with a value on every date.

    ``corr``: highest Pearson correlation; ``dtw``: least warping distance within ``window`` dates.  Units lie in blocks; a task compares one block
    with another and keeps the ``top`` of either unit, so no task and no shuffle holds all pairs.  Distances are computed only while an
    envelope bound leaves them a chance.  Ties go to the smaller name; a constant series is like no other (null correlation, left out)."""
    if measure not in ("corr", "dtw"):
        raise ValueError(measure)
    series = _series(panel, y)
    n = max(1, -(-series.count() // block))
    placed = series.withColumn("own", F.pmod(F.xxhash64("unit"), F.lit(n)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tiles = (placed.select("unit", "v", F.col("own").alias("i"), every.alias("j"), F.lit(0).alias("side"))
             .unionByName(placed.select("unit", "v", F.col("own").alias("j"), every.alias("i"), F.lit(1).alias("side"))))

    def tile(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("unit")
        left, right = f[f["side"] == 0], f[f["side"] == 1]
        out = []
        if len(left) and len(right):
            names, others = left["unit"].tolist(), right["unit"].tolist()
            X, Z = np.stack([np.asarray(v, float) for v in left["v"]]), np.stack([np.asarray(v, float) for v in right["v"]])
            if measure == "corr":
                X, Z = (m - m.mean(axis=1, keepdims=True) for m in (X, Z))
                with np.errstate(divide="ignore", invalid="ignore"):
                    score = (X @ Z.T) / np.sqrt((X * X).sum(axis=1)[:, None] * (Z * Z).sum(axis=1)[None, :])
                for r, name in enumerate(names):
                    order = [k for k in np.argsort(-np.nan_to_num(score[r], nan=-2.0), kind="stable").tolist() if others[k] != name and np.isfinite(score[r, k])]
                    out += [(name, others[k], float(score[r, k])) for k in order[:top]]
            else:
                for r, name in enumerate(names):
                    keep = np.array([k for k, o in enumerate(others) if o != name], int)
                    out += [(name, others[keep[k]], float(d)) for k, d in (_nearest_dtw(X[r], Z[keep], top, window) if len(keep) else [])]
        return pd.DataFrame(out, columns=["unit", "other", "score"])

    found = tiles.groupBy("i", "j").applyInPandas(tile, "unit string, other string, score double")
    best = F.col("score").desc() if measure == "corr" else F.col("score").asc()
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("unit").orderBy(best, "other")))
    return ranked.filter(F.col("rank") <= top)


# Weights --------------------------------------------------------------------------------------------

WEIGHT_SCHEMA = ("treated string, donor string, weight double, sc_weight double, l2_imbalance double, "
                 "scaled_l2_imbalance double, model string")


def _solve_one(units: list, G: np.ndarray, S: list[int], gid: str, model: str, lam_scale: float, Z: np.ndarray | None = None, lam: float | None = None):
    """Weights for the treated set S (one unit, or a group whose series is the members' sum):
    donors are all units outside S; c = G[D, S] 1 and g = 1' G[S, S] 1 come from the unit Gram.

    With covariates ``Z`` (units x covariates) the weights are found for what a regression on [1, Z] over the donors leaves of all series, which the
    Gram gives by its Schur complement; the regression's own prediction of the treated series is a weighting of the donors, too, and is added."""
    sset = set(S)
    donors = [i for i in range(len(units)) if i not in sset]
    Gd = G[np.ix_(donors, donors)]
    c = G[np.ix_(donors, S)].sum(axis=1)
    gjj = float(G[np.ix_(S, S)].sum())

    def imb(v):
        return math.sqrt(max(gjj - 2.0 * v @ c + v @ Gd @ v, 0.0))

    def whole(v):
        return v
    Gw, cw = Gd, c
    if Z is not None and Z.shape[1]:
        A, target = _adjustment(Z, donors, S)
        B = A @ np.linalg.pinv(A.T @ A, rcond=1e-10)
        left = np.eye(len(donors)) - B @ A.T
        Gw, cw = left @ Gd @ left, left @ (c - Gd @ (B @ target))
        if np.linalg.norm(Gw) <= 10 * len(donors) * np.finfo(float).eps * np.linalg.norm(Gd):
            Gw, cw = np.zeros_like(Gw), np.zeros_like(cw)  # only rounding is left (as many regressors as donors): no weights fit it better than others

        def whole(v):
            return v + B @ (target - A.T @ v)
    w = simplex_ls(Gw, cw)
    uni = np.full(len(donors), 1.0 / len(donors))
    base_imb, uni_imb = imb(whole(w)), imb(uni)
    out_w, chosen = whole(w), "none"
    if model in ("ridge", "best") and len(donors) > 1:
        lam = lam_scale * float(np.trace(Gw)) / len(donors) if lam is None else lam
        w_r = whole(w + _ridge_step(Gw, cw, w, lam)) if Gw.any() else out_w
        if model == "ridge" or imb(w_r) < base_imb:
            out_w, chosen = w_r, "ridge"
    l2 = imb(out_w)
    scaled = l2 / uni_imb if uni_imb > 0 else float("nan")
    return [(gid, units[d], float(out_w[k]), float(w[k]), l2, scaled, chosen) for k, d in enumerate(donors)]


def _adjustment(Z: np.ndarray, donors: list[int], S: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """([1, Z] of the donors, summed [1, Z] of the treated), the covariates centred and scaled over the donors."""
    mean, sd = Z[donors].mean(axis=0), Z[donors].std(axis=0)
    z = (Z - mean) / np.where(sd > 0, sd, 1.0)
    full = np.column_stack([np.ones(len(Z)), z])
    return full[donors], full[S].sum(axis=0)


def _ridge_step(G: np.ndarray, c: np.ndarray, w: np.ndarray, lam: float) -> np.ndarray:
    return np.linalg.solve(G + lam * np.eye(len(c)), c - G @ w)


def group_id(members: Sequence[str]) -> str:
    return "+".join(sorted(str(m) for m in members))


GRAM, COVARIATE, MEMBER, LAMBDA, POST, STEP = range(6)  # kinds of rows that a solve task reads


def _of_kind(rows: DataFrame, kind: int, a: str, b, g, keys: Sequence[str]) -> DataFrame:
    return rows.select(*keys, F.lit(kind).alias("kind"), F.col(a).cast("string").alias("a"), b.cast("string").alias("b"), g.cast("double").alias("g"))


def covariate_means(panel_pre: DataFrame, covariates: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """keys, unit, covariate (its number), z: mean of each covariate over a unit's pre-period."""
    means = panel_pre.groupBy(*keys, "unit").agg(*[F.avg(c).alias(f"_z{i}") for i, c in enumerate(covariates)])
    items = F.array(*[F.struct(F.lit(i).alias("covariate"), F.col(f"_z{i}").alias("z")) for i in range(len(covariates))])
    return means.select(*keys, "unit", F.explode(items).alias("s")).select(*keys, "unit", "s.covariate", "s.z")


def synth_weights(gram: DataFrame, treated: Sequence[str] | None = None, model: str = "none",
                  lam_scale: float = 0.1, buckets: int | None = None, keys: Sequence[str] = (),
                  groups: DataFrame | None = None, covariates: DataFrame | None = None, lambdas: DataFrame | None = None) -> DataFrame:
    """Simplex-constrained weights (w >= 0, sum 1) for each treated unit against all other units.

    ``treated`` None = every unit (in-space placebo); ``groups`` (treated, unit): groups of units treated together.  ``model`` ``none`` (plain SC),
    ``ridge`` (ridge-augmented SC: w + (G + lambda I)^-1 (c - G w), from the Gram only) or
    ``best`` (lower pre-period imbalance); ``lambdas`` (treated, lam) from :func:`ridge_lambdas`, else ``lam_scale`` of the mean diagonal.
    ``covariates`` (:func:`covariate_means`) adjusts the weights.  Output: keys, treated, donor, weight, sc_weight,
    l2_imbalance, scaled_l2_imbalance (ratio to uniform weights), model.
    """
    keys = list(keys)
    if buckets is None:
        n = groups.select("treated").distinct().count() if groups is not None else len(treated) if treated is not None else gram.select("a").distinct().count()
        buckets = n
    B = max(1, min(buckets, 64))
    tset = None if treated is None else set(treated)
    common = [_of_kind(gram, GRAM, "a", F.col("b"), F.col("g"), keys)]
    if covariates is not None:
        common.append(_of_kind(covariates, COVARIATE, "unit", F.col("covariate"), F.col("z"), keys))
    rep = reduce(DataFrame.unionByName, common).withColumn("_bucket", F.explode(F.sequence(F.lit(0), F.lit(B - 1))))
    own = lambda df: df.withColumn("_bucket", F.pmod(F.crc32(F.col("a").cast("binary")), F.lit(B)).cast("int"))
    everywhere = gram.select(*keys).distinct() if keys else None
    for extra, kind, b, g in ((groups, MEMBER, F.col("unit") if groups is not None else None, F.lit(0.0)),
                              (lambdas, LAMBDA, F.lit("") if lambdas is not None else None, F.col("lam") if lambdas is not None else None)):
        if extra is not None:
            if keys and not set(keys) <= set(extra.columns):  # the same in every key: a row a key and member
                listed = everywhere.agg(F.collect_list(F.struct(*keys)).alias("_k")).withColumn("_one", F.pmod(F.xxhash64(F.size("_k")), F.lit(1)))
                extra = extra.withColumn("_one", F.pmod(F.xxhash64("treated"), F.lit(1))).join(F.broadcast(listed), "_one").withColumn("_k", F.explode("_k")).select(
                    *[c for c in extra.columns if c not in keys], *[F.col(f"_k.{k}").alias(k) for k in keys])
            rep = rep.unionByName(own(_of_kind(extra, kind, "treated", b, g, keys)))
    key_fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in gram.schema.fields if f.name in keys)
    schema = (key_fields + ", " if key_fields else "") + WEIGHT_SCHEMA
    grouped = groups is not None

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["_bucket"].iloc[0])
        of = {k: pdf[pdf["kind"] == k] for k in (GRAM, COVARIATE, MEMBER, LAMBDA)}
        units = sorted(set(of[GRAM]["a"]).union(of[GRAM]["b"]))
        pos = {u: i for i, u in enumerate(units)}
        G = np.zeros((len(units), len(units)))
        G[of[GRAM]["a"].map(pos).to_numpy(), of[GRAM]["b"].map(pos).to_numpy()] = of[GRAM]["g"].to_numpy()
        Z = None
        if len(of[COVARIATE]):
            z = of[COVARIATE][of[COVARIATE]["a"].isin(pos)]
            Z = np.zeros((len(units), z["b"].astype(int).max() + 1))
            Z[z["a"].map(pos).to_numpy(), z["b"].astype(int).to_numpy()] = z["g"].to_numpy()
        lam = dict(zip(of[LAMBDA]["a"], of[LAMBDA]["g"], strict=True))
        rows = []
        if grouped:
            for gid, members in of[MEMBER].groupby("a")["b"]:
                S = [pos[m] for m in sorted(set(members)) if m in pos]
                if len(S) == len(set(members)) and len(units) > len(S):
                    rows.extend(_solve_one(units, G, S, gid, model, lam_scale, Z, lam.get(gid)))
        else:
            for j, u in enumerate(units):
                if (tset is None or u in tset) and _stable_hash(u) % B == bucket and len(units) >= 2:
                    rows.extend(_solve_one(units, G, [j], u, model, lam_scale, Z, lam.get(u)))
        out = pd.DataFrame(rows, columns=["treated", "donor", "weight", "sc_weight", "l2_imbalance",
                                          "scaled_l2_imbalance", "model"])
        for i, k in enumerate(keys):
            out.insert(i, k, pdf[k].iloc[0])
        return out

    return rep.groupBy(*keys, "_bucket").applyInPandas(solve, schema)


def column_weights(panel_pre: DataFrame, treated: Sequence[str] | None, y: str = "y_fit", at_once: int = 16, tol: float = 1e-7) -> DataFrame:
    """The plain simplex weights of :func:`synth_weights` (rows of weight > 0 only) without a matrix of all pairs of units.

    Each round takes the gradient of every donor, sum over dates of y times the treated unit's residual, in one grouped sum; the ``at_once`` donors with the
    lowest ones below the weighted mean enter, and the weights are solved anew over the donors entered so far.  A treated unit is settled when no other donor
    lies more than ``tol`` of its own sum of squares below: the condition of the optimum over all donors.  A task holds the series of the
    donors that entered for one treated unit.  ``panel_pre`` (unit, date, y) is read every round, so it should be a written table."""
    rows = panel_pre.select("unit", "date", F.col(y).cast("double").alias("y"))
    own = rows if treated is None else rows.filter(F.col("unit").isin(list(treated)))
    own = own.select(F.col("unit").alias("treated"), "date", F.col("y").alias("own")).checkpoint(eager=True)
    size = own.groupBy("treated").agg(F.sum(F.col("own") ** 2).alias("_size"))
    totals = rows.groupBy("date").agg(F.sum("y").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    even = own.join(totals, "date").select("treated", "date", ((F.col("_sum") - F.col("own")) / F.nullif(F.col("_n") - 1, F.lit(0)) - F.col("own")).alias("r"))
    even = even.filter("r IS NOT NULL").checkpoint(eager=True)
    lowest = Window.partitionBy("treated").orderBy("g", "donor")
    donors = rows.withColumnRenamed("unit", "donor")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        u = pdf["treated"].iloc[0]
        wide = pdf.pivot(index="unit", columns="date", values="y").sort_index()
        D, own_y = wide.drop(index=u), wide.loc[u].to_numpy()
        w = simplex_ls(D.to_numpy() @ D.to_numpy().T, D.to_numpy() @ own_y, tol=1e-15)
        return pd.DataFrame({"treated": u, "donor": D.index, "weight": w})

    def residuals(weights):
        fitted = weights.join(donors, "donor").groupBy("treated", "date").agg(F.sum(F.col("weight") * F.col("y")).alias("_p"))
        return fitted.join(own, ["treated", "date"]).select("treated", "date", (F.col("_p") - F.col("own")).alias("r"))

    weights, left = None, even
    while True:
        grad = donors.join(left, "date").filter(F.col("donor") != F.col("treated")).groupBy("treated", "donor").agg(F.sum(F.col("y") * F.col("r")).alias("g"))
        outside = grad
        if weights is not None:
            grad = grad.join(weights, ["treated", "donor"], "left").checkpoint(eager=True)
            bound = grad.groupBy("treated").agg(F.sum(F.col("weight") * F.col("g")).alias("_mean")).join(size, "treated")
            outside = grad.filter("weight IS NULL").join(bound, "treated").filter(F.col("g") < F.col("_mean") - tol * F.col("_size"))
        entered = outside.withColumn("_rank", F.row_number().over(lowest)).filter(F.col("_rank") <= at_once).select("treated", "donor").checkpoint(eager=True)
        if entered.isEmpty():
            break
        going = entered.select("treated").distinct()
        kept = None if weights is None else weights.join(going, "treated", "left_anti")
        active = entered if weights is None else entered.unionByName(weights.join(going, "treated", "left_semi").select("treated", "donor"))
        members = active.unionByName(going.select("treated", F.col("treated").alias("donor"))).withColumnRenamed("donor", "unit")
        solved = members.join(rows, "unit").groupBy("treated").applyInPandas(solve, "treated string, donor string, weight double").checkpoint(eager=True)
        left = residuals(solved)
        weights = (solved if kept is None else solved.unionByName(kept)).checkpoint(eager=True)
    if weights is None:
        return panel_pre.sparkSession.createDataFrame([], WEIGHT_SCHEMA)
    l2 = residuals(weights).groupBy("treated").agg(F.sqrt(F.sum(F.col("r") ** 2)).alias("l2_imbalance"))
    base = even.groupBy("treated").agg(F.sqrt(F.sum(F.col("r") ** 2)).alias("_even"))
    return weights.filter("weight > 0").join(l2.join(base, "treated"), "treated").select(
        "treated", "donor", "weight", F.col("weight").alias("sc_weight"), "l2_imbalance",
        F.try_divide("l2_imbalance", "_even").alias("scaled_l2_imbalance"), F.lit("none").alias("model"))


def _stable_hash(s: str) -> int:
    import zlib
    return zlib.crc32(str(s).encode())


LAMBDAS, LEAST_RATIO = 20, 1e-8  # length of the penalty path, its last element over its first


def penalty_path(G: np.ndarray) -> np.ndarray:
    """Penalties from the largest eigenvalue of the donors' Gram down, evenly on a log scale."""
    return max(float(np.linalg.eigvalsh(G)[-1]), 1e-300) * LEAST_RATIO ** (np.arange(LAMBDAS) / (LAMBDAS - 1))


def ridge_errors(gram: DataFrame, panel_pre: DataFrame, treated: Sequence[str] | None = None, y: str = "y_fit") -> DataFrame:
    """QX8: treated, idx, step, lam, error: squared error at a pre-period date of weights fitted without it, for every penalty of the path.

    Leaving a date out takes the product of its values off the Gram, so each (date, penalty) is solved from the Gram and one vector of
    unit values; dates are dealt out to the tasks."""
    dates = panel_pre.select("idx").distinct().count()
    B = max(1, min(dates, 64))
    rep = _of_kind(gram, GRAM, "a", F.col("b"), F.col("g"), []).withColumn("idx", F.lit(-1)).withColumn("_bucket", F.explode(F.sequence(F.lit(0), F.lit(B - 1))))
    values = panel_pre.select(F.lit(COVARIATE).alias("kind"), F.col("unit").alias("a"), F.lit("").alias("b"), F.col(y).alias("g"), F.col("idx").cast("int").alias("idx"),
                              F.pmod(F.col("idx"), F.lit(B)).cast("int").alias("_bucket"))
    tset = None if treated is None else set(treated)

    def errors(pdf: pd.DataFrame) -> pd.DataFrame:
        of, dated = pdf[pdf["kind"] == GRAM], pdf[pdf["kind"] == COVARIATE]
        units = sorted(set(of["a"]).union(of["b"]))
        pos = {u: i for i, u in enumerate(units)}
        G = np.zeros((len(units), len(units)))
        G[of["a"].map(pos).to_numpy(), of["b"].map(pos).to_numpy()] = of["g"].to_numpy()
        out = []
        for j, u in enumerate(units):
            if tset is not None and u not in tset or len(units) < 3:
                continue
            donors = [i for i in range(len(units)) if i != j]
            path = penalty_path(G[np.ix_(donors, donors)])
            for idx, day in dated.groupby("idx"):
                v = np.zeros(len(units))
                v[day["a"].map(pos).to_numpy()] = day["g"].to_numpy()
                Gt, ct = G[np.ix_(donors, donors)] - np.outer(v[donors], v[donors]), G[donors, j] - v[donors] * v[j]
                w = simplex_ls(Gt, ct)
                for step, lam in enumerate(path.tolist()):
                    miss = v[j] - v[donors] @ (w + _ridge_step(Gt, ct, w, lam))
                    out.append((u, int(idx), step, lam, float(miss * miss)))
        return pd.DataFrame(out, columns=["treated", "idx", "step", "lam", "error"])

    both = rep.select("_bucket", "kind", "a", "b", "g", "idx").unionByName(values.select("_bucket", "kind", "a", "b", "g", "idx"))
    return both.groupBy("_bucket").applyInPandas(errors, "treated string, idx int, step int, lam double, error double")


def ridge_lambdas(errors: DataFrame) -> DataFrame:
    """treated, lam: the penalty with the least mean error over the dates left out (ties: the largest)."""
    mean = errors.groupBy("treated", "step").agg(F.avg("error").alias("error"), F.max("lam").alias("lam"))
    return mean.groupBy("treated").agg(F.min_by("lam", F.struct("error", "step")).alias("lam"))


# GSYN: interactive fixed effects ---------------------------------------------------------------

def _loo_rank(factors: np.ndarray, y: np.ndarray, most: int) -> int:
    """Number of factors (0 to ``most``) with the least squared error over dates left out one at a time (ties: fewer)."""
    best, chosen = float(np.mean(y * y)), 0
    for r in range(1, min(most, len(y) - 1, factors.shape[1]) + 1):
        f = factors[:, :r]
        hat = f @ np.linalg.pinv(f)
        room = 1.0 - np.diag(hat)
        if (room < 1e-9).any():
            break
        error = float(np.mean(((y - hat @ y) / room) ** 2))
        if error < best * (1 - 1e-12):
            best, chosen = error, r
    return chosen


def gsyn_series(panel: DataFrame, treated: Sequence[str], p0: int, rank: int | None = None, most: int = 5) -> DataFrame:
    """QX8 ``gsyn``: generalized synthetic control (interactive fixed effects) counterfactual.

    Time factors are the top ``rank`` eigenvectors of the dates x dates Gram of the control
    units' (demeaned) series -- ``pair_moments`` with the roles of unit and date swapped, so
    no unit-by-unit rows are emitted; the treated unit's own outer product is subtracted in
    its solve task.  Loadings are fitted on the pre-period (positions < p0) and the
    counterfactual is F * loading (+ the unit's pre-mean).  ``rank`` None: the number of factors, up to ``most``, whose predictions of
    pre-period dates left out of the fit are best.  Returns (unit, idx, predicted).
    """
    T_ = int(panel.agg(F.max("idx") + 1).collect()[0][0])
    swapped = panel.select(F.col("idx").cast("string").alias("unit"), F.col("unit").alias("date"), "y_fit")
    dates = [str(i) for i in range(T_)]
    tg = pair_moments(swapped, "y_fit", units=dates, fields=("sab",))
    treated = list(treated)
    tser = {r["unit"]: (r["v"], r["mu"]) for r in panel.filter(F.col("unit").isin(treated))
            .groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("idx", "y_fit"))).alias("s"),
                                 F.first(F.coalesce("mu", F.lit(0.0))).alias("mu"))
            .select("unit", F.col("s.y_fit").alias("v"), "mu").collect()}  # treated series: #dates values each
    B = max(1, min(len(treated), 64))
    rep = tg.select("*", F.explode(F.sequence(F.lit(0), F.lit(B - 1))).alias("_bucket"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["_bucket"].iloc[0])
        G = np.zeros((T_, T_))
        G[pdf["a"].astype(int).to_numpy(), pdf["b"].astype(int).to_numpy()] = pdf["sab"].to_numpy()
        rows = []
        for u in treated:
            if _stable_hash(u) % B != bucket or u not in tser:
                continue
            y, mu = np.asarray(tser[u][0], float), float(tser[u][1])
            if len(y) != T_:
                continue
            Gc = G - np.outer(y, y)
            vals, vecs = np.linalg.eigh(Gc)
            Fm = vecs[:, ::-1]
            Fm = Fm[:, :_loo_rank(Fm[:p0], y[:p0], most) if rank is None else rank]
            lam, *_ = np.linalg.lstsq(Fm[:p0], y[:p0], rcond=None)
            pred = Fm @ lam + mu
            rows.extend((u, int(t), float(pred[t])) for t in range(T_))
        return pd.DataFrame(rows, columns=["unit", "idx", "predicted"])

    return rep.groupBy("_bucket").applyInPandas(solve, "unit string, idx int, predicted double")


# Counterfactual series --------------------------------------------------------------------------

def counterfactual(panel: DataFrame, weights: DataFrame, keys: Sequence[str] = (),
                   groups: DataFrame | None = None) -> DataFrame:
    """(keys, unit=treated, date, idx, observed, predicted): predicted = treated pre-mean +
    sum_d w_d * y_fit_d (fixed effects) or sum_d w_d * y_d; a join on the donor then a grouped sum.
    A treated group observes the sum of its members (membership table: one row per member)."""
    donors = panel.select(*keys, F.col("unit").alias("donor"), "date", "idx", F.col("y_fit").alias("yd"))
    pred = (weights.select(*keys, "treated", "donor", "weight").join(donors, [*keys, "donor"])
            .groupBy(*keys, "treated", "date", "idx").agg(F.sum(F.col("weight") * F.col("yd")).alias("_p")))
    if groups is not None:
        obs = (panel.join(groups.select("treated", "unit"), "unit")
               .groupBy(*keys, "treated", "date").agg(F.sum("y").alias("observed"),
                                                      F.sum(F.coalesce("mu", F.lit(0.0))).alias("_mu")))
    else:
        obs = panel.select(*keys, F.col("unit").alias("treated"), "date", F.col("y").alias("observed"),
                           F.coalesce("mu", F.lit(0.0)).alias("_mu"))
    return (pred.join(obs, [*keys, "treated", "date"])
            .select(*keys, F.col("treated").alias("unit"), "date", "idx", "observed",
                    (F.col("_p") + F.col("_mu")).alias("predicted")))


# Conformal (cyclic shift) test and CI inversion -------------------------------------------------------

def _post_flag(idx: F.Column, p0: F.Column, p1: F.Column) -> F.Column:
    return (idx >= p0) & (idx <= p1)


def shift_sums(series: DataFrame, p0: int, p1: int, keys: Sequence[str] = (), n_periods: int | None = None) -> DataFrame:
    """Per (keys, unit, shift s): A_s = sum over post t of u_{(t+s) mod T}, c_s = #post t with
    (t+s) mod T in post, B_s = sum of predicted over the same positions, T periods (idx 0..T-1)."""
    s = series.select(*keys, "unit", "idx", (F.col("observed") - F.col("predicted")).alias("u"), "predicted")
    if n_periods is None:
        n_periods = F.max("idx").over(Window.partitionBy(*keys, "unit")) + 1
    s = s.select("*", F.lit(p0).alias("_p0"), (F.lit(n_periods) if isinstance(n_periods, int) else n_periods).alias("_T"))
    return cyclic_sums(s, p1 - p0 + 1, keys)


def cyclic_sums(s: DataFrame, length: int, keys: Sequence[str] = ()) -> DataFrame:
    """A, c, B of every cyclic shift from rows (keys, unit, idx, u, predicted, _p0, _T).

    The post window shifted by s is the run of ``length`` positions from (p0 + s) mod T on.  Two copies of
    a unit's series, one after the other, turn every cyclic run into a plain one: one window over 2T rows gives all T sums."""
    twice = s.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("_copy")).withColumn("_at", (F.col("idx") + F.col("_copy") * F.col("_T")).cast("long"))
    run = Window.partitionBy(*keys, "unit").orderBy("_at").rangeBetween(0, length - 1)
    post = _post_flag(F.col("idx"), F.col("_p0"), F.col("_p0") + length - 1)
    out = twice.select(*keys, "unit", "idx", "_copy", F.pmod(F.col("idx") - F.col("_p0"), F.col("_T")).cast("int").alias("shift"),
                       F.sum("u").over(run).alias("A"), F.sum(F.when(post, 1).otherwise(0)).over(run).alias("c"),
                       F.sum(F.when(post, F.col("predicted")).otherwise(0.0)).over(run).alias("B"))
    return out.filter("_copy = 0").select(*keys, "unit", "shift", "A", "c", "B")


def _stat(x: F.Column, stat_test: str) -> F.Column:
    if stat_test == "Total":
        return F.abs(x)
    if stat_test == "Positive":
        return x
    if stat_test == "Negative":
        return -x
    raise ValueError(stat_test)


def conformal_pvalue(shifts: DataFrame, stat_test: str = "Total", keys: Sequence[str] = ()) -> DataFrame:
    """QX9: p = share of cyclic shifts whose statistic is >= the observed one (shift 0)."""
    w = Window.partitionBy(*keys, "unit")  # one unit's T shift rows
    s = shifts.select("*", _stat(F.col("A"), stat_test).alias("S"))
    s = s.select("*", F.max(F.when(F.col("shift") == 0, F.col("S"))).over(w).alias("S0"))
    return s.groupBy(*keys, "unit").agg(F.avg((F.col("S") >= F.col("S0") - 1e-12).cast("double")).alias("p_value"),
                                        F.count(F.lit(1)).alias("n_shifts"))


def effect_interval(shifts: DataFrame, alpha: float = 0.1, stat_test: str = "Total", keys: Sequence[str] = ()) -> DataFrame:
    """QX10: exact CI of the per-period effect by test inversion: keys, unit, ate_lower, ate_upper.

    Under H0 an effect theta is taken off the post residuals, so A_s(theta) = A_s - theta * c_s.  A shift reaches the statistic of
    shift 0 on one interval of theta around the estimate, whose ends are crossings of two lines; theta is kept while at least
    alpha * T shifts reach it, so a bound is an order statistic of the crossings.  It is null (unbounded) where the p-value stays above alpha."""
    w = Window.partitionBy(*keys, "unit")  # one unit's T shift rows
    s = shifts.select("*", F.max(F.when(F.col("shift") == 0, F.col("A"))).over(w).alias("A0"), F.max(F.when(F.col("shift") == 0, F.col("c"))).over(w).alias("c0"),
                      F.ceil(F.lit(float(alpha)) * F.count(F.lit(1)).over(w) - 1e-9).alias("k"))
    same = (F.col("A0") - F.col("A")) / (F.col("c0") - F.col("c"))
    opposite = (F.col("A0") + F.col("A")) / (F.col("c0") + F.col("c"))
    moved = F.col("c") < F.col("c0")  # the others (shift 0) reach it everywhere
    ends = {"Total": (F.least(same, opposite), F.greatest(same, opposite)), "Positive": (same, None), "Negative": (None, same)}[stat_test]
    out = []
    for end, name, order in ((ends[0], "ate_lower", F.col("_lo").asc_nulls_first()), (ends[1], "ate_upper", F.col("_hi").desc_nulls_first())):
        column = "_lo" if name == "ate_lower" else "_hi"
        s = s.withColumn(column, F.lit(None).cast("double") if end is None else F.when(moved, end))
        s = s.withColumn(f"{column}_rank", F.row_number().over(w.orderBy(order)))
        out.append(F.max(F.when(F.col(f"{column}_rank") == F.col("k"), F.col(column))).alias(name))
    return s.groupBy(*keys, "unit").agg(*out)


# Conformal test with weights refitted under each null -----------------------------------------------

GRID, STEPS_AT_ONCE = 250, 32  # effects of the grid; neighbouring ones that a task solves in one go


def effect_grid(att: DataFrame, grid_size: int = GRID, span: float = 4.0) -> DataFrame:
    """treated, step, theta: ``grid_size`` effects evenly around the estimate of a unit, wide enough to hold 0 and ``span`` times the spread of
    its pre-period residuals (``att``: unit, ate, scale); step -1 is the effect 0."""
    half = F.abs("ate") + F.lit(float(span)) * F.coalesce("scale", F.lit(0.0))
    theta = F.when(F.col("step") < 0, 0.0).otherwise(F.col("ate") + half * (F.col("step") * (2.0 / max(grid_size - 1, 1)) - 1.0))
    steps = F.explode(F.sequence(F.lit(-1), F.lit(grid_size - 1))).alias("step")
    return att.filter(F.col("ate").isNotNull()).select("unit", "ate", "scale", steps).select(F.col("unit").alias("treated"), "step", theta.alias("theta"))


def null_weights(gram: DataFrame, post_sums: DataFrame, grid: DataFrame, buckets: int = 64) -> DataFrame:
    """treated, step, theta, donor, weight (> 0): simplex weights for the treated series less theta in the post period.

    Over the whole period the Gram of the donors does not depend on theta, and their products with the treated series are affine in it:
    c - theta * d, d = a donor's sum over the post period (``post_sums``: unit, d).  So a step needs one vector and starts from the
    weights of the step before; units and stretches of steps are dealt out to the tasks."""
    B = max(1, min(buckets, 64))
    shared = _of_kind(gram, GRAM, "a", F.col("b"), F.col("g"), []).unionByName(_of_kind(post_sums, POST, "unit", F.lit(""), F.col("d"), []))
    shared = shared.withColumn("_bucket", F.explode(F.sequence(F.lit(0), F.lit(B - 1))))
    stretch = F.pmod(F.xxhash64("treated", F.floor(F.col("step") / STEPS_AT_ONCE)), F.lit(B)).cast("int")
    asked = grid.select(F.lit(STEP).alias("kind"), F.col("treated").alias("a"), F.col("step").cast("string").alias("b"), F.col("theta").alias("g"), stretch.alias("_bucket"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        of = {k: pdf[pdf["kind"] == k] for k in (GRAM, POST, STEP)}
        units = sorted(set(of[GRAM]["a"]))
        pos = {u: i for i, u in enumerate(units)}
        G, d = np.zeros((len(units), len(units))), np.zeros(len(units))
        G[of[GRAM]["a"].map(pos).to_numpy(), of[GRAM]["b"].map(pos).to_numpy()] = of[GRAM]["g"].to_numpy()
        d[of[POST]["a"].map(pos).to_numpy()] = of[POST]["g"].to_numpy()
        steps = of[STEP].assign(step=of[STEP]["b"].astype(int)).sort_values(["a", "step"])
        rows = []
        for u, mine in steps.groupby("a", sort=False):
            if u not in pos or len(units) < 2:
                continue
            donors = [i for i in range(len(units)) if i != pos[u]]
            Gd, c = G[np.ix_(donors, donors)], G[donors, pos[u]]
            top, w, last = float(np.linalg.eigvalsh(Gd)[-1]), None, None
            for step, theta in zip(mine["step"].tolist(), mine["g"].tolist(), strict=True):
                if last is None or step // STEPS_AT_ONCE != last // STEPS_AT_ONCE:
                    w = None  # a stretch starts afresh, whichever others the task holds
                w, last = simplex_ls(Gd, c - theta * d[donors], start=w, top=top), step
                rows.extend((u, step, theta, units[i], float(w[k])) for k, i in enumerate(donors) if w[k] > 0)
        return pd.DataFrame(rows, columns=["treated", "step", "theta", "donor", "weight"])

    both = shared.select("_bucket", "kind", "a", "b", "g").unionByName(asked.select("_bucket", "kind", "a", "b", "g"))
    return both.groupBy("_bucket").applyInPandas(solve, "treated string, step int, theta double, donor string, weight double")


def refit_tests(panel: DataFrame, p0: int, p1: int, grid: DataFrame, stat_test: str = "Total", fixed_effects: bool = True, buckets: int = 64) -> DataFrame:
    """QX9 with refit: unit, step, theta, p_value, n_shifts.

    Under each null the effect theta is taken off the treated unit's post period, the weights are fitted to all periods 0..p1 (fixed effects:
    means of all of them), and the cyclic shifts of the residuals give the p-value."""
    whole = panel.filter(F.col("idx") <= p1).select("unit", "date", "idx", "y")
    whole = with_fixed_effects(whole, F.lit(True)) if fixed_effects else whole.withColumn("y_fit", F.col("y"))
    post = _post_flag(F.col("idx"), F.lit(p0), F.lit(p1))
    sums = whole.groupBy("unit").agg(F.sum(F.when(post, F.col("y_fit")).otherwise(0.0)).alias("d"))
    w = null_weights(donor_gram(whole), sums, grid, buckets)
    donors = whole.select(F.col("unit").alias("donor"), "idx", F.col("y_fit").alias("yd"))
    fitted = w.join(donors, "donor").groupBy("treated", "step", "theta", "idx").agg(F.sum(F.col("weight") * F.col("yd")).alias("predicted"))
    own = whole.select(F.col("unit").alias("treated"), "idx", "y_fit")
    share = (p1 - p0 + 1) / (p1 + 1) if fixed_effects else 0.0
    u = F.col("y_fit") - F.col("theta") * (F.when(post, 1.0).otherwise(0.0) - F.lit(share)) - F.col("predicted")
    rows = fitted.join(own, ["treated", "idx"]).select("step", "theta", F.col("treated").alias("unit"), "idx", u.alias("u"), "predicted",
                                                       F.lit(p0).alias("_p0"), F.lit(p1 + 1).alias("_T"))
    return conformal_pvalue(cyclic_sums(rows, p1 - p0 + 1, ["step", "theta"]), stat_test, ["step", "theta"])


def refit_interval(tests: DataFrame, alpha: float = 0.1) -> DataFrame:
    """unit, p_value (of no effect), n_shifts, ate_lower, ate_upper: the least and the greatest effect of the grid whose test keeps it at level alpha;
    null where that is an end of the grid (no bound found) or no effect is kept."""
    kept = (F.col("step") >= 0) & (F.col("p_value") >= alpha - 1e-12)
    g = tests.groupBy("unit").agg(F.max(F.when(F.col("step") < 0, F.col("p_value"))).alias("p_value"), F.max("n_shifts").alias("n_shifts"), F.max("step").alias("_last"),
                                  F.min(F.when(kept, F.struct("step", "theta"))).alias("_lo"), F.max(F.when(kept, F.struct("step", "theta"))).alias("_hi"))
    return g.select("unit", "p_value", "n_shifts", F.when(F.col("_lo.step") > 0, F.col("_lo.theta")).alias("ate_lower"),
                    F.when(F.col("_hi.step") < F.col("_last"), F.col("_hi.theta")).alias("ate_upper"))


# Impact -----------------------------------------------------------------------------------------

def _unit_dates(df: DataFrame, date: str, unit: str, kpi: str, covariates: Sequence[str] = ()) -> DataFrame:
    """unit, date, y (sum) and _c<i> (means) of the rows that have all of them."""
    covs = [f"_c{i}" for i in range(len(covariates))]
    rows = df.select(F.col(unit).cast("string").alias("unit"), F.to_date(F.col(date)).alias("date"), F.col(kpi).cast("double").alias("y"),
                     *[F.col(c).cast("double").alias(n) for c, n in zip(covariates, covs, strict=True)])
    return rows.dropna().groupBy("unit", "date").agg(F.sum("y").alias("y"), *[F.avg(c).alias(c) for c in covs])


def prepare_panel(df: DataFrame, date: str, unit: str, kpi: str, start: str, duration: int | None = None,
                  fixed_effects: bool = True, covariates: Sequence[str] = ()) -> tuple[DataFrame, int, int, int]:
    """Aggregate to (unit, date, y, covariates as _c<i>), drop units with gaps (TS8), index dates, add FE columns.  Returns (panel, p0, p1, T):
    post positions p0..p1 = the ``duration`` dates from the first date >= start."""
    panel = index_dates(complete_units(_unit_dates(df, date, unit, kpi, covariates)))
    b = panel.agg(F.min(F.when(F.col("date") >= F.lit(start).cast("date"), F.col("idx"))).alias("p0"),
                  (F.max("idx") + 1).alias("T")).collect()[0]
    if b["p0"] is None or b["p0"] == 0:
        raise ValueError("intervention start must lie inside the panel and after its first date")
    p0, T_ = int(b["p0"]), int(b["T"])
    p1 = T_ - 1 if duration is None else min(p0 + duration - 1, T_ - 1)
    pre = F.col("idx") < p0
    panel = with_fixed_effects(panel, pre) if fixed_effects else panel.select("*", F.lit(0.0).alias("mu"),
                                                                              F.col("y").alias("y_fit"))
    return panel, p0, p1, T_


def synth_impact(df: DataFrame, date: str, unit: str, kpi: str, treated: Sequence[str] | None, start: str,
                 duration: int = 14, model: str = "none", alpha: float = 0.1, stat_test: str = "Total",
                 fixed_effects: bool = True, with_ci: bool = True,
                 gsyn_rank: int | None = None, covariates: Sequence[str] = (), lam_scale: float | None = None, refit: bool = False,
                 grid_size: int = GRID, by_columns: bool = False) -> dict[str, DataFrame]:
    """QX6: synthetic-control impact for the treated units (None = every unit, in-space placebo).

    Returns dict of DataFrames: ``weights``, ``series`` (TS13 layout), ``impact`` (one row per
    unit: ATT, its CI by inversion, incremental (cum) and its CI, percent lift and its CI
    (relative CI = cum bound / (cum / lift)), conformal p, alpha, significant, imbalance).

    ``covariates``: columns whose pre-period means the weights are adjusted for (not with ``gsyn``).  The ridge penalty is chosen by leaving out pre-period
    dates, unless ``lam_scale`` sets it; so is the number of factors of ``gsyn``, unless ``gsyn_rank`` does.

    ``refit`` (plain weights without covariates): the p-value and the interval come from weights fitted under each null of a grid of ``grid_size``
    effects (:func:`refit_tests`), returned as ``tests``, instead of from the residuals of one fit.  ``by_columns`` (the same restriction, not
    with ``refit``): weights by :func:`column_weights`, for panels whose pairs of units do not fit a task.
    """
    if refit and (model != "none" or covariates):
        raise ValueError("refit is for plain synthetic control without covariates")
    if by_columns and (model != "none" or covariates or refit):
        raise ValueError("by_columns is for plain synthetic control without covariates and refit")
    panel, p0, p1, T_ = prepare_panel(df, date, unit, kpi, start, duration, fixed_effects, covariates)
    # the aggregated panel is read by several jobs (Gram, counterfactual, tests): write it once to
    # the shared checkpoint folder so the source aggregation is not repeated and lineage is cut
    panel = panel.checkpoint(eager=True)
    before = panel.filter(F.col("idx") < p0)
    gram = None if by_columns else donor_gram(before)
    lambdas = None
    if model in ("ridge", "best") and lam_scale is None:
        gram = gram.checkpoint(eager=True)
        lambdas = ridge_lambdas(ridge_errors(gram, before, treated))
    z = covariate_means(before, [f"_c{i}" for i in range(len(covariates))]) if covariates and model != "gsyn" else None
    w = column_weights(before, treated) if by_columns else synth_weights(gram, treated, "none" if model == "gsyn" else model,
                                                                         0.1 if lam_scale is None else lam_scale, covariates=z, lambdas=lambdas)
    if model == "gsyn":
        units = treated if treated is not None else [r[0] for r in panel.select("unit").distinct().collect()]
        g = gsyn_series(panel, units, p0, rank=gsyn_rank)
        obs = panel.select("unit", "date", "idx", F.col("y").alias("observed"))
        series = g.join(obs, ["unit", "idx"]).filter(F.col("idx") <= p1).select("unit", "date", "idx", "observed",
                                                                                  "predicted")
    else:
        series = counterfactual(panel.filter(F.col("idx") <= p1), w)
    series = series.withColumn("is_post", _post_flag(F.col("idx"), F.lit(p0), F.lit(p1)).cast("int"))
    eff = F.col("observed") - F.col("predicted")
    post = F.col("is_post") == 1
    att = series.groupBy("unit").agg(
        F.avg(F.when(post, eff)).alias("ate"), F.sum(F.when(post, eff)).alias("cum"),
        F.sum(F.when(post, F.col("predicted"))).alias("pred_post"), F.sum(F.when(post, 1)).alias("n_post"),
        F.sqrt(F.avg(F.when(~post, eff * eff))).alias("scale"))
    shifts = shift_sums(series.select("unit", "idx", "observed", "predicted"), p0, p1, n_periods=p1 + 1)
    tests = refit_tests(panel, p0, p1, effect_grid(att, grid_size if with_ci else 1), stat_test, fixed_effects) if refit else None
    pv = refit_interval(tests, alpha) if refit else conformal_pvalue(shifts, stat_test)
    if model == "gsyn":  # pre-period fit of the factor model; scaled by the plain SC's uniform-weight imbalance
        pre_sq = series.filter(F.col("idx") < p0).groupBy("unit").agg(
            F.sqrt(F.sum((F.col("observed") - F.col("predicted")) ** 2)).alias("l2_imbalance"))
        uni = w.groupBy(F.col("treated").alias("unit")).agg(
            (F.first("l2_imbalance") / F.first("scaled_l2_imbalance")).alias("_u"))
        imb = pre_sq.join(uni, "unit", "left").select(
            "unit", "l2_imbalance", (F.col("l2_imbalance") / F.col("_u")).alias("scaled_l2_imbalance"))
    else:
        imb = w.groupBy(F.col("treated").alias("unit")).agg(F.first("l2_imbalance").alias("l2_imbalance"),
                                                            F.first("scaled_l2_imbalance").alias("scaled_l2_imbalance"))
    out = att.join(pv, "unit").join(imb, "unit")
    if with_ci:
        out = out if refit else out.join(effect_interval(shifts, alpha, stat_test), "unit", "left")
    else:
        out = out.withColumns({c: F.lit(None).cast("double") for c in ("ate_lower", "ate_upper")})
    rel = F.try_divide(F.col("cum"), F.col("pred_post"))
    ratio = F.col("pred_post")  # cum / rel: the predicted post-period total
    impact = out.select(
        F.lit(f"SyntheticControl({model})").alias("method"), "unit", "ate", "ate_lower", "ate_upper", "cum",
        (F.col("ate_lower") * F.col("n_post")).alias("cum_lower"), (F.col("ate_upper") * F.col("n_post")).alias("cum_upper"),
        (rel * 100).alias("rel"), (F.try_divide(F.col("ate_lower") * F.col("n_post"), ratio) * 100).alias("rel_lower"),
        (F.try_divide(F.col("ate_upper") * F.col("n_post"), ratio) * 100).alias("rel_upper"),
        "p_value", F.lit(float(alpha)).alias("alpha"), (F.col("p_value") < alpha).alias("significant"),
        "l2_imbalance", "scaled_l2_imbalance", F.lit(None).cast("string").alias("error"))
    return {"weights": w, "series": series, "impact": impact, "panel": panel, "shifts": shifts} | ({"tests": tests} if refit else {})


def placebo_rank(impact_all: DataFrame, treated: str) -> DataFrame:
    """QX19: rank of the treated unit's |ATT| / pre-fit imbalance among all units run as
    pseudo-treated; p = rank / units."""
    r = impact_all.select("unit", F.try_divide(F.abs("ate"), F.greatest(F.col("l2_imbalance"), F.lit(1e-12))).alias("ratio"))
    w = Window.orderBy(F.desc(rnd("ratio", 9)))  # one row per unit; equal to 9 digits is a tie
    ranked = r.select("*", F.rank().over(w).alias("rank"), F.count(F.lit(1)).over(Window.partitionBy()).alias("units"))
    return ranked.filter(F.col("unit") == treated).select("unit", "ratio", "rank", "units",
                                                          (F.col("rank") / F.col("units")).alias("placebo_p"))


# Power analysis / market selection ----------------------------------------------------------------

def market_groups(panel: DataFrame, sizes: Sequence[int], candidates: Sequence[str] | None = None, similarity: DataFrame | None = None) -> DataFrame:
    """treated (the members' names joined by ``+``), unit: a row a member of every group of markets to try.

    For every size n, each market is grouped with the n - 1 markets most similar to it; equal groups count once.  ``similarity`` (unit, other,
    rank) replaces the correlations (for instance ``neighbours(..., "dtw")``).  Groups with a market outside of ``candidates`` are left out."""
    most = max(sizes)
    near = similarity if similarity is not None else neighbours(panel, most - 1)
    near = near.filter(F.col("rank") < most).groupBy("unit").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "other"))), lambda s: s["other"]).alias("near"))
    units = panel.select("unit").distinct().join(near, "unit", "left")
    near_ = F.coalesce("near", F.array().cast("array<string>"))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.array_sort(F.concat(F.array("unit"), F.slice(near_, 1, n - 1))).alias("members")) for n in sorted(set(sizes))]))
    groups = units.select(each.alias("s")).filter(F.size("s.members") == F.col("s.n")).select(F.col("s.members").alias("members")).distinct()
    if candidates is not None:
        groups = groups.filter(F.size(F.array_except("members", F.array(*[F.lit(str(c)) for c in candidates]))) == 0)
    return groups.select(F.array_join("members", "+").alias("treated"), F.explode("members").alias("unit"))


def random_sums(s: DataFrame, length: int, ns: int, seed: int = 42, keys: Sequence[str] = ()) -> DataFrame:
    """A, c, B of the observed window (shift 0) and of ``ns`` random choices of as many dates, from rows like those of :func:`cyclic_sums`.

    One row a unit carries its series of dates to the draws, which follow from seed, keys and unit."""
    keys = list(keys)
    rows = (s.groupBy(*keys, "unit").agg(F.sort_array(F.collect_list(F.struct("idx", "u", "predicted"))).alias("s"), F.max("_p0").alias("_p0"))
            .select(*keys, "unit", "_p0", F.col("s.u").alias("u"), F.col("s.predicted").alias("predicted")))
    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields if f.name in (*keys, "unit"))

    def draw(frames):
        for f in frames:
            for r in f.to_dict("records"):
                u, pred, p0 = np.asarray(r["u"], float), np.asarray(r["predicted"], float), int(r["_p0"])
                rng = np.random.default_rng([seed, _stable_hash("|".join(str(r[k]) for k in [*keys, "unit"]))])
                at = np.vstack([np.arange(p0, p0 + length), rng.random((ns, len(u))).argsort(axis=1)[:, :length]])
                post = (at >= p0) & (at < p0 + length)
                yield pd.DataFrame({**{k: r[k] for k in [*keys, "unit"]}, "shift": np.arange(ns + 1), "A": u[at].sum(axis=1), "c": post.sum(axis=1),
                                    "B": np.where(post, pred[at], 0.0).sum(axis=1)})

    return rows.mapInPandas(draw, fields + "shift int, A double, c long, B double")


def market_power(df: DataFrame, date: str, unit: str, kpi: str, duration: int = 14, lookback: int = 1,
                 effects: Sequence[float] = (0.0, 0.1), alpha: float = 0.1, stat_test: str = "Total",
                 candidates: Sequence[str] | None = None, fixed_effects: bool = True, model: str = "none",
                 cutoff: str | None = None, cpic: float | None = None, budget: float | None = None,
                 n_markets: int | Sequence[int] = 1, covariates: Sequence[str] = (), side: str | None = None, normalize: bool = False,
                 ns: int = 0, seed: int = 42, similarity: DataFrame | None = None) -> dict:
    """QX11: simulated power of every candidate market.

    Simulation k = 1..lookback places a ``duration``-period test window ending k-1 windows
    before the last date; weights are fitted on the periods before the window (Gram keyed by
    k), the relative effect e is injected as e * predicted on the window, and the conformal test decides detection.
    Power(c, e) = share of the k simulations with p < alpha.
    Everything is keyed by (k, candidate[, effect]) so the simulations run as parallel groups.
    ``n_markets``: how many markets are treated together (their summed series), one number or several; beyond one, every market is grouped with
    those most like it (:func:`market_groups`, ``similarity``).  ``side``: ``one_sided`` (for increases) or ``two_sided`` in place of ``stat_test``.
    ``ns`` > 0 tests against that many random choices of dates instead of cyclic shifts.  ``normalize`` divides the outcome by its standard deviation
    while the weights are found.  ``covariates`` are adjusted for as in :func:`synth_impact`.
    """
    if side is not None:
        stat_test = {"one_sided": "Positive", "two_sided": "Total"}[side]
    base = df if cutoff is None else df.filter(F.to_date(F.col(date)) < F.lit(cutoff).cast("date"))
    panel = index_dates(complete_units(_unit_dates(base, date, unit, kpi, covariates)))
    scale = 1.0
    if normalize:
        scale = panel.agg(F.stddev_samp("y")).first()[0] or 1.0
        panel = panel.withColumn("y", F.col("y") / scale)
    T_ = int(panel.agg(F.max("idx") + 1).collect()[0][0])
    if T_ - lookback * duration <= 1:
        raise ValueError("not enough history for the requested lookback")
    # simulation k uses positions idx <= p1_k = T - (k-1)*duration - 1 (its window and its past):
    # each panel row is replicated to the simulations that can see it (explode, no join)
    kmax = F.least(F.lit(lookback), F.floor((F.lit(T_ - 1) - F.col("idx")) / duration).cast("int") + 1)
    pk = panel.select("*", F.explode(F.sequence(F.lit(1), kmax)).alias("k"))
    pk = pk.select("*", (F.lit(T_) - F.col("k") * duration).alias("p0"),
                   (F.lit(T_) - (F.col("k") - 1) * duration - 1).alias("p1"))
    pre = F.col("idx") < F.col("p0")
    if fixed_effects:
        pk = with_fixed_effects(pk, pre, keys=["k"])
    else:
        pk = pk.select("*", F.lit(0.0).alias("mu"), F.col("y").alias("y_fit"))
    pk = pk.checkpoint(eager=True)  # read by the Gram, counterfactual and test jobs
    gram = donor_gram(pk.filter(pre), keys=["k"])
    sizes = [n_markets] if isinstance(n_markets, int) else list(n_markets)
    groups = None
    if sizes != [1]:
        groups = market_groups(panel.filter(F.col("idx") < T_ - lookback * duration), sizes, candidates, similarity).checkpoint(eager=True)
    z = covariate_means(pk.filter(pre), [f"_c{i}" for i in range(len(covariates))], ["k"]) if covariates else None
    w = synth_weights(gram, candidates, model, keys=["k"], groups=groups, covariates=z)
    series = counterfactual(pk, w, keys=["k"], groups=groups)
    series = series.select("*", (F.lit(T_) - F.col("k") * duration).alias("p0"),
                           (F.lit(T_) - (F.col("k") - 1) * duration - 1).alias("p1"))
    s = series.select("k", "unit", "idx", "observed", "predicted", "p0", "p1")
    # the injected effect e * predicted sits on post positions: B sums predicted over them
    rows = s.select("k", "unit", "idx", (F.col("observed") - F.col("predicted")).alias("u"), "predicted", F.col("p0").alias("_p0"), (F.col("p1") + 1).alias("_T"))
    sh = random_sums(rows, duration, ns, seed, ["k"]) if ns > 0 else cyclic_sums(rows, duration, ["k"])
    grid = sh.select("*", F.explode(F.array(*[F.lit(float(e)) for e in effects])).alias("effect"))
    st = grid.select("k", "unit", "shift", "effect", _stat(F.col("A") + F.col("effect") * F.col("B"), stat_test).alias("S"))
    wv = Window.partitionBy("k", "unit", "effect")
    st = st.select("*", F.max(F.when(F.col("shift") == 0, F.col("S"))).over(wv).alias("S0"))
    pv = st.groupBy("k", "unit", "effect").agg(F.avg((F.col("S") >= F.col("S0") - 1e-12).cast("double")).alias("p"))
    post_tot = (series.filter((F.col("idx") >= F.col("p0")) & (F.col("idx") <= F.col("p1")))
                .groupBy("k", "unit").agg(F.sum("predicted").alias("pred_post"),
                                          F.sum(F.col("observed") - F.col("predicted")).alias("resid_post")))
    sim = pv.join(post_tot, ["k", "unit"])
    detected_lift = F.try_divide(F.col("resid_post") + F.col("effect") * F.col("pred_post"), F.col("pred_post"))
    power = sim.groupBy(F.col("unit").alias("candidate"), "effect").agg(
        F.avg((F.col("p") < alpha).cast("double")).alias("power"),
        F.avg(detected_lift).alias("avg_detected_lift"),
        (F.avg(F.col("effect") * F.col("pred_post")) * scale).alias("avg_incremental"),
        F.count(F.lit(1)).alias("simulations"))
    if cpic is not None:
        power = power.withColumn("investment", F.lit(float(cpic)) * F.col("avg_incremental"))
        if budget is not None:
            power = power.withColumn("within_budget", F.col("investment") <= F.lit(float(budget)))
    imb = w.groupBy(F.col("treated").alias("candidate")).agg(F.avg("scaled_l2_imbalance").alias("scaled_l2_imbalance"),
                                                             (F.avg("l2_imbalance") * scale).alias("l2_imbalance"))
    return {"power": power.join(imb, "candidate", "left"), "weights": w, "panel": pk}


def minimum_detectable_effect(power: DataFrame, threshold: float = 0.8) -> DataFrame:
    """QX12: per candidate, the smallest positive effect whose power reaches ``threshold``."""
    ok = power.filter((F.col("effect") > 0) & (F.col("power") >= threshold))
    return ok.groupBy("candidate").agg(F.min("effect").alias("mde"),
                                       F.min_by("avg_detected_lift", "effect").alias("mde_detected_lift"))


def rank_markets(power: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Candidate ranking: MDE (smaller first), then scaled imbalance; strong pre-fit < 0.2."""
    mde = minimum_detectable_effect(power, threshold)
    imb = power.groupBy("candidate").agg(F.first("scaled_l2_imbalance").alias("scaled_l2_imbalance"))
    r = imb.join(mde, "candidate", "left")
    w = Window.orderBy(F.col("mde").asc_nulls_last(), F.col("scaled_l2_imbalance"), "candidate")
    return r.select("*", (F.col("scaled_l2_imbalance") < 0.2).alias("strong_fit"), F.row_number().over(w).alias("rank"))


def method_comparison(impacts: Sequence[DataFrame], labels: Sequence[str]) -> DataFrame:
    """QX20 / SNK4: union of impact rows with a label and formatted columns."""
    parts = [i.select(F.lit(l).alias("run"), "*") for i, l in zip(impacts, labels)]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p, allowMissingColumns=True)
    return u.select("*", F.format_string("%.2f [%.2f, %.2f]", "ate", "ate_lower", "ate_upper").alias("ate_fmt"),
                    F.format_string("%.2f [%.2f, %.2f]", "cum", "cum_lower", "cum_upper").alias("cum_fmt"),
                    F.format_string("%.2f%%", "rel").alias("rel_fmt"))
