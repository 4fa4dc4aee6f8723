"""Gram (moment) aggregates and the regressions built on them.

One ``groupBy(keys).agg`` computes every cross product of the design
[1, x_1..x_k, y] (optionally weighted).  Partial aggregation keeps the
shuffle at O(k^2) values per partition and group, independent of row count;
the k x k solve runs per group inside ``mapInPandas`` on the aggregated rows,
so thousands of regressions (periods, bootstrap replicates, units) are one
Spark job and nothing passes through the driver.

Columns are shifted by their global means (one scalar sub-query) before the
products are summed, which keeps the normal equations well conditioned at
any row count.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.linalg import ols_from_moments
from .results import COEF_SCHEMA_FIELDS


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def moments(df: DataFrame, exprs: dict[str, Column | str], keys: Sequence[str] = (),
            weight: Column | str | None = None, shift: bool = True,
            shift_from: DataFrame | None = None, fixed_shifts: dict[str, float] | None = None
            ) -> tuple[DataFrame, list[str]]:
    """Weighted moment table.

    Returns (DataFrame, names).  Columns: keys..., ``_n`` (rows), ``_sw`` (sum of
    weights), ``_c{i}`` (shift of column i), ``_s{i}`` and ``_s{i}_{j}`` (i<=j)
    sums of w*z_i and w*z_i*z_j over shifted columns z = x - c.

    Unweighted: one pass with ``avg`` and ``covar_pop`` per group (Welford-style
    mergeable buffers, numerically stable at any row count): the shift is the
    group mean, so s_i = 0 and s_ij = n * covar_pop.
    Weighted (replicates): raw weighted sums of columns shifted by global means
    taken from ``shift_from`` (e.g. the data *before* replicate explosion, so the
    expensive replicate pipeline runs once), or by ``fixed_shifts``.
    """
    names = list(exprs)
    m = len(names)
    base = df.select(*[_as_col(k) for k in keys],
                     *[_as_col(e).cast("double").alias(f"_z{i}") for i, e in enumerate(exprs.values())],
                     *([_as_col(weight).cast("double").alias("_w")] if weight is not None else []))
    base = base.dropna(subset=[f"_z{i}" for i in range(m)])
    if weight is None and shift:
        n = F.count(F.lit(1))
        aggs = [n.alias("_n"), n.cast("double").alias("_sw")]
        aggs += [F.avg(f"_z{i}").alias(f"_c{i}") for i in range(m)]
        aggs += [F.lit(0.0).alias(f"_s{i}") for i in range(m)]
        for i in range(m):
            for j in range(i, m):
                aggs.append((F.covar_pop(f"_z{i}", f"_z{j}") * n).alias(f"_s{i}_{j}"))
        g = base.groupBy(*keys).agg(*aggs) if keys else base.agg(*aggs)
        return g, names
    if fixed_shifts is not None:
        shifts = [F.lit(float(fixed_shifts.get(nm, 0.0))) for nm in names]
    elif shift:
        src = base if shift_from is None else shift_from.select(
            *[_as_col(e).cast("double").alias(f"_z{i}") for i, e in enumerate(exprs.values())])
        from ..functions.columns import dlit, one_row
        means = one_row(src.agg(*[F.avg(f"_z{i}").alias(f"m{i}") for i in range(m)]))
        shifts = [dlit(means.get(f"m{i}") or 0.0) for i in range(m)]
    else:
        shifts = [F.lit(0.0) for _ in range(m)]
    z = [F.col(f"_z{i}") - shifts[i] for i in range(m)]
    w = F.col("_w") if weight is not None else F.lit(1.0)
    aggs = [F.count(F.lit(1)).alias("_n"), F.sum(w).alias("_sw")]
    for i in range(m):
        aggs.append(F.sum(w * z[i]).alias(f"_s{i}"))
    for i in range(m):
        for j in range(i, m):
            aggs.append(F.sum(w * z[i] * z[j]).alias(f"_s{i}_{j}"))
    g = base.groupBy(*keys).agg(*aggs) if keys else base.agg(*aggs)
    g = g.select("*", *[shifts[i].alias(f"_c{i}") for i in range(m)])
    return g, names


def moment_matrix(row, m: int, idx: Sequence[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Build the (p+1)x(p+1) matrix over [1, z_idx...] from one moment row (dict-like)."""
    idx = list(range(m)) if idx is None else list(idx)
    p = len(idx) + 1
    M = np.empty((p, p))
    M[0, 0] = row["_sw"]
    for a, i in enumerate(idx, start=1):
        M[0, a] = M[a, 0] = row[f"_s{i}"]
        for b, j in enumerate(idx, start=1):
            lo, hi = (i, j) if i <= j else (j, i)
            M[a, b] = row[f"_s{lo}_{hi}"]
    shifts = np.array([row[f"_c{i}"] for i in idx], dtype=float)
    return M, shifts


def coef_schema(keys_schema: Sequence[T.StructField]) -> T.StructType:
    return T.StructType(list(keys_schema) + COEF_SCHEMA_FIELDS)


def solve_moments(g: DataFrame, names: list[str], y: str, xs: list[str], keys: Sequence[str] = (),
                  alpha: float = 0.05, with_se: bool = True, intercept: bool = True,
                  terms: Sequence[str] | None = None) -> DataFrame:
    """OLS ``y ~ 1 + xs`` for every moment row; one output row per (keys, term)."""
    pos = {n: i for i, n in enumerate(names)}
    idx = [pos[x] for x in xs] + [pos[y]]
    key_fields = [g.schema[k] for k in keys]
    schema = coef_schema(key_fields)
    term_names = (["const"] if intercept else []) + list(xs)
    keep = set(terms) if terms else None
    m = len(names)

    def solve(batches):
        for pdf in batches:
            out = []
            for _, row in pdf.iterrows():
                M, shifts = moment_matrix(row, m, idx)
                n = int(row["_n"])
                base = {k: row[k] for k in keys}
                if n == 0:
                    continue
                r = ols_from_moments(M, shifts, float(row["_sw"]), alpha, with_se, intercept)
                for t, name in enumerate(term_names):
                    if keep is not None and name not in keep:
                        continue
                    rec = dict(base)
                    rec.update(term=name, estimate=float(r["beta"][t]), n=n, dof=float(r["dof"]))
                    if with_se:
                        rec.update(std_error=float(r["se"][t]), stat=float(r["t"][t]),
                                   p_value=float(r["p"][t]), ci_lower=float(r["ci_lower"][t]),
                                   ci_upper=float(r["ci_upper"][t]))
                    out.append(rec)
            frame = pd.DataFrame(out, columns=[f.name for f in schema.fields])
            yield frame

    return g.mapInPandas(solve, schema)


def ols(df: DataFrame, y: str | Column, xs: dict[str, Column | str] | Sequence[str], keys: Sequence[str] = (),
        weight: Column | str | None = None, alpha: float = 0.05, with_se: bool = True,
        terms: Sequence[str] | None = None, intercept: bool = True) -> DataFrame:
    """Coefficient table of ``y ~ 1 + xs`` (or ``y ~ xs`` without intercept) per group of ``keys``."""
    if not isinstance(xs, dict):
        xs = {x: F.col(x) for x in xs}
    ycol = F.col(y) if isinstance(y, str) else y
    exprs = dict(xs)
    exprs["__y"] = ycol
    g, names = moments(df, exprs, keys, weight, shift=intercept)
    return solve_moments(g, names, "__y", list(xs), keys, alpha, with_se, intercept, terms)


def solve_specs(g: DataFrame, names: list[str], specs: Sequence[tuple[str, str, Sequence[str], str]],
                keys: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Many regressions from one moment table.

    ``specs`` = [(label, y, xs, term), ...]; each emits the ``term`` row of
    ``y ~ 1 + xs`` with a ``label`` column.  Used by the interaction scans so
    every feature's model reads a sub-matrix of a single aggregate.
    """
    pos = {n: i for i, n in enumerate(names)}
    key_fields = [g.schema[k] for k in keys]
    schema = T.StructType(list(key_fields) + [T.StructField("label", T.StringType())] + COEF_SCHEMA_FIELDS)
    m = len(names)
    plan = [(label, [pos[x] for x in xs] + [pos[y]], (["const"] + list(xs)).index(term), term)
            for label, y, xs, term in specs]

    def solve(batches):
        for pdf in batches:
            out = []
            for _, row in pdf.iterrows():
                n = int(row["_n"])
                if n == 0:
                    continue
                for label, idx, t, term in plan:
                    M, shifts = moment_matrix(row, m, idx)
                    r = ols_from_moments(M, shifts, float(row["_sw"]), alpha, True)
                    rec = {k: row[k] for k in keys}
                    rec.update(label=label, term=term, estimate=float(r["beta"][t]),
                               std_error=float(r["se"][t]), stat=float(r["t"][t]), p_value=float(r["p"][t]),
                               ci_lower=float(r["ci_lower"][t]), ci_upper=float(r["ci_upper"][t]),
                               n=n, dof=float(r["dof"]))
                    out.append(rec)
            yield pd.DataFrame(out, columns=[f.name for f in schema.fields])

    return g.mapInPandas(solve, schema)
