"""Forests grown from per-tree cell sums (EST7 to EST10, HTE5).

Rows are read once.  Each row takes part in tree r with its Poisson(1) weight of replicate r, so a forest is one grouped aggregate of
weights and weighted sums by (tree, feature cell), which tasks add up for chunks of rows before anything is shuffled; a tree is then grown by key from its own cells, level by level and to any
depth, without going back to rows.  A feature with more than ``bins`` different values is cut at exact quantiles; others keep every value.
Cells that a tree's sample lacks travel with the rest and end in a leaf, so every tree predicts every cell.  A task holds the
cells of one tree (at most the product of the features' bins); the rows are spread over all tasks however often a cell occurs.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import LOW_BITS, STREAMS, grouped_quantiles, one_row, poisson1_cdf, row_seed
from ..functions.dist import norm_cdf
from ..session import written

BINS, TREES = 256, 100
TREES_AT_ONCE = 10  # trees whose sums are columns of one aggregate row
#: Little bags (causal forest): trees a bag, share of the rows in a bag, share of a bag's rows in each half of a tree.
BAG_TREES, BAG_SHARE, HALF_SHARE = 4, 0.5, 0.45


# A tree ---------------------------------------------------------------------------------------------

def grow(values: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, tries: int | None = None, rng=None, least: float = 0.0,
         least_share: float = 0.0, other_n: np.ndarray | None = None, decay=None) -> tuple[np.ndarray, np.ndarray]:
    """(leaf of each cell, importance of each feature) of one tree over cells with ``values`` (cells x features).

    A node with sums A, B has the effect B / A; a cut is judged by the children's sums of b - a * B / A, squared and
    divided by their n (with a = n that is the reduction of variance).  A node is split until its cells agree or no cut leaves ``least`` of n
    (and of ``other_n``) and ``least_share`` of the node on either side.  ``tries`` features, of those that can be cut, are judged a node.
    Cuts lie half way between values present in the node; ties go to the first feature and the lowest cut."""
    cells, p = values.shape
    uniques, codes = zip(*[np.unique(values[:, j], return_inverse=True) for j in range(p)], strict=True)
    leaf, importance = np.zeros(cells, np.int64), np.zeros(p)
    open_, node, leaves, depth = np.arange(cells), np.zeros(cells, np.int64), 0, 0
    while len(open_):
        k = int(node.max()) + 1
        total_n, total_a, total_b = (np.bincount(node, x[open_], k) for x in (n, a, b))
        effect = np.divide(total_b, total_a, out=np.zeros(k), where=total_a > 0)
        other = np.bincount(node, other_n[open_], k) if other_n is not None else None
        there = n[open_] > 0
        at, in_node = open_[there], node[there]
        moment = b[at] - effect[in_node] * a[at]
        scale = np.bincount(in_node, np.abs(b[at]), k)
        mixed = np.zeros(k, bool)
        mixed[in_node[np.abs(moment) > 1e-9 * scale[in_node]]] = True
        gain, cut = np.full((k, p), -np.inf), np.zeros((k, p))
        slack = 1e-10 * np.bincount(in_node, moment ** 2 / n[at], k)  # gains that differ by less are ties
        for j in range(p):
            _cuts_of(uniques[j], codes[j][at], in_node, n[at], moment, total_n, slack, gain[:, j], cut[:, j], least, least_share,
                     None if other is None else (codes[j][open_], node, other_n[open_], other))
        if tries is not None and tries < p:
            order = np.where(np.isfinite(gain), rng.random((k, p)), 2.0).argsort(axis=1).argsort(axis=1)
            gain[order >= tries] = -np.inf
        best = (gain >= gain.max(axis=1, keepdims=True) - slack[:, None]).argmax(axis=1)
        found = gain[np.arange(k), best]
        split = mixed & np.isfinite(found)
        weight = 1.0 if decay is None else decay(depth)
        np.add.at(importance, best[split], weight * found[split])
        closed = ~split[node]
        number = np.cumsum(~split) - 1
        leaf[open_[closed]] = leaves + number[node[closed]]
        leaves += int((~split).sum())
        open_, node = open_[~closed], node[~closed]
        right = values[open_, best[node]] > cut[node, best[node]]
        node = 2 * (np.cumsum(split) - 1)[node] + right
        depth += 1
    return leaf, importance


def _cuts_of(unique, code, node, n, moment, total_n, slack, gain, cut, least, least_share, passengers):
    """Best gain and cut of one feature in every node (into ``gain`` and ``cut``)."""
    if not len(code):
        return
    width = len(unique) + 1
    key = node * width + code
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    group_node, low = node[order][first], unique[code[order][first]]
    high = np.concatenate([low[1:], low[-1:]])
    between = np.where(np.isinf(high), low, low + (high - low) / 2)
    group_n, group_m = np.add.reduceat(n[order], first), np.add.reduceat(moment[order], first)
    begins = np.flatnonzero(np.concatenate([[True], group_node[1:] != group_node[:-1]]))
    rank = np.cumsum(np.concatenate([[0], (group_node[1:] != group_node[:-1]).astype(np.int64)]))

    def running(x):
        sums = np.cumsum(x)
        return sums - (sums[begins] - x[begins])[rank]

    left_n, left_m = running(group_n), running(group_m)
    total_m = np.add.reduceat(group_m, begins)[rank]
    right_n, right_m = total_n[group_node] - left_n, total_m - left_m
    last = np.concatenate([group_node[1:] != group_node[:-1], [True]])
    floor = np.maximum(least, least_share * total_n[group_node])
    good = ~last & (left_n >= floor) & (right_n >= floor) & (left_n > 0) & (right_n > 0)
    if passengers is not None:  # the half that fills the leaves must leave as much on either side
        their_code, their_node, their_n, their_total = passengers
        their_key = their_node * width + their_code
        by = np.argsort(their_key, kind="stable")
        sums = np.concatenate([[0.0], np.cumsum(their_n[by])])
        upto_code = np.searchsorted(unique, between, "right") - 1
        upto = (sums[np.searchsorted(their_key[by], group_node * width + upto_code, "right")]
                - sums[np.searchsorted(their_key[by], group_node * width, "left")])
        floor = np.maximum(least, least_share * their_total[group_node])
        good &= (upto >= floor) & (their_total[group_node] - upto >= floor)
    if not good.any():
        return
    with np.errstate(divide="ignore", invalid="ignore"):
        gains = np.where(good, left_m ** 2 / left_n + right_m ** 2 / right_n - total_m ** 2 / total_n[group_node], -np.inf)
    top = np.maximum.reduceat(gains, begins)
    hit = np.flatnonzero(good & (gains >= top[rank] - slack[group_node]))
    nodes, where = np.unique(group_node[hit], return_index=True)
    hit = hit[where]
    gain[nodes], cut[nodes] = gains[hit], between[hit]


def leaf_means(leaf: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """B / A of each cell's leaf (NaN where a leaf has no weight)."""
    top, bottom = np.bincount(leaf, b), np.bincount(leaf, a)
    return np.divide(top, bottom, out=np.full(len(top), np.nan), where=bottom > 0)[leaf]


# Cells ----------------------------------------------------------------------------------------------

def with_cells(df: DataFrame, features: Sequence[str], bins: int = BINS) -> tuple[DataFrame, list[str]]:
    """``df`` with a column ``_x<i>`` for each feature, and their names: the value itself, or the number of its quantile bin where the
    feature has more than about ``bins`` values.  Null and NaN count as the largest value."""
    if bins < 2:
        raise ValueError("bins must be at least 2")
    features = list(features)
    values = [F.col(f).cast("double") for f in features]
    some = one_row(df.agg(*[F.approx_count_distinct(v, 0.01).alias(f"d{i}") for i, v in enumerate(values)]))
    many = [i for i in range(len(features)) if (some[f"d{i}"] or 0) > bins]
    cuts = {}
    if many:
        long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), values[i].alias("v")) for i in many])).alias("s")).select("s.*")
        for r in grouped_quantiles(long, ["i"], "v", [k / bins for k in range(1, bins)]).collect():  # a row a feature
            cuts[r["i"]] = sorted(set(r["q"]))
    out, names = df, [f"_x{i}" for i in range(len(features))]
    for i, v in enumerate(values):
        invalid = v.isNull() | F.isnan(v)
        if i in cuts:
            from pyspark.ml.feature import Bucketizer
            raw = f"_raw{i}"
            out = out.withColumn(raw, F.when(~invalid, v).otherwise(0.0))
            out = Bucketizer(splits=[-float("inf"), *cuts[i], float("inf")], inputCol=raw, outputCol=names[i]).transform(out).drop(raw)
            v = F.col(names[i])
        out = out.withColumn(names[i], F.when(invalid, float("inf")).otherwise(v))
    return out, names


def tree_sums(rows: DataFrame, xs: Sequence[str], keys: Sequence[str], targets: Sequence[str], trees: int = TREES, seed: int = 42,
              weight: str | None = None, unit_weights: bool = False, deal: bool = True) -> DataFrame:
    """_tree, xs, keys, _n, targets: Poisson-weighted count and sums of every cell in every tree.

    ``rows`` have an ``_id``; ``weight`` multiplies the draws, ``unit_weights`` replaces them by 1; ``deal`` lays the rows out first."""
    cells, blocks, at_once = [*xs, *keys], -(-trees // TREES_AT_ONCE), TREES_AT_ONCE
    base = rows.select("_id", *cells, *[F.col(t).cast("double").alias(t) for t in targets], *([F.col(weight).cast("double").alias("_v")] if weight else []))
    base = (dealt(base, cells) if deal else base).withColumn("_seed", row_seed(F.col("_id"), F.lit(seed), F.lit("tree"))).drop("_id")
    names = [f"_s{j}_{k}" for j in range(at_once) for k in range(1 + len(targets))]

    def draw(frames):
        for f in _chunks(frames):
            code, heads = _coded(f, cells)
            stream, v = Streams(f["_seed"].to_numpy()), f["_v"].to_numpy() if weight else 1.0
            for block in range(blocks):
                columns = {"_block": block}
                for j in range(at_once):
                    w = np.full(len(f), 1.0) if unit_weights else stream.poisson1()
                    w = w * v
                    for k, t in enumerate([None, *targets]):
                        columns[f"_s{j}_{k}"] = np.bincount(code, w if t is None else w * f[t].to_numpy(), len(heads))
                yield heads.assign(**columns)

    per = base.mapInPandas(draw, _fields(base, cells) + "_block int, " + ", ".join(f"{n} double" for n in names))
    per = per.groupBy("_block", *cells).agg(*[F.sum(n).alias(n) for n in names])
    tree = lambda j: F.struct((F.col("_block") * at_once + j + 1).alias("_tree"), *[F.col(f"_s{j}_{k}").alias(n) for k, n in enumerate(["_n", *targets])])
    return per.select(*cells, F.explode(F.array(*[tree(j) for j in range(at_once)])).alias("s")).select("s.*", *cells).filter(F.col("_tree") <= trees)


class Streams:
    """The rows' replicate streams (:func:`row_seed`), one uniform a row at a time: what ``explode_replicates`` gives, without the rows."""

    def __init__(self, seed: np.ndarray):
        self.x = [seed.astype(np.int64) // LOW_BITS, seed.astype(np.int64) % LOW_BITS]

    def uniform(self) -> np.ndarray:
        self.x = [x * a % m for x, (m, a) in zip(self.x, STREAMS, strict=True)]
        top = STREAMS[0][0]
        z = (self.x[0] - self.x[1]) % (top - 1)
        return np.where(z == 0, top - 1, z) / float(top)

    def poisson1(self) -> np.ndarray:
        return np.searchsorted(poisson1_cdf(), self.uniform(), "right").astype(float)


def dealt(rows: DataFrame, cells: Sequence[str]) -> DataFrame:
    """Rows dealt out to all tasks by cell, however few files they lie in: a task meets some of the cells, and a frequent cell is split over
    a quarter of the tasks (by id)."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.repartition(n, *cells, F.pmod(F.xxhash64("_id"), F.lit(max(1, n // 4))))


def _chunks(frames, rows: int = 100_000):
    """Frames of about ``rows`` rows: a chunk's cells are what its sums are kept for."""
    held, n = [], 0
    for f in frames:
        held.append(f)
        n += len(f)
        if n >= rows:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


def _coded(f: pd.DataFrame, cells: list[str]) -> tuple[np.ndarray, pd.DataFrame]:
    """(number of each row's cell, the cells in the order of these numbers)."""
    if not cells:
        return np.zeros(len(f), np.int64), pd.DataFrame(index=range(1))
    return f.groupby(cells, sort=False, dropna=False).ngroup().to_numpy(), f[cells].drop_duplicates().reset_index(drop=True)


def _cells_of(group: pd.DataFrame, xs: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct cells in a fixed order, the cell number of each row)."""
    cells, at = np.unique(group[list(xs)].to_numpy(float), axis=0, return_inverse=True)
    return cells, at.reshape(-1)


def _fields(df: DataFrame, names: Sequence[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in names)


def predictions(sums: DataFrame, xs: Sequence[str], fits: dict, seed: int = 42, extra: Sequence[float] | None = None,
                by: Sequence[str] = ()) -> DataFrame:
    """by, xs and a column for each fit: the forest's mean prediction in every cell; a forest for every value of ``by``.

    ``fits``: name -> (condition on the rows, target, tries): the trees of a fit learn the target's mean from the rows of ``sums`` that fulfil
    the condition (a pandas query, or None), judging ``tries(p)`` features a node.  With ``extra`` the last of the features is
    a treatment: a cell is predicted at each of these values of it, in columns ``<name>_<k>``."""
    by = list(by)
    inner = list(xs) if extra is None else list(xs)[:-1]
    names = list(fits) if extra is None else [f"{f}_{k}" for f in fits for k in range(len(extra))]

    def one_tree(group: pd.DataFrame) -> pd.DataFrame:
        tree, keys = int(group["_tree"].iloc[0]), {k: group[k].iloc[0] for k in by}
        group = group[[c for c in group.columns if c not in by]].reset_index(drop=True)
        if extra is not None:  # every cell at every value of the treatment takes a place in the tree
            base = _cells_of(group, inner)[0]
            more = pd.DataFrame(np.column_stack([np.repeat(base, len(extra), axis=0), np.tile(extra, len(base))]), columns=list(xs))
            group = pd.concat([group, more], ignore_index=True).fillna(0.0)
        cells, at = _cells_of(group, xs)
        out = {}
        for number, (name, (condition, target, tries)) in enumerate(fits.items()):
            rows = np.ones(len(group), bool) if condition is None else group.eval(condition).to_numpy(bool)
            n = np.bincount(at[rows], group["_n"].to_numpy(float)[rows], len(cells))
            b = np.bincount(at[rows], group[target].to_numpy(float)[rows], len(cells))
            leaf, _ = grow(cells, n, n, b, tries and tries(len(xs)), np.random.default_rng([seed, tree, number]))
            out[name] = leaf_means(leaf, n, b)
        if extra is None:
            frame = pd.DataFrame(np.column_stack([cells, *out.values()]), columns=[*xs, *names])
        else:
            base, where = np.unique(cells[:, :-1], axis=0, return_inverse=True)
            columns = []
            for f in fits:
                for v in extra:
                    hit = cells[:, -1] == v
                    mean = np.full(len(base), np.nan)
                    mean[where.reshape(-1)[hit]] = out[f][hit]
                    columns.append(mean)
            frame = pd.DataFrame(np.column_stack([base, *columns]), columns=[*inner, *names])
        for k in reversed(by):
            frame.insert(0, k, keys[k])
        return frame

    schema = _fields(sums, by) + ", ".join(f"`{c}` double" for c in [*inner, *names])
    trees = sums.groupBy(*by, "_tree").applyInPandas(one_tree, schema)
    return trees.groupBy(*by, *inner).agg(*[F.avg(F.nanvl(F.col(c), F.lit(None).cast("double"))).alias(c) for c in names])


def root_of(p: int) -> int:
    """Features a node of a classification forest: the root of their number."""
    return max(1, int(p ** 0.5))


# The tables below take rows with _id, _t, _y, the cells xs and the columns ``by``; ``weight`` is a column of frequencies.

def arm_table(rows: DataFrame, xs: Sequence[str], by: Sequence[str] = (), binary: bool = False, trees: int = TREES, seed: int = 42,
              weight: str | None = None, unit_weights: bool = False) -> DataFrame:
    """by, xs, _mu0, _mu1: one forest an arm (T-learner); one aggregate serves both."""
    sums = tree_sums(rows.filter(F.col("_t").isin(0.0, 1.0) & F.col("_y").isNotNull()), xs, [*by, "_t"], ["_y"], trees, seed, weight, unit_weights)
    tries = root_of if binary else None
    return predictions(sums, xs, {"_mu0": ("_t == 0", "_y", tries), "_mu1": ("_t == 1", "_y", tries)}, seed, by=by)


def treated_table(rows: DataFrame, xs: Sequence[str], by: Sequence[str] = (), binary: bool = False, trees: int = TREES, seed: int = 42,
                  weight: str | None = None) -> DataFrame:
    """by, xs, _mu0, _mu1: one forest over cells and treatment, asked at treatment 0 and 1 (S-learner)."""
    sums = tree_sums(rows.filter(F.col("_t").isNotNull() & F.col("_y").isNotNull()), [*xs, "_t"], by, ["_y"], trees, seed, weight)
    return predictions(sums, [*xs, "_t"], {"_mu": (None, "_y", root_of if binary else None)}, seed, (0.0, 1.0), by).withColumnsRenamed(
        {"_mu_0": "_mu0", "_mu_1": "_mu1"})


def with_nuisances(rows: DataFrame, xs: Sequence[str], by: Sequence[str] = (), k: int = 3, binary: bool = False, trees: int = TREES,
                   seed: int = 42, weight: str | None = None, deal: bool = True) -> DataFrame:
    """``rows`` (with _fold) with _m and _e: forest predictions of outcome and treatment learnt from the other folds.

    One aggregate by (tree, cell, fold) serves all folds and both targets; the table of predictions by cell is written."""
    doubled = rows.withColumn("_tt", F.col("_t"))
    sums = tree_sums(doubled, xs, [*by, "_fold"], ["_y", "_tt"], trees, seed, weight, deal=deal)
    fits = {}
    for f in range(k):
        fits[f"_m{f}"] = (f"_fold != {f}", "_y", root_of if binary else None)
        fits[f"_e{f}"] = (f"_fold != {f}", "_tt", root_of)
    means = written(predictions(sums, xs, fits, seed, by=by), "nuisances")
    joined = rows.join(means, [*by, *xs], "left")
    return joined.select(*[F.col(c) for c in rows.columns], F.array(*[f"_m{f}" for f in range(k)])[F.col("_fold")].alias("_m"),
                         F.array(*[f"_e{f}" for f in range(k)])[F.col("_fold")].alias("_e"))


# Causal forest --------------------------------------------------------------------------------------

def bag_sums(rows: DataFrame, xs: Sequence[str], by: Sequence[str] = (), trees: int = TREES, seed: int = 42, weight: str | None = None,
             deal: bool = True) -> DataFrame:
    """by, _bag, _tree, xs, and n, a = sum t~^2, b = sum t~ y~ of either half (_n0, _a0, _b0 for the splits, _n1, _a1, _b1 for the leaves).

    ``rows`` have _id, _tt, _yt.  A bag is half of the rows; each of its trees takes 45 % of the bag for the splits and other 45 % for the
    leaves.  Every cell is there in every tree, with zeros where the tree has none of its rows."""
    bags = max(1, trees // BAG_TREES)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    cells = [*by, *xs]
    base = rows.select("_id", *cells, w.alias("_n"), (w * F.col("_tt") * F.col("_tt")).alias("_a"), (w * F.col("_tt") * F.col("_yt")).alias("_b"))
    base = (dealt(base, cells) if deal else base).withColumn("_seed", row_seed(F.col("_id"), F.lit(seed), F.lit("bag"))).drop("_id")
    sums = [f"{c}{h}" for h in (0, 1) for c in ("_n", "_a", "_b")]
    names = [f"_s{j}{n}" for j in range(BAG_TREES) for n in sums]

    def draw(frames):
        for f in _chunks(frames):
            code, heads = _coded(f, cells)
            stream, values = Streams(f["_seed"].to_numpy()), {c: f[c].to_numpy(float) for c in ("_n", "_a", "_b")}
            for bag in range(1, bags + 1):
                inside, columns = stream.uniform() < BAG_SHARE, {"_bag": bag}
                for j in range(BAG_TREES):
                    u = stream.uniform()
                    for h in (0, 1):
                        at = np.flatnonzero(inside & (u >= h * HALF_SHARE) & (u < (h + 1) * HALF_SHARE))
                        for c, x in values.items():
                            columns[f"_s{j}{c}{h}"] = np.bincount(code[at], x[at], len(heads))
                yield heads.assign(**columns)

    per = base.mapInPandas(draw, _fields(base, cells) + "_bag int, " + ", ".join(f"{n} double" for n in names))
    per = per.groupBy("_bag", *cells).agg(*[F.sum(n).alias(n) for n in names])
    tree = lambda j: F.struct(F.lit(j).alias("_tree"), *[F.col(f"_s{j}{n}").alias(n) for n in sums])
    return per.select(*by, "_bag", *xs, F.explode(F.array(*[tree(j) for j in range(BAG_TREES)])).alias("s")).select(*by, "_bag", "s.*", *xs)


def honest_trees(sums: DataFrame, xs: Sequence[str], by: Sequence[str] = (), least: int = 5, least_share: float = 0.05) -> DataFrame:
    """by, _bag, _tree, xs, _a, _b (its leaf's mean moments for each cell of each tree) and importance (on one row a tree).

    Splits come from one half of a tree's rows, by the gradient of the local moment t~ (y~ - effect t~); the moments of a leaf from the
    other.  A feature's importance adds its gains, divided by (1 + depth)^2, to depth 4."""
    by = list(by)

    def one_tree(group: pd.DataFrame) -> pd.DataFrame:
        cells, at = _cells_of(group, xs)
        col = {c: np.bincount(at, group[c].to_numpy(float), len(cells)) for c in ("_n0", "_a0", "_b0", "_n1", "_a1", "_b1")}
        leaf, importance = grow(cells, col["_n0"], col["_a0"], col["_b0"], None, None, least, least_share, col["_n1"],
                                lambda depth: 1.0 / (1 + depth) ** 2 if depth < 4 else 0.0)
        out = pd.DataFrame(cells, columns=list(xs))
        for k in reversed([*by, "_bag", "_tree"]):
            out.insert(0, k, group[k].iloc[0])
        out["_a"], out["_b"] = leaf_means(leaf, col["_n1"], col["_a1"]), leaf_means(leaf, col["_n1"], col["_b1"])
        total = importance.sum()
        out["importance"] = [(importance / total if total > 0 else importance).tolist()] + [None] * (len(cells) - 1)
        return out

    schema = _fields(sums, by) + "_bag int, _tree int, " + ", ".join(f"`{x}` double" for x in xs) + ", _a double, _b double, importance array<double>"
    return sums.groupBy(*by, "_bag", "_tree").applyInPandas(one_tree, schema)


def forest_effects(trees: DataFrame, xs: Sequence[str], name: str, by: Sequence[str] = ()) -> DataFrame:
    """by, xs, ``name`` and ``<name>_se``: effect of each cell (its mean b over its mean a) and its standard error from the little bags.

    The variance between bags of b - effect * a, less what trees of one bag differ by, kept positive by the posterior mean of a
    flat prior on positive values; divided by the mean of a squared."""
    known = trees.filter(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    inner, xs = list(xs), [*by, *xs]
    bags = known.groupBy(*xs, "_bag").agg(F.count(F.lit(1)).alias("k"), *[F.sum(e).alias(c) for c, e in {
        "a": F.col("_a"), "b": F.col("_b"), "aa": F.col("_a") * F.col("_a"), "ab": F.col("_a") * F.col("_b"), "bb": F.col("_b") * F.col("_b")}.items()])
    per = bags.groupBy(*xs).agg(F.sum("k").alias("k"), F.count(F.lit(1)).alias("bags"), F.sum("a").alias("a"), F.sum("b").alias("b"),
                                *[F.sum(c).alias(c) for c in ("aa", "ab", "bb")],
                                *[F.sum(e).alias(c) for c, e in {"maa": F.pow(F.col("a") / F.col("k"), 2), "mab": F.col("a") * F.col("b") / F.pow(F.col("k"), 2),
                                                                 "mbb": F.pow(F.col("b") / F.col("k"), 2)}.items()])
    theta = F.try_divide("b", "a")
    per = per.withColumn(name, theta)

    def quadratic(bb, ab, aa):
        return F.col(bb) - 2 * F.col(name) * F.col(ab) + F.col(name) * F.col(name) * F.col(aa)

    between = quadratic("mbb", "mab", "maa") / F.col("bags")
    noise = (quadratic("bb", "ab", "aa") / F.col("k") - between) / F.greatest(F.col("k") / F.col("bags") - 1, F.lit(1.0))
    per = per.select(*xs, name, between.alias("between"), F.greatest(noise, F.lit(0.0)).alias("noise"), "bags", (F.col("a") / F.col("k")).alias("mean_a"))

    def errors(frames):
        for f in frames:
            first = (f["between"] - f["noise"]).to_numpy(float)
            spread = np.maximum(f["between"], f["noise"]).to_numpy(float) * np.sqrt(2.0 / f["bags"].to_numpy(float))
            ratio = np.divide(first, spread, out=np.zeros(len(f)), where=spread > 0)
            mills = np.array([np.exp(-0.5 * r * r) / np.sqrt(2 * np.pi) / max(norm_cdf(r), 1e-300) if r > -30 else -r for r in ratio])
            f[f"{name}_se"] = np.sqrt(np.maximum(first + spread * mills, 0.0)) / f["mean_a"].to_numpy(float)
            yield f[[*xs, name, f"{name}_se"]]

    schema = _fields(trees, by) + ", ".join(f"`{c}` double" for c in [*inner, name, f"{name}_se"])
    return per.mapInPandas(errors, schema)
