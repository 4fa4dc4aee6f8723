"""Exact top-k search by inner product with multi-resolution segment statistics.

Vectors become integer vectors (floor of ``scale`` times a component).  Over a segment of length l
with means m and deviations s, the squared distance of two vectors is at least
l * ((mq - mv)^2 + (sq - sv)^2); as |q|^2 + |v|^2 - d^2 is twice the inner product, each
segment bounds it from above by l * (mq * mv + sq * sv).  Bounds are computed coarse to fine
(1, 4, 16 segments); only candidates whose bound still reaches a query's k-th best score go on, and
the survivors get their exact integer score.

Queries and candidates meet block by block: candidates are dealt into cells, every cell gets
the blocks of queries, and each cell keeps its k best of each query.  A second step merges the
cells' lists.  A cell's candidates are bounded by the number of cells, never by a key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import grouped_stream, shuffle_width

NULL_ID = np.iinfo(np.int64).max
LEVELS = (1, 4, 16)
SLACK = 1e-6


def integer_vectors(table: DataFrame, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, v (floor(scale * x) as exact doubles) of the vectors that take part."""
    v = F.col(f"`{vec_col}`")
    fine = v.isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return table.filter(fine).select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"),
        F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double")).alias("v"))


def segment_statistics(m: np.ndarray, parts: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(means, deviations, length) for each segment of the rows of ``m``."""
    out = []
    for cols in np.array_split(np.arange(m.shape[1]), min(parts, max(1, m.shape[1]))):
        if len(cols):
            seg = m[:, cols]
            mean = seg.mean(axis=1)
            out.append((mean, np.sqrt(np.maximum((seg * seg).mean(axis=1) - mean * mean, 0)), len(cols)))
    return out


def upper_bounds(q, v) -> np.ndarray:
    total = 0.0
    for (mq, sq, length), (mv, sv, _) in zip(q, v, strict=True):
        total = total + length * (np.outer(mq, mv) + np.outer(sq, sv))
    return total


def exact_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products (rows of q times rows of v); beyond 2^53 by Python integers."""
    big = np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * max(1, q.shape[1])
    if big < 2.0 ** 53:
        return (q @ v.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in q], object) @ np.array([[int(x) for x in r] for r in v], object).T
    lo, hi = -(1 << 63), (1 << 63) - 1
    return np.array([[min(max(int(x), lo), hi) for x in r] for r in exact], np.int64).reshape(len(q), len(v))


class BestOf:
    """The k best (score, smaller id) of each query of a block, over candidate blocks."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, vec_id) ascending
        self.floor = np.full(len(ids), -np.inf)
        self.stats = [segment_statistics(q, n) for n in LEVELS]

    def see(self, ids: np.ndarray, v: np.ndarray, stats) -> None:
        rows = cols = None
        for level, s in enumerate(stats):
            if rows is None:
                bound = upper_bounds(self.stats[level], s)
                bound += SLACK * (1 + np.abs(bound))
                rows, cols = np.nonzero(bound >= self.floor[:, None])
            else:
                bound = np.zeros(len(rows))
                for (mq, sq, n), (mv, sv, _) in zip(self.stats[level], s, strict=True):
                    bound += n * (mq[rows] * mv[cols] + sq[rows] * sv[cols])
                keep = bound + SLACK * (1 + np.abs(bound)) >= self.floor[rows]
                rows, cols = rows[keep], cols[keep]
            if not len(rows):
                return
            if len(rows) > 0.25 * len(self.ids) * len(ids):
                break  # hardly pruned: finer bounds cost more than the exact product
        if len(rows) > 0.05 * len(self.ids) * len(ids):
            scores = exact_scores(self.q, v)[rows, cols]
        else:
            scores = np.concatenate([self._pairs(rows[a:a + 100_000], cols[a:a + 100_000], v) for a in range(0, len(rows), 100_000)])
        keep = (scores >= self.floor[rows]) & (ids[cols] != self.ids[rows])
        rows, cols, scores = rows[keep], cols[keep], scores[keep]
        order = np.lexsort((ids[cols], -scores, rows))
        rows, cols, scores = rows[order], cols[order], scores[order]
        first = np.searchsorted(rows, rows, "left")
        top = np.arange(len(rows)) - first < self.k
        for r, i, s in zip(rows[top].tolist(), ids[cols[top]].tolist(), scores[top].tolist(), strict=True):
            self.best[r].append((-s, i))
        for r in np.unique(rows).tolist():
            self.best[r] = sorted(self.best[r])[:self.k]
            if len(self.best[r]) == self.k:
                self.floor[r] = -self.best[r][-1][0]

    def _pairs(self, rows, cols, v) -> np.ndarray:
        q, v = self.q[rows], v[cols]
        if np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * max(1, q.shape[1]) < 2.0 ** 53:
            return np.einsum("ij,ij->i", q, v).astype(np.int64)
        return np.array([exact_scores(q[i:i + 1], v[i:i + 1])[0, 0] for i in range(len(q))], np.int64)

    def rows(self):
        for i, best in zip(self.ids.tolist(), self.best, strict=True):
            for s, v in best:
                yield i, v, -s


def _blocks(size: int):
    """Rows (cell, dim, vec_id, v) -> blocks of one cell and dimension as binary matrices."""
    def run(batches):
        held: dict = {}

        def block(key):
            ids, vs = held.pop(key)
            return {"cell": key[0], "dim": key[1], "n": len(ids), "ids": np.asarray(ids, np.int64).tobytes(),
                    "m": np.asarray(vs, np.float64).reshape(len(ids), key[1]).tobytes()}

        fields = pa.schema([("cell", pa.int32()), ("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("m", pa.binary())])
        for batch in batches:
            out = []
            cols = [batch.column(c).to_pylist() for c in ("cell", "vec_id", "v")]
            for cell, i, v in zip(*cols, strict=True):
                key = (cell, len(v))
                ids, vs = held.setdefault(key, ([], []))
                ids.append(NULL_ID if i is None else i)
                vs.append(v)
                if len(ids) == size:
                    out.append(block(key))
            if out:
                yield pa.RecordBatch.from_pylist(out, fields)
        if held:
            yield pa.RecordBatch.from_pylist([block(k) for k in list(held)], fields)

    return run


def _search(k: int):
    def matrix(n, dim, ids, m):
        return np.frombuffer(ids, np.int64), np.frombuffer(m, np.float64).reshape(n, dim)

    def run(batches):
        columns = ["kind", "n", "dim", "ids", "m"]
        for _, g in grouped_stream(batches, "cell", columns):
            queries: dict = {}
            rest = []
            for kind, n, dim, ids, m in zip(*[g[c] for c in columns], strict=True):
                if kind == 0:
                    i, q = matrix(n, dim, ids, m)
                    queries.setdefault(dim, []).append(BestOf(i, q, k))
                else:
                    rest.append((n, dim, ids, m))
            for n, dim, ids, m in rest:
                if dim in queries:
                    i, v = matrix(n, dim, ids, m)
                    stats = [segment_statistics(v, p) for p in LEVELS]
                    for b in queries[dim]:
                        b.see(i, v, stats)
            found = [r for bs in queries.values() for b in bs for r in b.rows()]
            if found:
                q, v, s = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.int64())],
                                                 ["query_id", "vec_id", "score"])

    return run


def top_k(table: DataFrame, is_query, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding",
          block: int = 1024, group_queries: int = 50_000, cells: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest inner products of every query row.

    * vectors null or with a null or non-finite component take no part; empty vectors score 0;
    * vectors meet those of their own length; a row with the query's own id is no candidate;
    * ties go to the smaller id (null ids last); fewer candidates give fewer rows;
    * an empty table gives an empty result; other columns are ignored; scores beyond a long saturate.

    ``cells`` deals the candidates (default: the shuffle partitions); queries come in groups of about
    ``group_queries``, and a task holds one cell of candidates and one group of queries."""
    spark = table.sparkSession
    cells = cells or shuffle_width(spark)
    vectors = integer_vectors(table, scale, id_col, vec_col)
    groups = -(-max(1, vectors.filter(is_query).count()) // group_queries)
    fields = "cell int, dim int, n int, ids binary, m binary"
    place = F.xxhash64("vec_id", "v")
    cand = vectors.select(F.pmod(place, F.lit(cells)).cast("int").alias("cell"), "vec_id", "v").mapInArrow(_blocks(block), fields)
    query = (vectors.filter(is_query).select(F.pmod(place, F.lit(groups)).cast("int").alias("cell"), "vec_id", "v")
             .mapInArrow(_blocks(block), fields))
    if groups > 1:
        cand = cand.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    else:
        cand = cand.withColumn("g", F.lit(0))
    both = (query.withColumnRenamed("cell", "g").withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
            .select((F.col("g") * cells + F.col("cell")).cast("int").alias("cell"), F.lit(0).alias("kind"), "n", "dim", "ids", "m")
            .unionByName(cand.select((F.col("g") * cells + F.col("cell")).cast("int").alias("cell"), F.lit(1).alias("kind"),
                                     "n", "dim", "ids", "m")))
    found = (both.repartition(cells * groups, "cell").sortWithinPartitions("cell", "kind")
             .mapInArrow(_search(k), "query_id long, vec_id long, score long"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)
            .select("query_id", "rank", F.when(F.col("vec_id") != F.lit(int(NULL_ID)), F.col("vec_id")).alias("vec_id"), "score"))


def brute_top_k(rows: list[tuple], queries: set, k: int = 5, scale: int = 256) -> pd.DataFrame:
    """Plain version for tests: (vec_id, vector) rows, ids unique."""
    good = [(i, [int(np.floor(np.float64(x) * scale)) for x in v]) for i, v in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in good:
        if i in queries:
            s = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in good if j != i and len(v) == len(q))[:k]
            out += [(i, r + 1, j, -neg) for r, (neg, j) in enumerate(s)]
    return pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])
