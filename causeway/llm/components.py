"""Connected components of a graph given as edges of 64-bit node ids.

Alternating large-star and small-star steps: every round joins the edges with the smallest
neighbour of each node, until each component is a star around its smallest node.  Tasks first contract their own edges with a union-find, so that long
chains and dense groups shrink before anything is shuffled.  No node's neighbours are ever gathered
into a list: the joins' one side has one row per node, so a hub's edges can be split over tasks.  Rounds are
written to the shared folder, in few files.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few_files, write_shared

EDGES_HELD = 500_000


class UnionFind:
    """Smallest member as the root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while (p := up.get(x, x)) != r:
            up[x] = r
            x = p
        return r

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def stars(self):
        nodes = list(self.up)
        return nodes, [self.root(x) for x in nodes]


def contract(batches):
    """Edges of a task as stars of its own components (a bounded number of edges at a time)."""
    def out(uf):
        u, v = uf.stars()
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    uf = UnionFind()
    for batch in batches:
        pairs = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
        for a, b in np.unique(pairs, axis=0).tolist() if len(pairs) else []:
            uf.link(a, b)
        if len(uf.up) >= EDGES_HELD:
            yield out(uf)
            uf = UnionFind()
    if uf.up:
        yield out(uf)


def connected_components(edges: DataFrame, find=None) -> DataFrame:
    """(node, root) for every node that has an edge to another and is not its component's smallest node.

    ``edges`` has columns a, b (longs).  Loops, repeated edges and both directions are allowed; rows
    with a null end are no edges.  A node without a row is its own root.

    With ``find``, ``edges`` holds any rows, whose Arrow batches ``find`` turns into batches of a, b (longs, no nulls).  It runs in the
    worker that contracts what it finds: two Python steps in a row would hold two workers for each task."""
    if find is None:
        pairs = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter(F.col("a") != F.col("b"))
        stars = pairs.mapInArrow(contract, "u long, v long")
    else:
        stars = edges.mapInArrow(lambda batches: contract(find(batches)), "u long, v long")
    now = write_shared(few_files(stars.distinct()), "edges")
    while not _all_stars(now):
        low = now.groupBy("u").agg(F.min("v").alias("m"))
        large = (now.join(low.withColumnRenamed("u", "v"), "v", "left")
                 .select("u", F.coalesce("m", "v").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u")
                 .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
                 .select("e.u", "e.v").filter(F.col("u") != F.col("v")).distinct())
        now = write_shared(few_files(small), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node points to one other node at most, and none that is pointed to points on."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("out")), F.struct(F.col("v").alias("x"), F.lit(0).alias("out"))))
    nodes = edges.select(ends.alias("e")).select("e.x", "e.out").groupBy("x").agg(F.sum("out").alias("s"), F.min("out").alias("m"))
    return not nodes.agg(F.max((F.col("s") > 1) | ((F.col("s") > 0) & (F.col("m") == 0))).alias("bad")).first()["bad"]
