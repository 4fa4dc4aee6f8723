"""Resharding by minimum-cost flow.

Given the shard every row is in now and the capacities wanted, a minimum-cost flow says how many
bytes go from each old shard to each new one so that the fewest bytes move.  Rows are gathered
into blocks by a hash of the row; the flow's amounts become whole blocks, and where an amount ends inside a
block, that block is cut at a hash value found by a running sum over it.  The plan is a bounded table of
hash intervals, so any scan of the rows can apply it without a shuffle.

Rows are placed in size classes, from large to small: each class is solved against the capacity that is
really left, so the rounding of a class to whole rows is made good by the smaller rows after it.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import write_shared

BLOCKS = 256
CLASSES = 13
SLOT_BLOCKS = 1024
TOP = (1 << 63) - 1


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Flow {(i, j): amount} that ships all supply within the capacities at the least total cost (None: no arc).

    Successive shortest paths over the bipartite graph of old and new shards (Bellman-Ford on the residual)."""
    n, m = len(supply), len(capacity)
    flow: dict[tuple[int, int], int] = defaultdict(int)
    left, room = list(supply), list(capacity)
    price = [[cost(i, j) for j in range(m)] for i in range(n)]
    arcs = [(i, j) for i in range(n) for j in range(m) if price[i][j] is not None]
    while any(left):
        dist = [0 if left[i] else None for i in range(n)] + [None] * m
        back: list = [None] * (n + m)
        changed = True
        while changed:
            changed = False
            for i, j in arcs:
                if dist[i] is not None and (dist[n + j] is None or dist[i] + price[i][j] < dist[n + j]):
                    dist[n + j], back[n + j], changed = dist[i] + price[i][j], i, True
                if flow[i, j] and dist[n + j] is not None and (dist[i] is None or dist[n + j] - price[i][j] < dist[i]):
                    dist[i], back[i], changed = dist[n + j] - price[i][j], n + j, True
        ends = [j for j in range(m) if room[j] and dist[n + j] is not None]
        if not ends:
            raise ValueError("capacities are smaller than the rows")
        end = min(ends, key=lambda j: (dist[n + j], j))
        path, node = [], n + end
        while back[node] is not None:
            path.append((back[node], node))
            node = back[node]
        amount = min(left[node], room[end], *(flow[b, a - n] for a, b in path if a >= n), left[node])
        for a, b in path:
            if a < n:
                flow[a, b - n] += amount
            else:
                flow[b, a - n] -= amount
        left[node] -= amount
        room[end] -= amount
    return {k: v for k, v in flow.items() if v}


def _merged(flow: dict, n: int) -> dict:
    out: dict = defaultdict(int)
    for (i, j), amount in flow.items():
        out[i, j % n] += amount
    return dict(out)


def _level(room: list[int], wanted: int) -> list[int]:
    """Lower all room by one amount (not below 0) until just ``wanted`` is left, so that bytes which
    rounding put over one capacity are missing evenly from the others."""
    lo, hi = 0, max(room)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if sum(max(0, r - mid) for r in room) >= wanted else (lo, mid - 1)
    return [max(0, r - lo) for r in room]


def _size_class(size: Column, share: float) -> Column:
    """0 for rows of at least half a shard, one more for each halving, the last for all smaller."""
    out = F.lit(CLASSES - 1)
    for k in range(CLASSES - 2, -1, -1):
        out = F.when(size >= F.lit(share / 2 ** (k + 1)), k).otherwise(out)
    return out.cast("int")


def _block(h: Column, blocks: int) -> Column:
    return F.shiftrightunsigned(h.bitwiseXOR(F.lit(-(1 << 63))), 64 - (blocks.bit_length() - 1)).cast("int")


def solve(rows: DataFrame, n_new: int, capacities: list[int] | None = None, cost=None) -> DataFrame:
    """``rows`` (old int, size long, h long) with their new ``shard``.  See :func:`reshard`."""
    return placed(rows, *plan_of(rows, n_new, capacities, cost))


def placed(rows: DataFrame, table: DataFrame, share: float) -> DataFrame:
    """``rows`` (old, size, h, ...) with the ``shard`` that a plan gives them, without a shuffle."""
    keyed = rows.withColumns({"class": _size_class(F.col("size"), share), "block": _block(F.col("h"), BLOCKS)})
    # at most CLASSES * BLOCKS * old shards rows and a few cuts: bounded, whatever the data
    found = keyed.join(F.broadcast(table), ["class", "old", "block"])
    return found.withColumn("shard", F.filter("cuts", lambda c: F.col("h") <= c["hi"])[0]["shard"]).drop("cuts", "class", "block")


def plan_of(rows: DataFrame, n_new: int, capacities: list[int] | None = None, cost=None) -> tuple[DataFrame, float]:
    """(table of hash intervals and their new shards, bytes of an average shard) for ``rows`` (old, size, h)."""
    spark = rows.sparkSession
    cost = cost or (lambda i, j: int(i != j))
    totals = {r["old"]: int(r["s"]) for r in rows.groupBy("old").agg(F.sum("size").alias("s")).collect()}
    olds = sorted(totals)
    total = sum(totals.values())
    if capacities is None:
        capacities = [total // n_new + (j < total % n_new) for j in range(n_new)]
    if sum(capacities) < total:
        raise ValueError("capacities are smaller than the rows")
    share = max(1.0, total / n_new)
    rows = rows.withColumns({"class": _size_class(F.col("size"), share), "block": _block(F.col("h"), BLOCKS)})
    blocks = defaultdict(dict)
    for r in rows.groupBy("class", "old", "block").agg(F.sum("size").alias("s")).collect():
        blocks[r["class"]][r["old"], r["block"]] = int(r["s"])
    filled, plan = [0] * n_new, []
    for k in sorted(blocks):
        supply = [sum(s for (o, _), s in blocks[k].items() if o == old) for old in olds]
        room = _level([c - f for c, f in zip(capacities, filled, strict=True)], sum(map(sum, (blocks[c].values() for c in blocks if c >= k))))
        rest = {old: sum(s for c in blocks if c >= k for (o, _), s in blocks[c].items() if o == old) for old in olds}
        own = [min(r, rest.get(j, 0)) for j, r in enumerate(room)]  # kept free for a shard's own rows of this and later classes
        flow = _merged(min_cost_flow(supply, own + [r - o for r, o in zip(room, own, strict=True)],
                                     lambda i, j: cost(olds[i], j % n_new) if j >= n_new or olds[i] == j else None), n_new)
        cuts = []
        for i, old in enumerate(olds):
            mine = sorted((b, s) for (o, b), s in blocks[k].items() if o == old)
            parts = sorted(((j, a) for (x, j), a in flow.items() if x == i), key=lambda p: (p[0] != old, p[0]))
            at = 0  # bytes of this part already taken up by blocks before
            for b, s in mine:
                begin, targets = 0, []
                while parts:
                    j, amount = parts[0]
                    take = min(s - begin, amount - at)
                    if take:
                        targets.append((j, begin + take))
                    begin, at = begin + take, at + take
                    if at == amount:
                        parts.pop(0)
                        at = 0
                    if begin == s:
                        break
                if len(targets) == 1:
                    plan.append((k, old, b, TOP, targets[0][0]))
                    filled[targets[0][0]] += s
                else:
                    cuts.append((old, b, s, targets))
        if cuts:
            plan += _cut(rows, spark, k, cuts, filled)
    schema = "class int, old int, block int, hi long, shard int"
    table = (spark.createDataFrame(plan, schema).groupBy("class", "old", "block")
             .agg(F.array_sort(F.collect_list(F.struct("hi", "shard"))).alias("cuts")))
    return table, share


def _cut(rows: DataFrame, spark, k: int, cuts, filled: list[int]) -> list[tuple]:
    """Plan rows for blocks that several new shards share: the hash values where they are cut."""
    wanted = spark.createDataFrame([(k, old, b, [int(e) for _, e in t[:-1]]) for old, b, _, t in cuts],
                                   "class int, old int, block int, ends array<long>")
    run = Window.partitionBy("class", "old", "block").orderBy("h").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    by_hash = (rows.join(F.broadcast(wanted), ["class", "old", "block"])
               .groupBy("class", "old", "block", "h").agg(F.sum("size").alias("size"), F.first("ends").alias("ends"))
               .withColumn("upto", F.sum("size").over(run)))
    found = (by_hash.select("old", "block", "h", "upto", "size", F.posexplode("ends").alias("at", "end"))
             .filter(F.col("upto") - F.col("size") / 2 <= F.col("end"))
             .groupBy("old", "block", "at").agg(F.max("h").alias("h"), F.max("upto").alias("upto")).collect())
    found = {(r["old"], r["block"], r["at"]): (int(r["h"]), int(r["upto"])) for r in found}
    plan = []
    for old, b, s, targets in cuts:
        last, before = -TOP - 1, 0
        for at, (j, _) in enumerate(targets):
            hi, upto = (TOP, s) if at == len(targets) - 1 else found.get((old, b, at), (last, before))
            if hi > last:  # else no row falls to this part
                filled[j] += upto - before
                plan.append((k, old, b, hi, j))
                last, before = hi, upto
    return plan


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (shard, h, ...) with ``slot``: 0, 1, ... within each shard.

    Rows are numbered within hash blocks of a shard; a bounded table holds the blocks' first numbers."""
    rows = rows.withColumn("_b", _block(F.col("h"), SLOT_BLOCKS))
    counts = rows.groupBy("shard", "_b").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "_b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("shard", "_b").orderBy("h", "doc_id", "crc")
    return (rows.join(F.broadcast(first), ["shard", "_b"])
            .withColumn("slot", (F.col("_first") + F.row_number().over(within) - 1).cast("long")).drop("_b", "_first"))


def reshard(docs: DataFrame, old: Column, n_new: int, capacities: list[int] | None = None, id_col: str = "doc_id",
            text_col: str = "text", cost=None) -> DataFrame:
    """doc_id, size, crc, old, shard, slot of every row of ``docs``.

    ``old``: the shard (int) a row is in now; ``capacities``: bytes for each new shard (default: equal);
    ``cost(i, j)``: cost of a byte from old shard i to new shard j (default: 1 unless it stays).
    Size: UTF-8 bytes of the text plus 8.

    * a null text has 8 bytes and crc 0; a null id or old shard (taken as 0) is allowed;
    * repeated rows share a hash and go to one shard, with slots of their own; ties (equal costs) go to the lower shard;
    * a row larger than a shard fills one alone; an empty table gives an empty result; other columns are ignored."""
    rows = write_shared(_sized(docs, old, id_col, text_col).drop("text"), "sizes")
    if rows.limit(1).count() == 0:
        return rows.select("doc_id", "size", "crc", "old", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    return numbered(write_shared(solve(rows, n_new, capacities, cost), "placed")).select("doc_id", "size", "crc", "old", "shard", "slot")


def _sized(docs: DataFrame, old: Column, id_col: str, text_col: str, *more: str) -> DataFrame:
    """doc_id, text, old, size, crc, h (hash of id and checksum) and the columns ``more`` of every row."""
    raw = F.col(f"`{text_col}`").cast("binary")
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.coalesce(old.cast("int"), F.lit(0)).alias("old"),
                       (F.coalesce(F.octet_length(raw), F.lit(0)) + 8).cast("long").alias("size"),
                       F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("crc"), *more)
    return slim.withColumn("h", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "crc"))


def reshard_files(docs: DataFrame, old: Column, n_new: int, path: str, capacities: list[int] | None = None, id_col: str = "doc_id",
                  text_col: str = "text", cost=None) -> DataFrame:
    """:func:`reshard` carried out on files: doc_id, size, crc, old, shard, slot as read back from ``path``/shard=<n>.

    The rows are laid out by their old shard, the flow is solved over their sizes, and the files of the shards that lose or gain rows are written
    anew by one scan that applies the plan; files of other shards stay as they are.  A file holds doc_id, text and old.  Edge cases are
    those of :func:`reshard`."""
    spark = docs.sparkSession
    rows = _sized(docs, old, id_col, text_col)
    slim = write_shared(rows.drop("text"), "sizes")
    if slim.limit(1).count() == 0:
        return slim.select("doc_id", "size", "crc", "old", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    rows.select("doc_id", "text", "old", F.col("old").alias("shard")).write.partitionBy("shard").parquet(path)
    table, share = plan_of(slim, n_new, capacities, cost)
    table = write_shared(table, "plan")
    moves = placed(slim, table, share).groupBy("old", "shard").count().collect()  # a row a pair of shards
    affected = sorted({s for r in moves for s in (r["old"], r["shard"]) if r["old"] != r["shard"]})
    if affected:
        anew = placed(rows, table, share).filter(F.col("shard").isin(affected)).select("doc_id", "text", "old", "shard")
        anew.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
        _remove_empty(spark, path, set(affected) - {r["shard"] for r in moves})
    back = _sized(spark.read.schema("doc_id long, text string, old int, shard int").parquet(path).select("doc_id", "text", "old", "shard"), F.col("old"), "doc_id", "text", "shard")
    return numbered(write_shared(back.drop("text"), "back")).select("doc_id", "size", "crc", "old", "shard", "slot")


def _remove_empty(spark, path: str, shards) -> None:
    for n in sorted(shards):
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/shard={n}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def rewrite_affected(docs: DataFrame, plan: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> list[int]:
    """Write anew the files of the shards that lose or gain rows, under ``path``/shard=<n>; returns these shards.

    ``plan`` is a result of :func:`reshard`; rows join it by id and text checksum (null ids included), so equal
    rows are written once for each of them.  Shards that keep all their rows are not touched; ``docs`` may be read
    from ``path`` itself, as the rows are written aside first.  Folders of shards that end up empty are removed."""
    spark = docs.sparkSession
    moved = plan.filter(F.col("old") != F.col("shard"))
    affected = sorted({r[0] for r in moved.select("old").distinct().collect()} | {r[0] for r in moved.select("shard").distinct().collect()})
    if not affected:
        return []
    goes = plan.filter(F.col("shard").isin(affected)).select(F.col("doc_id").alias("_id"), F.col("crc").alias("_crc"), "shard").distinct()
    crc = F.coalesce(F.crc32(F.col(f"`{text_col}`").cast("binary")), F.lit(0)).cast("long")
    names = [c for c in docs.columns if c not in ("shard", "_id", "_crc")]
    out = docs.select(*[F.col(f"`{c}`") for c in names], crc.alias("_c")).join(
        goes, F.col(f"`{id_col}`").eqNullSafe(F.col("_id")) & (F.col("_c") == F.col("_crc"))).select(*names, "shard")
    written = write_shared(out, "affected")
    written.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    _remove_empty(spark, path, set(affected) - {r[0] for r in goes.select("shard").distinct().collect()})
    return affected


def imbalance(sizes) -> float:
    sizes = np.asarray(list(sizes), float)
    return float((sizes.max() - sizes.min()) / sizes.mean()) if len(sizes) and sizes.mean() else 0.0


