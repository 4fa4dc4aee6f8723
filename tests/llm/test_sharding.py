import itertools
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from causeway.llm import sharding as S
from causeway.llm.queries import op2_resharding

from .conftest import SF


def least_moved(supply, capacity):
    return sum(max(0, s - c) for s, c in itertools.zip_longest(supply, capacity, fillvalue=0))


def test_flow_moves_the_fewest_bytes():
    rng = random.Random(2)
    for _ in range(40):
        n = rng.randint(1, 6)
        supply = [rng.randint(0, 30) for _ in range(n)]
        m = rng.randint(1, 6)
        capacity = [sum(supply) // m + 1 for _ in range(m)]
        flow = S.min_cost_flow(supply, capacity, lambda i, j: int(i != j))
        assert [sum(a for (i, _), a in flow.items() if i == k) for k in range(n)] == supply
        assert all(sum(a for (_, j), a in flow.items() if j == k) <= capacity[k] for k in range(m))
        assert sum(a for (i, j), a in flow.items() if i != j) == least_moved(supply, capacity)


def test_flow_needs_rerouting():
    cost = [[1, 2], [1, 5]]
    flow = S.min_cost_flow([4, 4], [4, 4], lambda i, j: cost[i][j])
    assert sum(cost[i][j] * a for (i, j), a in flow.items()) == 12  # 0 -> 1, 1 -> 0


def check(rows, texts, n):
    """Every row once, right size and checksum, slots gapless."""
    assert sorted((str(r.doc_id), r.size, r.crc) for r in rows) == sorted(
        (str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts)
    slots = defaultdict(list)
    for r in rows:
        assert 0 <= r.shard < n
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_edge_rows(spark, edge_docs, clashing, no_docs):
    texts = [(r.doc_id, r.text) for r in edge_docs.collect()]
    check(S.reshard(edge_docs, F.lit(0), 3).collect(), texts, 3)
    check(S.reshard(clashing, F.lit(None).cast("int"), 2).collect(), texts, 2)
    assert S.reshard(no_docs, F.lit(0), 4).count() == 0


def test_equal_sizes_and_few_moves(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") * 37 % 900).cast("int")).alias("text"))
    old = F.when(F.col("doc_id") % 3 == 0, 0).otherwise(F.col("doc_id") % 5).cast("int")
    rows = S.reshard(docs, old, 5).collect()
    by_new, by_old, moved = defaultdict(int), defaultdict(int), 0
    for r in rows:
        by_new[r.shard] += r.size
        by_old[r.old] += r.size
        moved += r.size * (r.shard != r.old)
    mean = sum(by_new.values()) / 5
    assert S.imbalance(by_new.values()) < 0.01
    assert moved <= sum(max(0, s - mean) for s in by_old.values()) * 1.02


def test_unequal_capacities_and_rewrite(spark, tmp_path):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab"), (F.col("id") % 50).cast("int")).alias("text"), F.lit("k").alias("shard"))
    total = sum(2 * (i % 50) + 8 for i in range(400))
    plan = S.reshard(docs, (F.col("doc_id") % 2).cast("int"), 3, [total // 2 + 100, total // 4 + 100, total // 4 + 100]).cache()
    path = str(tmp_path / "out")
    affected = S.rewrite_affected(docs, plan, path)
    want = {(r.doc_id, r.shard) for r in plan.collect() if r.shard in affected}
    assert {(r.doc_id, r.shard) for r in spark.read.parquet(path).collect()} == want
    same = plan.withColumn("old", F.col("shard"))
    assert S.rewrite_affected(docs, same, path + "-none") == []


def test_query(spark):
    rows = op2_resharding(spark, SF).withColumnRenamed("text_crc32", "crc").collect()
    check(rows, [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()], 24)
    assert {r.law for r in rows} == {"bytes"} and all(r.grown_shard is None for r in rows)


def test_rewrite_on_a_folder_with_all_old_shards(spark, tmp_path):
    """Shard 2 keeps its rows and files, 0 gives some to 1, 3 ends up empty."""
    rows = spark.range(80).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), (F.col("id") % 4).cast("int").alias("shard"))
    path = str(tmp_path / "shards")
    rows.write.partitionBy("shard").parquet(path)
    kept = {f: f.stat().st_mtime_ns for f in (tmp_path / "shards" / "shard=2").iterdir()}
    new = F.when(F.col("shard") == 3, 1).when((F.col("shard") == 0) & (F.col("doc_id") < 40), 1).otherwise(F.col("shard"))
    plan = rows.select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc"), F.col("shard").alias("old"), new.cast("int").alias("shard")).cache()
    assert S.rewrite_affected(spark.read.parquet(path), plan, path) == [0, 1, 3]
    assert sorted((r.doc_id, r.text, r.shard) for r in spark.read.parquet(path).collect()) == sorted((r.doc_id, f"text {r.doc_id}", r.shard) for r in plan.collect())
    assert {f: f.stat().st_mtime_ns for f in (tmp_path / "shards" / "shard=2").iterdir()} == kept
    assert not (tmp_path / "shards" / "shard=3").exists()


def test_files_hold_what_the_plan_says(spark, edge_docs, no_docs, tmp_path):
    texts = [(r.doc_id, r.text) for r in edge_docs.collect()]
    check(S.reshard_files(edge_docs, F.coalesce(F.col("doc_id"), F.lit(0)) % 5, 3, str(tmp_path / "a")).collect(), texts, 3)
    back = spark.read.parquet(str(tmp_path / "a"))
    assert sorted(map(str, ((r.doc_id, r.text) for r in back.collect()))) == sorted(map(str, texts))
    assert {r.shard for r in back.select("shard").distinct().collect()} <= {0, 1, 2}  # the folders of old shards 3 and 4 are gone
    assert S.reshard_files(no_docs, F.lit(0), 3, str(tmp_path / "b")).count() == 0


def test_files_of_unaffected_shards_stay(spark, tmp_path):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("text of one size").alias("text"))
    old = F.when(F.col("doc_id") < 100, 0).when(F.col("doc_id") < 160, 1).otherwise(2)
    rows = S.reshard_files(docs, old, 3, str(tmp_path / "x"), [2400, 2400, 2400]).collect()
    assert sum(r.old != r.shard for r in rows) == 40 and all(r.shard == 0 for r in rows if r.old == 0)
    same = S.reshard_files(docs, F.col("doc_id") % 3, 3, str(tmp_path / "y")).collect()
    assert all(r.old == r.shard for r in same)
