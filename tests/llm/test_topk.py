import random

from pyspark.sql import functions as F

from causeway.llm import topk as K
from causeway.llm.queries import op10_exact_top_k

from .conftest import SF

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def check(spark, rows, k=5, **options):
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in K.top_k(df, F.col("vec_id") % 10 == 0, k, **options).collect())
    held = [(r.vec_id, r.embedding) for r in df.collect()]
    want = sorted(map(tuple, K.brute_top_k(held, {i for i, _ in rows if i % 10 == 0}, k).itertuples(index=False)))
    assert got == want


def test_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(20)]) for i in range(300)]
    check(spark, rows)
    check(spark, rows, k=3, block=16, cells=5, group_queries=7)


def test_ties_edges_and_lengths(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, -1.0, 0.5]) for i in range(25)] + [(30, None), (31, [None, 1.0, 2.0]), (40, [nan, 1.0, 1.0]), (50, [inf, 0.0, 0.0]), (60, []), (61, []), (70, [2.0])]
    check(spark, rows)
    check(spark, [(0, [1.0]), (1, [2.0])])
    assert K.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0).count() == 0


def test_null_ids_are_candidates(spark):
    df = spark.createDataFrame([(0, [1.0], 0, ""), (None, [3.0], 0, ""), (7, [3.0], 0, "")], SCHEMA)
    assert [(r.rank, r.vec_id) for r in sorted(K.top_k(df, F.col("vec_id") % 10 == 0).collect(), key=lambda r: r.rank)] == [(1, 7), (2, None)]


def test_large_components_stay_exact(spark):
    check(spark, [(i, [float(2 ** 20 + i), float(2 ** 21 - 3 * i)]) for i in range(20)])


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = sorted(map(tuple, K.brute_top_k(rows, {i for i, _ in rows if i % 50 == 0}).itertuples(index=False)))
    assert sorted(tuple(r) for r in op10_exact_top_k(spark, SF).collect()) == want
