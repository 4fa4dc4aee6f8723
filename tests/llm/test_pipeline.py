


from pyspark.sql import functions as F

import corpus_pipeline as P
from causeway.llm import langid

from .conftest import SF
from .test_near_duplicates import brute
from .test_packing import check_pieces


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = []
    for name, stage in P.STAGES:
        out = P.write_shared(stage(spark, docs, SF), f"test-{name}")
        if name != "packing":
            assert out.columns == P.COLUMNS
        held.append((docs, out))
        docs = out
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}

    before, after = held[0]
    model = langid.train_on(before)
    keep = {r.doc_id for r in langid.identify(before, model).filter("NOT rejected").collect()}
    assert texts(after) == {i: t for i, t in texts(before).items() if i in keep} and len(keep) >= 0.97 * before.count()

    before, after = held[1]
    plain = brute(list(texts(before).items()))
    assert set(texts(after)) == {c for n, c in plain.values()} and 0 < after.count() < before.count()

    before, after = held[2]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {i for i, t in texts(before).items() if any(b in t for b in items)}
    gone = set(texts(before)) - set(texts(after))
    assert leaked <= gone and len(gone - leaked) <= 1

    before, after = held[3]
    was, now = texts(before), texts(after)
    assert set(was) == set(now)
    assert all(now[i] == was[i] or "[SECRET]" in now[i] for i in was)
    assert {r.doc_id for r in after.filter(F.col("n_chars") != F.char_length("text")).collect()} == {r.doc_id for r in before.filter(F.col("n_chars") != F.char_length("text")).collect()}

    used, padded = check_pieces(held[4][1].collect(), list(now.items()))
    assert padded <= 1.02 * used


def test_edge_rows_pass_through(spark, edge_docs):
    docs = edge_docs.withColumn("extra", F.lit(1))
    for _, stage in P.STAGES:
        docs = P.write_shared(stage(spark, docs, SF), "edge")
    assert docs.columns[:3] == ["doc_id", "start", "length"]


def test_empty_table(spark, no_docs):
    docs = no_docs
    for _, stage in P.STAGES:
        docs = P.write_shared(stage(spark, docs, SF), "empty")
        assert docs.count() == 0


def test_registered():
    import __spark_entry__ as E
    q = E.queries()
    assert q.keys() >= {"pipeline"} and {n.split("_")[0] for n in q if n.startswith("op") and n[2].isdigit()} == {f"op{i}" for i in range(1, 14)}


def test_the_last_stage_keeps_token_ids(spark):
    docs = spark.createDataFrame([(1, "one text to pack", "en", "s", 16)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = P.packed(spark, docs, SF).collect()
    assert rows and all(len(r.ids) == 4 * r.length for r in rows)
