import zlib

import numpy as np
from pyspark.sql import functions as F

from causeway.llm import langid as L
from causeway.llm.queries import op9_language_id

from .conftest import SF


def test_features_are_letter_ngrams():
    assert len(L.features("")) == 0 and len(L.features("12 .. 3!")) == 0
    assert sorted(L.features("Ab")) == sorted(L.features("...aB1"))
    # a, b; <a, ab, b>; <ab, ab>; <ab>
    assert len(L.features("ab")) == 8
    once, twice = np.bincount(L.features("abc"), minlength=1 << L.BITS), np.bincount(L.features("abc 9 abc"), minlength=1 << L.BITS)
    assert (twice == 2 * once).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = L.train_on(docs, per_language=150)
    rows = L.identify(docs, model).collect()
    test = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([r.lang == r.lang_pred for r in test]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.rejected for r in rows]) < 0.02


def test_query(spark):
    rows = op9_language_id(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_edge_rows(spark, edge_docs, clashing, no_docs):
    model = L.train(["the cat and the dog"] * 10 + ["le chat et le chien"] * 10, ["en"] * 10 + ["fr"] * 10)
    by = {r.doc_id: (r.lang_pred, r.score, r.rejected) for r in L.identify(edge_docs, model).collect()}
    for i in (1, 2, 3, 8):
        assert by[i] == ("und", 0.0, True)
    assert by[4][0] in ("en", "fr") and by[6][1] > 0
    got = L.identify(clashing, model)
    assert got.count() == 10 and set(got.columns) == set(clashing.columns)
    assert L.identify(no_docs, model).count() == 0
    nothing = L.train_on(no_docs)
    assert nothing.labels == [] and {r.lang_pred for r in L.identify(edge_docs, nothing).collect()} == {"und"}


def test_sample_is_bounded_and_leaves_held_out_rows_alone(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"), F.when(F.col("id") % 10 == 0, "aa").otherwise("bb").alias("lang"))
    texts, langs = L.labelled_sample(docs.filter(~L.held_out()), 50)
    assert langs.count("aa") == 50 and langs.count("bb") == 50
    assert all(zlib.crc32(t[1:].encode()) % 4 != 2 for t in texts)


def test_predictions_equal_plain_scoring(spark, edge_docs):
    model = L.train(["the cat and the dog"] * 10 + ["le chat et le chien"] * 10, ["en"] * 10 + ["fr"] * 10)
    for r in L.identify(edge_docs, model).collect():
        x = L.features(r.text or "")
        if not len(x):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        z = (model.table[x].astype(float).mean(axis=0) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert r.lang_pred == model.labels[int(p.argmax())] and abs(r.score - p.max()) < 1e-6


def test_ties_go_to_the_first_label(spark, edge_docs):
    model = L.train(["abc abd"] * 5 + ["abc abd"] * 5, ["bb"] * 5 + ["aa"] * 5, epochs=0)
    assert {r.lang_pred for r in L.identify(edge_docs, model).collect()} <= {"aa", "und"}


def test_sample_is_bounded_in_bytes(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.repeat(F.lit("long "), 2000).alias("text"), F.lit("aa").alias("lang"))
    texts, _ = L.labelled_sample(docs, 30, max_bytes=50_000)
    assert len(texts) == 6 and all(len(t) == 10_000 for t in texts)
