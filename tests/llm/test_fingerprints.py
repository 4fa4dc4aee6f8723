import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from causeway.llm import fingerprints as P
from causeway.llm.queries import op13_fingerprints

from .conftest import SF

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def hashes(text, width=5):
    w = WORDS.findall(text or "")
    if not w:
        return set()
    return {hashlib.md5(" ".join(w[i:i + width]).encode()).hexdigest()[:12] for i in range(max(len(w) - width + 1, 1))}


def sketch(all_, share=4):
    return ",".join(sorted(h for h in all_ if int(h, 16) < 16 ** 12 // share or h == min(all_)))


def near(a, b):
    if a == b:
        return 1.0
    a, b = set(a.split(",")) - {""}, set(b.split(",")) - {""}
    return len(a & b) / min(len(a), len(b)) if a and b else 0.0


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        n = len(text)
        edited = text[:n - n // 3] + after[:n // 3]
        a, b, c = (sketch(hashes(t)) for t in (text, edited, after))
        out.append((i, n, edited, a, b, near(a, b), near(a, c)))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_chars, r.edited, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in df.collect()), key=str)


def test_edge_rows(spark, edge_docs, clashing, no_docs):
    want = brute([(r.doc_id, r.text) for r in edge_docs.collect()])
    assert result(P.edited_prints(edge_docs)) == want == result(P.edited_prints(clashing.withColumn("__bucket", F.lit(1))))
    assert P.edited_prints(no_docs).collect() == []
    one = spark.createDataFrame([(3, "a b c d e f g")], "doc_id long, text string")
    assert result(P.edited_prints(one)) == brute([(3, "a b c d e f g")])
    null = spark.createDataFrame([(None, "a b c"), (None, None)], "doc_id long, text string")
    assert result(P.edited_prints(null)) == brute([(None, "a b c"), (None, None)])
    kept = P.fingerprints(clashing.withColumn("fingerprint", F.lit("old")))
    assert kept.columns == [*clashing.columns, "fingerprint"] and kept.filter("fingerprint = 'old'").count() == 0


@pytest.mark.parametrize("ids", [range(300), [7 ** k % 100_003 - 50_000 for k in range(300)], [1] * 150 + list(range(150))])
def test_next_rows_over_many_buckets(spark, monkeypatch, ids):
    monkeypatch.setattr(P, "ROWS_A_BUCKET", 3)
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 30))) + f" {k}") for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(P.edited_prints(docs)) == brute(rows)


def test_merging_and_containment(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(5000)}" for _ in range(6000)]
    big, part, other = " ".join(words), " ".join(words[2000:2400]), " ".join(f"x{k}" for k in range(400))
    df = spark.createDataFrame([(big, part, other)], "a string, b string, c string")
    a, b, c = (P.fingerprint(F.col(x)) for x in "abc")
    r = df.select(P.likeness(a, b).alias("ab"), P.likeness(a, c).alias("ac"), P.merged(b, c).alias("m"), P.likeness(P.merged(b, c), b).alias("mb"),
                  P.merged(a, F.lit("")).alias("a0"), a.alias("a"), P.merged(F.lit(""), F.lit("")).alias("none")).first()
    assert r.ab == 1.0 and r.ac == 0.0 and r.mb == 1.0 and r.a0 == r.a and r.none == ""
    assert r.m == sketch(hashes(part) | hashes(other))
    assert abs(len(r.a.split(",")) / len(hashes(big)) - 0.25) < 0.03


def test_containment_is_estimated_well(spark):
    rng = random.Random(6)
    rows = []
    for k in range(40):
        w = [f"w{rng.randrange(10_000)}" for _ in range(1200)]
        cut = rng.randint(100, 700)
        rows.append((" ".join(w[:700]), " ".join(w[700 - cut:]), cut))
    got = spark.createDataFrame(rows, "a string, b string, cut int").select("a", "b", P.likeness(P.fingerprint(F.col("a")), P.fingerprint(F.col("b"))).alias("near")).collect()
    errors = [abs(r.near - len(hashes(r.a) & hashes(r.b)) / min(len(hashes(r.a)), len(hashes(r.b)))) for r in got]
    assert sum(errors) / len(errors) < 0.04 and max(errors) < 0.15


def test_no_python_in_the_plan(spark):
    plan = op13_fingerprints(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SinglePartition" not in plan


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = [(i, n, hashlib.sha256(e.encode()).hexdigest(), a, b, x, y) for i, n, e, a, b, x, y in brute(rows)]
    got = [tuple(r) for r in op13_fingerprints(spark, SF).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    long_ = [r for r in got if r[1] > 2000]
    assert sum(r[5] > 0.4 for r in long_) >= 0.9 * len(long_)
