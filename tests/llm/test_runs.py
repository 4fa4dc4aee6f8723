import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from causeway.llm import runs as R
from causeway.llm.common import mixed
from causeway.llm.queries import op11_periodic_runs, with_planted_runs

from .conftest import SF

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(w, exponent=4, least=6):
    """Every period by itself; of equal stretches the smallest period."""
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = q
        while i < len(w):
            if w[i] != w[i - q]:
                i += 1
                continue
            b = i
            while i < len(w) and w[i] == w[i - q]:
                i += 1
            if i - b + q >= max(least, exponent * q):
                found.setdefault((b - q, i - b + q), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(x for i, x in enumerate(w) if i not in gone)


def text_with_runs(rng, n, vocabulary):
    w = [rng.randrange(vocabulary) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        a = rng.randrange(n) if n else 0
        e = min(n, a + rng.randint(1, 80))
        p = 1 + (e - a) // (3 + rng.randrange(8))
        w = [w[i] if i < a or i >= e else w[a + (i - a) % p] for i in range(n)]
    return w


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_automaton_finds_the_runs(w):
    assert R.runs_of(w) == brute(w)
    assert R.runs_of(w, 3, 2) == brute(w, 3, 2)


def test_segments_of_an_access_are_the_last_occurrences():
    w = [1, 2, 1, 1, 2, 1, 2]
    size, link, prefix = R.automaton(w)
    forest = R.LinkCutForest([p if p > 0 else -1 for p in link])
    for i in range(len(w)):
        got = {(size[node], before) for node, before in forest.access(prefix[i], i)}
        want = {}
        for n in range(1, i + 1):  # the suffix of n words and where it ended last
            ends = [e for e in range(n - 1, i) if w[e - n + 1:e + 1] == w[i - n + 1:i + 1]]
            if ends:
                want[ends[-1]] = max(n, want.get(ends[-1], 0))
        assert got == {(n, e) for e, n in want.items()}


def test_stretches_lose_no_run():
    rng = random.Random(3)
    for _ in range(60):
        texts = [text_with_runs(rng, rng.randint(0, 150), rng.choice([1, 2, 5, 40])) for _ in range(rng.randint(1, 6))]
        codes = [mixed(np.array(w, np.uint64) + np.uint64(9)) for w in texts]
        for exponent, least in ((4, 6), (3, 1), (5, 20)):
            assert R._block_runs(codes, exponent, least) == [brute(w, exponent, least) for w in texts]


def test_operator_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{x}" for x in text_with_runs(rng, rng.randint(0, 200), 6))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    texts = dict(rows)
    for r in R.find_runs(docs).collect():
        w = texts[r.doc_id].encode().split()
        assert [tuple(x) for x in r.runs] == brute(w) and r.collapsed.encode() == collapsed(w, brute(w))


def test_edge_rows(spark, edge_docs, clashing, no_docs):
    for docs in (edge_docs, clashing):
        got = {(r.doc_id, r.collapsed): [tuple(x) for x in r.runs] for r in R.find_runs(docs).collect()}
        assert got[1, ""] == got[2, ""] == got[3, ""] == [] and got[6, "word"] == [(0, 60_000, 1)]
        assert len(R.find_runs(docs).collect()) == 10 and (None, "the cat sat on the mat and looked at the moon over the quiet hill") in got
    assert R.run_digests(R.find_runs(no_docs), "doc_id").collect() == []
    taken = edge_docs.select("doc_id", "text", *[F_lit(n) for n in ("runs", "collapsed", "__w", "start")])
    assert R.find_runs(taken).columns == ["doc_id", "runs", "collapsed"]


def F_lit(name):
    from pyspark.sql import functions as F
    return F.lit(1).alias(name)


def test_ties_of_the_longest_run(spark):
    rows = [(1, "a a a a a a x b b b b b b"), (2, "a b a b a b a b a b a b c d c d c d c d c d c d"), (3, None)]
    got = {r.doc_id: r for r in R.run_digests(R.find_runs(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id").collect()}
    assert (got[1].n_runs, got[1].start, got[1].length, got[1].period, got[1].exponent_milli) == (2, 0, 6, 1, 6000)
    assert (got[2].start, got[2].length, got[2].period) == (0, 12, 2)
    empty = hashlib.sha256(b"").hexdigest()
    assert (got[3].n_runs, got[3].start, got[3].exponent_milli, got[3].runs_sha256, got[3].collapsed_sha256) == (0, None, None, empty, empty)


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op11_periodic_runs(spark, SF).collect()
    assert len(got) == len(docs) and sum(r.n_runs > 0 for r in got) >= len(docs) // 20
    for r in got:
        w = WORDS.findall((docs[r.doc_id] or "").encode())
        h, n = zlib.crc32(str(r.doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            a = (h // 10) % n
            p = 1 + (n - a) // (3 + (h // 10) % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute(w)
        assert r.n_runs == len(runs) and r.collapsed_sha256 == hashlib.sha256(collapsed(w, runs)).hexdigest()
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()


def test_planting_leaves_null_ids_and_blank_texts(spark):
    docs = spark.createDataFrame([(None, "a b"), (0, None), (1, " "), (2, "")], "doc_id long, text string")
    assert sorted(with_planted_runs(docs).collect(), key=str) == sorted(docs.collect(), key=str)
