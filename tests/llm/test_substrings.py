import hashlib
import random
import re

import numpy as np

from causeway.llm import substrings as S
from causeway.llm.common import window_hashes

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows, length=13):
    words = [(i, WORDS.findall((t or "").encode())) for i, t in rows]
    low = {}
    for i, w in words:
        for s in range(len(w) - length + 1):
            k = tuple(w[s:s + length])
            if i is not None:
                low[k] = min(low.get(k, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            m = low.get(tuple(w[s:s + length]))
            if m is not None and (i is None or m < i):
                gone[s:s + length] = [True] * length
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()], key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyz")
    passages = [[word() for _ in range(n)] for n in (6, 12, 13, 14, 40)]
    rows = []
    for i in range(90):
        w = [word() for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(passages)
        rows.append((i, " ".join(w)))
    return rows + [(200 + k, rows[5][1]) for k in range(4)]


def test_equals_brute_force(spark):
    for seed, length in ((1, 13), (2, 13), (3, 5), (4, 30)):
        rows = corpus(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        assert result(S.remove_repeats(docs, length)) == brute(rows, length), (seed, length)


def test_edge_rows(spark, edge_docs, clashing, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    assert result(S.remove_repeats(edge_docs)) == brute(rows) == result(S.remove_repeats(clashing))
    assert S.remove_repeats(no_docs).count() == 0


def test_nothing_repeated(spark):
    docs = spark.createDataFrame([(1, " ".join(f"a{i}" for i in range(40))), (2, " ".join(f"b{i}" for i in range(40)))], "doc_id long, text string")
    assert {r.n_removed for r in S.remove_repeats(docs).collect()} == {0}


def test_kept_text(spark):
    same = " ".join(f"w{i}" for i in range(13))
    docs = spark.createDataFrame([(1, same), (2, f"start {same} end")], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in S.remove_repeats(docs).collect()} == {1: None, 2: "start end"}


def test_levels_and_hashes():
    assert S.level_lengths(13) == [7, 13] and S.level_lengths(50) == [7, 13, 25, 50] and S.level_lengths(5) == [5]
    codes = np.arange(50, dtype=np.uint64) % np.uint64(7)
    for width in (1, 2, 3, 5, 7, 13, 50):
        h = window_hashes(codes, width)
        assert len(h) == 51 - width
        for i in range(len(h)):
            for j in range(i):
                assert (h[i] == h[j]) == bool((codes[i:i + width] == codes[j:j + width]).all())
    assert len(window_hashes(codes, 51)) == 0
