import random
import zlib
from functools import cache

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from causeway.llm import packing as P
from causeway.llm.queries import TOKENIZER, op1_packing

from .conftest import SF


@cache
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return t


@cache
def word_ids():
    return P.WordIds(TOKENIZER)


def whole(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids


def test_word_ids_equal_the_whole_text_call():
    w = word_ids()
    for text in ["A'sb don't IT'S", "İstanbul ΑΣ Σ.", "abc<|endoftext|> <|startoftext|>x", "áb É ÉÀ.", "foo--bar x9.z 3.5kg", "naïve x\x85y z", "a''", "ﬁ..", "",
                 "日本語 テスト", "é ́a", "µm ª º ß", "tab\tnew\nline\x0b\x0c\r end"]:
        assert np.frombuffer(w.of(text.encode()), "<u4").tolist() == whole(text), text


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_word_ids_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(word_ids().of(text.encode()), "<u4").tolist() == whole(text)


def brute_best_fit(lengths, window):
    left, windows = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [(c, k) for k, c in enumerate(left) if c >= lengths[i]]
        if fits:
            tight = min(c for c, _ in fits)
            k = max(k for c, k in fits if c == tight)
        else:
            left.append(window)
            windows.append([])
            k = len(left) - 1
        left[k] -= lengths[i]
        windows[k].append(i)
    return windows


def test_best_fit_decreasing_takes_the_tightest_window():
    rng = random.Random(5)
    for _ in range(30):
        lengths = [rng.randint(1, 50) for _ in range(rng.randint(0, 80))]
        got = P.best_fit_decreasing(lengths, 50)
        want = brute_best_fit(lengths, 50)
        used = lambda ws: sorted(sum(lengths[i] for i in w) for w in ws)
        assert sorted(i for w in got for i in w) == list(range(len(lengths)))
        assert max(used(got), default=0) <= 50
        assert len(got) == len(want)


def check_pieces(pieces, docs, window=4096):
    """Every id lies in exactly one piece, with the right checksum; sequences are gapless and fit."""
    ids = {}
    for i, text in docs:
        ids.setdefault(i, []).append(np.asarray(whole(text) + [2], "<u4"))
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(ids)
    for i, ps in by_doc.items():
        copies = len(ids[i])
        x = ids[i][0]
        if copies == 1:
            at = 0
            for p in sorted(ps, key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(x)
                assert p.ids_crc32 == zlib.crc32(x[at:at + p.length].tobytes())
                at += p.length
            assert at == len(x)
        else:
            assert sum(p.length for p in ps) == sum(map(len, ids[i]))
    padded = used = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert 0 < at <= window
        used += at
        padded += at if at & (at - 1) == 0 else window
    return used, padded


def test_edge_rows(spark, edge_docs, clashing, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    pieces = P.piece_digests(P.pack(edge_docs.coalesce(1), TOKENIZER, window=64, chunk_tokens=200)).collect()
    check_pieces(pieces, rows, 64)
    assert P.pack(no_docs, TOKENIZER).count() == 0
    assert P.pack(clashing, TOKENIZER).columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def test_query_packs_everything_with_little_padding(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    used, padded = check_pieces(op1_packing(spark, SF).collect(), docs)
    assert padded <= 1.02 * used
