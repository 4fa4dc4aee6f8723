import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from causeway.llm import fim as M
from causeway.llm.queries import op12_fill_in_middle

from .conftest import SF

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_form(doc_id, text, seed=42, fim=50, spm=80):
    """(n, form, prefix, middle, output) by string slices."""
    text = text or ""
    tokens = TOKEN.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k:8 * k + 8], 16) for k in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim:
        return len(tokens), "plain", None, None, text
    lo, hi = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    a, b, z = "".join(tokens[:lo]), "".join(tokens[lo:hi]), "".join(tokens[hi:])
    if h[3] % 100 < spm:
        return len(tokens), "spm", len(a), len(b), f"<S>{z}<P>{a}<M>{b}"
    return len(tokens), "psm", len(a), len(b), f"<P>{a}<S>{z}<M>{b}"


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60), st.integers(0, 60), st.integers(0, 60), st.sampled_from(["psm", "spm"]))
def test_exchange_and_undo(text, i, j, form):
    lo, hi = sorted((min(i, len(text)), min(j, len(text))))
    for s in (M.PREFIX, M.SUFFIX, M.MIDDLE):
        if s in text:
            return
    a, b, z = text[:lo], text[lo:hi], text[hi:]
    out = bytes(M.exchange(text, lo, hi, form))
    assert out == (b"<S>" + z + b"<P>" + a + b"<M>" + b if form == "spm" else b"<P>" + a + b"<S>" + z + b"<M>" + b)
    assert M.undo(out, form) == text


def test_halves_of_sentinels_at_the_cuts():
    for text in (b"<P <S> x".replace(b"<S>", b"<S"), b"<<PP>>", b"<P", b">", b"M><", b"<M<S<P"):
        for lo in range(len(text) + 1):
            for hi in range(lo, len(text) + 1):
                for form in ("psm", "spm"):
                    assert M.undo(bytes(M.exchange(text, lo, hi, form)), form) == text


def test_rotation_in_strides(monkeypatch):
    monkeypatch.setattr(M, "STRIDE", 7)
    data = bytes(range(256)) * 2
    for mid in (0, 1, 100, 255, 511, 512):
        buffer = bytearray(data)
        M.rotate(buffer, 0, mid, len(buffer))
        assert bytes(buffer) == data[mid:] + data[:mid]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=" \t\n\x0b\x0c\r\x1c aé", max_size=30))
def test_token_ends(text):
    ends, at = [], 0
    for t in TOKEN.findall(text):
        at += len(t.encode())
        ends.append(at)
    assert M.token_ends(text.encode()).tolist() == ends


def rows_of(made):
    return sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made.collect()), key=str)


def test_edge_rows(spark, edge_docs, clashing, no_docs):
    want = sorted(((r.doc_id, *plain_form(r.doc_id, r.text)) for r in edge_docs.collect()), key=str)
    for docs in (edge_docs, clashing.withColumnRenamed("old", "form").withColumnRenamed("size", "output")):
        assert rows_of(M.fill_in_middle(docs)) == want
    always = M.fill_in_middle(edge_docs, fim_share=100, spm_share=50)
    want = sorted(((r.doc_id, *plain_form(r.doc_id, r.text, fim=100, spm=50)) for r in edge_docs.collect()), key=str)
    assert rows_of(always) == want and {w[2] for w in want} == {"plain", "psm", "spm"}
    back = sorted(((r.doc_id, r.restored) for r in M.restore(always).collect()), key=str)
    assert back == sorted(((r.doc_id, r.text or "") for r in edge_docs.collect()), key=str)
    assert M.restore(M.fill_in_middle(no_docs)).collect() == []


def test_texts_with_sentinels_and_other_white_space(spark):
    rows = [(i, t) for i in range(40) for t in ("a <P> b", "x<S>", "<M>", "é ü   ß\n", " \t ", "tail  ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = M.fill_in_middle(docs)
    assert rows_of(made) == sorted(((i, *plain_form(i, t)) for i, t in rows), key=str)
    assert sorted((r.doc_id, r.restored) for r in M.restore(made).collect()) == sorted(rows)


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = op12_fill_in_middle(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        n, form, prefix, middle, output = plain_form(r.doc_id, docs[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, prefix, middle, sha(output), sha(docs[r.doc_id] or ""))
