"""Fill-in-middle transformation by block rotation in place.

A text is cut into prefix, middle and suffix at two token ends.  Its bytes lie in one bytearray, the sentinels are
inserted at the cuts, and the blocks are exchanged by rotations made of three reversals each.  The same rotation, with its
blocks found again by their sentinels, undoes the exchange, so the text is restored exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_bytes, small_batches

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
STRIDE = 1 << 16
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True


def _reverse(view: np.ndarray, lo: int, hi: int) -> None:
    """Reverse view[lo:hi], swapping at most STRIDE bytes from either end at a time."""
    while hi - lo > 1:
        half = min(STRIDE, (hi - lo) // 2)
        left = view[lo:lo + half][::-1].copy()
        view[lo:lo + half] = view[hi - half:hi][::-1]
        view[hi - half:hi] = left
        lo, hi = lo + half, hi - half


def rotate(buffer: bytearray, lo: int, mid: int, hi: int) -> None:
    """Exchange the neighbouring blocks [lo, mid) and [mid, hi) by three reversals."""
    view = np.frombuffer(buffer, np.uint8)
    _reverse(view, lo, mid)
    _reverse(view, mid, hi)
    _reverse(view, lo, hi)


def token_ends(text: bytes) -> np.ndarray:
    """Ends of the tokens: words with the white space before them, and white space at the text's end."""
    gap = _SPACE[np.frombuffer(text, np.uint8)]
    return np.flatnonzero(np.concatenate([~gap[:-1] & gap[1:], np.ones(min(len(gap), 1), bool)])) + 1


def exchange(text: bytes, first: int, second: int, form: str) -> bytearray:
    """The text with sentinels, cut after ``first`` and ``second`` bytes, in the order of ``form``."""
    buffer = bytearray(text)
    buffer[second:second] = SUFFIX
    buffer[first:first] = MIDDLE
    buffer[0:0] = PREFIX
    at_middle, at_suffix = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    rotate(buffer, 0 if form == "spm" else at_middle, at_suffix, len(buffer))
    return buffer


def undo(output: bytes, form: str) -> bytes:
    """The text that :func:`exchange` was given; a plain output is the text."""
    if form == "plain":
        return output
    buffer = bytearray(output)
    lo = 0 if form == "spm" else buffer.index(SUFFIX)
    rotate(buffer, lo, buffer.index(PREFIX if form == "spm" else MIDDLE, lo), len(buffer))
    at_suffix = buffer.rindex(SUFFIX)
    del buffer[at_suffix:at_suffix + len(SUFFIX)]
    at_middle = buffer.index(MIDDLE)
    del buffer[at_middle:at_middle + len(MIDDLE)]
    del buffer[:len(PREFIX)]
    return bytes(buffer)


def _characters(text: bytes, lo: int, hi: int) -> int:
    return int(np.count_nonzero((np.frombuffer(text, np.uint8, hi - lo, lo) & 0xC0) != 0x80)) if hi > lo else 0


def _transform(names: list[str], fim_share: int, spm_share: int):
    def run(batches):
        for batch in batches:
            rows = []
            draws = zip(*[batch.column(f"__h{k}").to_pylist() for k in range(1, 5)], strict=True)
            for text, (h1, h2, h3, h4) in zip(column_bytes(batch, "__text"), draws, strict=True):
                text = text or b""
                ends = token_ends(text)
                n = len(ends)
                if not text or h3 % 100 >= fim_share or PREFIX in text or SUFFIX in text or MIDDLE in text:
                    rows.append((n, "plain", None, None, text))
                    continue
                first, second = (int(ends[k - 1]) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
                form = "spm" if h4 % 100 < spm_share else "psm"
                rows.append((n, form, _characters(text, 0, first), _characters(text, first, second), bytes(exchange(text, first, second, form))))
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                [*names, "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def draws(seed: int, id_col: str = "doc_id") -> list[Column]:
    """Four unsigned 32-bit numbers of a row from sha256 of ``seed:id`` (a null id counts as an empty one)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 42, fim_share: int = 50, spm_share: int = 80, id_col: str = "doc_id",
                   text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n (tokens), form (plain, psm, spm), prefix_chars, middle_chars, output of every row.

    ``fim_share`` of 100 rows are exchanged, ``spm_share`` of 100 of these suffix first; cuts and form follow from the id alone.
    psm: ``<P>``prefix``<S>``suffix``<M>``middle; spm: ``<S>``suffix``<P>``prefix``<M>``middle; plain: the text.

    * a null text counts as empty; empty texts and texts with a sentinel of their own stay plain;
    * a blank text is one token; equal cuts (ties) leave an empty middle, cuts at the ends an empty prefix or suffix;
    * very long texts take their own size once, besides blocks of 64 KB; repeated rows have equal results;
    * null ids share one draw and stay null; an empty table gives an empty result; other columns are ignored.
    """
    src = small_batches(docs).select(*[F.col(f"`{c}`").alias(c) for c in keep], F.col(f"`{text_col}`").cast("binary").alias("__text"),
                                     *[d.alias(f"__h{k}") for k, d in enumerate(draws(seed, id_col), 1)])
    schema = T.StructType([src.schema[c] for c in keep] + T._parse_datatype_string("n long, form string, prefix_chars long, middle_chars long, output binary").fields)
    return src.mapInArrow(_transform(list(keep), fim_share, spm_share), schema).withColumn("output", F.col("output").cast("string"))


def restore(transformed: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and restored: the text rebuilt from ``output`` and ``form`` alone (both null: empty)."""
    src = small_batches(transformed).select(*[F.col(f"`{c}`").alias(c) for c in keep], F.col("form").alias("__form"), F.col("output").cast("binary").alias("__text"))

    def run(batches):
        for batch in batches:
            forms = batch.column("__form").to_pylist()
            texts = [undo(t or b"", f or "plain") for t, f in zip(column_bytes(batch, "__text"), forms, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(texts, pa.binary())], [*keep, "restored"])

    schema = T.StructType([src.schema[c] for c in keep] + [T.StructField("restored", T.BinaryType())])
    return src.mapInArrow(run, schema).withColumn("restored", F.col("restored").cast("string"))
