"""Packing of tokenised documents into fixed windows, best fit decreasing.

A document's ids are followed by an end id.  Overlong documents are first cut into full windows;
what is left over (shorter than a window) is packed by best-fit decreasing: the longest pieces
first, each into the tightest open window that can hold it.  A segment tree over the remaining
capacities 0..window finds that window in O(log window).

Each Spark task packs the documents it reads, chunk by chunk, so nothing is shuffled and memory is
bounded by ``chunk_tokens``.  Windows that a chunk leaves with much padding give their pieces
back to the next chunk.  At the end of a partition such a window is cut at powers of two,
which need no padding.
"""

from __future__ import annotations

from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_bytes, kept_by_worker, small_batches

WORDS_KEPT = 300_000
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
LATIN = "\u0100"
#: Byte-level vocabularies write bytes without a printable Latin-1 character as letters from 256 on.
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
PIECES = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class WordIds(dict):
    """ids of a word (lower-cased bytes) as little-endian uint32 bytes.

    The vocabularies used here lower-case, split at ASCII white space and drop it, so a text's ids
    are its words' ids in order, and a word of letters (and signs after them) is one merge of its
    letters; ``tests/llm`` checks this against the whole-text call.  At most two generations of ``WORDS_KEPT`` words are
    remembered; a Python worker keeps them over its tasks."""

    def __init__(self, path: str, kept: int = WORDS_KEPT):
        from tokenizers import Tokenizer
        super().__init__()
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.model = self.tok.model
        self.older: dict[bytes, bytes] = {}
        self.kept = kept

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            text = word.decode("utf-8", "replace")
            head = text.rstrip(SIGNS)
            if head.isalpha() and (head.isascii() or max(head) < LATIN):
                letters = head if head.isascii() else head.lower().encode().decode("latin-1").translate(BYTE_LETTERS)
                ids = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
                if len(head) < len(text):
                    ids += self[text[len(head):].encode()]
            else:
                ids = array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self) >= self.kept:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def of(self, text: bytes | None) -> bytes:
        return b"".join(map(self.__getitem__, (text or b"").lower().split()))


class Capacities:
    """Segment tree over remaining capacities; a leaf holds the open windows with that capacity."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: dict[int, list[int]] = defaultdict(list)

    def add(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        node = capacity + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take_tightest(self, need: int) -> tuple[int, int] | None:
        """Remove and return (capacity, window) of the smallest capacity >= need."""
        count, node = self.count, need + self.leaves
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1  # up, until a right sibling holds a window
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        while node:
            count[node] -= 1
            node >>= 1
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths, window: int) -> list[list[int]]:
    """Windows as lists of item numbers; every length is 1..window."""
    order = np.argsort(-np.asarray(lengths, np.int64), kind="stable")
    tree, windows = Capacities(window), []
    for i in order.tolist():
        length = int(lengths[i])
        found = tree.take_tightest(length)
        if found is None:
            capacity, w = window, len(windows)
            windows.append([])
        else:
            capacity, w = found
        windows[w].append(i)
        if capacity > length:
            tree.add(capacity - length, w)
    return windows


def power_cuts(total: int) -> list[int]:
    """Descending powers of two that add up to ``total``."""
    return [1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1]


def _pack_partition(names: list[str], tokenizer: str, window: int, end_id: int, chunk_tokens: int, max_pad: int,
                    words_kept: int):
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches):
        sequence = (TaskContext.get().partitionId()) << 36
        words = kept_by_worker(f"ids of {tokenizer}", lambda: WordIds(tokenizer, words_kept))
        items: list[tuple] = []  # (row of kept columns, start, ids, doc_tokens)
        held, schema = 0, None

        def rows(out):
            arrays = [pa.array([r[0][k] for r in out], schema.field(n).type) for k, n in enumerate(names)]
            arrays += [pa.array([r[k] for r in out], t) for k, t in
                       ((1, pa.int64()), (2, pa.int64()), (3, pa.binary()), (4, pa.int64()), (5, pa.int64()), (6, pa.int64()))]
            return pa.RecordBatch.from_arrays(arrays, names + ["start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        def pack(last: bool):
            nonlocal items, held, sequence
            out, back = [], []
            for w in best_fit_decreasing([len(x[2]) // 4 for x in items], window):
                used = sum(len(items[i][2]) for i in w) // 4
                loose = window - used > max_pad
                if loose and not last:
                    back.extend(items[i] for i in w)
                    continue
                cuts = power_cuts(used) if loose else [used]
                room, offset = cuts.pop(0), 0
                for i in w:
                    row, start, ids, total = items[i]
                    while ids:
                        n = min(len(ids) // 4, room - offset)
                        out.append((row, start, n, ids[:4 * n], total, sequence, offset))
                        start, ids, offset = start + n, ids[4 * n:], offset + n
                        if offset == room and (cuts or ids):
                            room, offset, sequence = cuts.pop(0), 0, sequence + 1
                sequence += 1
            # pieces that came back unplaced could fill a chunk by themselves only if none fits another
            items, held = back, sum(len(x[2]) for x in back) // 4
            for at in range(0, len(out), 5000):
                yield rows(out[at:at + 5000])

        for batch in batches:
            schema = batch.schema
            kept = list(zip(*[batch.column(n).to_pylist() for n in names], strict=True)) if names else [()] * batch.num_rows
            texts = column_bytes(batch, "__text")
            for lo in range(0, len(texts), 500):
                full = []
                for row, text in zip(kept[lo:lo + 500], texts[lo:lo + 500], strict=True):
                    ids = words.of(text) + end
                    total = len(ids) // 4
                    cut = total - total % window
                    for s in range(0, cut, window):
                        full.append((row, s, window, ids[4 * s:4 * (s + window)], total, sequence, 0))
                        sequence += 1
                    if cut < total:
                        items.append((row, cut, ids[4 * cut:], total))
                        held += total - cut
                if full:
                    yield rows(full)
                if held >= chunk_tokens:
                    before = held
                    yield from pack(False)
                    if held > before // 2:
                        yield from pack(True)
        if items:
            yield from pack(True)

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, text_col: str = "text",
         keep: tuple[str, ...] = ("doc_id",), chunk_tokens: int = 2_000_000, max_pad: int = 32,
         words_kept: int = WORDS_KEPT) -> DataFrame:
    """Pieces of all documents in windows: ``keep`` columns, start, length, ids (uint32 bytes), doc_tokens, sequence_id, offset.

    * a null or empty text is a document of the end id alone; very long texts span many windows;
    * repeated rows are packed as documents of their own; ties go in reading order;
    * null ids stay null; an empty table gives no pieces; other columns of ``docs`` are ignored.
    ``sequence_id`` is unique over the result; offsets in a sequence are gapless from 0.  A window
    left with more than ``max_pad`` free places at the end of a partition is cut at powers of two."""
    if window < 2:
        raise ValueError("window must be at least 2")
    src = small_batches(docs).select(*[F.col(f"`{c}`").alias(c) for c in keep], F.col(f"`{text_col}`").cast("binary").alias("__text"))
    schema = T.StructType([src.schema[c] for c in keep] + T._parse_datatype_string(PIECES).fields)
    return src.mapInArrow(_pack_partition(list(keep), tokenizer, window, end_id, chunk_tokens, max_pad, words_kept), schema)


def piece_digests(pieces: DataFrame, *more: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of packed pieces, and the columns ``more``."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", *more)
