"""Periodic runs of words, found with a suffix automaton whose link tree is held as a link-cut forest.

A text's words are appended one after another.  Each one accesses the path from its prefix's state to the root, and
recolours it with the word's place: a path segment of one colour consists of the suffixes that ended last at that place.  If
the segment's longest suffix has L words and the two ends are d apart, with d <= L, the words around are a square of period d,
and the stretch of L + d words up to here has period d.  It cannot be extended to the left (L is the segment's greatest
length), and it is a run where the next word breaks the period.  A segment tells the last occurrence, so d is the smallest period.

The automaton costs some microseconds a word, so it reads only the stretches of a text that can hold a run: in a run of
period q and exponent 4, every window of 2^k <= q words after the first q words occurred less than 2^(k+1) words earlier.
Stretches where that holds are found with window hashes for all k at once over a block of texts; each, with the words
around it, holds every run of its level in full.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_bytes, mixed, small_batches
from .words import batch_codes

BLOCK_WORDS = 1 << 17
_ODD = np.uint64(0x9E3779B97F4A7C15)
_DOC = np.uint64(0xD1342543DE82EF95)


def automaton(words) -> tuple[array, array, array]:
    """(longest length of each state, suffix link of each state, state of each prefix); state 0 is the root.

    A state's first transition lies in two arrays, further ones in a dictionary: nearly all states have one."""
    size, link, word, to, more = array("i", [0]), array("i", [-1]), array("i", [-1]), array("i", [0]), {}
    prefix, last = array("i"), 0
    for c in words:
        cur = len(size)
        size.append(size[last] + 1)
        link.append(0)
        word.append(-1)
        to.append(0)
        p, q = last, -1
        while p >= 0:
            w = word[p]
            if w == c:
                q = to[p]
                break
            if w < 0:
                word[p], to[p] = c, cur
            elif p in more:
                q = more[p].setdefault(c, cur)
                if q != cur:
                    break
                q = -1
            else:
                more[p] = {c: cur}
            p = link[p]
        if q >= 0:
            if size[q] == size[p] + 1:
                link[cur] = q
            else:
                clone = len(size)
                size.append(size[p] + 1)
                link.append(link[q])
                word.append(word[q])
                to.append(to[q])
                if q in more:
                    more[clone] = more[q].copy()
                link[q] = link[cur] = clone
                while p >= 0:
                    if word[p] == c:
                        if to[p] != q:
                            break
                        to[p] = clone
                    elif p in more and more[p].get(c) == q:
                        more[p][c] = clone
                    else:
                        break
                    p = link[p]
        last = cur
        prefix.append(cur)
    return size, link, prefix


class LinkCutForest:
    """Preferred paths of a forest as splay trees ordered by depth; a path's colour lies at its splay tree's root."""

    def __init__(self, parent):
        self.up = array("i", parent)
        self.left = array("i", [-1]) * len(self.up)
        self.right = array("i", [-1]) * len(self.up)
        self.colour = array("i", [-1]) * len(self.up)

    def _rotate(self, x: int, y: int, z: int) -> None:
        """Lift x above its parent y, whose parent is z (a path parent where y is a root)."""
        up, left, right = self.up, self.left, self.right
        if left[y] == x:
            b = right[x]
            left[y], right[x] = b, y
        else:
            b = left[x]
            right[y], left[x] = b, y
        if b >= 0:
            up[b] = y
        if z >= 0:
            if left[z] == y:
                left[z] = x
            elif right[z] == y:
                right[z] = x
        up[y], up[x] = x, z

    def splay(self, x: int) -> None:
        up, left, right, colour, rotate = self.up, self.left, self.right, self.colour, self._rotate
        while True:
            y = up[x]
            if y < 0 or (left[y] != x and right[y] != x):
                return
            z = up[y]
            if z < 0 or (left[z] != y and right[z] != y):
                colour[x] = colour[y]
                rotate(x, y, z)
                return
            t = up[z]
            at_root = t < 0 or (left[t] != z and right[t] != z)
            if at_root:
                colour[x] = colour[z]
            if (left[y] == x) == (left[z] == y):
                rotate(y, z, t)
                rotate(x, y, t)
            else:
                rotate(x, y, z)
                rotate(x, z, t)
            if at_root:
                return

    def access(self, v: int, colour: int) -> list[tuple[int, int]]:
        """Recolour the path from v to its root; (lowest node, colour before) of the segments it had, from v upwards."""
        up, right, colours = self.up, self.right, self.colour
        segments, below, u = [], -1, v
        while u >= 0:
            self.splay(u)
            before = colours[u]
            if before >= 0:
                segments.append((u, before))
            deeper = right[u]
            if deeper >= 0:
                colours[deeper] = before
            right[u] = below
            below, u = u, up[u]
        colours[below] = colour
        return segments


def runs_of(words: list[int], exponent: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs with length >= max(least, exponent * period), by start and period; exponent >= 2."""
    size, link, prefix = automaton(words)
    forest = LinkCutForest([p if p > 0 else -1 for p in link])
    forest.up[0] = -1
    n, out = len(words), []
    for i in range(n):
        for node, before in forest.access(prefix[i], i):
            d, longest = i - before, size[node]
            length = longest + d
            if length >= exponent * d and length >= least and (i + 1 == n or words[i + 1] != words[i + 1 - d]):
                out.append((i - length + 1, length, d))
    return sorted(out, key=lambda r: (r[0], r[2]))


def stretches(codes: np.ndarray, ends: np.ndarray, exponent: int = 4, least: int = 6) -> list[tuple[int, int]]:
    """Stretches [lo, hi) of the word codes of several texts (text k ends before ``ends[k]``) that hold every run in full,
    with the words beside it.  Equal hashes of different windows only make more stretches."""
    n = len(codes)
    begins = np.concatenate([[0], ends[:-1]])
    lengths = ends - begins
    doc = np.repeat(np.arange(len(ends)), lengths)
    bits = np.uint64(max(1, int(n).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    found, wide, hashes, power = [], 1, codes, _ODD
    longest = int(lengths.max()) if len(lengths) else 0
    with np.errstate(over="ignore"):
        while exponent * wide <= longest and longest >= least:
            at = np.flatnonzero((lengths[doc[:len(hashes)]] >= exponent * wide) & (np.arange(len(hashes)) + wide <= ends[doc[:len(hashes)]]))
            keys = (mixed(hashes[at] + doc[at].astype(np.uint64) * _DOC) & ~low) | at.astype(np.uint64)
            keys.sort()
            place = (keys & low).astype(np.int64)
            near = ((keys[1:] ^ keys[:-1]) <= low) & (place[1:] - place[:-1] < 2 * wide)
            hit = np.sort(place[1:][near])
            if len(hit):
                cut = np.flatnonzero((np.diff(hit) != 1) | (doc[hit[1:]] != doc[hit[:-1]])) + 1
                first, last = hit[np.concatenate([[0], cut])], hit[np.concatenate([cut - 1, [len(hit) - 1]])]
                # windows of a run after its first q words: at least exponent * q - q - wide + 1 of them, q >= wide
                most = max((exponent - 2) * wide + 1, least - 1 if wide == 1 else 0)
                for a, b in zip(first[last - first + 1 >= most].tolist(), last[last - first + 1 >= most].tolist(), strict=True):
                    found.append((max(a - 2 * wide, int(begins[doc[a]])), min(b + wide + 1, int(ends[doc[a]]))))
            if len(hashes) <= wide:
                break
            hashes = hashes[:-wide] * power + hashes[wide:]
            power, wide = power * power, 2 * wide
    merged = []
    for lo, hi in sorted(found):
        if merged and lo < merged[-1][1] and doc[lo] == doc[merged[-1][0]]:
            merged[-1][1] = max(hi, merged[-1][1])
        else:
            merged.append([lo, hi])
    return [(lo, hi) for lo, hi in merged]


def _block_runs(texts: list[np.ndarray], exponent: int, least: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, given as word codes."""
    ends = np.cumsum([len(t) for t in texts])
    out = [[] for _ in texts]
    if not len(texts) or not ends[-1]:
        return out
    codes = np.concatenate(texts)
    for lo, hi in stretches(codes, ends, exponent, least):
        k = int(np.searchsorted(ends, lo, "right"))
        begin = int(ends[k]) - len(texts[k])
        words = np.unique(codes[lo:hi], return_inverse=True)[1].tolist()
        out[k] += [(s + lo - begin, length, d) for s, length, d in runs_of(words, exponent, least)]
    return out


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words that lie in no run, or only among the first words of runs, one period each."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


RUN = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())])


def _detect(names: list[str], exponent: int, least: int):
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def some(batch, texts, codes, lo):
        found = _block_runs(codes, exponent, least)
        kept = []
        for text, runs in zip(texts[lo:lo + len(codes)], found, strict=True):
            words = (text or b"").split()
            kept.append(b" ".join(_collapsed(words, runs) if runs else words))
        part = batch.slice(lo, len(codes))
        rows = [[{"start": s, "length": n, "period": d} for s, n, d in runs] for runs in found]
        return pa.RecordBatch.from_arrays([part.column(n) for n in names] + [pa.array(rows, run_type), pa.array(kept, pa.binary())],
                                          [*names, "runs", "collapsed"])

    def run(batches):
        for batch in batches:
            texts = column_bytes(batch, "__text")
            codes, words, lo = [], 0, 0
            for c in batch_codes(batch, "__text"):
                codes.append(c)
                words += len(c)
                if words >= BLOCK_WORDS:
                    yield some(batch, texts, codes, lo)
                    lo, codes, words = lo + len(codes), [], 0
            if codes:
                yield some(batch, texts, codes, lo)

    return run


def find_runs(docs: DataFrame, exponent: int = 4, least: int = 6, text_col: str = "text",
              keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, runs (array of start, length, period; by start, then period) and collapsed (text) of every row.

    A run is a stretch of consecutive words with smallest period q (words q apart are equal) and at least
    max(``least``, ``exponent`` * q) words that no neighbouring word extends with that period.  The collapsed text
    lacks the words that lie in a run after its first q words; the others are joined by one space.

    * words are runs without ASCII white space, told apart by 64-bit codes; an empty, blank or null text has no runs and collapses to an empty one;
    * very long texts are read whole; what the automaton takes (some 70 bytes a word) grows with the longest stretch that repeats itself;
    * overlapping runs of several periods (ties) all count; repeated rows are judged one by one, null ids stay null;
    * an empty table gives an empty result; other columns are ignored, whatever their names.

    Texts are judged where they are read: nothing is shuffled, so no group of copies lands in one task."""
    if exponent < 3:
        raise ValueError("exponent must be at least 3")
    src = small_batches(docs).select(*[F.col(f"`{c}`").alias(c) for c in keep], F.col(f"`{text_col}`").cast("binary").alias("__text"))
    schema = T.StructType([src.schema[c] for c in keep] + [T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.BinaryType())])
    return src.mapInArrow(_detect(list(keep), exponent, least), schema).withColumn("collapsed", F.col("collapsed").cast("string"))


def run_digests(found: DataFrame, *keep: str) -> DataFrame:
    """``keep``, n_runs, the longest run (start, length, period, exponent_milli) and the digests of runs and collapsed text."""
    longest = F.expr("array_min(transform(runs, r -> struct(-r.length AS length, r.start AS start, r.period AS period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return (found.withColumn("__best", longest)
            .select(*keep, F.size("runs").cast("long").alias("n_runs"), F.col("__best.start").alias("start"),
                    (-F.col("__best.length")).alias("length"), F.col("__best.period").alias("period"),
                    F.expr("(-1000 * __best.length) div __best.period").alias("exponent_milli"),
                    F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))

