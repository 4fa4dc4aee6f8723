"""Removal of repeated word windows by level-wise doubling.

A word is removed where a window of ``length`` words covers it whose words also start in a document with a
smaller id.  Windows are found level by level: lengths double up to ``length`` (7, 13 for 13 words; 7, 13,
25, 50 for 50), and a window is looked at only if the windows of the level before, at its begin and at its
end, are repeated in another document; their two hashes are its hash.  When no candidate survives a level, the search ends.

The first level takes a part of the windows: of every run of consecutive windows that a window of the next level
covers, the one with the smallest hash (its anchor).  Equal text has equal anchors, so no repeat is missed.

At each level the tasks send (hash, document) to hash buckets, which answer with the repeated hashes of each
document.  Hashes that a task meets often go on a bounded list instead, which is broadcast with the
smallest document of each; the others cannot load a bucket.  Between levels only places and hashes travel.  Texts are joined with
the answers twice, each time behind a Bloom filter of the documents that have one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_bytes, grouped_stream, key_filter, longs, mixed, passing, row_key, shuffle_width, small_batches, window_hashes, write_shared
from .words import batch_codes

HELD = 750_000
LOCAL_OFTEN = 3
NULL_FROM = 1 << 62  # orders from here on belong to rows without an id
FIRST_LENGTH = 7
PAIRED = np.uint64(0xA24BAED4963EE407)


def level_lengths(length: int) -> list[int]:
    out = [length]
    while out[-1] > FIRST_LENGTH:
        out.append(-(-out[-1] // 2))
    return out[::-1]


def order_column(id_col: str, key: str):
    """Place of a row by id; rows without an id come after all others, none before another."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_FROM) + F.col(key).bitwiseAND(F.lit(NULL_FROM - 1)))


def anchors(h: np.ndarray, span: int) -> np.ndarray:
    """For every run of ``span`` consecutive hashes, the place of the smallest (the first of equal ones)."""
    if len(h) < span:
        return np.empty(0, np.int64)
    low, at, have = h, np.arange(len(h)), 1
    while have < span:  # runs of twice the length, until the run is full
        step = min(have, span - have)
        n = len(low) - step
        later = low[step:] < low[:n]
        low, at = np.where(later, low[step:], low[:n]), np.where(later, at[step:], at[:n])
        have += step
    return at


class First:
    """Level 0 of a text: window hashes and, for each window of level 1, its anchor."""

    def __init__(self, levels: list[int]):
        self.width, self.after = levels[0], levels[1] if len(levels) > 1 else levels[0]

    def hashes(self, codes: np.ndarray) -> np.ndarray:
        h = window_hashes(codes, self.width)
        return h[np.unique(anchors(h, self.after - self.width + 1))]

    def candidates(self, codes: np.ndarray, *tables: np.ndarray, but: np.ndarray | None = None):
        """(starts, hashes) of the windows of level 1 whose anchor is in a table (and not in ``but``)."""
        h = window_hashes(codes, self.width)
        own = h[anchors(h, self.after - self.width + 1)]
        hit = np.zeros(len(own), bool)
        for t in tables:
            hit |= lookup(t, own)[0]
        if but is not None:
            hit &= ~lookup(but, own)[0]
        s = np.flatnonzero(hit)
        return s, doubled(h, self.width, self.after)[s] if len(s) else h[:0]


def doubled(h: np.ndarray, width: int, after: int) -> np.ndarray:
    """Hashes of windows of ``after`` words from those of ``width`` words, one per start: begin and end windows."""
    d = after - width
    return h if not d else mixed(h[:-d] * PAIRED + h[d:])


def lookup(table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found, place) of hashes in a sorted table."""
    if not len(table) or not len(h):
        return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return table[at] == h, at


# often repeated hashes --------------------------------------------------------------------------------

def _pairs(read):
    """Chunks of (hash, order) of distinct pairs, from an iterator of (order, hashes) of documents."""
    hs, os, size = [], [], 0
    for order, h in read:
        u = np.unique(h)
        hs.append(u)
        os.append(np.full(len(u), order, np.int64))
        size += len(u)
        if size >= HELD:
            yield np.concatenate(hs), np.concatenate(os)
            hs, os, size = [], [], 0
    if size:
        yield np.concatenate(hs), np.concatenate(os)


def _sorted_groups(h, o):
    order = np.lexsort((o, h))
    h, o = h[order], o[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h, o, first, np.diff(np.append(first, len(h)))


def _often_rows(reader):
    def run(batches):
        for h, o in _pairs(reader(batches)):
            h, o, first, n = _sorted_groups(h, o)
            keep = n >= LOCAL_OFTEN
            f, n = first[keep], n[keep]
            yield pa.RecordBatch.from_arrays([pa.array(h[f].view(np.int64)), pa.array(n.astype(np.int64)), pa.array(o[f]), pa.array(o[f + n - 1])],
                                             ["h", "n", "lo", "hi"])

    return run


def often(rows: DataFrame, reader, least: bool, kept: int = 250_000) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes, and with ``least`` the smallest order of each: the most frequent ones that several documents hold."""
    found = (rows.mapInArrow(_often_rows(reader), "h long, n long, lo long, hi long").groupBy("h")
             .agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo < hi")
             .orderBy(F.col("n").desc(), "h").limit(kept).select("h").toArrow())
    h = np.sort(found.column("h").to_numpy().view(np.uint64))
    if not len(h) or not least:
        return h, np.empty(0, np.int64)
    least = rows.mapInArrow(_least(reader, h), "at int, lo long").groupBy("at").agg(F.min("lo").alias("lo")).toArrow()
    lo = np.full(len(h), np.iinfo(np.int64).max)
    lo[least.column("at").to_numpy()] = least.column("lo").to_numpy()
    return h, lo


def _least(reader, table: np.ndarray):
    def run(batches):
        lo = np.full(len(table), np.iinfo(np.int64).max)
        for order, h in reader(batches):
            hit, at = lookup(table, h)
            at = at[hit]
            lo[at] = np.minimum(lo[at], order)
        at = np.flatnonzero(lo != np.iinfo(np.int64).max)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(lo[at])], ["at", "lo"])

    return run


# buckets ------------------------------------------------------------------------------------------------

def _send(reader, table: np.ndarray, buckets: int):
    """Rows (bucket, h, o): pairs whose hash is not on the list."""
    def run(batches):
        for h, o in _pairs(reader(batches)):
            hit, _ = lookup(table, h)
            h, o = h[~hit], o[~hit]
            bucket = (mixed(h) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            h, o, bucket = h[order], o[order], bucket[order]
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(h) else np.zeros(1, np.int64)
            for lo in range(0, len(cut) - 1, 256):
                part = [(cut[i], cut[i + 1]) for i in range(lo, min(lo + 256, len(cut) - 1))]
                yield pa.RecordBatch.from_arrays([pa.array([int(bucket[a]) for a, _ in part], pa.int32()), pa.array([h[a:b].tobytes() for a, b in part], pa.binary()),
                                                  pa.array([o[a:b].tobytes() for a, b in part], pa.binary())], ["bucket", "h", "o"])

    return run


def _answer(smaller_only: bool):
    """Per bucket: (order, hash) of hashes that another document holds as well / that a smaller one holds."""
    def run(batches):
        for _, g in grouped_stream(batches, "bucket", ["h", "o"]):
            h, o, first, n = _sorted_groups(np.concatenate([np.frombuffer(x, np.uint64) for x in g["h"]]),
                                            np.concatenate([np.frombuffer(x, np.int64) for x in g["o"]]))
            lo, hi = np.repeat(o[first], n), np.repeat(o[first + n - 1], n)
            keep = (lo < o) & (lo < NULL_FROM) if smaller_only else lo < hi
            h, o = h[keep], o[keep]
            for at in range(0, len(h), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(o[at:at + 50_000]), pa.array(h[at:at + 50_000].view(np.int64))], ["ord", "hash"])

    return run


def repeated(rows: DataFrame, reader, table: np.ndarray, smaller_only: bool) -> DataFrame:
    """(ord, hs): for each document the repeated hashes that are not on the list."""
    p = shuffle_width(rows.sparkSession)
    return (rows.mapInArrow(_send(reader, table, 4 * p), "bucket int, h binary, o binary")
            .repartition(p, "bucket").sortWithinPartitions("bucket").mapInArrow(_answer(smaller_only), "ord long, hash long")
            .groupBy("ord").agg(F.collect_list("hash").alias("hs")))


def _known(hs) -> np.ndarray:
    """Sorted hashes of an Arrow list of longs (or nothing)."""
    return np.sort(np.asarray(hs.values, np.int64).view(np.uint64)) if hs.is_valid else np.empty(0, np.uint64)


# readers: (order, hashes) of the documents of a task ------------------------------------------------------

def _first_reader(levels):
    def read(batches):
        first = First(levels)
        for batch in batches:
            for order, codes in zip(longs(batch, "ord", 0).tolist(), batch_codes(batch, "__text"), strict=True):
                yield order, first.hashes(codes)

    return read


def _table_reader(batches):
    for batch in batches:
        for order, h in zip(longs(batch, "ord", 0).tolist(), batch.column("h").to_pylist(), strict=True):
            yield order, np.frombuffer(h, np.uint64)


# levels ---------------------------------------------------------------------------------------------------

WINDOWS = "key long, ord long, starts binary, h binary"


def _window_batch(keys, orders, found):
    keep = [i for i, (s, _) in enumerate(found) if len(s)]
    return pa.RecordBatch.from_arrays([pa.array([keys[i] for i in keep], pa.int64()), pa.array([orders[i] for i in keep], pa.int64()),
                                       pa.array([found[i][0].astype(np.int32).tobytes() for i in keep], pa.binary()),
                                       pa.array([found[i][1].tobytes() for i in keep], pa.binary())], ["key", "ord", "starts", "h"])


def _plain_rows(levels: list[int], table: np.ndarray):
    """Every row as if nothing were removed, and its candidates of level 1 whose anchor is on the list."""
    def run(batches):
        first = First(levels)
        for batch in batches:
            words, digests, starts, hashes = [], [], [], []
            for text, codes in zip(column_bytes(batch, "__text"), batch_codes(batch, "__text"), strict=True):
                words.append(len(codes))
                digests.append(hashlib.sha256(b" ".join((text or b"").split())).hexdigest())
                s, h = first.candidates(codes, table)
                starts.append(s.astype(np.int32).tobytes())
                hashes.append(h.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in ("doc_id", "key", "ord")] + [
                pa.array(words, pa.int64()), pa.array(digests, pa.string()), pa.array(starts, pa.binary()), pa.array(hashes, pa.binary())],
                ["doc_id", "key", "ord", "n_words", "kept_sha256", "starts", "h"])

    return run


def _answered_rows(levels: list[int], table: np.ndarray):
    """Candidates of level 1 whose anchor is among the document's answers."""
    def run(batches):
        first = First(levels)
        for batch in batches:
            found = [first.candidates(codes, _known(hs), but=table) for codes, hs in zip(batch_codes(batch, "__text"), batch.column("hs"), strict=True)]
            yield _window_batch(batch.column("key").to_pylist(), batch.column("ord").to_pylist(), found)

    return run


def _surviving(batch, table, least=None):
    """Per row: (order, starts, hashes) of the windows that are repeated; with ``least``, in a smaller document."""
    for order, s, h, hs in zip(batch.column("ord").to_pylist(), batch.column("starts").to_pylist(), batch.column("h").to_pylist(), batch.column("hs"), strict=True):
        s, h = np.frombuffer(s, np.int32).astype(np.int64), np.frombuffer(h, np.uint64)
        listed, at = lookup(table, h)
        if least is not None and listed.any():
            listed &= (least[at] < order) & (least[at] < NULL_FROM)
        keep = listed | lookup(_known(hs), h)[0]
        yield order, s[keep], h[keep]


def _next_level(width: int, after: int, table: np.ndarray):
    """Candidates of a later level: windows whose first and last window of ``width`` words are both repeated."""
    def run(batches):
        for batch in batches:
            found = []
            for _, s, h in _surviving(batch, table):
                s, one = np.unique(s, return_index=True)
                h, d = h[one], after - width
                ends = np.searchsorted(s, s + d)
                both = s[np.minimum(ends, len(s) - 1)] == s + d if len(s) else np.zeros(0, bool)
                found.append((s[both], mixed(h[both] * PAIRED + h[ends[both]])))
            yield _window_batch(batch.column("key").to_pylist(), batch.column("ord").to_pylist(), found)

    return run


def _to_remove(table: np.ndarray, least: np.ndarray):
    def run(batches):
        for batch in batches:
            found = [s for _, s, _ in _surviving(batch, table, least)]
            keep = [i for i, s in enumerate(found) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([batch.column("key")[i].as_py() for i in keep], pa.int64()),
                                              pa.array([found[i].astype(np.int32).tobytes() for i in keep], pa.binary())], ["key", "starts"])

    return run


def _removed(length: int):
    def run(batches):
        for batch in batches:
            counts, digests, kept = [], [], []
            for text, starts in zip(column_bytes(batch, "__text"), batch.column("starts").to_pylist(), strict=True):
                words = (text or b"").split()
                edge = np.zeros(len(words) + 1, np.int64)
                for s in starts:
                    s = np.frombuffer(s, np.int32)
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                left = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                counts.append(int(gone.sum()))
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary())],
                                             ["key", "n_removed", "sha", "kept"])

    return run


def _starts_to_remove(texts: DataFrame, plain: DataFrame, levels: list[int], table: np.ndarray) -> DataFrame | None:
    """(key, starts as an array of binaries) of the windows of the last level that a smaller document has as well."""
    reader = _first_reader(levels)
    found = write_shared(repeated(texts.select("ord", "__text"), reader, table, False), "answers")
    asked = passing(texts, "ord", key_filter(found, "ord")).join(found, "ord").select("key", "ord", "__text", "hs")
    rest = asked.mapInArrow(_answered_rows(levels, table), WINDOWS)
    listed = plain.filter(F.octet_length("starts") > 0).select("key", "ord", "starts", "h")
    now = write_shared(listed.unionByName(rest), "windows")
    for k in range(1, max(2, len(levels))):
        if now.isEmpty():
            return None
        last = k >= len(levels) - 1
        if not last:  # a document's windows must be together for the next level
            now = now.groupBy("key", "ord").agg(F.collect_set(F.struct("starts", "h")).alias("x")).select(
                "key", "ord", _joined("x.starts").alias("starts"), _joined("x.h").alias("h"))
        pairs = now.select("ord", "h")
        table, least = often(pairs, _table_reader, last)
        found = repeated(pairs, _table_reader, table, last)
        told = now.join(found, "ord", "left").select("key", "ord", "starts", "h", "hs")
        if last:
            return told.mapInArrow(_to_remove(table, least), "key long, starts binary").groupBy("key").agg(F.collect_set("starts").alias("starts"))
        now = write_shared(told.mapInArrow(_next_level(levels[k], levels[k + 1], table), WINDOWS), "windows")
    return None


def _joined(col: str):
    return F.aggregate(col, F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b))


def remove_repeats(docs: DataFrame, length: int = 13, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and (``keep_text``) kept of every row.

    Words are runs without ASCII white space, unchanged; kept words are joined by one space (``kept`` is null
    where nothing is removed: the row's own text stands).

    * null, empty and blank texts have no words; texts shorter than ``length`` keep all words;
    * rows with equal ids do not remove each other's words; rows with a null id come after all others and
      remove nothing from each other; ids are below 2^62; repeated rows get equal results;
    * an empty table gives an empty result; other columns are ignored."""
    if length < 2:
        raise ValueError("length must be at least 2")
    levels = level_lengths(length)
    texts = small_batches(docs).select(F.col(f"`{id_col}`").alias("doc_id"), row_key(id_col, text_col).alias("key"), F.col(f"`{text_col}`").cast("binary").alias("__text"))
    texts = texts.withColumn("ord", order_column("doc_id", "key"))
    table, _ = often(texts.select("ord", "__text"), _first_reader(levels), False)
    schema = T.StructType([texts.schema["doc_id"], texts.schema["key"], texts.schema["ord"], T.StructField("n_words", T.LongType()),
                           T.StructField("kept_sha256", T.StringType()), T.StructField("starts", T.BinaryType()), T.StructField("h", T.BinaryType())])
    plain = write_shared(texts.mapInArrow(_plain_rows(levels, table), schema), "plain")
    starts = _starts_to_remove(texts.select("key", "ord", "__text"), plain, levels, table)
    none = F.lit(None).cast("string")
    if starts is None:
        out = plain.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", none.alias("kept"))
    else:
        starts = write_shared(starts, "removals")
        told = passing(texts.select("key", "__text"), "key", key_filter(starts, "key")).join(starts, "key").select("key", "__text", "starts")
        found = told.mapInArrow(_removed(length), "key long, n_removed long, sha string, kept binary").select(
            "key", "n_removed", "sha", (F.col("kept").cast("string") if keep_text else none).alias("kept")).dropDuplicates(["key"])
        out = (plain.select("doc_id", "key", "n_words", "kept_sha256").join(found, "key", "left")
               .select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("sha", "kept_sha256").alias("kept_sha256"), "kept"))
    return out if keep_text else out.drop("kept")
