"""N-gram Jaccard join with a prefix tree, and the classes it links documents into.

A document's set is its distinct word n-grams (as 64-bit hashes).  Two documents link when the Jaccard
similarity of their sets reaches the threshold.

1. Equal sets are one class: a fingerprint of the set names it, so copies cost nothing further.
2. Candidates: all sets are brought into one global order of n-grams, rare before frequent.  Sets that
   link must share an n-gram among their first n - ceil(t * n) + 1.  The tasks send (n-gram, class) of these
   prefixes to hash buckets, which answer with the lists of classes that share one.  The order rests on a bounded list of
   frequent n-grams; results do not depend on the list, only the number of candidates does.
   Within a list, classes are compared by a parity bitmap of about one bit per n-gram: the bits in which two bitmaps
   differ are a lower bound of the n-grams in which the sets differ, so no link is lost, while texts that merely share a passage
   part here.  Components of the pairs that remain are the groups that can contain links.
3. Verification: the sets of a group are stored in a trie, n-grams that most of them share first.  Each
   set traverses the trie; the overlap with a shared path is counted once for all sets below it, and a subtree is left
   as soon as the remaining lengths cannot reach the threshold.  Sets found are taken out of the trie: only their
   class is wanted, and they go on as probes themselves.  Groups beyond ``unit_size`` n-grams are
   split into blocks, and every pair of blocks is a task of its own, so no group has to fit one task.
4. The links found are joined to components; nothing is dropped or capped on the way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import few_files, fresh, grouped_stream, key_filter, mixed, passing_rows, row_key, shuffle_width, small_batches, window_hashes, write_shared
from .components import connected_components
from .words import batch_codes, word_codes

HELD = 750_000
LOCAL_OFTEN = 3


def distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    keep = np.empty(len(h), bool)
    keep[:1] = True
    np.not_equal(h[1:], h[:-1], out=keep[1:])
    return h[keep]


def set_of(codes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; fewer words are one n-gram; no words: empty."""
    return distinct(window_hashes(codes, width if len(codes) >= width else len(codes))) if len(codes) else codes


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    return set_of(word_codes(text or b"", True), width)


def fingerprint(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s)) - (1 << 63)


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def links(overlap: int, a: int, b: int, num: int, den: int) -> bool:
    return den * overlap >= num * (a + b - overlap)


# frequent n-grams -----------------------------------------------------------------------------------

def local_counts(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, n = np.unique(h, return_counts=True)
    often = n >= LOCAL_OFTEN
    return u[often], n[often]


def _often_rows(width: int):
    def run(batches):
        held, size = [], 0

        def out():
            u, n = local_counts(np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

        for batch in batches:
            for codes in batch_codes(batch, "__text", True):
                s = set_of(codes, width)
                held.append(s)
                size += len(s)
                if size >= HELD:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    return run


def frequent(texts: DataFrame, width: int, kept: int = 300_000) -> np.ndarray:
    """Up to ``kept`` n-grams found several times by the same task, from rare to frequent.  An aid to the order alone."""
    rows = (texts.mapInArrow(_often_rows(width), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
            .orderBy(F.col("n").desc(), "h").limit(kept).toArrow())
    return rows.column("h").to_numpy().view(np.uint64)[::-1].copy()


# candidates -----------------------------------------------------------------------------------------

class Order:
    """The global order: hash order, with the frequent n-grams after all others, rare to frequent."""

    def __init__(self, often: np.ndarray):
        self.rank = np.argsort(often, kind="stable")  # place in ``often`` of each sorted value
        self.sorted = often[self.rank]

    def prefix(self, s: np.ndarray, length: int) -> np.ndarray:
        if not len(self.sorted):
            return s[:length]
        at = np.minimum(np.searchsorted(self.sorted, s), len(self.sorted) - 1)
        common = self.sorted[at] == s
        rare = s[~common]
        if len(rare) >= length:
            return rare[:length]
        late = s[common][np.argsort(self.rank[at[common]], kind="stable")]
        return np.concatenate([rare, late[:length - len(rare)]])


PAYLOAD = "bucket int, h binary, c binary"
LIST_BLOCK = 10_000


def send(h: np.ndarray, c: np.ndarray, buckets: int):
    """Payload rows of a task: its (n-gram, class) pairs by bucket."""
    bucket = (mixed(h) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    h, c, bucket = h[order], c[order], bucket[order]
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    for lo in range(0, len(cut) - 1, 256):
        part = [(cut[i], cut[i + 1]) for i in range(lo, min(lo + 256, len(cut) - 1))]
        yield pa.RecordBatch.from_arrays([pa.array([int(bucket[a]) for a, _ in part], pa.int32()), pa.array([h[a:b].tobytes() for a, b in part], pa.binary()),
                                          pa.array([c[a:b].tobytes() for a, b in part], pa.binary())], ["bucket", "h", "c"])


def _prefix_rows(width: int, num: int, den: int, often: np.ndarray, buckets: int):
    def run(batches):
        order, hs, cs, size = Order(often), [], [], 0
        seen: set[int] = set()
        for batch in batches:
            for codes in batch_codes(batch, "__text", True):
                s = set_of(codes, width)
                if not len(s):
                    continue
                f = fingerprint(s)
                if f in seen:
                    continue
                seen.add(f)
                p = order.prefix(s, prefix_length(len(s), num, den))
                hs.append(p)
                cs.append(np.full(len(p), f, np.int64))
                size += len(p)
                if size >= HELD:
                    yield from send(np.concatenate(hs), np.concatenate(cs), buckets)
                    hs, cs, size = [], [], 0
                    seen.clear()
        if size:
            yield from send(np.concatenate(hs), np.concatenate(cs), buckets)

    return run


def shared_lists(h: np.ndarray, c: np.ndarray):
    """Arrays of the classes of each n-gram that several classes hold."""
    order = np.lexsort((c, h))
    h, c = h[order], c[order]
    keep = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
    h, c = h[keep], c[keep]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    size = np.diff(np.append(first, len(h)))
    for a, n in zip(first[size > 1].tolist(), size[size > 1].tolist(), strict=True):
        yield c[a:a + n]


def _bucket_lists(batches):
    """(unit, class): every list once; lists beyond LIST_BLOCK as pairs of blocks."""
    seen: set[int] = set()

    def out(units, classes):
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(units, [len(c) for c in classes]), pa.int64()), pa.array(np.concatenate(classes), pa.int64())], ["unit", "class"])

    for _, g in grouped_stream(batches, "bucket", ["h", "c"]):
        units, classes, size = [], [], 0
        for c in shared_lists(np.concatenate([np.frombuffer(x, np.uint64) for x in g["h"]]), np.concatenate([np.frombuffer(x, np.int64) for x in g["c"]])):
            name = xxhash.xxh3_64_intdigest(c.tobytes())
            if name in seen:
                continue
            seen.add(name)
            blocks = np.array_split(c, -(-len(c) // LIST_BLOCK))
            for i in range(len(blocks)):
                for j in range(i, len(blocks)):
                    units.append(xxhash.xxh3_64_intdigest(f"{name}/{i}/{j}") - (1 << 63))
                    classes.append(blocks[i] if i == j else np.concatenate([blocks[i], blocks[j]]))
                    size += len(classes[-1])
                    if size > 100_000:
                        yield out(units, classes)
                        units, classes, size = [], [], 0
        if units:
            yield out(units, classes)


def bitmap(s: np.ndarray) -> bytes:
    """Parity of the n-grams that fall on each bit; a power of two of bits, about one per n-gram."""
    bits = 1 << min(MOST_BITS, max(6, (len(s) - 1).bit_length()))
    return np.packbits((np.bincount((s % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


MOST_BITS = 12


def folded(words: np.ndarray, width: int) -> np.ndarray:
    """Rows of a bitmap matrix (64-bit words) folded to ``width`` words: still parities, of fewer bits."""
    while words.shape[1] > width:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


def near_by_bits(n: np.ndarray, bits: list[bytes], num: int, den: int) -> list[tuple[int, int]]:
    """Pairs that join all sets which sizes and bitmaps do not keep apart (found sets go on as probes)."""
    by_width: dict[int, np.ndarray] = {}
    for w in sorted({len(b) // 8 for b in bits}):
        by_width[w] = np.array([i for i, b in enumerate(bits) if len(b) // 8 == w])
    words = {w: np.frombuffer(b"".join(bits[i] for i in at), np.uint64).reshape(len(at), w) for w, at in by_width.items()}
    place = {int(i): (w, k) for w, at in by_width.items() for k, i in enumerate(at)}
    fold: dict = {}
    alive, out = np.ones(len(n), bool), []
    for seed in range(len(n)):
        if not alive[seed]:
            continue
        alive[seed] = False
        probes = [seed]
        while probes:
            x = probes.pop()
            wx, kx = place[x]
            for w, at in by_width.items():
                left = np.flatnonzero(alive[at])
                left = left[(den * n[at[left]] >= num * n[x]) & (den * n[x] >= num * n[at[left]])]
                if not len(left):
                    continue
                u = min(w, wx)
                if (w, u) not in fold:
                    fold[w, u] = folded(words[w], u)
                differ = np.bitwise_count(fold[w, u][left] ^ folded(words[wx][kx:kx + 1], u)).sum(axis=1, dtype=np.int64)
                both = n[at[left]] + n[x]
                for y in at[left[(num + den) * (both - differ) >= 2 * num * both]].tolist():
                    out.append((x, y))
                    alive[y] = False
                    probes.append(y)
    return out


def _list_pairs(num: int, den: int):
    def run(batches):
        for _, g in grouped_stream(batches, "unit", ["class", "n", "bits"]):
            found = near_by_bits(np.array(g["n"], np.int64), g["bits"], num, den) if len(g["class"]) > 1 else []
            if found:
                a, b = zip(*found, strict=True)
                c = g["class"]
                yield pa.RecordBatch.from_arrays([pa.array([c[i] for i in a], pa.int64()), pa.array([c[i] for i in b], pa.int64())], ["a", "b"])

    return run


def candidate_groups(texts: DataFrame, classes: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(class, grp): classes that may link to another, with their group.  ``classes``: class, n, bits."""
    often = frequent(texts, width)
    p = shuffle_width(texts.sparkSession)
    sent = texts.mapInArrow(_prefix_rows(width, num, den, often, 4 * p), PAYLOAD)
    lists = sent.repartition(p, "bucket").sortWithinPartitions("bucket").mapInArrow(_bucket_lists, "unit long, class long")
    lists = lists.join(classes.select("class", "n", "bits"), "class")
    rooted = connected_components(lists.repartition(p, "unit").sortWithinPartitions("unit"), _list_pairs(num, den))
    roots = rooted.select("root").distinct()
    return rooted.select(F.col("node").alias("class"), F.col("root").alias("grp")).unionByName(roots.select(F.col("root").alias("class"), F.col("root").alias("grp")))


# verification ---------------------------------------------------------------------------------------

class SetTrie:
    """Radix tree over sets of n-grams shared by at least two of them, most shared first."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.n = [len(s) for s in sets]
        self.num, self.den = num, den
        bounds = np.cumsum([0, *self.n])
        _, inverse, count = np.unique(np.concatenate(sets) if sets else np.empty(0, np.uint64), return_inverse=True, return_counts=True)
        rank = np.empty(len(count), np.int64)
        rank[np.lexsort((np.arange(len(count)), -count))] = np.arange(len(count))
        flat, shared = rank[inverse], count[inverse] > 1
        self.r = [np.sort(flat[a:b][shared[a:b]]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self.mark = np.zeros(len(count), bool)
        self._build()

    def _build(self):
        self.parent, self.start, self.end, self.src, self.here = [-1], [0], [0], [-1], [[]]

        def add(parent, start, end, src):
            self.parent.append(parent)
            self.start.append(start)
            self.end.append(end)
            self.src.append(src)
            self.here.append([])
            return len(self.parent) - 1

        keys = [r.astype(">u4").tobytes() for r in self.r]
        stack, before = [0], None
        self.home = [0] * len(self.r)
        for i in sorted(range(len(keys)), key=keys.__getitem__):
            r = self.r[i]
            same = 0
            if before is not None:
                k = min(len(r), len(before))
                differ = np.flatnonzero(r[:k] != before[:k])
                same = int(differ[0]) if len(differ) else k
            below = None
            while self.end[stack[-1]] > same:
                below = stack.pop()
            if self.end[stack[-1]] < same:
                node = add(stack[-1], self.end[stack[-1]], same, self.src[below])
                self.parent[below], self.start[below] = node, same
                stack.append(node)
            if len(r) > same:
                stack.append(add(stack[-1], same, len(r), i))
            self.here[stack[-1]].append(i)
            self.home[i] = stack[-1]
            before = r
        size = len(self.parent)
        low, high, deep = np.full(size, 1 << 60), np.zeros(size, np.int64), np.array(self.end)
        alive = np.zeros(size, np.int64)
        for i, h in enumerate(self.home):
            low[h], high[h] = min(low[h], self.n[i]), max(high[h], self.n[i])
            alive[h] += 1
        self.kids: list = [[] for _ in range(size)]
        for node in np.argsort(-np.array(self.end), kind="stable").tolist():
            up = self.parent[node]
            if up >= 0:
                low[up], high[up], deep[up] = min(low[up], low[node]), max(high[up], high[node]), max(deep[up], deep[node])
                alive[up] += alive[node]
                self.kids[up].append(node)
        self.kids = [np.array(k, np.int64) for k in self.kids]
        self.low, self.high, self.alive = low, high, alive
        self.rest = deep - np.array(self.start)  # longest path from the node's begin on

    def remove(self, i: int) -> None:
        self.here[self.home[i]].remove(i)
        node = self.home[i]
        while node >= 0:
            self.alive[node] -= 1
            node = self.parent[node]

    def linked(self, x: int) -> list[int]:
        """Sets still in the trie that link to set ``x``."""
        nx, rx, num, den = self.n[x], self.r[x], self.num, self.den
        self.mark[rx] = True
        out = [y for y in self.here[0] if links(0, nx, self.n[y], num, den)]
        stack = [(0, 0)]
        while stack:
            node, seen = stack.pop()
            kids = self.kids[node]
            if len(kids):
                low = self.low[kids]
                best = seen + np.minimum(self.rest[kids], len(rx) - seen)
                fits = (self.alive[kids] > 0) & (den * self.high[kids] >= num * nx) & (den * nx >= num * low) & ((num + den) * best >= num * (nx + low))
                for kid in kids[fits].tolist():
                    got = seen + int(np.count_nonzero(self.mark[self.r[self.src[kid]][self.start[kid]:self.end[kid]]]))
                    out += [y for y in self.here[kid] if links(got, nx, self.n[y], num, den)]
                    stack.append((kid, got))
        self.mark[rx] = False
        return out


def link_sets(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links that join all sets of a component (a spanning forest of the full set of links)."""
    trie, out = SetTrie(sets, num, den), []
    gone = [False] * len(sets)
    for seed in range(len(sets)):
        if gone[seed]:
            continue
        gone[seed] = True
        trie.remove(seed)
        probes = [seed]
        while probes:
            x = probes.pop()
            for y in trie.linked(x):
                out.append((x, y))
                gone[y] = True
                trie.remove(y)
                probes.append(y)
    return out


def _set_rows(width: int, members):
    """(key, class, set) of the rows that ``members`` lets pass."""
    def run(batches):
        for batch in members(batches):
            sets = [set_of(c, width) for c in batch_codes(batch, "__text", True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([fingerprint(s) if len(s) else 0 for s in sets], pa.int64()),
                                              pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "class", "set"])

    return run


def _unit_links(num: int, den: int):
    def run(batches):
        for _, g in grouped_stream(batches, "unit", ["class", "set"]):
            sets = {c: s for c, s in zip(g["class"], g["set"], strict=True)}
            if len(sets) > 1:
                names = list(sets)
                found = link_sets([np.frombuffer(sets[c], np.uint64) for c in names], num, den)
                if found:
                    a, b = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in a], pa.int64()), pa.array([names[i] for i in b], pa.int64())], ["a", "b"])

    return run


# the join -------------------------------------------------------------------------------------------

def _class_rows(width: int, names: list[str]):
    def run(batches):
        for batch in batches:
            sizes, classes, bits = [], [], []
            for codes in batch_codes(batch, "__text", True):
                s = set_of(codes, width)
                sizes.append(len(s))
                classes.append(fingerprint(s) if len(s) else None)
                bits.append(bitmap(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(bits, pa.binary())],
                names + ["n_shingles", "class", "bits"])

    return run


def near_classes(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, unit_size: int = 2_000_000,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, n_shingles, component_id, root of every row: components of links with Jaccard >= num / den.

    ``component_id`` is the smallest id of the component; ``key`` is :func:`row_key` of id and text; ``root`` is
    the component itself (a class of it, null without words), as two components may share their smallest id where ids are not unique.
    Words are runs without ASCII white space, A-Z lower-cased.

    * null, empty and blank texts have an empty set and link with nothing: their component is their own id;
    * texts shorter than ``width`` words are one n-gram; repeated rows and equal sets share a component;
    * rows with a null id link as others do and never name a component unless all its ids are null;
    * an empty table gives an empty result; other columns are ignored.
    Sets are told apart by 64-bit hashes of n-grams and of whole sets."""
    texts = small_batches(docs).select(F.col(f"`{id_col}`").alias("doc_id"), row_key(id_col, text_col).alias("key"),
                        F.col(f"`{text_col}`").cast("binary").alias("__text"))
    schema = T.StructType([texts.schema["doc_id"], texts.schema["key"], T.StructField("n_shingles", T.LongType()), T.StructField("class", T.LongType()),
                           T.StructField("bits", T.BinaryType())])
    slim = write_shared(few_files(texts.mapInArrow(_class_rows(width, ["doc_id", "key"]), schema)), "classes")
    one = slim.filter("class IS NOT NULL").groupBy("class").agg(F.min("key").alias("key"), F.max("n_shingles").alias("n"), F.min("doc_id").alias("low"), F.min("bits").alias("bits"))
    one = write_shared(few_files(one), "representatives")
    groups = write_shared(few_files(candidate_groups(texts.select("__text"), one, width, num, den)), "groups")

    members = one.join(groups, "class")
    sizes = members.groupBy("grp").agg(F.ceil(F.sum("n") / F.lit(unit_size)).cast("int").alias("blocks"), F.count("*").alias("m")).filter("m > 1").drop("m")
    members = write_shared(few_files(members.join(sizes, "grp").select("key", "grp", "blocks")), "members")
    # One Python step a stage: a second one would hold a second worker for each task, as long as the first.
    sets = (texts.select("key", "__text").mapInArrow(_set_rows(width, passing_rows("key", key_filter(members, "key"))), "key long, class long, set binary")
            .join(members, "key").select("grp", "blocks", "class", "set"))
    block = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    units = (sets.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select(F.xxhash64("grp", F.least("block", "other"), F.greatest("block", "other")).alias("unit"), "class", "set"))
    rooted = connected_components(units.repartition("unit").sortWithinPartitions("unit"), _unit_links(num, den))
    placed = one.select("class", "low").join(rooted.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    named = placed.join(least, "root").select("class", "component_id", "root")
    return (slim.join(named, "class", "left")
            .select("doc_id", "key", "n_shingles", F.coalesce("component_id", F.when(F.col("class").isNull(), F.col("doc_id"))).alias("component_id"), "root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component: the row with the smallest id (of repeated rows, one).

    Components whose smallest ids are equal keep a row each.
    Rows without words are no one's copies and all stay, as do rows with a null id (they cannot be told apart)."""
    classes = near_classes(docs, id_col=id_col, text_col=text_col, **options)
    key, mark = fresh(docs, "__key"), fresh(docs, "__stay")
    stay = (classes.filter(F.col("doc_id").isNotNull() & F.col("root").isNotNull())
            .groupBy("root").agg(F.min(F.struct("doc_id", "key"))["key"].alias(mark)).select(mark))
    keyed = docs.withColumn(key, row_key(id_col, text_col))
    kept = keyed.join(stay, F.col(key) == F.col(mark), "left_semi").dropDuplicates([key])
    wordless = keyed.filter(F.col(id_col).isNull() | ~F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return kept.unionByName(wordless).drop(key)
