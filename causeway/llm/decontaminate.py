"""Benchmark decontamination by template canonicalisation.

Words become template tokens: numbers, units after numbers, and names are replaced by typed placeholders,
everything else is the lower-cased word without outer punctuation.  Windows of template tokens of
the benchmark items are hash-joined with the windows of the documents, so a question that only had
its numbers or names changed is found as well.  A second set of windows, of the lower-cased words alone, finds
copies whatever they consist of.  The replaced words of the joined windows are the slots: in the template windows
that count along one alignment of document and item, a benchmark value stands for one document value and the other way round.
Windows that clash with the others are left out; the rest of the alignment and its literal windows count.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column_bytes, fresh, kept_by_worker, longs, row_key, small_batches, window_hashes

# Unit words (singular and plural, signs), in English, German, French and Spanish.
UNITS = frozenset("""% ° °c °f mm cm dm m km inch inches in foot feet ft yard yards mile miles mg g kg t gram grams kilogram kilograms ton tons
tonne tonnes lb lbs pound pounds oz ounce ounces ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr
hour hours day days week weeks month months year years hz khz mhz ghz w kw mw v a j kj kb mb gb tb bit bits byte bytes usd eur gbp dollar
dollars euro euros cent cents percent degree degrees sekunde sekunden minuten stunde stunden tag tage woche wochen monat monate jahr jahre meter
metre metres mètre mètres metro metros heure heures jour jours semaine semaines mois an ans hora horas día días semana semanas mes meses año
años stück""".split())
NUMBER = re.compile(r"[+\-−]?[$€£¥]?\d[\d.,:/'\-−]*(?:st|nd|rd|th|e)?$", re.I)
NUMBER_UNIT = re.compile(r"[+\-−]?[$€£¥]?\d[\d.,:/'\-−]*([^\W\d_]{1,3}|[%°])$")
OUTER = re.compile(r"^[^\w$€£¥+\-−]+|[^\w%°$€£¥]+$")

WORD, NUM, NAME, UNIT, SKIP = range(5)
UNIT_BIT, ENDS_BIT = 8, 16
ENDS = ".,!?:;"
UNIT_WORDS = frozenset(u.encode() for u in UNITS)
_PLACEHOLDER = {k: xxhash.xxh3_64_intdigest(f"<{k}>".encode()) for k in (NUM, NAME, UNIT)}
KEPT = 250_000
LITERAL = np.uint64(0xA5B35705F1C2D3E9)  # keeps the hashes of literal windows apart from those of template windows


class TemplateWords(dict):
    """A word's row in the tables: literal code, and kind with a unit and an ends-a-sentence bit."""

    def __init__(self):
        super().__init__()
        self.code = np.zeros(1024, np.uint64)
        self.flag = np.zeros(1024, np.uint8)

    def __missing__(self, word: bytes) -> int:
        at = len(self)
        if at == len(self.code):
            self.code = np.concatenate([self.code, np.zeros_like(self.code)])
            self.flag = np.concatenate([self.flag, np.zeros_like(self.flag)])
        if word.isalpha():  # letters of ASCII alone
            low, flag = word.lower(), WORD if word[0] >= 97 else NAME
        else:
            low, flag = self._other(word.decode("utf-8", "replace"))
        self.code[at] = xxhash.xxh3_64_intdigest(low)
        self.flag[at] = flag | UNIT_BIT if low in UNIT_WORDS else flag
        self[word] = at
        return at

    @staticmethod
    def _other(text: str) -> tuple[bytes, int]:
        head = text.rstrip(ENDS) if text[-1] in ENDS else text
        if head.isalpha():
            core = head
        else:
            core = OUTER.sub("", text).strip("_")
            core = core if core[:1].isdigit() else core.lstrip("-−+") if not NUMBER.match(core) else core
        low = core.lower()
        if not any(c.isalnum() for c in low) and low.encode() not in UNIT_WORDS:
            kind = SKIP
        elif core[:1].isalpha():
            kind = NAME if core[0].isupper() else WORD
        else:
            kind = NUM if NUMBER.match(core) or NUMBER_UNIT.match(core) else WORD
        ends = text.rstrip("\"'”’»)]*#$%&|")[-1:] in (".", "!", "?", ":", ";")
        return low.encode("utf-8", "replace"), kind | (ENDS_BIT if ends else 0)

    def template(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(template codes, literal codes, is-placeholder) of a whole text's tokens."""
        words = text.split()
        parts = []
        for lo in range(0, len(words), KEPT):
            if len(self) > KEPT:
                self.clear()
            at = np.fromiter(map(self.__getitem__, words[lo:lo + KEPT]), np.int64, min(KEPT, len(words) - lo))
            parts.append((self.code[at], self.flag[at]))
        if not parts:
            e = np.empty(0, np.uint64)
            return e, e, np.empty(0, bool)
        code, flag = parts[0] if len(parts) == 1 else [np.concatenate(x) for x in zip(*parts, strict=True)]
        kind, unit = flag & 7, (flag & UNIT_BIT) > 0
        kind[1:][(kind[1:] == NAME) & ((flag[:-1] & ENDS_BIT) > 0)] = WORD  # a capital that begins a sentence
        if kind[0] == NAME:
            kind[0] = WORD
        keep = kind != SKIP
        if not keep.all():
            code, kind, unit = code[keep], kind[keep], unit[keep]
        if unit.any():
            kind[1:][unit[1:] & (kind[:-1] == NUM)] = UNIT
        slot = kind != WORD
        if not slot.any():
            return code, code, slot
        template = code.copy()
        for k, v in _PLACEHOLDER.items():
            template[kind == k] = np.uint64(v)
        return template, code, slot


def _windows(template, code, slot, width: int, least_words: int):
    """(positions, hashes, is-literal): every literal window, and the template windows with slots and enough literal words."""
    exact = window_hashes(code, width) ^ LITERAL
    at = np.arange(len(exact))
    if not len(exact) or not slot.any():
        return at, exact, np.ones(len(exact), bool)
    sums = np.concatenate([[0], np.cumsum(slot)])
    slots = sums[width:] - sums[:-width]
    some = np.flatnonzero((slots > 0) & (width - slots >= least_words))
    return np.concatenate([at, some]), np.concatenate([exact, window_hashes(template, width)[some]]), np.arange(len(at) + len(some)) < len(at)


def _rows_of(width: int, own: bool, wanted: np.ndarray | None, widths: list[int] | None, id_col: str):
    """Windows as rows (id, row, n, pos, h, literal, slots).  ``own``: items shorter than the width give one window of all their tokens."""
    schema = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("h", pa.int64()), ("literal", pa.bool_()), ("slots", pa.list_(pa.int64()))])

    def run(batches):
        words = kept_by_worker("template words", TemplateWords)
        for batch in batches:
            ids, rows = batch.column(id_col).to_pylist(), longs(batch, "__row", 0).tolist()
            out = []
            for i, row, text in zip(ids, rows, column_bytes(batch, "__text"), strict=True):
                if not text:
                    continue
                template, code, slot = words.template(text)
                n = len(template)
                for w in ([min(width, n)] if own else widths):
                    if not 0 < w <= n:
                        continue
                    at, h, literal = _windows(template, code, slot, w, (w + 1) // 2)
                    if wanted is not None and len(h):
                        near = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1) if len(wanted) else None
                        hit = wanted[near] == h if near is not None else np.zeros(len(h), bool)
                        at, h, literal = at[hit], h[hit], literal[hit]
                    for p, x, same in zip(at.tolist(), h.view(np.int64).tolist(), literal.tolist(), strict=True):
                        out.append((i, row, n, p, x, same, [] if same and not own else code[p:p + w][slot[p:p + w]].view(np.int64).tolist()))
                    if len(out) > 20_000:
                        yield _batch(out, schema)
                        out = []
            if out:
                yield _batch(out, schema)

    return run


def _batch(out, schema):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)


ROWS = "id long, row long, n int, pos int, h long, literal boolean, slots array<long>"


def _cover(at: list[int], wide: int) -> int:
    """Tokens under windows at the sorted places ``at``."""
    return sum((min(b - a, wide) for a, b in zip(at, at[1:], strict=False)), wide) if at else 0


def _consistent(windows: list, wide: int) -> list:
    """Windows (place, pairs of values), sorted, whose pairs are one to one: the longest run of them, or all that agree with the commonest pairs."""
    uses, partners = Counter(), Counter()  # windows of a pair; other values beside a value, by side
    clashes, lo, best, most = 0, 0, (0, 0), 0
    covered = np.cumsum([0] + [min(b[0] - a[0], wide) for a, b in zip(windows, windows[1:], strict=False)]).tolist()
    for hi, (_, pairs) in enumerate(windows):
        for b, d in pairs:
            uses[b, d] += 1
            if uses[b, d] == 1:
                for side in ((0, b), (1, d)):
                    partners[side] += 1
                    clashes += partners[side] > 1
        while clashes:
            for b, d in windows[lo][1]:
                uses[b, d] -= 1
                if not uses[b, d]:
                    for side in ((0, b), (1, d)):
                        clashes -= partners[side] > 1
                        partners[side] -= 1
            lo += 1
        if lo <= hi and wide + covered[hi] - covered[lo] > most:
            best, most = (lo, hi + 1), wide + covered[hi] - covered[lo]
    run = windows[best[0]:best[1]]
    if len(run) == len(windows):
        return run
    common = Counter(p for _, pairs in windows for p in pairs)
    there, back = {}, {}
    for b, d in sorted(common, key=lambda p: (-common[p], p[0] != p[1], p)):
        if b not in there and d not in back:
            there[b], back[d] = d, b
    agreed = [w for w in windows if all(there.get(b) == d for b, d in w[1])]
    return max(run, agreed, key=lambda ws: _cover([at for at, _ in ws], wide))


def _agreeing(width: int):
    """Alignments with ``matched``, ``slots`` and ``changed`` over their literal windows and consistent template windows."""
    names = ["id", "row", "item_id", "item_tokens", "line"]

    def run(batches):
        for batch in batches:
            out = []
            for n, windows in zip(batch.column("item_tokens").to_pylist(), batch.column("windows").to_pylist(), strict=True):
                wide = min(width, n)
                literal = [(w["item_pos"], set(zip(w["b"], w["d"], strict=True))) for w in windows if w["literal"]]
                loose = sorted(((w["item_pos"], set(zip(w["b"], w["d"], strict=True))) for w in windows if not w["literal"]), key=lambda w: w[0])
                kept = literal + _consistent(loose, wide)
                pairs = set().union(*(p for _, p in kept))
                out.append((_cover(sorted({at for at, _ in kept}), wide), len(pairs), sum(b != d for b, d in pairs)))
            columns = [pa.array(c, pa.int32()) for c in (zip(*out, strict=True) if out else ([], [], []))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + columns, names + ["matched", "slots", "changed"])

    return run


LINES = "id long, row long, item_id long, item_tokens int, line int, matched int, slots int, changed int"


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 8, least_tokens: int = 13, least_share: float = 0.5, least_item: int = 3,
               broadcast_up_to: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, row, item_id, matched (tokens), item_tokens, share, slots, changed of every leaked (row, item).

    A document leaks an item if, along one alignment, literal windows and template windows with consistent
    slots cover ``least_tokens`` tokens or ``least_share`` of the item.  ``changed`` counts slots with other values:
    0 for a literal copy.  ``row`` is :func:`row_key` of id and text.

    * null or empty texts and items, and items without words, leak nothing; neither do items of fewer than ``least_item`` tokens:
      a word or two of a language are found in any text;
    * items shorter than ``width`` are one window of their own length;
    * template windows need half literal words; windows of equal words, in any case, count whatever the words are;
    * repeated rows share their result; a null id stays null; ties between alignments: the longest counts;
    * very long texts and items are read whole; empty tables give an empty result; other columns are ignored.

    Up to ``broadcast_up_to`` window hashes of the benchmark (8 bytes each) go to the tasks, which then
    emit joined windows only; beyond that all windows of the documents meet them in a shuffled join."""
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("__id"), F.lit(0).cast("long").alias("__row"),
                             F.col(f"`{item_text_col}`").cast("binary").alias("__text"))
    src = small_batches(docs).select(F.col(f"`{id_col}`").cast("long").alias("__id"), row_key(id_col, text_col).alias("__row"),
                      F.col(f"`{text_col}`").cast("binary").alias("__text"))
    bench = items.mapInArrow(_rows_of(width, True, None, None, "__id"), ROWS).filter(F.col("n") >= least_item).select(
        F.col("id").alias("item_id"), F.col("n").alias("item_tokens"), F.col("pos").alias("item_pos"), "h", "literal", F.col("slots").alias("item_slots"))
    widths = sorted({width, *(r[0] for r in bench.filter(F.col("item_tokens") < width).select("item_tokens").distinct().collect())})
    few = bench.select("h").distinct().limit(broadcast_up_to + 1).toArrow()["h"].to_numpy()
    bounded = len(few) <= broadcast_up_to
    wanted = np.sort(few.astype(np.int64).view(np.uint64)) if bounded else None
    found = src.mapInArrow(_rows_of(width, False, wanted, widths, "__id"), ROWS).drop("n", "literal")
    joined = found.join(bench, "h").withColumn("slots", F.when(F.col("literal"), F.col("item_slots")).otherwise(F.col("slots")))
    lines = (joined.withColumn("line", F.col("pos") - F.col("item_pos"))
             .groupBy("id", "row", "item_id", "item_tokens", "line")
             .agg(F.array_sort(F.collect_set("item_pos")).alias("at"),
                  F.collect_set(F.struct("item_pos", "literal", F.col("item_slots").alias("b"), F.col("slots").alias("d"))).alias("windows")))
    wide = F.least(F.lit(width), F.col("item_tokens"))
    gaps = F.zip_with(F.slice("at", 2, F.greatest(F.size("at") - 1, F.lit(0))), F.slice("at", 1, F.greatest(F.size("at") - 1, F.lit(0))), lambda b, a: b - a)
    enough = (F.col("matched") >= least_tokens) | (F.col("matched") >= F.col("item_tokens") * least_share)
    lines = lines.withColumn("matched", F.aggregate(gaps, wide, lambda total, gap: total + F.least(gap, wide))).filter(enough)  # what all windows together cover
    lines = lines.select("id", "row", "item_id", "item_tokens", "line", "windows").mapInArrow(_agreeing(width), LINES).filter(enough)
    best = Window.partitionBy("id", "row", "item_id").orderBy(F.col("matched").desc(), "changed", "line")
    return (lines.withColumn("_k", F.row_number().over(best)).filter("_k = 1")
            .select(F.col("id").alias("doc_id"), "row", "item_id", "matched", "item_tokens",
                    (F.col("matched") / F.col("item_tokens")).alias("share"), "slots", "changed"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that leak no benchmark item, with all their columns."""
    key, mark = fresh(docs, "__key"), fresh(docs, "__leak")
    bad = find_leaks(docs, benchmark, id_col=id_col, text_col=text_col, **options).select(F.col("row").alias(mark)).distinct()
    return docs.withColumn(key, row_key(id_col, text_col)).join(bad, F.col(key) == F.col(mark), "left_anti").drop(key)


