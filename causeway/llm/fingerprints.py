"""Document fingerprints: a threshold-scaled sketch of word shingles, in DataFrame functions alone.

The fingerprint of a text holds the hash of every distinct shingle whose hash lies below a fixed fraction of all values, and
the smallest hash, so that short texts have one.  Whether a hash stays does not depend on what else the text holds, so the
fingerprint of a union follows from the fingerprints, and the share of a small text's hashes that a large one has estimates
how far it is contained there, however unequal they are.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, let, shuffle_width

DIGITS = 12
FRACTION = 0.25
BUCKETS_A_TASK, ROWS_A_BUCKET = 8, 500
SPACES = " \t\n\x0b\x0c\r"


def shingle_hashes(text: Column, width: int = 5) -> Column:
    """First 12 hex digits of md5 of every run of ``width`` words (joined by one space); of the whole sequence where it is
    shorter; an empty array without words.  Words are runs without ASCII white space."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    runs = lambda w: F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(w) - (width - 1), F.lit(1))),
        lambda i: F.substring(F.md5(F.array_join(F.slice(w, i, width), " ").cast("binary")), 1, DIGITS))
    return F.when(F.length(bare) > 0, let(F.split(bare, r"[\x20\x09-\x0D]+"), runs)).otherwise(F.array().cast("array<string>"))


def sketch(hashes: Column, fraction: float = FRACTION) -> Column:
    """The hashes below ``fraction`` of all values and the smallest one, distinct and sorted, joined by commas."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be above 0 and at most 1")
    below = format(int(fraction * 16 ** DIGITS) - 1, f"0{DIGITS}x")
    kept = lambda h: let(F.greatest(F.lit(below), F.array_min(h)), lambda top: F.filter(h, lambda x: x <= top))
    return F.array_join(F.sort_array(F.array_distinct(let(hashes, kept))), ",")


def fingerprint(text: Column, width: int = 5, fraction: float = FRACTION) -> Column:
    """Fingerprint of a text column: equal texts have equal ones; a text without words (or null) has the empty one."""
    return sketch(shingle_hashes(text, width), fraction)


def _hashes(print_: Column) -> Column:
    return F.when(F.length(print_) > 0, F.split(print_, ",")).otherwise(F.array().cast("array<string>"))


def merged(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Fingerprint of the union of two shingle sets, from their fingerprints."""
    return sketch(F.array_union(_hashes(a), _hashes(b)), fraction)


def likeness(a: Column, b: Column) -> Column:
    """Estimated containment, 0 to 1: the share of the smaller fingerprint's hashes that the other has too.

    Equal fingerprints, two empty ones included, give 1; an empty and another one 0; a null one null."""
    x, y = _hashes(a), _hashes(b)
    least = F.least(F.size(x), F.size(y))
    return F.when(a == b, 1.0).when(a.isNull() | b.isNull(), None).when(least == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / least)


def _bucket(key: Column, bounds: list[int]) -> Column:
    """Number of ``bounds`` (ascending) below ``key``; -1 for null.  Two steps, each over the root of their number."""
    if not bounds:
        return F.when(key.isNull(), -1).otherwise(0)
    step = isqrt(len(bounds) - 1) + 1
    groups = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    tops = F.from_json(F.lit(str([g[-1] for g in groups])), "array<bigint>")
    inside = F.from_json(F.lit(str([*groups, []])), "array<array<bigint>>")
    whole = F.size(F.filter(tops, lambda b: b < key))
    rest = F.size(F.filter(F.get(inside, whole), lambda b: b < key))
    return F.when(key.isNull(), -1).otherwise(whole * step + rest)


def with_next(docs: DataFrame, id_col: str, tie_col: str, **columns: str) -> DataFrame:
    """``docs`` with columns (new name = column) of the next row by descending id; after the last comes the first.

    Rows go to buckets of neighbouring ids, one shuffle; each bucket's first row is also sent to the bucket before it, so
    no window spans the table.  Rows of equal id go by ``tie_col``, null ids come last; a single row is its own next."""
    key = F.col(f"`{id_col}`").cast("long")
    bucket, home, ghost, head = (fresh(docs, n) for n in ("__bucket", "__home", "__ghost", "__head"))
    wide = docs.agg(F.count(key)).first()[0] // ROWS_A_BUCKET
    wide = max(1, min(wide, BUCKETS_A_TASK * shuffle_width(docs.sparkSession)))
    cuts = [k / wide for k in range(1, wide)]
    bounds = docs.agg(F.percentile_approx(key, F.lit(cuts), F.lit(max(10_000, 20 * wide)))).first()[0] if cuts else []
    own = _bucket(key, sorted(set(bounds or [])))
    heads = sorted(((r[0], r[1]) for r in docs.groupBy(own.alias("b")).agg(F.max(key)).collect()), reverse=True)  # one row a bucket
    before = [(h, heads[i - 1][0]) for i, (_, h) in enumerate(heads)]
    first = docs.sparkSession.createDataFrame(before, f"`{head}` long, `{ghost}` int")
    placed = (docs.join(F.broadcast(first), key.eqNullSafe(F.col(head)), "left")
              .select(*[F.col(f"`{c}`") for c in docs.columns], F.posexplode(F.when(F.col(ghost).isNull(), F.array(own)).otherwise(F.array(own, F.col(ghost)))).alias(home, bucket)))
    order = Window.partitionBy(bucket).orderBy(home, key.desc_nulls_last(), F.col(f"`{tie_col}`").asc_nulls_last())
    return (placed.withColumns({new: F.lead(f"`{c}`").over(order) for new, c in columns.items()})
            .filter(F.col(home) == 0).drop(home, bucket))


def fingerprints(docs: DataFrame, width: int = 5, fraction: float = FRACTION, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each text in ``out_col``.

    * null, empty and blank texts have the empty fingerprint; texts of fewer than ``width`` words have one hash;
    * very long texts are hashed whole, in one row; repeated rows have equal fingerprints; ties do not occur;
    * an empty table gives an empty result; all other columns stay (one named ``out_col`` is replaced)."""
    return docs.withColumn(out_col, fingerprint(F.col(f"`{text_col}`"), width, fraction))


def edited_prints(docs: DataFrame, width: int = 5, fraction: float = FRACTION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited (text), fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text has its last third (floor of the code points) replaced by the first as many of the next row by descending
    id (all, if it has fewer).  Null texts count as empty; see :func:`with_next` and :func:`fingerprints` for ties, null ids,
    repeated rows and empty tables."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"))
    rows = with_next(fingerprints(rows, width, fraction), "doc_id", "text", next_text="text", next_print="fingerprint")
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.expr("concat(left(text, cast(n_chars - n_chars div 3 as int)), left(next_text, cast(n_chars div 3 as int)))"))
    rows = rows.withColumn("edited_fingerprint", fingerprint(F.col("edited"), width, fraction))
    return rows.select("doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint",
                       likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                       likeness(F.col("fingerprint"), F.col("next_print")).alias("near_next"))
