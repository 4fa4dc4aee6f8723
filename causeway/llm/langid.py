"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's features are the hashed n-grams of 1 to 4 letters of its words, word ends included; the
text is the average of their embeddings, and a linear softmax over that average gives the language.
Embeddings and softmax are trained by stochastic gradient descent in numpy on a bounded sample of
labelled rows, on the driver.  A held-back part of the sample sets the temperature of the softmax and
the score below which a prediction is rejected.

Scoring is a map over all rows: because the model is linear in the average, embeddings and softmax
weights become one table of class scores per n-gram.  Whole texts are used, and nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_bytes, fresh, kept_by_worker, small_batches

UNDETERMINED = "und"
BITS = 15
CHARS_AT_ONCE = 1_000_000


@dataclass
class LanguageModel:
    labels: list[str]
    table: np.ndarray        # buckets x classes: embedding @ softmax weights
    bias: np.ndarray
    temperature: float
    reject_below: float
    accuracy: float          # on the held-back part of the sample


@cache
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def features(text: str) -> np.ndarray:
    """Buckets of the n-grams (1 to 4) of the letters of a text; empty if it has no letter."""
    parts = [_features(text[at:at + CHARS_AT_ONCE]) for at in range(0, len(text), CHARS_AT_ONCE)]
    return parts[0] if len(parts) == 1 else np.concatenate([*parts, np.empty(0, np.uint32)])


def _features(text: str) -> np.ndarray:
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    c = np.where(letters()[c], c, 0).astype(np.uint32)
    c = np.concatenate([np.zeros(1, np.uint32), c, np.zeros(1, np.uint32)])
    c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]  # one 0 between words
    is_letter = c != 0
    h, inner, out = c, is_letter, []
    for n in range(1, 5):
        if n > 1:
            h = h[:-1] * np.uint32(0x01000193) + c[n - 1:]
            # only the first and the last place may be a word's end, and not both alone
            inner = is_letter[1:] | is_letter[:-1] if n == 2 else (is_letter[1:-1] if n == 3 else is_letter[1:-2] & is_letter[2:-1])
        g = h[inner] + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
        g = (g ^ (g >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        out.append((g ^ (g >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS))
    return np.concatenate(out)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


def train(texts: list[str], langs: list[str], dim: int = 12, epochs: int = 5, rate: float = 1.0, max_features: int = 1500,
          target_error: float = 0.001, seed: int = 1) -> LanguageModel:
    """Stochastic gradient descent over the sample, one text piece after another.

    A text is trained in pieces of up to ``max_features`` features, so that short texts are learnt too
    and every part of a long text is used.  Each fifth text is held back for calibration."""
    rng, buckets = np.random.default_rng(seed), 1 << BITS
    labels = sorted(set(langs))
    if not labels:
        return LanguageModel([], np.zeros((buckets, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.0, 0.0)
    place = {v: i for i, v in enumerate(labels)}
    pieces, held = [], []
    for i, (t, lang) in enumerate(zip(texts, langs, strict=True)):
        x, y = features(t), place[lang]
        if not len(x):
            continue
        if i % 5 == 4:
            held.append((x, y))
        else:
            pieces += [(x[a:a + max_features], y) for a in range(0, len(x), max_features)]
    k = len(labels)
    emb = rng.uniform(-1, 1, (buckets, dim)).astype(np.float32) / dim
    out, bias = np.zeros((k, dim), np.float32), np.zeros(k, np.float32)
    weight = np.bincount([y for _, y in pieces], minlength=k).astype(np.float64)
    weight = np.where(weight > 0, weight.sum() / np.maximum(weight, 1) / k, 0)  # rare languages count as much
    weight = np.minimum(weight, 10)
    steps, step = max(1, epochs * len(pieces)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(pieces)):
            x, y = pieces[i]
            lr = np.float32(rate * (1 - step / steps))
            step += 1
            rows = emb[x]
            mean = rows.mean(axis=0)
            p = _softmax(out @ mean + bias)
            p[y] -= 1
            g = p * np.float32(weight[y])
            back = (g @ out) * (lr / np.float32(len(x)))
            out -= lr * np.outer(g, mean)
            bias -= lr * g
            np.subtract.at(emb, x, back)
    table = (emb @ out.T).astype(np.float32)
    temperature, reject, acc = 1.0, 0.0, 0.0
    if held:
        z = np.stack([table[x].mean(axis=0) + bias for x, _ in held]).astype(np.float64)
        y = np.array([v for _, v in held])
        grid = np.geomspace(0.05, 20, 60)
        loss = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
        p = _softmax(z / temperature)
        right = p.argmax(axis=1) == y
        acc = float(right.mean())
        reject = _threshold(p.max(axis=1), right, target_error, k)
    return LanguageModel(labels, table, bias, temperature, reject, acc)


def _threshold(score: np.ndarray, right: np.ndarray, target_error: float, k: int) -> float:
    """Smallest score from which on the held-back error is at most ``target_error``; never above what
    would reject more than one right text in 1000, nor above one half: a majority is kept."""
    order = np.argsort(-score)
    wrong = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
    fine = np.flatnonzero(wrong <= target_error)
    cut = float(score[order[fine[-1]]]) if len(fine) else 1.0
    kept = np.sort(score[right])
    keep = float(kept[int(0.001 * len(kept))]) if len(kept) else 1.0
    return max(1.0 / k, min(cut, keep, 0.5))


def labelled_sample(rows: DataFrame, per_language: int, id_col: str = "doc_id", text_col: str = "text",
                    lang_col: str = "lang", max_bytes: int = 40_000_000) -> tuple[list[str], list[str]]:
    """At most ``per_language`` non-null texts and ``max_bytes`` of text of each language, the ones with the smallest id hash.

    One aggregate counts the languages; a second scan joins a hash limit for each of them (a row a language), which leaves about as many rows as
    are wanted before any is ranked, so no task sorts a language that holds most rows.  The driver gets the sample alone."""
    base = rows.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
        F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.col(text_col)), F.lit(7)).alias("h"))
    limits = []
    for r in base.groupBy("lang").agg(F.count("*").alias("n")).collect():
        share = min(1.0, 1.5 * per_language / r["n"] + 20 / r["n"])
        limits.append((r["lang"], int(-(1 << 63) + share * ((1 << 64) - 1)) if share < 1 else (1 << 63) - 1))
    if not limits:
        return [], []
    few = base.join(F.broadcast(rows.sparkSession.createDataFrame(limits, "lang string, top long")), "lang").filter("h <= top")
    first = Window.partitionBy("lang").orderBy("h", "text")
    before = F.sum(F.octet_length("text")).over(first.rowsBetween(Window.unboundedPreceding, -1))
    few = few.select("lang", "text", F.row_number().over(first).alias("k"), F.coalesce(before, F.lit(0)).alias("bytes"))
    got = sorted((r["lang"], r["k"], r["text"]) for r in few.filter((F.col("k") <= per_language) & (F.col("bytes") <= max_bytes)).collect())
    order = np.random.default_rng(3).permutation(len(got))
    return [got[i][2] for i in order], [got[i][0] for i in order]


def _scorer(model: LanguageModel, names: list[str], text_name: str):
    table, k = model.table, len(model.labels)

    def run(batches):
        kept_by_worker("letters", letters)
        for batch in batches:
            preds, scores, rejects = [], [], []
            for text in column_bytes(batch, text_name):
                total, n = np.zeros(k), 0
                text = (text or b"").decode("utf-8", "replace")
                for at in range(0, len(text), CHARS_AT_ONCE):
                    x = _features(text[at:at + CHARS_AT_ONCE])
                    total += table[x].sum(axis=0, dtype=np.float64)
                    n += len(x)
                if not n or not k:
                    pred, score, reject = UNDETERMINED, 0.0, True
                else:
                    p = _softmax((total / n + model.bias) / model.temperature)
                    best = int(p.argmax())
                    pred, score = model.labels[best], float(p[best])
                    reject = score < model.reject_below
                preds.append(pred)
                scores.append(score)
                rejects.append(reject)
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array(preds, pa.string()), pa.array(scores, pa.float64()),
                                                    pa.array(rejects, pa.bool_())],
                names + ["lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all of ``docs``) with lang_pred, score (0 to 1) and rejected.

    * a null text, an empty text and a text without any letter get ``und``, score 0, rejected;
    * very long texts are scored whole, a million characters at a time; ties between languages go to the first label; repeated rows are scored alike;
    * an empty table gives an empty result; a model without labels answers ``und``;
    * columns of ``docs`` named like an output column are replaced."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score", "rejected")]
    src = small_batches(docs).select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("binary").alias(fresh(docs, "__text")))
    schema = T.StructType([src.schema[c] for c in keep] + [
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return src.mapInArrow(_scorer(model, keep, src.columns[-1]), schema)


def held_out(col="doc_id"):
    """Rows that training must not see: crc32 of the id's text mod 4 is 2 (a null id: not held out)."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_on(docs: DataFrame, per_language: int = 400, **options) -> LanguageModel:
    """Model trained on a bounded sample of the rows that are not held out."""
    texts, langs = labelled_sample(docs.filter(~held_out()), per_language)
    return train(texts, langs, **options)
