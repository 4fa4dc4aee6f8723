"""Secret scan: pattern candidates, and a random forest that removes the false positives.

Everything on the main path is DataFrame and SQL functions.  Candidates are the matches of one pattern (long runs with
a digit, runs with a known prefix, values assigned to the names of secrets, credentials in URLs, private key blocks).  Each becomes a vector of its length,
character classes and transitions between them, dictionary coverage, path signs around it and
neighbouring words.  A random forest trained from labelled findings scores it; the trees are written out as one SQL expression, so a
scan needs no shuffle and no model on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, write_shared

ASSIGNED = r"(?:[pP]assword|PASSWORD|[pP]asswd|PASSWD|pwd|PWD|[sS]ecret|SECRET)[\"']?\s{0,3}[=:]\s{0,3}[\"']?"
# The other names of KEYWORD; their values end before signs of code, markup and query strings, and before a sentence's end.
NAMED = (r"(?i:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth(?:orization)?|credentials?|private[_-]?key|bearer)[\"']?"
         r"(?:\s{0,3}[=:]|(?<=[rR])\s|\s{1,3}is\s)\s{0,3}(?i:(?:bearer|basic)\s{1,3})?[\"']?")
LOGIN = r"://[^\s/:@\"'<>]{0,64}:"
KEY = r"(?:" + ASSIGNED + "|" + NAMED + "|" + LOGIN + ")"
CANDIDATE = (r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s:,.-]*?-----END [A-Z ]{0,40}PRIVATE KEY-----"
             r"|" + ASSIGNED + r"[^\s\"',;]{6,}"
             r"|" + NAMED + r"[^\s\"',;&<>()\[\]{}]{5,}[^\s\"',;&<>()\[\]{}.:!?]"
             r"|" + LOGIN + r"[^\s/@\"'<>]++(?=@)"
             r"|(?<![A-Za-z0-9_+/-])(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk[-_]|rk_live|AIza|ya29\.?|eyJ|npm_)[A-Za-z0-9_+/-]{8,}+={0,2}"
             r"|(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{12,}+={0,2}")
KEYWORD = r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credentials?|private[_-]?key|bearer)[\"']?\s{0,3}(?:=|:|is|)\s{0,3}[\"']?$"
KNOWN = r"^(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk[-_]|rk_live|AIza|ya29|eyJ|npm_|-----BEGIN)"
#: Words of placeholders and of ordinary identifiers.
DICTIONARY = ("example", "sample", "dummy", "test", "fake", "placeholder", "changeme", "password", "secret", "token", "default", "user", "admin",
              "index", "image", "video", "static", "assets", "content", "version", "release", "build", "commit", "license", "public", "your", "here",
              "number", "order", "article", "chapter", "section", "page", "item", "data", "file", "name", "http", "www", "xxxx", "1234", "0000")
CONTEXT = 60


@dataclass
class Forest:
    trees: list[str]       # SQL of each tree's probability, over an array column or variable called ``f``
    threshold: float
    names: list[str]


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _share(pattern: str) -> str:
    return f"(length(x.v) - length(regexp_replace(x.v, {_quoted(pattern)}, ''))) / length(x.v)"


def _flag(condition: str) -> str:
    return f"cast({condition} as double)"


def feature_sql(dictionary=DICTIONARY) -> dict[str, str]:
    """SQL of each feature over a variable x with fields v (value), l and r (text before and after)."""
    words = _quoted("(?i)(?:" + "|".join(sorted(set(dictionary), key=lambda w: (-len(w), w))) + ")")
    runs = "length(regexp_replace(regexp_replace(regexp_replace(x.v, '[0-9]+', '0'), '[a-z]+', 'a'), '[A-Z]+', 'A'))"
    return {
        "length": "cast(least(length(x.v), 400) as double)",
        "digits": _share("[0-9]"),
        "upper": _share("[A-Z]"),
        "lower": _share("[a-z]"),
        "vowels": _share("[aeiouAEIOU]"),
        "signs": _share("[^A-Za-z0-9]"),
        "transitions": f"{runs} / length(x.v)",
        "letter_pairs": "(length(x.v) - length(regexp_replace(x.v, '[bcdfghjklmnpqrstvwxz][aeiouy]', ''))) / length(x.v)",
        "distinct": "size(array_distinct(split(left(x.v, 400), ''))) / cast(least(length(x.v), 64) as double)",
        "hex": _flag("x.v rlike '^(?:[0-9a-f]+|[0-9A-F]+)$'"),
        "number": _flag("x.v rlike '^[0-9+-]+$'"),
        "uuid": _flag("x.v rlike '^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$'"),
        "coverage": f"(length(x.v) - length(regexp_replace(x.v, {words}, ''))) / length(x.v)",
        "known": _flag(f"x.v rlike {_quoted(KNOWN)}"),
        "keyword": _flag(f"x.l rlike {_quoted(KEYWORD)}"),
        "assigned": _flag("x.l rlike '[=:]\\\\s{0,3}[\"\\']?$'"),
        "login": _flag("x.l rlike '://[^\\s/@]*:$' and x.r rlike '^@'"),
        "quoted": _flag("x.l rlike '[\"\\'`]$' and x.r rlike '^[\"\\'`]'"),
        "path": _flag("x.l rlike '[/.@\\\\\\\\#][^\\\\s]*$' or x.l rlike '://[^\\\\s]*$' or x.r rlike '^[./@\\\\\\\\][A-Za-z]' or x.v rlike '/[A-Za-z]{3,}[/-]'"),
        "neighbour": _flag("concat(x.l, ' ', x.r) rlike '(?i)\\\\b(?:commit|sha\\\\d*|md5|checksum|digest|hash|isbn|order|invoice|card|tel|phone|uuid|serial|version|example|sample|dummy|fake|placeholder)\\\\b'"),
    }


def labelled_findings(docs: DataFrame, rows: int = 600, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """l, v, r, label: labelled findings derived from at most ``rows`` rows of ``docs`` (their first 400 characters lend the words around a value).

    Each sampled row's own words stand around a value made from its hash, in the forms in which secrets (label 1) and
    harmless look-alikes (label 0) are usually found.  The sample is the rows with the smallest id hash."""
    seed = F.sha2(F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.lit("|findings")), 256)
    base = (docs.select(F.col(f"`{id_col}`").alias("i"), seed.alias("s"), F.slice(F.split(F.left(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.lit(400)), r"\s+"), 1, 12).alias("w"))
            .orderBy("s", "i").limit(rows))
    b64 = "regexp_replace(base64(unhex(sha2(concat(s, '{0}'), 256))), '[+/=]', 'x')"
    hx = "sha2(concat(s, '{0}'), 256)"
    number = "translate(sha2(concat(s, '{0}'), 256), 'abcdef', '123456')"
    letters = "translate(regexp_replace(base64(unhex(sha2(concat(s, '{0}'), 512))), '[+/=]', ''), '0123456789', 'QwErTyUiOp')"
    word = "coalesce(try_element_at(filter(transform(w, x -> regexp_replace(x, '[^\\\\p{{L}}]', '')), x -> length(x) >= 6), {0}), '{1}')"
    before, after = "concat_ws(' ', slice(w, 1, 5))", "concat_ws(' ', slice(w, 6, 5))"
    forms = [  # (label, text before the value, value, text after it)
        (1, "' '", f"concat('AKIA', upper(left({b64.format('a')}, 16)))", "' '"),
        (1, "' token = \"'", f"left({hx.format('b')}, 40)", "'\" '"),
        (1, "' password='", f"left({hx.format('c')}, 10 + cast(conv(left(s, 2), 16, 10) as int) % 12)", "' '"),
        (1, "' api_key: '", f"left({b64.format('d')}, 32)", "' '"),
        (1, "' secret = \\''", f"left({b64.format('e')}, 24)", "'\\' '"),
        (1, "' '", f"concat('ghp_', left({b64.format('f')}, 36))", "' '"),
        (1, "' Authorization: Bearer '", f"concat('eyJ', left({b64.format('g')}, 40))", "' '"),
        (1, "' '", f"concat('sk-', left({b64.format('h')}, 40))", "' '"),
        (1, "' '", f"concat('-----BEGIN PRIVATE KEY-----\\n', {b64.format('i')}, '\\n-----END PRIVATE KEY-----')", "' '"),
        (1, "' access_key='", f"left({b64.format('j')}, 40)", "' '"),
        (1, "' '", f"concat('AKIA', upper(left({letters.format('A')}, 16)))", "' '"),
        (1, "' api_key = \"'", f"left({letters.format('B')}, 24)", "'\" '"),
        (1, "' token: '", f"left({letters.format('C')}, 16 + cast(conv(left(s, 2), 16, 10) as int) % 24)", "' '"),
        (1, "' passphrase: '", f"left({b64.format('D')}, 8 + cast(conv(left(s, 2), 16, 10) as int) % 12)", "' '"),
        (1, "' passphrase: '", f"concat({word.format(1, 'hunter')}, left({number.format('E')}, 1), left({hx.format('E')}, 2))", "' '"),
        (1, "' postgres://bob:'", f"left({b64.format('F')}, 8 + cast(conv(left(s, 2), 16, 10) as int) % 12)", "'@db/x '"),
        (1, "' https://me:'", f"concat({word.format(1, 'Hunter')}, left({number.format('G')}, 1), left({hx.format('G')}, 2))", "'@host/ '"),
        (1, "' '", f"concat('ghp_', left({letters.format('H')}, 36))", "' '"),
        (1, "' Authorization: Bearer '", f"left({letters.format('I')}, 32)", "' '"),
        (1, "' '", f"concat('xoxb-', left({number.format('J')}, 12), '-', left({b64.format('J')}, 24))", "' '"),
        (1, "' '", f"concat('xoxp-', left({number.format('K')}, 10), '-', left({letters.format('K')}, 16))", "' '"),
        (1, "' '", f"concat('glpat-', left({b64.format('L')}, 20))", "' '"),
        (1, "' '", f"concat('github_pat_', left({b64.format('M')}, 22), '_', left({b64.format('N')}, 40))", "' '"),
        (1, "' '", f"concat('AIza', left({b64.format('O')}, 35))", "' '"),
        (1, "' '", f"concat('ya29.', left({b64.format('P')}, 40))", "' '"),
        (1, "' '", f"concat('npm_', left({b64.format('Q')}, 36))", "' '"),
        (1, "' '", f"concat('rk_live_', left({b64.format('R')}, 24))", "' '"),
        (1, "' '", f"concat('ASIA', upper(left({b64.format('S')}, 16)))", "' '"),
        (1, "' password='", f"lower(concat({word.format(1, 'correct')}, {word.format(2, 'battery')}, {word.format(3, 'horse')}))", "' '"),
        (1, "' passwd: \"'", f"lower(concat({word.format(2, 'staple')}, {word.format(1, 'correct')}))", "'\" '"),
        (0, "' token: '", word.format(1, "chapter"), "' '"),
        (0, "' secret: '", word.format(2, "garden"), "' '"),
        (0, "' bearer '", word.format(1, "shares"), "' '"),
        (0, "' password is '", word.format(1, "required"), "' '"),
        (0, "' auth: '", f"concat_ws('-', {word.format(1, 'section')}, {word.format(2, 'chapter')})", "' '"),
        (0, "' api_key = '", f"concat_ws('_', 'your', lower({word.format(1, 'number')}), 'here')", "' '"),
        (0, "' '", f"concat('sk-', lower({word.format(1, 'learning')}), '-', lower({word.format(2, 'version')}))", "' '"),
        (0, "' http://user:'", "if(left(s, 1) < '8', 'password', 'your-password')", "'@example.com/ '"),
        (0, "' '", f"left({number.format('k')}, 16)", "' '"),
        (0, "' commit '", f"left({hx.format('l')}, 40)", "' '"),
        (0, "' sha256: '", hx.format("m"), "' '"),
        (0, "' https://example.com/static/'", f"concat('app-', left({hx.format('n')}, 12))", "'.js '"),
        (0, "' id '", f"concat_ws('-', left({hx.format('o')}, 8), substr({hx.format('o')}, 9, 4), substr({hx.format('o')}, 13, 4), substr({hx.format('o')}, 17, 4), substr({hx.format('o')}, 21, 12))", "' '"),
        (0, "' password='", "concat('your-password-', left(translate(s, 'abcdef', '123456'), 4))", "' '"),
        (0, "' token = \"'", "concat('example-token-', left(translate(s, 'abcdef', '123456'), 4))", "'\" '"),
        (0, "' order '", f"concat('ORDER-', left({number.format('p')}, 10))", "', '"),
        (0, "' '", f"concat('+1-', left({number.format('q')}, 3), '-555-', left({number.format('r')}, 4), '-', left(s, 1), '0')", "' '"),
        (0, "' '", "concat(lower(regexp_replace(coalesce(try_element_at(w, 1), 'chapter'), '[^A-Za-z]', '')), '_section_', left(translate(s, 'abcdef', '123456'), 6))", "' '"),
        (0, "' /images/2024/'", f"concat('photo_', left({number.format('t')}, 10))", "'.jpg '"),
        (0, "' card '", f"left({number.format('u')}, 16)", "' '"),
    ]
    structs = ", ".join(f"named_struct('l', right(concat({before}, {a}), {CONTEXT}), 'v', {v}, 'r', left(concat({b}, {after}), {CONTEXT}), 'label', {y})" for y, a, v, b in forms)
    return base.select(F.explode(F.expr(f"array({structs})")).alias("x")).select("x.l", "x.v", "x.r", "x.label")


def train_forest(findings: DataFrame, trees: int = 15, depth: int = 6, threshold: float = 0.5, seed: int = 7, dictionary=DICTIONARY) -> Forest:
    """Random forest over labelled findings (l, v, r, label).  The driver gets the trees alone; without findings, none is confirmed."""
    sql = feature_sql(dictionary)
    rows = (findings.filter("v IS NOT NULL AND length(v) > 0")
            .select(F.struct(F.coalesce("l", F.lit("")).alias("l"), "v", F.coalesce("r", F.lit("")).alias("r")).alias("x"), F.col("label").cast("double").alias("label"))
            .select(array_to_vector(F.expr(f"array({', '.join(sql.values())})").cast("array<double>")).alias("features"), "label"))
    if rows.isEmpty():
        return Forest(["0.0D"], threshold, list(sql))  # nothing to learn from: nothing is confirmed
    rows = write_shared(rows, "findings")  # a bounded sample, read for every level of the trees
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", maxMemoryInMB=64).fit(rows)
    return Forest([_tree_sql(t._call_java("rootNode")) for t in model.trees], threshold, list(sql))


def _tree_sql(node) -> str:
    if node.subtreeDepth() == 0:
        stats = node.impurityStats().stats()
        total = sum(stats)
        return repr(float(stats[1] / total if total and len(stats) > 1 else 0.0)) + "D"
    split = node.split()
    return (f"CASE WHEN f[{split.featureIndex()}] <= {float(split.threshold())!r}D THEN {_tree_sql(node.leftChild())} ELSE {_tree_sql(node.rightChild())} END")


def scanned(docs: DataFrame, forest: Forest, text_col: str = "text", dictionary=DICTIONARY) -> DataFrame:
    """``docs`` with ``__gaps`` (text between candidates), ``__hits`` (the candidates) and ``__found``: array of (i, key, v, score) of all of them."""
    text = F.col(f"`{text_col}`")
    sql = ", ".join(feature_sql(dictionary).values())
    score = "(" + " + ".join(forest.trees) + f") / {len(forest.trees)}D"
    out = docs.withColumns({"__gaps": F.split(text, CANDIDATE, -1), "__hits": F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))})
    parts = f"transform(__hits, (m, i) -> named_struct('i', i, 'm', m, 'v', regexp_replace(m, {_quoted('^' + KEY)}, '')))"
    parts = (f"transform({parts}, x -> named_struct('i', x.i, 'v', x.v, 'key', left(x.m, length(x.m) - length(x.v)), "
             f"'l', right(concat(if(x.i > 0, __hits[greatest(x.i - 1, 0)], ''), __gaps[x.i], left(x.m, length(x.m) - length(x.v))), {CONTEXT}), "
             f"'r', left(__gaps[x.i + 1], {CONTEXT})))")
    scored = (f"transform(transform({parts}, x -> named_struct('i', x.i, 'key', x.key, 'v', x.v, 'f', cast(array({sql}) as array<double>))), "
              f"y -> named_struct('i', y.i, 'key', y.key, 'v', y.v, 'score', {score.replace('f[', 'y.f[')}))")
    return out.withColumn("__found", F.expr(scored))


def find_secrets(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start (0-based, in characters), length, kind, score of every finding that the forest confirms.

    * null and empty texts have no findings; a null id stays null; repeated rows give repeated findings;
    * a finding's score at the threshold counts as a secret; whole texts are scanned, whatever their length;
    * an empty table gives an empty result; other columns are ignored."""
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("__text"))
    rows = scanned(src, forest, "__text").withColumn("__found", F.filter("__found", lambda x: x["score"] >= forest.threshold)).filter(F.size("__found") > 0)
    rows = rows.select("doc_id", "__gaps", "__hits", F.explode("__found").alias("x"))
    begin = F.expr("aggregate(slice(__gaps, 1, x.i + 1), 0L, (a, g) -> a + length(g)) + aggregate(slice(__hits, 1, x.i), 0L, (a, g) -> a + length(g)) + length(x.key)")
    kind = (F.when(F.col("x.v").startswith("-----BEGIN"), "private_key").when(F.col("x.v").rlike(KNOWN), "known_prefix")
            .when(F.col("x.key") != "", "assigned").otherwise("token"))
    return rows.select("doc_id", begin.alias("start"), F.length("x.v").cast("long").alias("length"), kind.alias("kind"), F.col("x.score").alias("score"))


def redact(docs: DataFrame, forest: Forest, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every confirmed secret in the text replaced by ``mark``; all rows and columns stay.

    Null and empty texts stay as they are; names before an assigned value stay."""
    taken = [c for c in docs.columns if c.lower() in ("__gaps", "__found", "__hits")]
    names, inner = docs.columns, docs.withColumnsRenamed({c: fresh(docs, c) for c in taken})
    rows = scanned(inner, forest, text_col)
    new = F.expr(f"concat(array_join(transform(__found, x -> concat(__gaps[x.i], if(x.score >= {forest.threshold!r}D, concat(x.key, {_quoted(mark)}), __hits[x.i]))), ''), "
                 "element_at(__gaps, -1))")
    clean = F.when(F.exists("__found", lambda x: x["score"] >= forest.threshold), new).otherwise(F.col(f"`{text_col}`"))
    return rows.withColumn(text_col, clean).select(*[F.col(f"`{c}`").alias(n) for c, n in zip(inner.columns, names, strict=True)])
