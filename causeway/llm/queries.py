"""Registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.session import shared_path

from . import decontaminate, fim, fingerprints, html, langid, ngram_join, packing, runs, secrets, sharding, substrings, topk, urlfilter
from .common import need, read_documents
from .sql import OP11_SQL, OP12_SQL, OP13_SQL

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-fit-decreasing packing of all documents into windows of 4096 tokens."""
    docs = need(read_documents(spark, sf_dir), "doc_id", "text")
    return packing.piece_digests(packing.pack(docs, TOKENIZER))


def op2_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents laid out by source, resharded on files to 24 shards of equal bytes with the fewest bytes moved, and read back."""
    docs = need(read_documents(spark, sf_dir), "doc_id", "text", "source")
    old = F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(24))
    return sharding.reshard_files(docs, old, 24, shared_path(spark, "shards")).select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), F.col("old").alias("old_shard"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents leak, re-parameterised ones included."""
    docs = need(read_documents(spark, sf_dir), "doc_id", "text")
    items = need(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", "text")
    return decontaminate.find_leaks(docs, items).drop("row")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url by rules and redirect equivalence."""
    pages = need(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "url", "html")
    return urlfilter.judge_urls(pages)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets have a Jaccard similarity of 0.8 or more."""
    docs = need(read_documents(spark, sf_dir), "doc_id", "text")
    return ngram_join.near_classes(docs).drop("key", "root")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents that the random forest confirms."""
    docs = need(read_documents(spark, sf_dir), "doc_id", "text")
    return secrets.find_secrets(docs, secrets.train_forest(secrets.labelled_findings(docs)))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page after site-template removal."""
    pages = need(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "url", "html")
    return html.extract_text(pages).withColumn("n_chars", F.char_length("text").cast("long"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left after removing windows of 13 words that also start in a document with a smaller id."""
    docs = need(read_documents(spark, sf_dir), "doc_id", "text")
    return substrings.remove_repeats(docs, keep_text=False)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from rows that are not held out."""
    docs = need(read_documents(spark, sf_dir), "doc_id", "text", "lang")
    model = langid.train_on(docs)
    return (langid.identify(docs, model, keep=["doc_id"])
            .select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five highest integer inner products for every 50th vector against all others."""
    table = need(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return topk.top_k(table, F.col("vec_id") % 50 == 0)


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` where a tenth of the texts, told by the id's crc32, repeat a stretch of their own words up to the end."""
    h = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.expr(rf"regexp_extract_all(`{text_col}`, '[^\\x20\\x09-\\x0D]+', 0)"))
    d = docs.withColumn("__g", F.expr(f"crc32(cast(cast(`{id_col}` as string) as binary)) div 10")).withColumn("__w", words)
    d = d.withColumn("__n", F.size("__w"))  # -1 where the text stands as it is
    d = d.withColumn("__a", F.expr("case when __n > 0 then cast(__g % __n as int) end"))
    d = d.withColumn("__p", F.expr("cast(1 + (__n - __a) div (3 + __g % 8) as int)"))
    repeated = F.expr("""array_join(slice(concat(slice(__w, 1, __a),
        flatten(array_repeat(slice(__w, __a + 1, __p), cast(ceil((__n - __a) / __p) as int)))), 1, __n), ' ')""")
    return d.withColumn(text_col, F.when(F.col("__n") > 0, repeated).otherwise(F.col(f"`{text_col}`"))).drop("__g", "__w", "__n", "__a", "__p")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in all documents, a tenth of which repeat a stretch of their words."""
    docs = with_planted_runs(need(read_documents(spark, sf_dir), "doc_id", "text"))
    return runs.run_digests(runs.find_runs(docs), "doc_id")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-middle form of all documents, and the texts restored from it."""
    docs = need(read_documents(spark, sf_dir), "doc_id", "text")
    columns = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256")
    made = fim.fill_in_middle(docs).withColumn("output_sha256", F.sha2(F.col("output").cast("binary"), 256))
    restored = fim.restore(made, keep=columns)
    return restored.select(*columns, F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike they are."""
    prints = fingerprints.edited_prints(need(read_documents(spark, sf_dir), "doc_id", "text"))
    return prints.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                         "fingerprint", "edited_fingerprint", "near_edited", "near_next")


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_NODE = "regexp_extract({0}, '(?s)^.*?://([^/?#]*)([^?#]*)', {1})"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _host(url: str) -> str:
    return _LOWER.format(f"coalesce({_NODE.format(url, 1)}, '')")


def _path(url: str) -> str:
    return f"coalesce({_NODE.format(url, 2)}, '')"


_HREF = """'(?is)\\bhref\\s*=\\s*["'']?\\s*([^"''\\s>]+)'"""


def _sql_text(s: str) -> str:
    return s.replace("'", "''")


def _folded(path: str) -> str:
    parts = f"string_split(substr({path}, 2), '/')"
    kept = (f"list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform({parts}, lambda s: [s])), "
            "lambda a, s: CASE s[1] WHEN '..' THEN a[1:len(a) - 1] WHEN '.' THEN a ELSE list_concat(a, s) END)")
    return (f"CASE WHEN regexp_matches({path}, '/\\.\\.?(?:/|$)') THEN '/' || array_to_string(list_concat({kept}, "
            f"CASE WHEN {parts}[-1] IN ('.', '..') THEN [''] ELSE [] END), '/') ELSE {path} END")


def _resolved(href: str, url: str) -> str:
    """Absolute form of a link, dot segments folded; the query does not matter to a node."""
    link = f"replace({href}, '&amp;', '&')"
    whole = (f"CASE WHEN contains({link}, '://') THEN {link} WHEN starts_with({link}, '//') THEN regexp_extract({url}, '(?s)^(.*?)://', 1) || ':' || {link} "
             f"WHEN starts_with({link}, '/') THEN regexp_extract({url}, '(?s)^(.*?://[^/?#]*)', 1) || {link} "
             f"ELSE regexp_extract({url}, '(?s)^(.*?://[^/?#]*)', 1) || coalesce(nullif(regexp_extract({_path(url)}, '(?s)^(.*/)', 1), ''), '/') || {link} END")
    return f"(SELECT regexp_extract(x, '(?s)^(.*?://[^/?#]*)', 1) || {_folded(_path('x'))} FROM (SELECT {whole} AS x))"


OP4_SQL = f"""
WITH RECURSIVE rules(verdict, rule) AS (VALUES {", ".join(f"('{v}', '{r}')" for v, r in urlfilter.RULES)}),
rule_parts AS (SELECT *, split_part(rule, '/', 1) AS rhost, substr(rule, strpos(rule, '/')) AS rpath FROM rules),
read AS (SELECT url, regexp_replace(html, '{_sql_text(urlfilter.UNREAD)}', ' ', 'g') AS html FROM pages WHERE url IS NOT NULL),
tags AS (
  SELECT url, regexp_extract(regexp_extract(html, '(?is)<base\\s[^>]*>'), {_HREF}, 1) AS base, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\\s[^>]*>')) AS t FROM read),
links AS (
  SELECT url AS src, base, regexp_extract(t, {_HREF}, 1) AS href FROM tags
  WHERE regexp_matches(t, '(?is)^<link\\s.*\\brel\\s*=\\s*["'']?canonical\\b')
  UNION ALL
  SELECT url, base, regexp_extract(t, '(?is)\\burl\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1) FROM tags
  WHERE regexp_matches(t, '(?is)^<meta\\s.*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b')),
based AS (SELECT src, href, CASE WHEN base <> '' THEN {_resolved('base', 'src')} ELSE src END AS start FROM links WHERE href <> ''),
urls AS (SELECT src, {_resolved('href', 'start')} AS dst FROM based),
edge AS (
  SELECT {_host('src')} || ' ' || {_path('src')} AS a, {_host('dst')} || ' ' || {_path('dst')} AS b FROM urls),
both_ways AS (SELECT a, b FROM edge WHERE a <> ' ' AND b <> ' ' UNION SELECT b, a FROM edge WHERE a <> ' ' AND b <> ' '),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
judged AS (
  SELECT n.node, arg_max(verdict, length(rule) * 2 + CAST(verdict = 'allow' AS INTEGER)) AS verdict
  FROM (SELECT DISTINCT b AS node FROM reach) n JOIN rule_parts
    ON (split_part(n.node, ' ', 1) = rhost OR ends_with(split_part(n.node, ' ', 1), '.' || rhost))
    AND starts_with(substr(n.node, strpos(n.node, ' ') + 1), rpath) GROUP BY n.node),
spread AS (
  SELECT a FROM reach JOIN judged ON b = node GROUP BY a
  HAVING count(*) FILTER (verdict = 'block') > 0 AND count(*) FILTER (verdict = 'allow') = 0),
p AS (SELECT page_id, {_host('url')} AS host, {_path('url')} AS path, row_number() OVER () AS k FROM pages),
fit AS (
  SELECT k, max_by(rule, length(rule) * 2 + CAST(verdict = 'allow' AS INTEGER)) AS rule,
    max_by(verdict, length(rule) * 2 + CAST(verdict = 'allow' AS INTEGER)) AS verdict
  FROM p JOIN rule_parts ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY k)
SELECT p.page_id, p.host, p.path, fit.rule,
  coalesce(fit.verdict, CASE WHEN spread.a IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  spread.a IS NOT NULL AS alias_blocked
FROM p LEFT JOIN fit USING (k) LEFT JOIN spread ON spread.a = p.host || ' ' || p.path
"""

OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, row_number() OVER () AS k,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
                lambda x: x <> '') AS words FROM documents),
g AS (
  SELECT k, doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS grams FROM w),
sized AS (SELECT k, doc_id, len(grams) AS n, list_sort(grams) AS grams FROM g),
cls AS (SELECT grams, min(k) AS rep, min(n) AS n FROM sized WHERE n > 0 GROUP BY grams),
gram AS (SELECT rep, n, unnest(grams) AS gram FROM cls),
pair AS (
  SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM gram a JOIN gram b ON a.gram = b.gram AND a.rep <> b.rep
  GROUP BY ALL),
link AS (SELECT a, b FROM pair WHERE 100 * shared >= 80 * (na + nb - shared)),
reach(a, b) AS (SELECT rep, rep FROM cls UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
member AS (SELECT s.k, s.doc_id, c.rep FROM sized s JOIN cls c ON s.grams = c.grams WHERE s.n > 0),
low AS (SELECT r.a AS rep, min(m.doc_id) AS low FROM reach r JOIN member m ON m.rep = r.b GROUP BY r.a)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, coalesce(low.low, s.doc_id) AS component_id
FROM sized s LEFT JOIN member m ON m.k = s.k LEFT JOIN low ON low.rep = m.rep
"""

OP8_SQL = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS k, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
win AS (
  SELECT k, doc_id, s, array_to_string(words[s:s + 12], ' ') AS win
  FROM (SELECT k, doc_id, words, unnest(range(1, len(words) - 11)) AS s FROM w)),
low AS (SELECT win, min(doc_id) AS low FROM win GROUP BY win),
hit AS (SELECT k, s FROM win JOIN low USING (win) WHERE low < doc_id),
gone AS (SELECT DISTINCT k, unnest(range(s, s + 13)) AS p FROM hit),
per AS (SELECT k, list(p) AS ps FROM gone GROUP BY k),
kept AS (
  SELECT doc_id, words, coalesce(len(ps), 0) AS n_removed,
    CASE WHEN ps IS NULL THEN words ELSE list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda z: NOT list_contains(ps, z[2])), lambda z: z[1]) END AS rest
  FROM w LEFT JOIN per USING (k))
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
  sha256(array_to_string(rest, ' ')) AS kept_sha256 FROM kept
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_resharding": op2_resharding,
    "op3_decontamination": op3_decontamination,
    "op4_url_filter": op4_url_filter,
    "op5_ngram_join": op5_ngram_join,
    "op6_secret_scan": op6_secret_scan,
    "op7_html_extraction": op7_html_extraction,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_language_id": op9_language_id,
    "op10_exact_top_k": op10_exact_top_k,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_fingerprints": op13_fingerprints,
}
ORACLES: dict[str, str] = {"op4_url_filter": OP4_SQL, "op5_ngram_join": OP5_SQL, "op8_substring_dedup": OP8_SQL,
                           "op10_exact_top_k": OP10_SQL, "op11_periodic_runs": OP11_SQL, "op12_fill_in_middle": OP12_SQL,
                           "op13_fingerprints": OP13_SQL}
