"""DuckDB SQL of the registered queries op11 to op13."""

from __future__ import annotations


def crc32(text: str) -> str:
    """Unsigned crc32 of a string expression of ASCII characters, bit by bit."""
    bits = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: [CAST(ascii({text}[i]) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    step = "xor(xor(c, b) >> 1, CASE WHEN xor(c, b) % 2 = 1 THEN 3988292384 ELSE 0 END)"
    return f"xor(list_reduce(list_prepend(4294967295, {bits}), lambda c, b: {step}), 4294967295)"


_CODE = crc32("CAST(doc_id AS VARCHAR)")

OP11_SQL = rf"""
WITH RECURSIVE raw AS (
  SELECT doc_id, row_number() OVER () AS k, {_CODE} AS h,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
cut AS (
  SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM raw),
period AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM cut),
txt AS (
  SELECT doc_id, k, n, CASE WHEN a IS NULL THEN w ELSE
    list_transform(range(0, n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) END AS w FROM period),
win AS (SELECT k, i, array_to_string(w[i + 1:i + 5], ' ') AS v FROM (SELECT k, w, unnest(range(0, n - 4)) AS i FROM txt)),
same AS (SELECT b.k, b.i, b.i - a.i AS q FROM win a JOIN win b ON a.k = b.k AND a.v = b.v AND a.i < b.i),
isle AS (SELECT *, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS g FROM same),
stretch AS (SELECT k, q, min(i) - q AS s, max(i) + 4 - min(i) + q + 1 AS len FROM isle GROUP BY k, q, g),
run AS (SELECT k, s, len, min(q) AS q FROM stretch WHERE len >= greatest(6, 4 * q) GROUP BY k, s, len),
per AS (
  SELECT k, count(*) AS n_runs, arg_min(struct_pack(s := s, len := len, q := q), struct_pack(a := -len, b := s, c := q)) AS best,
    string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM run GROUP BY k),
gone AS (SELECT k, list(DISTINCT p) AS ps FROM (SELECT k, unnest(range(s + q, s + len)) AS p FROM run) GROUP BY k),
kept AS (
  SELECT k, CASE WHEN ps IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(0, n)), lambda z: NOT list_contains(ps, z[2])), lambda z: z[1]) END AS rest
  FROM txt LEFT JOIN gone USING (k))
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.len AS BIGINT) AS length, CAST(best.q AS BIGINT) AS period,
  CAST(1000 * best.len // best.q AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
  sha256(array_to_string(rest, ' ')) AS collapsed_sha256
FROM txt JOIN kept USING (k) LEFT JOIN per USING (k)
"""

OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tok FROM d),
c AS (SELECT *, len(tok) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(tok) + 1) AS x, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(tok) + 1) AS y,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
      WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(tok[1:least(x, y)], '') AS a, array_to_string(tok[least(x, y) + 1:greatest(x, y)], '') AS b,
    array_to_string(tok[greatest(x, y) + 1:], '') AS z FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""


def _sketch(text: str) -> str:
    """Sorted distinct hashes below a quarter of all values, and the smallest one, of the 5-word runs of ``text``."""
    words = rf"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
    runs = f"(SELECT list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: substr(md5(array_to_string(w[i:i + 4], ' ')), 1, 12))) AS h FROM (SELECT {words} AS w))"
    return f"(SELECT CASE WHEN {text} IS NULL OR trim({text}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN [] ELSE list_sort(list_filter(h, lambda x: x < '4' OR x = list_min(h))) END FROM {runs})"


def _near(a: str, b: str) -> str:
    return (f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE "
            f"ELSE len(list_intersect({a}, {b})) / least(len({a}), len({b}))::DOUBLE END")


OP13_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id DESC NULLS LAST, text) AS k FROM documents),
e AS (
  SELECT a.doc_id, a.k, a.text, length(a.text) AS n, b.k AS next_k,
    left(a.text, length(a.text) - length(a.text) // 3) || left(b.text, length(a.text) // 3) AS edited
  FROM d a JOIN d b ON b.k = CASE WHEN a.k = (SELECT max(k) FROM d) THEN 1 ELSE a.k + 1 END),
f AS (SELECT *, {_sketch("text")} AS fp, {_sketch("edited")} AS ep FROM e)
SELECT f.doc_id, CAST(f.n AS BIGINT) AS n_chars, sha256(f.edited) AS edited_sha256, array_to_string(f.fp, ',') AS fingerprint,
  array_to_string(f.ep, ',') AS edited_fingerprint, {_near("f.fp", "f.ep")} AS near_edited, {_near("f.fp", "g.fp")} AS near_next
FROM f JOIN f g ON g.k = f.next_k
"""
