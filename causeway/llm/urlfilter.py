"""URL filter with redirect equivalence.

A URL's host and path are judged by the longest fitting rule.  URLs that redirect to each other or
name each other as canonical are aliases: connected components over these edges carry a block from any
member to all members without a rule of their own.  Explicit allow has precedence: a URL that a rule
allows stays allowed, and a component with an allowed member passes no block on.

Edges come from the pages' own ``<link rel="canonical">`` and ``<meta http-equiv="refresh">`` elements and,
if given, from a table of redirects.  Nodes are (host, path): rules see nothing else of a URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let
from .components import connected_components

#: Contract rules, as (verdict, "host/path").
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
MAX_RULES = 10_000

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
ELEMENT = r"(?is)<(?:link|meta)\s[^>]*>"
BASE = r"(?is)<base\s[^>]*>"
#: What a browser does not read as elements: comments, and elements of raw text (cut off at the end of the page, too).
UNREAD = r"(?is)<!--.*?(?:-->|\z)" + "".join(rf"|<{t}\b.*?(?:</{t}\s*>|\z)" for t in ("script", "style", "noscript", "template", "iframe", "textarea", "title", "xmp"))
IS_CANONICAL = r"(?is)^<link\s.*\brel\s*=\s*[\"']?canonical\b"
IS_REFRESH = r"(?is)^<meta\s.*\bhttp-equiv\s*=\s*[\"']?refresh\b"
HREF = r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)"
REFRESH_URL = r"(?is)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules) -> Column:
    """struct(verdict, rule) of the longest fitting rule (ties: allow first), else null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules: pass them in several calls or compile them to a table")
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(set(rules), key=lambda r: (len(r[1]), r[0] == "allow")):  # the longest is tested first
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def folded(path: Column) -> Column:
    """A path without its ``.`` and ``..`` segments."""
    up = lambda a: F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))

    def without_dots(parts):
        kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, s: F.when(s == "..", up(a)).when(s == ".", a).otherwise(F.concat(a, F.array(s))))
        open_end = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.lit("/"), F.array_join(F.concat(kept, open_end), "/"))
    return let(path, lambda p: F.when(p.rlike(r"/\.\.?(?:/|$)"), let(F.split(F.substr(p, F.lit(2)), "/", -1), without_dots)).otherwise(p))


def resolved(href: Column, url: Column) -> Column:
    """Absolute form of a link found at ``url`` (absolute, //host, /path, or relative to the folder), dot segments folded."""
    def from_url(u, link):
        scheme = F.regexp_extract(u, r"(?s)^(.*?)://", 1)
        site = F.concat(scheme, F.lit("://"), F.regexp_extract(u, URL, 1))
        folder = F.regexp_extract(path_of(u), r"(?s)^(.*/)", 1)
        folder = F.when(folder == "", "/").otherwise(folder)
        return (F.when(link.contains("://"), link).when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
                .when(link.startswith("/"), F.concat(site, link)).otherwise(F.concat(site, folder, link)))

    def tidy(whole):
        front, rest = F.regexp_extract(whole, r"(?s)^(.*?://[^/?#]*)", 1), F.regexp_extract(whole, r"(?s)^.*?://[^?#]*(.*)$", 1)
        return F.concat(front, folded(path_of(whole)), rest)
    return let(url, lambda u: let(F.replace(href, F.lit("&amp;"), F.lit("&")), lambda link: let(from_url(u, link), tidy)))


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst) URLs of canonical links and refresh redirects of the pages (whole html).

    Comments, scripts and other raw text hold no links; a ``<base href>`` is what relative links start from."""
    url, html = F.col(f"`{url_col}`"), F.col(f"`{html_col}`")
    linked = pages.filter(url.isNotNull() & html.rlike("(?i)canonical|refresh")).select(url.alias("src"), F.regexp_replace(html, UNREAD, " ").alias("html"))
    tags = F.regexp_extract_all(F.col("html"), F.lit(ELEMENT), F.lit(0))
    named = F.transform(F.filter(tags, lambda t: t.rlike(IS_CANONICAL)), lambda t: F.regexp_extract(t, HREF, 1))
    sent = F.transform(F.filter(tags, lambda t: t.rlike(IS_REFRESH)), lambda t: F.regexp_extract(t, REFRESH_URL, 1))
    base = F.regexp_extract(F.regexp_extract(F.col("html"), BASE, 0), HREF, 1)
    found = linked.select("src", base.alias("base"), F.explode(F.concat(named, sent)).alias("href")).filter(F.col("href") != "")
    start = F.when(F.col("base") != "", resolved(F.col("base"), F.col("src"))).otherwise(F.col("src"))
    return found.select("src", resolved(F.col("href"), start).alias("dst"))


def _nodes(urls: DataFrame, col: str, rules) -> DataFrame:
    host, path = host_of(F.col(col)), path_of(F.col(col))
    return urls.select(host.alias("host"), path.alias("path")).select(
        F.xxhash64("host", "path").alias("node"), rule_for(F.col("host"), F.col("path"), rules)["verdict"].alias("verdict"))


def judge_urls(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, id_col: str = "page_id",
               url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """page id, host, path, rule, verdict and ``alias_blocked`` of every row of ``pages``.

    * very long urls and pages are read whole; a null url or one without ``://`` has an empty host and path, no rule and no alias: allowed;
    * a url that a rule fits gets the rule's verdict, whatever its aliases;
    * without a rule: blocked if an alias is blocked by a rule and none is allowed by one, else allowed;
    * repeated rows are judged alike; rules of equal length: allow wins; null html has no links;
    * an empty table gives an empty result; other columns are ignored."""
    pair = []
    if html_col:
        pair.append(page_edges(pages, url_col, html_col))
    if redirects is not None:
        pair.append(redirects.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL"))
    url = F.col(f"`{url_col}`")
    out = (pages.select(F.col(f"`{id_col}`").alias(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
           .withColumn("_r", rule_for(F.col("host"), F.col("path"), rules)))
    alias = F.lit(False)
    if pair:
        urls = pair[0] if len(pair) == 1 else pair[0].unionByName(pair[1])
        aliased = blocked_nodes(urls, rules)
        out = out.withColumn("_n", F.xxhash64("host", "path")).join(aliased, F.col("_n") == F.col("node"), "left")
        alias = F.coalesce(F.col("aliased"), F.lit(False)) & ((F.col("host") != "") | (F.col("path") != ""))
    return out.select(id_col, "host", "path", F.col("_r.rule").alias("rule"),
                      F.coalesce("_r.verdict", F.when(alias, "block").otherwise("allow")).alias("verdict"),
                      alias.alias("alias_blocked"))


def blocked_nodes(urls: DataFrame, rules) -> DataFrame:
    """(node, aliased): nodes whose component has a blocked member and no allowed one."""
    ends = urls.select(host_of(F.col("src")).alias("h1"), path_of(F.col("src")).alias("p1"),
                       host_of(F.col("dst")).alias("h2"), path_of(F.col("dst")).alias("p2"))
    ends = ends.filter("(h1 <> '' OR p1 <> '') AND (h2 <> '' OR p2 <> '')")
    edges = ends.select(F.xxhash64("h1", "p1").alias("a"), F.xxhash64("h2", "p2").alias("b"))
    roots = connected_components(edges)
    nodes = _nodes(urls, "src", rules).unionByName(_nodes(urls, "dst", rules)).groupBy("node").agg(F.max("verdict").alias("verdict"))
    placed = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "verdict")
    spread = (placed.groupBy("root").agg(F.max(F.coalesce(F.col("verdict") == "block", F.lit(False))).alias("b"),
                                         F.max(F.coalesce(F.col("verdict") == "allow", F.lit(False))).alias("a"))
              .filter("b AND NOT a").select("root"))
    return placed.join(spread, "root").select("node", F.lit(True).alias("aliased"))
