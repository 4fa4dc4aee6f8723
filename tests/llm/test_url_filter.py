from urllib.parse import urljoin

from causeway.llm import urlfilter as U

RULES = U.RULES


def node(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([len(rest)] + [rest.find(c) for c in "/?#" if c in rest])
    host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
    rest = rest[end:]
    return host, rest[:min([len(rest)] + [rest.find(c) for c in "?#" if c in rest])]


def rule(host, path):
    best = None
    for verdict, r in RULES:
        h, p = r.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r) > len(best[1])):
            best = verdict, r
    return best


def brute(pages, edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = node(a), node(b)
        if a != ("", "") and b != ("", ""):
            up[root(a)] = root(b)
    seen = {}
    for x in up:
        r = rule(*x)
        seen.setdefault(root(x), set()).add(r[0] if r else None)
    out = set()
    for i, url in pages:
        x = node(url)
        r = rule(*x)
        s = seen.get(root(x), set()) if x in up else set()
        alias = "block" in s and "allow" not in s
        out.add((i, *x, r[1] if r else None, r[0] if r else ("block" if alias else "allow"), alias))
    return out


PAGES = [
    (1, "https://example.org/es/1", ""), (2, "http://WWW.Example.ORG/es/x?y#z", None), (3, "https://a.example.org/en/12", ""), (4, "https://example.org/en/2", ""),
    (5, "http://shop.com/de/1", "<html>"), (6, "http://shop.com/fr/1", ""), (7, "http://notorg/", ""), (8, "http://myexample.org/es/", ""), (9, None, None),
    (10, "no scheme", ""), (11, "x://", ""), (12, "http://net.net", '<link rel="canonical" href="http://shop.com/de/9">'),
    (13, "http://net.net/a/b.html", '<head><LINK href=\'../c\' rel=canonical></head><meta http-equiv="refresh" content="0; url=/de">'),
    (14, "http://net.net/de", '<meta content="3;URL=//shop.com/de/7?x" http-equiv=refresh>'), (15, "http://other.net/p", '<link rel="stylesheet" href="http://shop.com/de/s.css">'),
    (16, "http://mixed.net/1", '<link rel="canonical" href="http://shop.com/de/m">'), (17, "http://mixed.net/2", '<link rel="canonical" href="http://mixed.net/1">'),
    (18, "http://good.org/", '<link rel="canonical" href="http://mixed.net/2">'), (1, "https://example.org/es/1", ""), (19, "http://x.org", ""), (20, "a\nb://c.net/d\ne", ""),
]
EDGES = [("http://net.net", "http://shop.com/de/9"), ("http://net.net/a/b.html", "http://net.net/c"), ("http://net.net/a/b.html", "http://net.net/de"),
         ("http://net.net/de", "http://shop.com/de/7?x"), ("http://mixed.net/1", "http://shop.com/de/m"), ("http://mixed.net/2", "http://mixed.net/1"), ("http://good.org/", "http://mixed.net/2")]


def rows(df):
    return {(r.page_id, r.host, r.path, r.rule, r.verdict, r.alias_blocked) for r in df.collect()}


def test_equals_brute_force(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = rows(U.judge_urls(pages))
    assert got == brute([(i, u) for i, u, _ in PAGES], EDGES)
    by = {r[0]: r[4] for r in got}
    assert [by[i] for i in (12, 13, 14, 15, 16, 17, 18)] == ["block", "block", "block", "allow", "allow", "allow", "allow"]
    assert U.judge_urls(pages).count() == len(PAGES)


def test_redirect_table(spark):
    pages = spark.createDataFrame([(i, f"http://n.net/{i}") for i in range(30)], "page_id long, url string")
    edges = [(f"http://n.net/{i}", f"http://n.net/{i + 1}") for i in range(0, 20)] + [("http://n.net/20", "http://a.com/de/x"), ("http://n.net/25", None)]
    redirects = spark.createDataFrame(edges, "src string, dst string")
    got = rows(U.judge_urls(pages, redirects=redirects, html_col=None))
    assert got == brute([(i, f"http://n.net/{i}") for i in range(30)], [e for e in edges if e[1]])
    assert sum(r[4] == "block" for r in got) == 21


def test_empty_and_clashing(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string, verdict string, node long, root long")
    assert U.judge_urls(pages).count() == 0
    one = spark.createDataFrame([(1, "http://a.com/de/1", None, "x", 5)], "page_id long, url string, html string, verdict string, node long")
    assert rows(U.judge_urls(one)) == {(1, "a.com", "/de/1", "com/de/", "block", False)}


def test_resolved_links_follow_the_standard(spark):
    cases = [("http://a.net/x/y?q", h) for h in ("http://b.net/z", "//b.net/z", "/z", "z.html", "../z", "./z", "../../../z", "a/./b/../c", "..", "/a/b/..", 
                                                 "a..b/c", ".well/x")]
    df = spark.createDataFrame(cases, "url string, href string")
    got = [r[0] for r in df.select(U.resolved(df.href, df.url)).collect()]
    assert got == [urljoin(u, h) for u, h in cases]
    whole = spark.createDataFrame([("http://a.net/", "http://b.net/a/../z?x=../y")], "url string, href string")
    assert whole.select(U.resolved(whole.href, whole.url)).first()[0] == "http://b.net/z?x=../y"


HIDDEN = [
    (1, "http://s.net/1", '<!-- <link rel="canonical" href="http://shop.com/de/1"> --><p>x'),
    (2, "http://s.net/2", '<script>var a = \'<link rel="canonical" href="http://shop.com/de/1">\'</script>'),
    (3, "http://s.net/3", '<textarea><meta http-equiv="refresh" content="0; url=http://shop.com/de/1">'),
    (4, "http://s.net/4", '<base href="http://shop.com/de/"><link rel="canonical" href="4">'),
    (5, "http://s.net/x/5", '<base href="../deep/"><link rel="canonical" href="../../5b"><!-- open'),
    (6, "http://s.net/5b", '<link rel="canonical" href="http://shop.com/x/../de/./6">'),
    (7, "http://s.net/7", '<!-- cut off <link rel="canonical" href="http://shop.com/de/1">'),
]


def test_links_that_no_browser_reads_and_bases(spark):
    pages = spark.createDataFrame(HIDDEN, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in U.judge_urls(pages).collect()}
    assert got == {1: "allow", 2: "allow", 3: "allow", 4: "block", 5: "block", 6: "block", 7: "allow"}


def test_query_and_sql_with_planted_links(spark, tmp_path):
    """Components carry blocks through op4_url_filter itself; the SQL agrees."""
    import duckdb

    from causeway.llm.queries import OP4_SQL, op4_url_filter
    long_ = [(900, "http://long.net/" + "a" * 50_000, "<p>" + "x" * 500_000 + '<link rel="canonical" href="http://shop.com/de/long">')]
    rows_ = [(*p, ) for p in PAGES if p[0] != 20] + [(100 + i, u, h) for i, u, h in HIDDEN] + long_
    spark.createDataFrame(rows_, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(map(str, (tuple(r) for r in op4_url_filter(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict", "alias_blocked").collect())))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = sorted(map(str, con.execute(f"SELECT page_id, host, path, rule, verdict, alias_blocked FROM ({OP4_SQL})").fetchall()))
    assert got == want and sum("True" in r for r in got) >= 5
