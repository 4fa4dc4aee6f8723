from causeway.llm import html as H
from causeway.llm.queries import op7_html_extraction

from .conftest import SF


def text(source):
    return H.blocks(H.walk(H.parse(source)))


def test_article_without_the_rest():
    page = ("<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t=\"</p>\";</script></head><body><nav><ul><li>menu</ul></nav>"
            "<!-- ad --><div class=\"ad\">buy</div><article><h1>T &amp; U&quot;</h1><p><b>one<br><p>two\n  three<div class='site-notice'>cookies</div>"
            "<form><p>form</form><div id=comments><p>first!</div><p>last &am</article><aside>side</aside><footer>&copy; x</footer>")
    assert text(page) == ['T & U"', "one", "two three", "last &am"]


def test_broken_markup():
    assert text(None or "") == []
    assert text("plain <b>text</b> only") == ["plain text only"]
    assert text("<p>a<p>b</p></p>c") == ["a", "b", "c"]
    assert text("<article><p>a < b and c > d</p></article>") == ["a < b and c > d"]
    assert text("<article><p title='x>y' data=\"a>b\">in</p><p attr='unclosed>still</p></article>")[0] == "in"
    assert text("<article>x</article><div class=\"cut off") == ["x"]
    assert text("<body><ul><li>one<li>two<ul><li>in</ul></ul><table><tr><td>a<td>b<tr><td>c</table>") == ["one", "two", "in", "a", "b", "c"]
    assert text("<div>" * 3000 + "deep") == ["deep"]
    assert text("<article><script>var a = '<p>no</p>'") == []
    assert text("<ARTICLE><P>Caps&nbsp;x&#65;&#x42;</P></ARTICLE>") == ["Caps xAB"]
    assert text("<main><p>m</main><p>out") == ["m"]
    assert text("<p hidden>h</p><p style='display: none'>h</p><p>shown") == ["shown"]


def test_site_templates_are_removed(spark):
    notice = "<div><p>Sign up to our letter today</p></div>"
    pages = [(i, f"http://a.net/{i}", f"<body><div>Header line</div><article><p>Story {i}</p>{notice}<p>Shared phrase</p></article></body>") for i in range(12)]
    pages += [(100 + i, f"http://b.net/{i}", f"<body><div>Top</div><p>Page {i}</p><p>Bottom line</p></body>") for i in range(12)]
    pages += [(200 + i, f"http://c.net/{i}", f"<article><p>Copied story</p>{notice}</article>") for i in range(12)]  # one article, twelve copies
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extract_text(df).collect()}
    assert got[3] == "Story 3\n\nShared phrase"
    assert got[103] == "Page 3"
    assert got[203] == "Copied story\n\nSign up to our letter today"
    joined = {r.page_id: r.text for r in H.extract_text(df, broadcast_up_to=0).collect()}
    assert joined == got


def test_edge_rows(spark):
    rows = [(1, None, None), (2, "http://a.net/", ""), (3, None, "<p>x"), (None, "http://a.net/1", "<p>y"), (5, "http://a.net/2", "<p>" + "long " * 100_000), (3, None, "<p>x")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.text) for r in H.extract_text(df).collect()), key=str)
    assert got == sorted([(1, ""), (2, ""), (3, "x"), (None, "y"), (5, ("long " * 100_000).strip()), (3, "x")], key=str)
    assert H.extract_text(df.limit(0)).count() == 0


def test_query_equals_the_article(spark):
    import html
    import re
    got = {r.page_id: (r.text, r.n_chars) for r in op7_html_extraction(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", p))).split()) for p in re.split(r"</?(?:p|h1)>", body)]
        want = "\n\n".join(p for p in parts if p)
        assert got[r.page_id] == (want, len(want))


def test_what_recurs_on_a_small_share_of_a_host_stays(spark):
    """Twelve of a hundred pages share parts of their text; the menu stands on all of them."""
    menu = "<div class=top><ul><li>Home</ul></div>"
    same = "<h2>Introduction</h2><p>Short note</p><ul><li>None</ul><table><tr><td>0</table><div>Equal part</div>"
    forms = {"a": "<body>{m}<article><p>Story {i} {w}</p>{s}</article>", "m": "<body>{m}<main><p>Story {i} {w}</p>{s}</main>",
             "d": "<body>{m}<div id=content><p>Story {i} {w}</p>{s}</div>", "b": "<body>{m}<p>Story {i} {w}</p>{s}</body>"}
    pages = [(1000 * k + i, f"http://{h}.net/{i}", form.format(m=menu, i=i, w="and what came of it " * 5, s=same if i < 12 else ""))
             for k, (h, form) in enumerate(forms.items()) for i in range(100)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text.split("\n\n") for r in H.extract_text(df).collect()}
    for k in range(4):
        assert got[1000 * k + 3][1:] == ["Introduction", "Short note", "None", "0", "Equal part"]
        assert len(got[1000 * k + 50]) == 1
    assert {r.page_id: r.text.split("\n\n") for r in H.extract_text(df, broadcast_up_to=0).collect()} == got


def test_parts_of_the_main_content_are_never_template(spark):
    """Headings, paragraphs, items and cells of the main content stay though every page has them."""
    same = "<h2>Introduction</h2><p>Short note</p><table><tr><td>{i}<td>0</table>"
    forms = {"m": "<body><div>Top</div><main><p>Story {i}</p>" + same + "</main>", "d": "<body><div>Top</div><div id=content><p>Story {i}</p>" + same + "</div>"}
    pages = [(1000 * k + i, f"http://{h}.net/{i}", form.format(i=i)) for k, (h, form) in enumerate(forms.items()) for i in range(12)]
    flat = "<body><div>Top</div><p>Story {i}</p><h2>Introduction</h2><table><tr><td>{i}<td>0</table>"
    pages += [(2000 + i, f"http://b.net/{i}", flat.format(i=i)) for i in range(12)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text.split("\n\n") for r in H.extract_text(df).collect()}
    assert got[3] == got[1003] == ["Story 3", "Introduction", "Short note", "3", "0"]
    assert got[2003] == ["Story 3", "Introduction", "3", "0"]


def test_names_that_only_mention_a_mark_stay_in_the_article():
    page = ("<article><p>Story</p><div class='notice-board'><p>On the board</p></div><p class=share-price>It rose</p><p class='social-history'>Of the town</p>"
            "<div class='ad-container'>buy</div><div class='cookie-banner wide'>cookies</div><div id=commentList>first!</div><p class='lead newsletter-signup'>Sign up</p></article>")
    assert text(page) == ["Story", "On the board", "It rose", "Of the town"]


def test_the_counted_subtrees_are_written_in_few_files(spark):
    from pathlib import Path

    pages = [(100 * h + i, f"http://h{h}.net/{i}", f"<body><div>Top of {h}</div><article><p>Story {h} {i}</p></article></body>") for h in range(30) for i in range(10)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    base = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = set(base.glob("subtrees-*"))
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {r.page_id: r.text for r in H.extract_text(df).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    new, = set(base.glob("subtrees-*")) - before
    assert len(list(new.glob("*.parquet"))) <= 4
    assert spark.read.parquet(str(new)).count() == 30 * 2  # of each host its articles and the line on top
    assert got == {100 * h + i: f"Story {h} {i}" for h in range(30) for i in range(10)}
