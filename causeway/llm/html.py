"""Main text of web pages, with site templates removed.

Every page's element subtrees are hashed together with the page's host.  Spark counts each hash
over the different articles of a host; subtrees that recur across a share of them (menus, notices,
footers) are template and are deleted, then the article's blocks are read.  Copies of one article
count once, so text that is merely republished is not taken for template.  Inside the article, the main
element, or what holds most text of a page without either, only container elements can be template,
never paragraphs, headings, list items or cells.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_bytes, longs, row_key, shuffle_width, small_batches, write_shared
from .urlfilter import host_of

TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Fixed values of HTML: elements without content, raw text, elements closed by a following start tag, inline elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title noembed noframes xmp".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
                     "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
CLOSES_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
               "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}}
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rb rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var wbr".split())
CONTAINERS = frozenset("aside dialog div dl fieldset figure footer form header menu nav ol section table ul".split())
PARTS = frozenset("h1 h2 h3 h4 h5 h6 hgroup li dt dd tr td th thead tbody tfoot caption".split())
DROPPED = RAW | frozenset("aside button canvas datalist dialog footer form head input menu nav object select svg audio video".split())
#: Words in class, id or role that mark what is not the article.
MARKS = frozenset("ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
                  "disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices overlay pager pagination paywall "
                  "popup promo promoted promotion related reply replies recommended share sharing sidebar signup social sponsor sponsored "
                  "subscribe subscription toolbar widget masthead contentinfo complementary".split())
#: Words at the end of a class name that say what shape an element has, not what it holds.
SHAPES = frozenset("area bar block body box button buttons container content form group holder icon icons inner item items link links list outer panel "
                   "placeholder row section slot thread title unit wrap wrapper zone".split())
WHOLE = frozenset(("html", "body", "article", "main"))
MAX_DEPTH = 500


class Node:
    __slots__ = ("tag", "attrs", "up", "kids", "kind")

    def __init__(self, tag, attrs, up):
        self.tag, self.attrs, self.up, self.kids = tag, attrs, up, []


def parse(source: str) -> Node:
    """Lenient element tree; kids are nodes and strings (character references decoded)."""
    root = Node("#root", "", None)
    stack, at, end = [root], 0, len(source)

    def text(s):
        if s:
            stack[-1].kids.append(entities.unescape(s) if "&" in s else s)

    for m in TOKEN.finditer(source):
        if m.start() < at:
            continue
        text(source[at:m.start()])
        at = m.end()
        name = m[2]
        if name is None or not m[4]:
            continue  # comment, declaration, or a tag cut off at the end of the page
        name = name.lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == name:
                    del stack[k:]
                    break
                if stack[k].tag in WHOLE and name in INLINE:
                    break
            continue
        if name in CLOSES_P:
            _close(stack, {"p"}, {"button", "table", "td", "th", "object"})
        if name in CLOSES_SAME:
            _close(stack, CLOSES_SAME[name], STOPS.get(name, {"table"}))
        node = Node(name, m[3], stack[-1])
        stack[-1].kids.append(node)
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(source, at)
            inner = source[at:close.start()] if close else source[at:]
            node.kids.append(inner)
            at = close.end() if close else end
        elif name not in VOID and len(stack) < MAX_DEPTH:  # a slash does not close an HTML element
            stack.append(node)
    text(source[at:])
    return root


def _close(stack, tags, stops) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            del stack[k:]
            return
        if stack[k].tag in stops or stack[k].tag in WHOLE:
            return


def _names_a_mark(name: str) -> bool:
    """Whether a class name as a whole is a mark (``site-notice``, ``adBox``): its last word is one, words of shape aside.  Inside an article
    a mark that only qualifies another thing (``notice-board``, ``share-price``) says nothing."""
    words = [w.lower() for w in WORD.findall(name)]
    while len(words) > 1 and words[-1] in SHAPES:
        words.pop()
    return bool(words) and words[-1] in MARKS


def marked(node: Node, in_article: bool) -> bool:
    """Whether tag or attributes say that the element is not part of an article."""
    if node.tag in DROPPED:
        return True
    if node.tag == "header" and not in_article:
        return True
    if not node.attrs or node.tag in ("html", "body", "main"):
        return False
    for m in ATTRIBUTE.finditer(node.attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True
        elif name in ("class", "id", "role") and (any(_names_a_mark(v) for v in value.split()) if in_article else any(w.lower() in MARKS for w in WORD.findall(value))):
            return True
        elif name in ("class", "id") and not in_article and any(w.lower() == "header" for w in WORD.findall(value)):
            return True
    return False


def walk(root: Node, deleted=frozenset()):
    """Article roots in page order, outside of marked and deleted elements."""
    articles, mains, stack = [], [], [root]
    while stack:
        node = stack.pop()
        if node.tag != "#root" and (id(node) in deleted or marked(node, False)):
            continue
        if node.tag == "article":
            articles.append(node)
            continue
        if node.tag == "main":
            mains.append(node)
        stack.extend(k for k in reversed(node.kids) if isinstance(k, Node))
    return articles or mains[:1] or [root]


def blocks(roots: list[Node], deleted=frozenset()) -> list[str]:
    """Blocks of text under the roots: white space folded, trimmed, empty ones left out."""
    out, now = [], []

    def flush():
        block = " ".join("".join(now).split())
        if block:
            out.append(block)
        now.clear()

    for root in roots:
        in_article = root.tag in ("article", "main")
        stack = [root]
        while stack:
            item = stack.pop()
            if item is None:
                flush()
            elif isinstance(item, str):
                now.append(item)
            elif item.tag == "br":
                now.append(" ")
            elif item is not root and (id(item) in deleted or marked(item, in_article)):
                if item.tag not in INLINE:
                    flush()
            elif item.tag == "header" and in_article:  # a header of the article: its headings alone
                flush()
                stack.extend([None, *reversed([k for k in _below(item) if k.tag in ("h1", "h2", "h3", "h4", "h5", "h6")])])
            else:
                inline = item.tag in INLINE
                if not inline:
                    flush()
                    stack.append(None)
                stack.extend(reversed(item.kids))
        flush()
    return out


def _below(node: Node):
    stack = [k for k in reversed(node.kids) if isinstance(k, Node)]
    while stack:
        n = stack.pop()
        yield n
        if n.tag not in ("h1", "h2", "h3", "h4", "h5", "h6"):
            stack.extend(k for k in reversed(n.kids) if isinstance(k, Node))


def subtrees(root: Node, host: str) -> list[tuple[int, Node]]:
    """(hash of host and subtree, element) of the elements that can be template."""
    salt = xxhash.xxh3_64_intdigest(host.encode())
    order = [root]
    for node in order:
        order.extend(k for k in node.kids if isinstance(k, Node))
    whole = any(node.tag in ("article", "main") for node in order)
    content = None if whole else _content(root, order)
    flat = content is not None and (content.tag == "#root" or content.tag in WHOLE)
    inside = {id(root): False}
    for node in order:
        for k in node.kids:
            if isinstance(k, Node):
                inside[id(k)] = inside[id(node)] or node.tag in ("article", "main") or node is content and not flat
    codes, out = {}, []
    for node in reversed(order):  # children before parents
        h = xxhash.xxh3_64(f"<{node.tag} {' '.join(node.attrs.split())}>".encode())
        for k in node.kids:
            if isinstance(k, Node):
                h.update(codes[id(k)].to_bytes(8, "little"))
            else:
                s = " ".join(k.split())
                if s:
                    h.update(s.encode("utf-8", "surrogatepass") + b"\0")
        code = codes[id(node)] = h.intdigest()
        if node.tag in WHOLE or node.tag == "#root" or node.tag in INLINE or node.tag in VOID or node.tag in ("head", "title", "style", "script"):
            continue
        if node.tag in CONTAINERS or not inside[id(node)] and not (flat and node.tag in PARTS):
            out.append(((code ^ salt) * 0x9E3779B97F4A7C15 % (1 << 64), node))
    return out


def _content(root: Node, order: list[Node]) -> Node:
    """The innermost element with blocks in it that holds more than half of the page's text outside of marked elements."""
    size = {}
    for node in reversed(order):
        own = 0 if node.tag != "#root" and marked(node, False) else sum(size[id(k)] if isinstance(k, Node) else len("".join(k.split())) for k in node.kids)
        size[id(node)] = own
    node, most = root, size[id(root)]
    while True:
        down = [k for k in node.kids if isinstance(k, Node) and 2 * size[id(k)] > most and any(isinstance(x, Node) and x.tag not in INLINE and x.tag not in VOID for x in k.kids)]
        if not down:
            return node
        node = down[0]


def _text(value: bytes | None) -> str:
    return (value or b"").decode("utf-8", "replace")


def _subtree_rows(batches):
    """(host, key, article, row) of each page: its subtrees' hashes beside the hash of its article text; and once with a null key, to count the host's articles."""
    for batch in batches:
        hosts, keys, arts, rows = [], [], [], []
        for host, source, row in zip(column_bytes(batch, "__host"), column_bytes(batch, "__html"), longs(batch, "__row", 0).tolist(), strict=True):
            root = parse(_text(source))
            found = [None, *{k - (k >> 63 << 64) for k, _ in subtrees(root, _text(host))}]
            art = xxhash.xxh3_64_intdigest("\n".join(blocks(walk(root))).encode("utf-8", "surrogatepass"))
            hosts += [xxhash.xxh3_64_intdigest(_text(host).encode())] * len(found)
            keys += found
            arts += [art] * len(found)
            rows += [row] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(hosts, np.uint64).view(np.int64)), pa.array(keys, pa.int64()),
                                          pa.array(np.array(arts, np.uint64).view(np.int64)), pa.array(rows, pa.int64())], ["host", "key", "article", "row"])


SUBTREES = "host long, key long, article long, row long"


def _extract_rows(names: list[str], templates: np.ndarray):
    def run(batches):
        for batch in batches:
            texts = []
            for host, source, own in zip(column_bytes(batch, "__host"), column_bytes(batch, "__html"), batch.column("__own").to_pylist(), strict=True):
                root = parse(_text(source))
                deleted = set()
                found = subtrees(root, _text(host)) if len(templates) or own else []
                if found:
                    keys = np.array([k for k, _ in found], np.uint64).view(np.int64)
                    if own:
                        hit = np.isin(keys, np.asarray(own, np.int64))
                    else:
                        at = np.minimum(np.searchsorted(templates, keys), len(templates) - 1)
                        hit = templates[at] == keys
                    deleted = {id(found[i][1]) for i in np.flatnonzero(hit).tolist()}
                texts.append("\n\n".join(blocks(walk(root, deleted), deleted)))
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array([t.encode("utf-8", "replace").decode() for t in texts], pa.string())], names + ["text"])

    return run


def extract_text(pages: DataFrame, min_articles: int = 8, min_share: float = 0.2, broadcast_up_to: int = 1_000_000, keep: tuple[str, ...] = ("page_id", "url"),
                 url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``keep`` columns and ``text`` of every page.

    A subtree is template where it stands beside at least ``min_articles`` different articles of its host, and beside
    a share of ``min_share`` of all of them, so that a host's size does not decide.
    Up to ``broadcast_up_to`` template hashes (8 bytes each) go to the tasks as one sorted array; beyond that
    each page gets its own template hashes by a join.

    * null or empty html gives an empty text; a null url counts as the host "";
    * without an article element: the main element, else the page without its marked parts;
    * markup cut off at the end of a page is dropped; elements nested deeper than 500 are flattened;
    * repeated rows are extracted alike; an empty table gives an empty result; other columns are ignored."""
    src = small_batches(pages).select(*[F.col(f"`{c}`").alias(c) for c in keep], host_of(F.col(f"`{url_col}`")).alias("__host"),
                       F.col(f"`{html_col}`").cast("binary").alias("__html"))
    rows = src.select("__host", "__html", F.lit(0).cast("long").alias("__row"))
    # Few of the counted subtrees are left: a file for each task that counted would hold a few rows, and tasks start a process (chmod) for each file.
    counts = write_shared(rows.mapInArrow(_subtree_rows, SUBTREES).select("host", "key", "article").distinct()
                          .groupBy("host", "key").count().filter(F.col("count") >= min_articles)
                          .repartition(max(4, shuffle_width(pages.sparkSession) // 50)), "subtrees")
    hosts = counts.filter("key IS NULL").select("host", F.col("count").alias("articles"))
    counted = counts.filter("key IS NOT NULL").join(hosts, "host").filter(F.col("count") >= F.col("articles") * min_share).select("key")
    few = counted.limit(broadcast_up_to + 1).toArrow()["key"].to_numpy()
    schema = T.StructType([src.schema[c] for c in keep] + [T.StructField("text", T.StringType())])
    if len(few) <= broadcast_up_to:
        templates = np.sort(few.astype(np.int64))
        return src.withColumn("__own", F.lit(None).cast("array<long>")).mapInArrow(_extract_rows(list(keep), templates), schema)
    src = src.withColumn("__row", row_key(*keep))
    mine = (src.select("__host", "__html", "__row").mapInArrow(_subtree_rows, SUBTREES)
            .join(counted, "key", "left_semi").groupBy("row").agg(F.collect_set("key").alias("__own")))
    joined = src.join(mine, F.col("__row") == F.col("row"), "left").drop("__row", "row")
    return joined.mapInArrow(_extract_rows(list(keep), np.empty(0, np.int64)), schema)
