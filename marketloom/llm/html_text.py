"""Main text of web pages by removing site templates.

Every element subtree is hashed (tag, text and the hashes of its children). Spark counts, per host, on how many distinct pages each subtree
occurs; subtrees that recur on many pages and on a share of their host are its template and are deleted. Pages with the same article are one
page, whatever stands around it. What the counts can't tell, as on hosts of a few pages or where menus and adverts have other words on each
page, is left to what the markup says of what the templates leave: elements named or classed as such go, and where the elements that a page marks as its
article hold most of what is left, only those stay. A page is parsed in time in proportion to its length, whatever its markup.

How it scales: a row per distinct page and subtree is dealt by both, and what is added up per subtree is added up before the shuffle, so a
host with a third of all pages is no hot group; its size meets its subtrees in ``SALTS`` parts. The recurring subtrees go to the tasks as
one sorted array of 64-bit numbers while there are at most ``BROADCAST_ENTRIES`` of them (8 bytes each); beyond that each page gets its own
by a join.
"""

from __future__ import annotations

import html as references
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text_arrays import pieces

#: A subtree is template if it is on so many distinct pages of its host, and on one of so many of them.
RECURS, ONE_OF = 5, 10
#: The same for elements that prose stands in.
PROSE_RECURS, PROSE_ONE_OF = 10, 2
SALTS = 32
BROADCAST_ENTRIES = 1_000_000

#: Content that is never text.
RAW = {"script", "style", "template", "noscript", "iframe", "object", "svg", "canvas", "select", "textarea", "title"}
#: Elements without an end tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that hold parts of a page other than its article.
ASIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "head", *RAW}
#: The same by a whole token of class, id or role, alone or with words that say where it is.
NAMED = {"ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "commentlist", "comments", "consent", "cookie", "cookies", "disqus", "footer", "header", "menu", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "related", "respond", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
#: Words that such a name is joined with: what holds many of the kind, or where it stands.
HOLDERS = {"area", "bar", "block", "box", "buttons", "container", "content", "form", "group", "holder", "icons", "inner", "item", "items", "link", "links", "list", "posts", "row", "section", "stories", "thread", "wrap", "wrapper"}
PLACES = {"site", "page", "main", "top", "bottom", "left", "right", "primary", "secondary", "global"}
#: Elements that names never mark.
UNNAMED = {"html", "body", "main", "article"}
#: Elements that begin and end a block of text.
BLOCK = {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html", "legend", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", *ASIDE} - RAW - {"button"}
#: Elements that recurrence never deletes.
FRAME = {"article", "main", "body", "html", "br"}
#: Elements that stand within a line of prose; recurrence deletes them only where they stand alone.
INLINE = {"b", "i", "em", "strong", "span", "a", "code"}
#: Elements that prose stands in; a recurring one may be a quotation, so it is template only on a large share of its host.
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "td", "th", "tr", "tbody", "li", "dd", "dt", *FRAME, *INLINE}
#: What a start tag closes: an open element of the first set, up to one of the second.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
#: A tag whose quotes are closed; without an end, it isn't one.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
#: The same where quotes stand for nothing.
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
#: What closed quotes could not be found for up to the end of the page so often is read without quotes from there on.
UNQUOTED = 8
_MARKUP = re.compile(r"<(?:[!?]|/?[a-zA-Z])")
_NAME = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: All words that may make up a name.
_WORDS = NAMED | PLACES | HOLDERS
#: Elements that an inline end tag doesn't reach over.
WALLS = {"article", "main", "body", "td", "table"}
_JOINTS = re.compile(r"[-_]+")
_SPACE = re.compile(r"\s+")


class _Element:
    __slots__ = ("tag", "aside", "named", "article", "gone", "parent", "parts", "size", "own", "spoken", "shown", "hash", "children")

    def __init__(self, tag: str, named: bool, parent: _Element | None = None) -> None:
        self.tag, self.named, self.parent = tag, named, parent
        self.aside, self.article, self.gone = tag in ASIDE, tag in ("article", "main"), False
        self.parts: list = []  # hashes of text and children, in order
        self.children: list = []  # elements and texts, in order
        self.size, self.own, self.hash = 0, 0, 0
        self.spoken = False  # whether it has text of its own
        self.shown = 0  # the size without what is aside or gone


def _is_named(attributes: str) -> bool:
    """Whether a token of class, id or role names a part of a page other than its article."""
    for token in (t for n in _NAME.findall(attributes) for t in "".join(n).lower().split()):
        words = [w for w in _JOINTS.split(token) if w]
        if token in NAMED or (not NAMED.isdisjoint(words) and _WORDS.issuperset(words)):
            return True
    return False


def _measure(root: _Element) -> None:
    """The sizes of all elements without what is aside or gone."""
    for e in reversed(list(_walk(root))):
        e.shown = e.own + sum(c.shown for c in e.children if isinstance(c, _Element) and not c.aside and not c.gone)


def _article(root: _Element) -> _Element | None:
    """The page's largest marked article that isn't empty."""
    return max((e for e in _reached(root) if e.article and e.shown), key=lambda e: e.shown, default=None)


def _set_aside(root: _Element) -> None:
    """Names mark what they stand on as aside, unless it holds the page's largest marked article, or most of the text of a page that marks none.

    Sizes are then without what is marked.
    """
    _measure(root)
    kept = {id(root)}
    best = _article(root)
    marked = best is not None
    while best is not None:
        kept.add(id(best))
        best = best.parent
    for e in _walk(root):
        if e.named and e.tag not in UNNAMED and id(e) not in kept and (marked or 2 * e.shown <= root.shown):
            e.aside = True
    _measure(root)


def _marked(root: _Element) -> bool:
    """Whether the page's marked articles hold most of its text that is neither aside nor gone."""
    held, todo = 0, [root]
    while todo:
        e = todo.pop()
        if e.article:
            held += e.shown
        else:
            todo += [c for c in e.children if isinstance(c, _Element) and not c.aside and not c.gone]
    return 2 * held > root.shown


def _parsed(page: str) -> _Element:
    """The element tree; tags that don't match are repaired as browsers do in the common cases."""
    root = _Element("", False)
    stack, at, unquoted = [root], 0, 0
    # where in the stack the open elements of each name are, those that are blocks, and those that no inline end tag reaches over
    opened: dict[str, list[int]] = {}
    blocks: list[int] = []
    walls: list[int] = []

    def text(s: str) -> None:
        if s:
            top = stack[-1]
            top.children.append(s)
            top.parts.append(xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")))
            size = len(s) - s.count(" ")
            top.size += size
            top.own += size
            top.spoken = top.spoken or not s.isspace()

    def close(depth: int) -> None:
        while len(stack) > depth:
            e = stack.pop()
            e.hash = xxhash.xxh3_64_intdigest(e.tag.encode() + np.array(e.parts, np.uint64).tobytes())
            stack[-1].parts.append(e.hash)
            stack[-1].size += e.size
            opened[e.tag].pop()
            for places in (blocks, walls):
                if places and places[-1] == len(stack):
                    places.pop()

    begin = 0  # of the text that no markup has ended yet
    while m := _MARKUP.search(page, at):
        if m[0][1] in "!?":
            closing = "-->" if page.startswith("<!--", m.start()) else ">"
            end = page.find(closing, m.start() + 4 if closing == "-->" else m.start())
            text(page[begin : m.start()])
            begin = at = len(page) if end < 0 else end + len(closing)
            continue
        own = _TAG.match(page, m.start()) if unquoted < UNQUOTED else None
        if own is None:
            if page.find(">", m.start()) < 0:
                break  # no tag ends any more: the rest is text
            unquoted += 1
            own = _PLAIN_TAG.match(page, m.start())
        if own is None:
            at = m.end()
            continue
        text(page[begin : own.start()])
        begin = at = own.end()
        end, tag, rest = own[1], own[2].lower(), own[3]
        if end:
            # an inline end tag closes nothing beyond its block
            if opened.get(tag) and (tag in BLOCK or not walls or walls[-1] <= opened[tag][-1]):
                close(opened[tag][-1])
            continue
        if tag in BLOCK and opened.get("p") and blocks[-1] == opened["p"][-1]:
            close(blocks[-1])
        if tag in CLOSES:
            closed, limits = CLOSES[tag]
            limit = max((opened[t][-1] for t in limits if opened.get(t)), default=0)
            above = [x[bisect_right(x, limit)] for x in (opened.get(t) or [] for t in closed) if x and x[-1] > limit]
            if above:
                close(min(above))
        if tag in VOID:
            stack[-1].children.append(_Element(tag, False))
            continue
        e = _Element(tag, bool(rest) and _is_named(rest), stack[-1])
        stack[-1].children.append(e)
        opened.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            blocks.append(len(stack))
        if tag in WALLS:
            walls.append(len(stack))
        stack.append(e)
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            text(page[at : stop.start() if stop else len(page)])
            begin = at = stop.end() if stop else len(page)
            close(len(stack) - 1)
    text(page[begin:])
    close(1)
    return root


def _walk(root: _Element) -> Iterator[_Element]:
    todo = [root]
    while todo:
        e = todo.pop()
        yield e
        todo += [c for c in e.children if isinstance(c, _Element)]


def _reached(root: _Element) -> Iterator[_Element]:
    """The elements that are within nothing aside or gone."""
    todo = [root]
    while todo:
        e = todo.pop()
        yield e
        todo += [c for c in e.children if isinstance(c, _Element) and not c.aside and not c.gone]


def _deletable(e: _Element, total: int) -> bool:
    """Whether recurrence may delete it: no article, no part of a line, not the most of the page."""
    return bool(e.hash) and e.tag not in FRAME and 2 * e.size <= total and not (e.tag in INLINE and _in_line(e))


def _in_line(e: _Element) -> bool:
    """Whether the element that holds this one is of prose or has text of its own."""
    return e.parent.tag in PROSE - FRAME or e.parent.spoken


def _key(host: str, subtree: int) -> int:
    """One 64-bit number for a subtree of a host."""
    return xxhash.xxh3_64_intdigest(subtree.to_bytes(8, "little"), xxhash.xxh3_64_intdigest(host.encode("utf-8", "surrogatepass"))) - (1 << 63)


def host_of(url: str | None) -> str:
    """The host of a URL in lower case; empty where there is none."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:]*)", url or "", re.I)
    return m[1].lower() if m else ""


def subtrees(host: str, root: _Element) -> dict[int, bool]:
    """Keys of the distinct subtrees of a page that recurrence may delete, and whether they are of prose."""
    return {_key(host, e.hash): e.tag in PROSE for e in _walk(root) if _deletable(e, root.size)}


def text_of(url: str | None, page: str, template) -> str:
    """The main text of a page; ``template(key)`` says whether a subtree recurs on its host."""
    root, host = _parsed(page), host_of(url)
    for e in _walk(root):
        e.gone = _deletable(e, root.size) and template(_key(host, e.hash))
    _set_aside(root)
    marked = _marked(root)
    blocks: list[list[str]] = [[]]
    # (node, inside the article); None ends a block
    todo: list = [(root, not marked)]
    while todo:
        node, inside = todo.pop()
        if node is None:
            blocks.append([])
        elif isinstance(node, str):
            if inside:
                blocks[-1].append(node)
        elif node.tag == "br":
            blocks[-1].append(" ")
        elif not node.aside and not node.gone:
            inside = inside or node.article
            edge = [(None, False)] if node.tag in BLOCK else []
            todo += [*edge, *((c, inside) for c in reversed(node.children)), *edge]
    # a reference is decoded within its block, so that what it stands for is never taken for markup
    lines = (_SPACE.sub(" ", references.unescape("".join(b))).strip() for b in blocks if b)
    return "\n".join(x for x in lines if x)


def _count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each distinct page of a batch its subtrees, and a row without one for the page itself, which goes by its article."""
    for batch in pieces(it, 1):
        columns: dict[str, list] = {"host": [], "page": [], "subtree": [], "prose": []}
        pages = set(zip(map(host_of, batch.column(0).to_pylist()), batch.column(1).to_pylist(), strict=True))
        for host, h in pages:
            root = _parsed(h or "")
            _set_aside(root)
            best = _article(root)
            page = best.hash - (1 << 63) if best and 2 * best.shown > root.shown else xxhash.xxh3_64_intdigest((h or "").encode("utf-8", "surrogatepass")) - (1 << 63)
            keys = {None: None, **subtrees(host, root)}
            for name, values in zip(columns, ([_key(host, 0)] * len(keys), [page] * len(keys), keys.keys(), keys.values()), strict=True):
                columns[name] += values
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns.values(), kinds, strict=True)], [*columns])


def templates(pages: DataFrame, recurs: int = RECURS, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Keys of the subtrees that recur on their host, as column ``subtree``."""
    from .scratch import discard, written

    seen = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(_count, "host long, page long, subtree long, prose boolean")
    counted = seen.distinct().groupBy("host", "subtree", "prose").agg(F.count("*").alias("n")).where(F.col("n") >= recurs)
    counted = written(counted, "recurring")
    # a hot host has many such subtrees
    hosts = counted.where("subtree IS NULL").select("host", F.col("n").alias("pages"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    found = counted.where("subtree IS NOT NULL").withColumn("salt", F.pmod("subtree", F.lit(SALTS)).cast("int")).join(hosts, ["host", "salt"])
    plain = ~F.col("prose") & (ONE_OF * F.col("n") >= F.col("pages"))
    prose = F.col("prose") & (F.col("n") >= PROSE_RECURS) & (PROSE_ONE_OF * F.col("n") >= F.col("pages"))
    out = written(found.where(plain | prose).select("subtree"), "templates")
    discard(counted)
    return out


def _texts(batch: pa.RecordBatch, template) -> pa.RecordBatch:
    found = [text_of(u, h or "", template(k)) for k, (u, h) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, recurs: int = RECURS, entries: int = BROADCAST_ENTRIES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars.

    Null and empty pages have an empty text. Pages without a URL share one nameless host. Repeated rows, and pages with equal articles, are kept
    but count as one page of their host; null ids are kept. A page that is cut off ends where it is cut. A marked article that is empty, or
    holds less than half of the text, decides nothing. An empty table gives no rows. Other columns are ignored.
    """
    from .scratch import discard, written

    spark = pages.sparkSession
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    template = templates(pages, recurs, url_col, html_col)
    schema = f"page_id {pages.schema[id_col].dataType.simpleString()}, url string, text string, n_chars long"
    if template.count() <= entries:
        sent = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in template.collect()], np.int64)))
        discard(template)

        def by_broadcast(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = set(sent.value.tolist())
            for batch in pieces(it, 2):
                yield _texts(batch, lambda _: known.__contains__)

        return source.mapInArrow(by_broadcast, schema)

    def own(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(it, 2):
            keys = [list(subtrees(host_of(u), _parsed(h or ""))) for u, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.int64()))], ["row", "url", "html", "page_id", "subtrees"])

    def by_join(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(it, 2):
            lists = [set(x or ()) for x in batch.column(3).to_pylist()]
            yield _texts(batch, lambda k, lists=lists: lists[k].__contains__)

    numbered = written(source.select(F.monotonically_increasing_id().alias("row"), "url", "html", "page_id").mapInArrow(own, f"row long, url string, html string, page_id {source.schema['page_id'].dataType.simpleString()}, subtrees array<long>"), "pages")
    hits = numbered.select("row", F.explode("subtrees").alias("subtree")).join(template, "subtree").groupBy("row").agg(F.collect_list("subtree").alias("hits"))
    return numbered.join(hits, "row", "left").select("page_id", "url", "html", "hits").mapInArrow(by_join, schema)
