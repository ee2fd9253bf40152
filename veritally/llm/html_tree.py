"""HTML extraction by a site style tree: pages of a host merged, branches of low importance removed from each page.

**Trees.** A page is parsed into block elements, each known by its path of signatures (tag, role, id and class words, figures
as 0); siblings with one signature are one node. Trees of a host are merged by these paths. An element's presentation is the
sequence of its children's signatures, repeats collapsed; its content is the text blocks that stand directly in it.

**Importance.** Of an element on m pages of the host: each text block a has the entropy H(a) of its occurrences over pages,
divided by ln m, so that it is 1 for a text that all pages carry and 0 for one that a single page has; the content's
importance is the mean of 1 - H(a) over its different texts. The presentation's importance is the entropy of its variants
over pages, divided by ln m; both count GAMMA ** l for the content and the rest for the presentation, l the number of kinds
of children (0 for a leaf). On a single page everything is 1. Pages of a host with the same blocks count once. A host with few
pages says little, so its importance is averaged with the element's in the tree of all hosts, which counts as BACKED pages.
Presentation whose style says what it is for weighs in with DECLARED: 0 for menus, headers, footers, sidebars, notices,
adverts, forms, scripts and reader comments (element names, roles and class words below), 1 for what stands in an article or
main element and in none of those; all other elements go by entropy alone.

**Removal.** A block goes where its element's importance is under THRESHOLD. Which elements go depends on host and layout (the
set of a page's elements) alone, so that verdicts meet pages by these two, and no text is shuffled for layouts that many
pages share.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritally.llm import common

GAMMA = 0.9
BACKED = 8
DECLARED = 0.75
THRESHOLD = 0.5
SHARE = 2000  #: keys of over one row in so many are frequent: there are at most so many of them for each row that a page gives
BROADCAST = 100_000  #: rows of host, key and verdict that may be broadcast

#: Words of classes and ids that say what an element is for.
NOISE = frozenset(
    (
        "nav navbar navigation menu menubar breadcrumb breadcrumbs topbar toolbar pager pagination skip masthead banner footer colophon copyright "
        "sidebar aside widget widgets notice notices cookie cookies consent gdpr popup modal newsletter subscribe subscription signup login "
        "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion share sharing sharebar social related recommended "
        "recommendations comment comments commentlist disqus respond replies form search searchbox"
    ).split()
)
NOISE_OUTSIDE = NOISE | {"header"}  #: outside articles, whose own header has the headline
NOISE_TAGS = frozenset("template noscript object svg canvas audio video applet nav aside footer form fieldset button select label dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var".split())
RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in "script style title textarea iframe noembed noframes xmp".split()}  #: their content is no markup, and dropped
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What a start tag closes if it is open, and where the search for that ends.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table", "thead", "tbody", "tfoot"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
SCOPE = frozenset("table td th caption template".split())  #: an end tag does not reach out of these

TAG = re.compile(r"<(?:!--.*?(?:--!?>|\Z)|(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)|[!?/][^>]*+(?:>|\Z))", re.S)
ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
SAYS = re.compile("class|id|role", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
FIGURES = re.compile(r"\d+")
HOST = re.compile(r"\s*(?:[A-Za-z][\w+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:\s]*)")

ALL = (1 << 64) - 1
KEPT, GONE, OPEN = 1, 0, 2  #: what a style declares


def host_of(url: str | None) -> str:
    """The host of a URL in lower case; the empty text without one."""
    found = HOST.match(url or "")
    return found.group(1).lower() if found else ""


@dataclass(slots=True)
class Node:
    tag: str
    signature: str
    parent: int
    words: frozenset = frozenset()
    role: str = ""
    main: bool = False  #: an article or main element
    children: list[str] = field(default_factory=list)
    holds: bool = False  #: the page's main element, or else its first article, lies below
    inside: bool = False  #: it lies in one
    key: int = 0
    mark: int = OPEN


@dataclass(slots=True)
class Page:
    nodes: list[Node]
    blocks: list[tuple[int, str]]  #: node and text, in page order


def _node(tag: str, attrs: str, parent: int) -> Node:
    if "=" not in attrs:
        return Node(tag, tag, parent, main=tag in ("article", "main"))
    got = {k.lower(): a or b or c for k, a, b, c in ATTR.findall(attrs)}
    said = [html.unescape(got[k]) for k in ("id", "class") if got.get(k)]
    words = frozenset(w.lower() for x in said for w in PART.findall(x))
    role = got.get("role", "").strip().lower()
    signature = " ".join([tag, role, *sorted(set(FIGURES.sub("0", " ".join(said)).split()))]) if said or role else tag
    return Node(tag, signature, parent, words, role, tag in ("article", "main") or role == "main" or got.get("itemprop") == "articleBody")


class _Reader:
    """Open elements of a page while it is read."""

    def __init__(self) -> None:
        self.nodes, self.blocks = [Node("body", "body", -1)], []
        self.stack, self.buffer = [0], []
        self.scopes, self.open = [Counter()], Counter()  # open tags of each scope; scopes themselves over all

    def flush(self) -> None:
        if self.buffer:
            said = " ".join("".join(self.buffer).split())
            self.buffer.clear()
            if said:
                self.blocks.append((self.stack[-1], said))

    def push(self, node: Node) -> None:
        self.nodes[node.parent].children.append(node.signature)
        self.nodes.append(node)
        self.stack.append(len(self.nodes) - 1)
        self.scopes[-1][node.tag] += 1
        if node.tag in SCOPE:
            self.open[node.tag] += 1
            self.scopes.append(Counter())

    def pop(self) -> str:
        tag = self.nodes[self.stack.pop()].tag
        if tag in SCOPE:
            self.open[tag] -= 1
            self.scopes.pop()
        self.scopes[-1][tag] -= 1
        return tag

    def close(self, tag: str) -> None:
        """Ends the nearest open element of this name, and what is open within it."""
        if (self.open if tag in SCOPE else self.scopes[-1])[tag] > 0:
            while self.pop() != tag:
                pass

    def start(self, tag: str, attrs: str) -> None:
        if self.scopes[-1]["p"] > 0:
            self.close("p")
        if tag in CLOSES:
            closed, bounds = CLOSES[tag]
            at = len(self.stack) - 1
            while at > 0 and (name := self.nodes[self.stack[at]].tag) not in closed and name not in bounds:
                at -= 1
            if at > 0 and self.nodes[self.stack[at]].tag in closed:
                while len(self.stack) > at:
                    self.pop()
        self.push(_node(tag, attrs, self.stack[-1]))
        if attrs.endswith("/") and tag == "svg":
            self.pop()


def parse(text: str) -> Page:
    """The block elements of a page and its text blocks. Markup that is broken or cut off is read as far as it goes.

    Inline elements belong to their block, unless their style says that they are noise. White space, a line break among it,
    becomes one space; character references are decoded. Scripts, styles, titles and comments of the source are no text.
    """
    page, at, n = _Reader(), 0, len(text)
    while at < n:
        found = TAG.search(text, at)
        till = found.start() if found else n
        if till > at:
            chunk = text[at:till]
            page.buffer.append(html.unescape(chunk) if "&" in chunk else chunk)
        if not found:
            break
        at, name = found.end(), found["name"]
        if not name:
            continue
        tag, attrs = name.lower(), found["attrs"]
        if tag == "br":
            page.buffer.append(" ")
        elif tag in INLINE:
            if found["end"]:
                if page.scopes[-1][tag] > 0:
                    page.flush()
                    page.close(tag)
            elif "=" in attrs and SAYS.search(attrs):
                node = _node(tag, attrs, page.stack[-1])
                if node.words & NOISE or node.role in ROLES:
                    page.flush()
                    page.push(node)
        elif tag in ("html", "head", "body"):
            page.flush()
        elif tag in VOID:
            if tag == "hr":
                page.flush()
                if not found["end"]:
                    page.close("p")
        elif found["end"]:
            page.flush()
            page.close(tag)
        elif tag in RAW:
            if tag != "script" and tag != "style":
                page.flush()
            ends = RAW[tag].search(text, at)
            at = ends.end() if ends else n
        else:
            page.flush()
            page.start(tag, attrs)
    page.flush()
    _declare(page.nodes)
    return Page(page.nodes, page.blocks)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _declare(nodes: list[Node]) -> None:
    """Keys of nodes, from the root down, and what their styles declare."""
    own = [n for n in nodes if n.tag == "main" or n.role == "main"] or [n for n in nodes if n.main][:1]
    for node in own:
        while node.parent >= 0 and not nodes[node.parent].holds:
            node = nodes[node.parent]
            node.holds = True
    for i, node in enumerate(nodes):
        up = nodes[node.parent] if i else None
        node.key = _signed(xxhash.xxh64_intdigest(node.signature.encode(errors="replace"), up.key & ALL if up else 0))
        node.inside = bool(up and (up.inside or up.main))
        if up and up.mark == GONE:
            node.mark = GONE
            continue
        said = () if node.tag in ("body", "main") or (node.main and not node.inside) or node.holds else node.words & (NOISE if node.inside else NOISE_OUTSIDE)
        if node.tag in NOISE_TAGS or said or (node.role in ROLES and not node.holds) or (node.tag == "header" and not node.inside and not node.holds):
            node.mark = GONE
        else:
            node.mark = KEPT if node.main or node.inside else OPEN


def _layout(page: Page) -> int:
    used = sorted({page.nodes[i].key for i, _ in page.blocks})
    return _signed(xxhash.xxh64_intdigest(np.array(used, np.int64).tobytes()))


FACT = [("element", pa.int64()), ("mark", pa.int8()), ("style", pa.bool_()), ("kinds", pa.int32()), ("value", pa.int64()), ("times", pa.int32())]
FACTS = "host string, body long, layout long, facts array<struct<element:long,mark:byte,style:boolean,kinds:int,value:long,times:int>>"


def _facts(page: Page) -> list[tuple]:
    """Each element that has text, or leads to it, with its variant of presentation, and the different texts in it."""
    needed: set[int] = set()
    for i, _ in page.blocks:
        while i >= 0 and i not in needed:
            needed.add(i)
            i = page.nodes[i].parent
    styles: dict[tuple[int, int], list[str]] = {}
    for i in sorted(needed):
        node = page.nodes[i]
        children = styles.setdefault((node.key, node.mark), [])
        children += [c for k, c in enumerate(node.children) if not k or c != node.children[k - 1]]
    out = [(k, mark, True, len(set(children)), _hash("\x00".join(children)), 1) for (k, mark), children in styles.items()]
    texts = Counter((page.nodes[i].key, page.nodes[i].mark, t) for i, t in page.blocks)
    return out + [(k, mark, False, 0, _hash(t), c) for (k, mark, t), c in texts.items()]


def _hash(text: str) -> int:
    return _signed(xxhash.xxh64_intdigest(text.encode(errors="replace")))


def _lists(rows: list[list[tuple]], fields: list[tuple]) -> pa.Array:
    """A column of lists of structs."""
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    columns = list(zip(*(x for r in rows for x in r), strict=True)) or [[] for _ in fields]
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[k for k, _ in fields]))


def _pages(batch: pa.RecordBatch) -> list[Page]:
    return [parse(text or "") for text in batch["html"].to_pylist()]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, 128):
        pages = _pages(batch)
        hosts = pa.array([host_of(u) for u in batch["url"].to_pylist()])
        bodies = pa.array([_hash("\n".join(f"{p.nodes[i].key} {t}" for i, t in p.blocks)) for p in pages], pa.int64())
        yield pa.RecordBatch.from_arrays([hosts, bodies, pa.array(map(_layout, pages), pa.int64()), _lists([_facts(p) for p in pages], FACT)], names=["host", "body", "layout", "facts"])


def _importance(styles: DataFrame, contents: DataFrame, keys: list[str]) -> DataFrame:
    """Importance of each element of a tree; ``styles`` and ``contents`` have its variants and texts with their sums."""
    looks = styles.groupBy(*keys, "mark").agg(F.sum("pages").alias("m"), F.max("kinds").alias("kinds"), F.sum(F.col("pages") * F.log("pages")).alias("own"))
    texts = contents.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.log("times") - F.col("spread") / F.col("times")).alias("h"))
    log_m = F.log(F.greatest("m", F.lit(2)))
    looked = (F.log("m") - F.col("own") / F.col("m")) / log_m
    said = F.when(F.col("n").isNull(), looked).otherwise(1 - F.col("h") / F.col("n") / log_m)
    weight = F.pow(F.lit(GAMMA), F.col("kinds"))
    both = F.when(F.col("m") <= 1, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), weight * said + (1 - weight) * looked)))
    return looks.join(texts, keys, "left").select(*keys, "mark", "m", both.alias("importance"))


def _meet(rows: DataFrame, small: DataFrame, keys: list[str], often: Column) -> DataFrame:
    """Inner join on ``keys``, of which the staged ``small`` has one row each.

    It is broadcast if it has BROADCAST rows or fewer; otherwise its frequent keys (``often``) are, of which there are few by
    their definition, and the rest, where no key has many rows, is shuffled.
    """
    if small.count() <= BROADCAST:
        return rows.join(F.broadcast(small), keys)
    hot = small.where(often)
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(small.where(~often), keys))


def style_tree(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tree, layouts): each element's importance (host, element, mark, m, entropy, importance), and the layouts (host, layout, pages, elements).

    Pages of a host with the same blocks are merged first, and everything is summed before it moves, so a host or a text with
    a third of all pages is no task of its own.
    """
    read = pages.select("url", "html").mapInArrow(_read, FACTS)
    read = read.groupBy("host", "body").agg(F.first("layout").alias("layout"), F.first("facts").alias("facts"), F.count(F.lit(1)).alias("pages"))
    read = common.staged(read, "facts", compact=True)
    facts = read.select("host", F.explode("facts").alias("f")).select("host", "f.*")
    sums = [F.count(F.lit(1)).alias("pages"), F.sum("times").alias("times"), F.sum(F.col("times") * F.log("times")).alias("spread"), F.max("kinds").alias("kinds")]
    by_host = common.staged(facts.groupBy("host", "element", "mark", "style", "value").agg(*sums), "nodes", compact=True)
    again = [F.sum("pages").alias("pages"), F.sum("times").alias("times"), F.sum("spread").alias("spread"), F.max("kinds").alias("kinds")]
    overall = by_host.groupBy("element", "mark", "style", "value").agg(*again)
    own = common.staged(_importance(by_host.where("style"), by_host.where("not style"), ["host", "element"]), "tree", compact=True)
    everywhere = _importance(overall.where("style"), overall.where("not style"), ["element"]).select("element", F.col("importance").alias("backed"))
    hosts = own.groupBy("element").agg(F.count(F.lit(1)).alias("hosts"))
    everywhere = common.staged(everywhere.join(hosts, "element"), "elements", compact=True)
    both = _meet(own, everywhere, ["element"], F.col("hosts") * SHARE > own.count())
    entropy = (F.col("m") * F.col("importance") + BACKED * F.col("backed")) / (F.col("m") + BACKED)
    declared = F.when(F.col("mark") == OPEN, entropy).otherwise(DECLARED * F.col("mark") + (1 - DECLARED) * entropy)
    tree = common.staged(both.select("host", "element", "mark", "m", F.round(entropy, 9).alias("entropy"), F.round(declared, 9).alias("importance")), "importance", compact=True)
    elements = F.expr("array_distinct(transform(filter(facts, f -> not f.style), f -> f.element))")
    layouts = common.staged(read.groupBy("host", "layout").agg(F.sum("pages").alias("pages"), F.first(elements).alias("elements")), "layouts", compact=True)
    for each in (read, by_host, own, everywhere):
        common.discard(each)
    return tree, layouts


def _verdicts(tree: DataFrame, layouts: DataFrame, pages: int) -> DataFrame:
    """(host, layout, pages, removed): the elements of each layout whose text goes."""
    low = common.staged(tree.where(F.col("importance") < THRESHOLD).select("host", "element", "m"), "low", compact=True)
    each = layouts.select("host", "layout", F.explode("elements").alias("element"))
    found = _meet(each, low, ["host", "element"], F.col("m") * SHARE > pages).select("host", "layout", "element", F.lit(0).alias("pages"))
    both = found.unionByName(layouts.select("host", "layout", F.lit(None).cast("long").alias("element"), "pages"))
    return both.groupBy("host", "layout").agg(F.sort_array(F.collect_set("element")).alias("removed"), F.sum("pages").alias("pages"))


BLOCK = [("element", pa.int64()), ("text", pa.string())]


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row: its main text, blocks joined by line feeds in page order.

    Every row has a result, repeated ones each; a null or empty html, or one without main text, gives an empty text. A null
    url counts as a host without name. Null ids and other columns change nothing; only page_id, url and html are read.
    Pages of any length are parsed whole, in one pass. An empty table gives none.
    """
    tree, layouts = style_tree(pages)
    total = layouts.agg(F.sum("pages")).first()[0] or 0
    verdicts = common.staged(_verdicts(tree, layouts, total).select(F.col("host").alias("_host"), F.col("layout").alias("_layout"), "removed", "pages"), "verdicts", compact=True)
    kind = pages.select("page_id").schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 128):
            read = _pages(batch)
            hosts = pa.array([host_of(u) for u in batch["url"].to_pylist()])
            blocks = _lists([[(p.nodes[i].key, t.encode(errors="replace").decode()) for i, t in p.blocks] for p in read], BLOCK)
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], hosts, pa.array(map(_layout, read), pa.int64()), blocks], names=["page_id", "url", "_host", "_layout", "_blocks"])

    read = pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, _host string, _layout long, _blocks array<struct<element:long,text:string>>")
    joined = _meet(read, verdicts, ["_host", "_layout"], F.col("pages") * SHARE > total)
    text = F.expr("array_join(transform(filter(_blocks, b -> not array_contains(removed, b.element)), b -> b.text), '\\n')")
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
