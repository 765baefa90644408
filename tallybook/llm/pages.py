"""Main text of web pages by site style trees.

The pages of a host are merged into one tree. Its nodes are paths of block elements (tag and class, or place); a node has the styles, that is
the sequences of children, and the text blocks seen on the host's pages. A node's presentation importance is the entropy
of its styles; the content importance of its text is one less the mean entropy of its blocks over the pages, all to base m for m different pages: what
every page repeats has none, what is told once has all. A branch's importance joins the two from the leaves up, for each page.

From each page go branches of low importance, and elements that say themselves that they are no content (scripts, forms, navigation,
footers, asides, adverts, comments and so on). ``article`` and ``main`` say that they are content, so that pages that
a host repeats whole, and hosts with a single page, keep their text.

Pages are parsed twice, each time in their own tasks. The first time only numbers are stored: nodes, styles and hashes of blocks.
Sums over the host are of numbers for each (host, node, style or block), pre-aggregated, and so is the decision on a page's
nodes. The second time the texts, compressed, meet the list of nodes that stay.
"""

import html
import math
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import Scratch, ship, tagged

GAMMA = 0.9
LOW = 0.2

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"
    r"|([^<]++)|<",
    re.S,
)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
# Elements of layout: without a name, their place among their like tells them apart.
_PLACED = frozenset("center dialog div dl fieldset ol section summary table tbody td ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template svg select button head".split())
_CLOSED_BY_SAME = frozenset("li dt dd tr td th p".split())
_NOISE_TAGS = frozenset("nav footer aside form menu dialog search".split())
_MAIN = frozenset(("article", "main"))
# Names of what is no content, alone or with words of layout around them: "ad", "site-footer", "sidebar_left", but not "ad-free".
_KINDS = (
    r"(?:ads?|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|sidebar|menu|nav|navbar|navigation|cookies?|consent|notice"
    r"|footer|comments?|newsletter|subscribe|contentinfo|complementary)"
)
_HEADERS = r"(?:header|masthead|topbar)"
_LAYOUT = (
    r"(?:left|right|top|bottom|main|site|page|global|primary|secondary|box|bar|list|items?|links?|slot|unit|wrap|wrapper|container|inner"
    r"|outer|area|block|section|widget|reader|user|\d+)"
)


def _named(kinds: str) -> re.Pattern:
    return re.compile(rf"(?:{_LAYOUT}[-_])*{kinds}(?:[-_](?:{kinds}|{_LAYOUT}))*", re.I)


_NOISE_NAMES, _HEADER_NAMES = _named(_KINDS), _named(_HEADERS)
_NOISE_IDS, _HEADER_IDS = re.compile(_KINDS, re.I), re.compile(_HEADERS, re.I)
# Elements that hold content themselves; their names say what it is about.
_TELLING = frozenset("h1 h2 h3 h4 h5 h6 p main blockquote pre".split())
_SPACE = re.compile(r"\s+")


def _hash(text: str) -> int:
    data = text.encode("utf-8", "surrogatepass")
    return (zlib.crc32(data) << 31) | (zlib.crc32(data, 0x5BD1E995) >> 1)


def _says(tag: str, found: list[tuple[str, str]], names: re.Pattern, ids: re.Pattern) -> bool:
    """Whether an element's class or role says so, word by word, or its whole id does."""
    if tag in _TELLING:
        return False
    return any(
        ids.fullmatch(text.strip()) if kind == "id" else any(names.fullmatch(word) for word in text.split()) for kind, text in found
    )


class Page:
    """nodes: [key, parent, noise, main]; styles: children of each node's occurrences; blocks: (node, text)."""

    def __init__(self, source: str):
        self.nodes, self.children, self.blocks = [], [], []
        self._at: dict[tuple[int, str], int] = {}
        self._parts: list[str] = []
        self._stack: list[tuple[str, int, list[str], dict]] = [("", self._node(-1, "", False, False), [], {})]
        self._read(source)

    def _node(self, parent: int, name: str, noise: bool, main: bool) -> int:
        at = self._at.get((parent, name))
        if at is None:
            key = _hash(f"{self.nodes[parent][0] if parent >= 0 else ''}/{name}")
            at = self._at[parent, name] = len(self.nodes)
            self.nodes.append((key, parent, noise, main))
            self.children.append([])
        return at

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            found = _TOKEN.match(source, at)
            at = found.end()
            text = found[7]
            tag = found[2] or found[5]
            if text is not None:
                self._parts.append(text)
            elif tag:
                closing, tag, attributes = found[1] or found[4], tag.lower(), found[3] or found[6] or ""
                if closing:
                    self._close(tag)
                elif tag in _VOID:
                    if tag == "hr":
                        self._flush()
                    elif tag == "br":
                        self._parts.append(" ")
                elif tag in _RAW:
                    if not attributes.endswith("/"):
                        stop = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                        at = stop.end() if stop else (source.lower().find("<body", at) if tag == "head" else end)
                        at = end if at < 0 else at
                elif tag in _BLOCKS:
                    self._open(tag, attributes)
            elif found[0] == "<":
                self._parts.append("<")
        while len(self._stack) > 1:
            self._pop()
        self._flush()

    def _open(self, tag: str, attributes: str) -> None:
        self._flush()
        top = self._stack[-1][0]
        if top == "p" or (top == tag and tag in _CLOSED_BY_SAME):
            self._pop()
        found = [(kind.lower(), a or b or c) for kind, a, b, c in _NAMES.findall(attributes)] if attributes else []
        names = " ".join(x for _, x in found)
        parent = self._stack[-1][1]
        _, _, noise, main = self.nodes[parent]
        noise = noise or tag in _NOISE_TAGS or _says(tag, found, _NOISE_NAMES, _NOISE_IDS)
        noise = noise or (not main and (tag == "header" or _says(tag, found, _HEADER_NAMES, _HEADER_IDS)))
        name = f"{tag}.{names}" if names else tag
        if tag in _PLACED and not names:
            nth = self._stack[-1][3]
            nth[tag] = nth.get(tag, 0) + 1
            name = f"{tag}:{nth[tag]}"
        styles = self._stack[-1][2]
        if not styles or styles[-1] != name:
            styles.append(name)
        self._stack.append((tag, self._node(parent, name, noise, main or tag in _MAIN), [], {}))

    def _close(self, tag: str) -> None:
        if tag in _BLOCKS and any(t == tag for t, *_ in self._stack):
            self._flush()
            while self._stack[-1][0] != tag:
                self._pop()
            self._pop()

    def _pop(self) -> None:
        self._flush()
        _, node, styles, _ = self._stack.pop()
        self.children[node].append(_hash("|".join(styles)))

    def _flush(self) -> None:
        text = _SPACE.sub(" ", html.unescape("".join(self._parts))).strip()
        self._parts.clear()
        if text:
            self.blocks.append((self._stack[-1][1], text.encode("utf-8", "replace").decode("utf-8")))


_PARSED = (
    "nodes array<struct<key:bigint,parent:int,noise:boolean,main:boolean,styles:array<bigint>>>,"
    " blocks array<struct<node:int,hash:bigint>>"
)


def _parse(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The numbers of each page."""
    for sources in columns:
        nodes, blocks = [], []
        for source in sources:
            page = Page(source)
            nodes.append(
                [
                    {"key": k, "parent": p, "noise": n, "main": m, "styles": s}
                    for (k, p, n, m), s in zip(page.nodes, page.children)
                ]
            )
            blocks.append([{"node": n, "hash": _hash(t)} for n, t in page.blocks])
        yield pd.DataFrame({"nodes": nodes, "blocks": blocks})


def _texts(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The node of each block, and the texts of the blocks, a line each, compressed."""
    for sources in columns:
        pages = [Page(source).blocks for source in sources]
        lines = [zlib.compress("\n".join([t for _, t in blocks]).encode("utf-8"), 1) for blocks in pages]
        yield pd.DataFrame({"of": [[n for n, _ in blocks] for blocks in pages], "lines": lines})


def _importance(parsed: DataFrame) -> DataFrame:
    """host, key, pages, styles, presentation, content of every node of every host's tree."""
    node = parsed.select("host", "_tag", F.posexplode("nodes").alias("at", "node")).filter("NOT node.noise")
    keys = node.select("_tag", "at", "host", F.col("node.key").alias("key"), F.col("node.styles").alias("styles"))
    seen = keys.select("host", "key", F.lit("page").alias("kind"), F.lit(0).cast("long").alias("h"), F.lit(1).alias("c"))
    style = keys.select("host", "key", F.lit("style").alias("kind"), F.explode("styles").alias("h"), F.lit(1).alias("c"))
    block = parsed.select("host", "_tag", "nodes", F.explode("blocks").alias("b"))
    block = block.withColumn("key", F.expr("nodes[b.node].key")).filter("NOT nodes[b.node].noise")
    block = block.groupBy("host", "_tag", "key", F.col("b.hash").alias("h")).agg(F.count("*").cast("int").alias("c"))
    text = block.select("host", "key", F.lit("text").alias("kind"), "h", "c")
    sums = (
        seen.union(style).union(text)
        .groupBy("host", "key", "kind", "h")
        .agg(F.sum("c").cast("double").alias("c"), F.sum(F.col("c") * F.log("c")).alias("l"))
    )

    def of(kind, value):
        return F.when(F.col("kind") == kind, value)

    by = sums.groupBy("host", "key").agg(
        F.max(of("page", F.col("c"))).alias("pages"),
        F.count(of("style", F.col("c"))).alias("styles"),
        F.sum(of("style", F.col("c"))).alias("s"),
        F.sum(of("style", F.col("c") * F.log("c"))).alias("sl"),
        F.avg(of("text", F.log("c") - F.col("l") / F.col("c"))).alias("spread"),
    )
    base = F.log("pages")
    entropy = F.coalesce(F.log("s") - F.col("sl") / F.col("s"), F.lit(0.0))
    bounded = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    return by.select(
        "host", "key", "pages", "styles",
        # A host of a single page repeats nothing.
        F.when(F.col("pages") < 2, 1.0).otherwise(bounded(entropy / base)).alias("presentation"),
        # Null where a node has no text of its own.
        F.when(F.col("spread").isNotNull(),
               F.when(F.col("pages") < 2, 1.0).otherwise(bounded(1 - F.col("spread") / base))).alias("content"),
    )


def kept_nodes(nodes: list, known: dict) -> list[int]:
    """Nodes of a page whose text stays. nodes: (key, parent, noise, main); known: key -> (styles, presentation, content)."""
    n = len(nodes)
    below: list[list[float]] = [[] for _ in range(n)]
    worth = [1.0] * n
    for i in range(n - 1, -1, -1):  # a parent comes before its children
        key, parent, noise, _ = nodes[i]
        if noise:
            worth[i] = 0.0
            continue
        styles, presentation, content = known.get(key, (0, 1.0, None))
        parts = below[i] + ([content] if content is not None and not math.isnan(content) else [])
        inner = sum(parts) / len(parts) if parts else presentation
        weight = GAMMA ** max(1, styles)
        worth[i] = (1 - weight) * presentation + weight * inner
        if parent >= 0:
            below[parent].append(worth[i])
    # A branch goes as a whole if all of it is of low importance; what is important in a poor branch stays.
    return [i for i, (_, _, noise, main) in enumerate(nodes) if not noise and (main or worth[i] >= LOW)]


def _decide(columns: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
    for pages in columns:
        out = []
        for nodes, known in zip(pages["nodes"], pages["known"]):
            listed = [(x["key"], x["parent"], x["noise"], x["main"]) for x in nodes]
            table = {k["key"]: (k["styles"], k["presentation"], k["content"]) for k in (known if known is not None else ())}
            out.append(kept_nodes(listed, table))
        yield pd.Series(out, dtype=object)


def _joined(columns: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
    for pages in columns:
        out = []
        for of, lines, kept in zip(pages["of"], pages["lines"], pages["kept"]):
            stays = set(kept)
            texts = zlib.decompress(lines).decode("utf-8").split("\n")
            out.append("\n".join([t for n, t in zip(of, texts) if n in stays]))
        yield pd.Series(out, dtype=object)


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html, any other columns), a scan of files.

    Null html counts as empty and gives an empty text. Pages whose url is null or names no host share a tree. Repeated rows are each
    returned, and count once in the tree. A page of any length is read whole. Unclosed elements end with what holds them, a cut page with its end. An empty table gives no rows.
    """
    spark, scratch = pages.sparkSession, Scratch(pages.sparkSession)
    ship(spark)
    parse = F.pandas_udf(_parse, _PARSED)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    rows = tagged(pages.select("page_id", "url", "html"))
    source = F.coalesce("html", F.lit(""))
    parsed = rows.select("_tag", host.alias("host"), parse(source).alias("p")).select("_tag", "host", "p.nodes", "p.blocks")
    parsed = scratch.keep(parsed, "parsed")
    # Copies of a page tell no more about its host than one.
    page = F.xxhash64("nodes.key", "blocks")
    tree = scratch.keep(_importance(parsed.withColumn("page", page).dropDuplicates(["host", "page"])), "trees")
    uses = parsed.select("_tag", "host", F.explode("nodes").alias("n")).filter("NOT n.noise")
    uses = uses.select("_tag", "host", F.col("n.key").alias("key"))
    known = uses.join(tree, ["host", "key"]).groupBy("_tag").agg(
        F.collect_list(F.struct("key", "styles", "presentation", "content")).alias("known")
    )
    decide = F.pandas_udf(_decide, "array<int>")
    slim = parsed.select("_tag", F.transform("nodes", lambda x: x.dropFields("styles")).alias("nodes"))
    kept = slim.join(known, "_tag", "left").select("_tag", decide(F.struct("nodes", "known")).alias("kept"))
    kept = scratch.keep(kept, "kept")
    texts = rows.select("_tag", "page_id", "url", F.pandas_udf(_texts, "of array<int>, lines binary")(source).alias("t"))
    joined = F.pandas_udf(_joined, "string")
    text = texts.join(kept, "_tag").select(
        "page_id", "url", joined(F.struct(F.col("t.of").alias("of"), F.col("t.lines").alias("lines"), "kept")).alias("text")
    )
    return text.withColumn("n_chars", F.char_length("text").cast("long"))
