"""Main text of web pages by the container paths that the pages of a host agree on."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediatimeline.llm.common import by_bytes
from mediatimeline.session import settle, ship

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
READ_ATTRIBUTES = frozenset("class id role style hidden aria-hidden".split())
TOKENS_OF_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
DIGITS = re.compile(r"\d+")

RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption".split())
CONTAINERS = frozenset("article body div main section td form center blockquote fieldset details".split())
PARAGRAPH_ENDS = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option"}  # these starts close an open p
LIKE = {"li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
LIMITS = {"li": ("ul", "ol", "menu"), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table",), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}
DROPPED_TAGS = frozenset("head nav footer aside form button select option noscript template svg canvas object audio video dialog menu".split()) | RAW
DROPPED_ROLES = frozenset("navigation banner complementary contentinfo search form menu menubar dialog alert".split())
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner breadcrumb breadcrumbs comment comments "
    "discussion disqus replies cookie cookies consent gdpr notice notices alert popup modal overlay footer nav navbar navigation menu sidebar "
    "sidebars masthead toolbar share sharing social related recommended newsletter subscribe subscription signup login pagination pager skip "
    "widget widgets".split())
HEADER_WORDS = frozenset(["header", "topbar"])
# What others say below an article can be longer than the article.
FOREIGN_WORDS = frozenset("comment comments discussion disqus replies related recommended".split())
MAIN_SHARE = 0.5  # of a page's prose: an element that holds as much is not boilerplate by its name alone
BY_KIND, BY_NAME, BY_PLAIN_NAME = 1, 2, 3
PREFERRED = {"article": 1.5, "main": 1.3, "body": 0.8}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LONG_BLOCK = 40  # characters from which a block outside a heading looks like prose


class Page:
    """Blocks of text in page order, each with the elements that it stands in.

    nodes: (parent, tag, generalised path, dropped by its own tag or names). blocks: (node, text, length of text in links).
    Names are judged when the page has been read: an element named like boilerplate that holds the page's main or most of its
    prose, such as a layout "has-sidebar", is not boilerplate.
    """

    def __init__(self, source: str):
        self.nodes: list[tuple[int, str, str, int]] = [(-1, "", "", 0)]
        self.blocks: list[tuple[int, str, int]] = []
        self._stack = [0]
        self._pieces: list[str] = []
        self._links = self._open_links = 0
        self._read(source)
        if any(kind > BY_KIND for _, _, _, kind in self.nodes):
            self._judge_names()

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            sign = source.find("<", at)
            if sign < 0:
                self._text(source[at:])
                break
            if sign > at:
                self._text(source[at:sign])
            token = TOKEN.match(source, sign)
            if token is None:
                self._text("<")
                at = sign + 1
                continue
            at = token.end()
            tag = token["tag"]
            if tag is None:
                if token[0].startswith("<![CDATA["):
                    self._text(html.escape(token[0][9:-3], False))
                continue
            tag = tag.lower()
            if token["end"]:
                self._end(tag)
                continue
            self._start(tag, token["attrs"])
            if tag in RAW:
                closing = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at)
                self._end(tag)
                at = closing.end() if closing else size
        self._flush()

    def _text(self, text: str) -> None:
        self._pieces.append(text)
        if self._open_links:
            self._links += len(text)

    def _flush(self) -> None:
        if self._pieces:
            text = " ".join(html.unescape("".join(self._pieces)).split())
            if text:
                self.blocks.append((self._stack[-1], text, min(self._links, len(text))))
            self._pieces = []
        self._links = 0

    def _start(self, tag: str, attrs: str) -> None:
        if tag in BLOCKS:
            self._flush()
            if tag in PARAGRAPH_ENDS:
                self._close(("p",), ("td", "th", "table", "button"))
            if tag in LIKE:
                self._close(LIKE[tag], LIMITS[tag])
        elif tag == "br":
            self._pieces.append(" ")
        if tag in VOID or (attrs.endswith("/") and tag not in BLOCKS and tag not in RAW):
            return
        if tag == "a":
            self._open_links += 1
        if tag in BLOCKS or tag in DROPPED_TAGS:
            if tag not in BLOCKS:
                self._flush()
            self._stack.append(self._node(tag, attrs))

    def _node(self, tag: str, attrs: str) -> int:
        parent = self._stack[-1]
        names: dict[str, str] = {}
        if attrs:
            for m in ATTRIBUTE.finditer(attrs):
                if m[1].lower() in READ_ATTRIBUTES:
                    names.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        classes = names.get("class", "")
        words = {w.lower() for w in TOKENS_OF_NAME.findall(classes + " " + names.get("id", ""))} if names else set()
        inside = any(self.nodes[i][1] in ("article", "main") for i in self._stack)
        dropped = 0
        if tag not in ("html", "body", "article", "main"):
            if (tag in DROPPED_TAGS or names.get("role", "").lower() in DROPPED_ROLES or "hidden" in names
                    or names.get("aria-hidden") == "true" or "display:none" in names.get("style", "").replace(" ", "")
                    or not inside and tag == "header"):
                dropped = BY_KIND
            elif not words.isdisjoint(FOREIGN_WORDS) or not DROPPED_WORDS.isdisjoint(classes.lower().split()):
                dropped = BY_PLAIN_NAME
            elif not words.isdisjoint(DROPPED_WORDS) or not inside and not words.isdisjoint(HEADER_WORDS):
                dropped = BY_NAME
        label = ".".join([tag, *sorted(DIGITS.sub("#", c) for c in classes.split())])
        self.nodes.append((parent, tag, f"{self.nodes[parent][2]}/{label}", dropped))
        return len(self.nodes) - 1

    def _judge_names(self) -> None:
        """Settle which elements are boilerplate by their names: those whose class is just such a word, or that name other
        people's words, unless they hold the page's main, or an article with most of its prose; those with the word as a
        part of a name also if they hold most of the prose themselves."""
        by_kind = [False]
        for parent, _, _, kind in self.nodes[1:]:
            by_kind.append(by_kind[parent] or kind == BY_KIND)
        keep = {0}
        for plain in (True, False):
            out, prose = [False], [0] * len(self.nodes)
            for n, (parent, _, _, kind) in enumerate(self.nodes[1:], 1):
                out.append(out[parent] or by_kind[n] or not plain and kind == BY_PLAIN_NAME and n not in keep)
            for node, text, links in self.blocks:
                if not out[node] and links <= 0.3 * len(text):
                    prose[node] += len(text)
            holds_main = [False] * len(self.nodes)
            for n in range(len(self.nodes) - 1, 0, -1):
                parent, tag, _, _ = self.nodes[n]
                prose[parent] += prose[n]
                much = prose[n] > 0
                holds_main[parent] |= holds_main[n] or tag == "main" and much
            most = MAIN_SHARE * prose[0]
            for n in range(len(self.nodes) - 1, 0, -1):
                parent, tag, _, _ = self.nodes[n]
                holds_main[parent] |= holds_main[n] or tag == "article" and prose[n] > 0 and prose[n] >= most
            for n, (_, _, _, kind) in enumerate(self.nodes):
                if kind == (BY_PLAIN_NAME if plain else BY_NAME) and (holds_main[n] or not plain and prose[n] > 0 and prose[n] >= most):
                    keep.add(n)
        self.nodes = [(parent, tag, path, bool(kind) and n not in keep) for n, (parent, tag, path, kind) in enumerate(self.nodes)]

    def _close(self, tags: tuple[str, ...], limits: tuple[str, ...]) -> None:
        for k in range(len(self._stack) - 1, 0, -1):
            tag = self.nodes[self._stack[k]][1]
            if tag in tags:
                del self._stack[k:]
            elif tag in limits:
                return

    def _end(self, tag: str) -> None:
        if tag == "a":
            self._open_links = max(0, self._open_links - 1)
        if tag not in BLOCKS and tag not in DROPPED_TAGS:
            return
        self._flush()
        for k in range(len(self._stack) - 1, 0, -1):
            if self.nodes[self._stack[k]][1] == tag:
                del self._stack[k:]
                return

    def scores(self) -> dict[str, float]:
        """Score of every container path: long blocks with few links count for their container, and half for the one around."""
        found: dict[str, float] = defaultdict(float)
        gone = self.dropped(forms=False)
        for node, text, links in self.blocks:
            if gone[node]:
                continue
            value, weight = len(text) * (1 - links / len(text)) ** 2, 1.0
            while node > 0 and weight > 0.4:
                parent, tag, path, _ = self.nodes[node]
                if tag in CONTAINERS:
                    found[path] += value * weight * PREFERRED.get(tag, 1.0)
                    weight /= 2
                node = parent
        return found

    def dropped(self, forms: bool = True, below: str | None = None) -> list[bool]:
        """Per node, if it or an element around it is boilerplate; with `below`, only inside elements of that path."""
        gone = [False]
        inside = [below is None]
        for parent, tag, path, own in self.nodes[1:]:
            gone.append((gone[parent] or own and (forms or tag != "form")) and (below is None or inside[parent]))
            inside.append(inside[parent] or path == below)
        return gone

    def _blocks_in(self, path: str | None, forms: bool) -> list[int]:
        """Numbers of the blocks inside the elements of `path`, boilerplate left out."""
        inside = [path is None]
        for parent, _, own, _ in self.nodes[1:]:
            inside.append(inside[parent] or own == path)
        gone = self.dropped(forms, path)
        return [k for k, (node, _, _) in enumerate(self.blocks) if inside[node] and not gone[node]]

    def _adds_text(self, added: list[int], tag: str) -> bool:
        """True if the blocks are mainly text: long ones with few links, headings too unless in the body, and inside an article or
        main every block with few links. Other headings count neither way."""
        good = bad = 0
        for k in added:
            node, text, links = self.blocks[k]
            heading = self.nodes[node][1] in HEADINGS
            if links <= 0.3 * len(text) and (len(text) >= LONG_BLOCK or tag in ("article", "main") or heading and tag != "body"):
                good += len(text)
            elif not heading or links > 0.3 * len(text):
                bad += len(text)
        return good > bad

    def _widened(self, path: str, found: list[int], forms: bool) -> list[int]:
        """The blocks of the widest container around `path` that adds mainly text: articles and mains first, then the others from
        the inside out. One whose names would drop what was found is not taken."""
        start = next(k for k, node in enumerate(self.nodes) if node[2] == path)
        around = []
        node = self.nodes[start][0]
        while node > 0:
            if self.nodes[node][1] in CONTAINERS:
                around.append((self.nodes[node][1], self.nodes[node][2]))
            node = self.nodes[node][0]
        for first in (True, False):
            for tag, wider in around:
                if (tag in ("article", "main")) == first:
                    more = self._blocks_in(wider, forms)
                    if len(more) > len(found) and set(found) <= set(more) and self._adds_text(sorted(set(more) - set(found)), tag):
                        found = more
        return found

    def text(self, path: str | None) -> str:
        """Blocks inside the elements of `path` and what belongs to them around it, boilerplate left out; without such elements,
        or if they hold nothing, of the page's own best path."""
        paths = {p for _, _, p, _ in self.nodes}
        tried = [path] if path in paths else []
        for again in (False, True):
            if again:
                scores = self.scores()
                tried = [max(scores, key=lambda p: (scores[p], p)) if scores else None]
            for own in tried:
                for forms in (True, False):
                    found = self._blocks_in(own, forms)
                    if found:
                        if own:
                            found = self._widened(own, found, forms)
                        return "\n".join(self.blocks[k][1] for k in found)
        return ""


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, without user and port; empty if there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(found)


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, path: the container path with the most votes of each host.

    A page gives every path its score over the page's best score. Sums are combined in the tasks before the shuffle, so a
    host with most pages is no heavier than another.
    """
    schema = T.StructType([T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("vote", T.DoubleType())])
    rows = pages.select(host_of(pages[url_col]).alias("host"), pages[html_col].cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            votes: dict[tuple[str, str], float] = defaultdict(float)
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                scores = Page(source).scores() if source else {}
                best = max(scores.values(), default=0.0)
                for path, score in scores.items():
                    if best > 0:
                        votes[host, path] += round(1e6 * score / best)
            if votes:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h for h, _ in votes]), pa.array([p for _, p in votes]), pa.array(list(votes.values()), pa.float64())], names=schema.names)

    sums = rows.mapInArrow(run, schema).groupBy("host", "path").agg(F.sum("vote").alias("votes"))
    return sums.groupBy("host").agg(F.max_by("path", F.struct("votes", "path")).alias("path"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """`id_col`, `url_col`, text and n_chars of every page: the main text, blocks joined by line feeds.

    First all pages of a host vote for the generalised path (tags and classes from the root, numbers as #) of the container
    that holds their text; then each page is read again and gives the blocks inside the elements with the winning path.
    Where the containers around it add mainly text, as the title and lead of an article beside its body, they are taken too.
    Menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts and styles inside are left out. A page
    without such an element, or with nothing in it, uses its own best path.

    A null or empty page has empty text. Pages without a host vote together. Ids may be null or repeated, every row comes
    out once. An empty table gives an empty result. Other columns are not read.
    """
    ship(pages.sparkSession)
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), pages[html_col].cast("string").alias("html"))
    winners = settle(host_paths(rows))  # its size is known then, and decides how it is joined
    placed = rows.withColumn("host", host_of(F.col("url"))).join(winners, "host", "left").select("id", "html", "url", "path")
    schema = T.StructType([placed.schema["id"], placed.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            texts = [Page(source).text(path) if source else "" for source, path in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(texts, pa.string()),
                                              pa.array(list(map(len, texts)), pa.int64())], names=schema.names)

    return placed.mapInArrow(run, schema).withColumnsRenamed({"id": id_col, "url": url_col})
