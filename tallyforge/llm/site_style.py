"""Main text of web pages by site style trees.

Pages of one host are merged into a style tree: a style node stands for a place in the tree (the path of tag names with
their class, id and role), and holds in how many pages it occurs, which ways of continuing it has (presentation; a child
that repeats counts once), and how its content is spread over pages (content, composed of that of all nodes below). Text
counts as itself, but a run of short links counts as a run of links, whatever they say: a menu whose links differ by page
is one content. A node's importance is the entropy of its presentation over pages with
that of its content; branches of low importance (the same on most of the different pages that have them, if these are enough) are removed
from each page. A host with too few pages for that is judged by what all hosts have at the same place, where its own is
what most of them have. What a page itself declares to be navigation, notice, advert, form, sidebar, footer, comments, script or
style is removed on any site. Where a page has article or main elements, text is taken within them only; a container
with a boilerplate name does not hide the main that it holds, nor its articles if the page has no others. A name is a hint
only: it does not count on a container that holds an h1, nor at all on a page of which it would leave nothing.

Statistics are sums of partial counts by (host, node), so one huge host is pre-aggregated in every task and its tree is
never gathered with its pages; only the few low-importance nodes of each site come back to its pages, by a join, in which
a large host is dealt over several tasks.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import table, written

#: A node is judged from so many different pages on that have it, one inside article or main from LEAST_PAGES on; low
#: importance is below LEAST_IMPORTANCE.
LEAST_OCCURRENCES, LEAST_PAGES, LEAST_IMPORTANCE = 3, 8, 0.25
#: Hosts that must have the commonest content of a place, on different pages, before it speaks for hosts with fewer pages.
LEAST_HOSTS = 8
#: A run of blocks is one of links from so many links on; a block belongs to it if so many percent of its words stand in
#: links of so many words each at most. Headings never do.
LEAST_LINKS, LINK_PERCENT, LINK_WORDS = 3, 80, 4
#: A host with so many pages, and at least one in so many of all, is dealt: there are at most MOST_HOT of them.
LEAST_HOT, MOST_HOT = 1_000, 10_000
#: Fixed lists of the HTML standard: elements without content, elements that begin a block, and their implied ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
HIDDEN = frozenset("script style noscript template head title svg canvas iframe object select option button textarea input label form nav footer aside menu dialog datalist audio video map math".split())
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Fixed words in class, id or role that name boilerplate, as whole words between blanks; a number may follow.
NAMES = re.compile(
    r"(?<!\S)(?:ad|ads|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|sidebar|side-bar|footer|masthead|site-header|page-header|topbar|cookie|cookies|consent|gdpr|notice|alert|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|comment|comments|comment-list|disqus|reply|replies|respond|pagination|pager|widget|toolbar|contentinfo|complementary|search|skip|skip-link|legal|copyright)(?:[_-]?\d+)?(?!\S)",
    re.I,
)
_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRS = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?(?=$|\s|/)", re.I)
_DIGITS = re.compile(r"\d+")
_WORD = re.compile(r"\w+")
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_M64 = 0xFFFFFFFFFFFFFFFF


_PLACES: dict[tuple[int, str, str], tuple[int, bool, bool]] = {}


def _place(parent: int, tag: str, attrs: str) -> tuple[int, bool, bool]:
    """The style node of an element below a node, and whether it declares itself to be boilerplate: as such, or by name."""
    key = parent, tag, attrs
    found = _PLACES.get(key)
    if found is None:
        label, off, named = "", tag in HIDDEN, False
        for m in _ATTRS.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                off = True
            elif name != "aria-hidden":
                label += f" {name}={_DIGITS.sub('#', value)}"
                named |= bool(NAMES.search(value)) and tag not in ("body", "html", "article", "main")
        if len(_PLACES) > 100_000:
            _PLACES.clear()
        found = _PLACES[key] = xxhash.xxh64_intdigest(f"{parent}>{tag}{label}") >> 1, off, named
    return found


class Page:
    """One page's text blocks, each with the style nodes around it, and the nodes with their children."""

    def __init__(self, source: str | None) -> None:
        self.blocks: list[tuple[str, tuple[int, ...], int, bool, tuple[int, ...], int]] = []
        self._named, self._titled = 0, set()  # containers with a boilerplate name so far, and those of them that hold an h1
        self.nodes: dict[int, list] = {0: [[], 0, False, 0, 0]}  # children, content, inside, links of the run that is open, its text
        self._links, self._linked = 0, []
        self.main = 0  # the best of `inside`: 2 in article or main, 1 in an article whose container has a boilerplate name, else 0
        self._tags, self._path, self._state = [""], [0], [(False, (), 0)]  # hidden, the containers with a boilerplate name around, inside
        self._held: dict[str, int] = {}
        self._text: list[str] = []
        self._read(source or "")
        self._flush()
        for held in self.nodes.values():
            self._settle(held)

    def _short_links(self, text: str) -> int:
        """Links of the block, if it is little else."""
        n, linked = self._links, self._linked
        self._links, self._linked = 0, []
        if not linked or any(self._held.get(tag) for tag in _HEADINGS):
            return 0
        n, inside = max(n, 1), len(_WORD.findall(" ".join(linked)))
        return n if 0 < inside <= LINK_WORDS * n and 100 * inside >= LINK_PERCENT * len(_WORD.findall(text)) else 0

    @staticmethod
    def _settle(held: list) -> None:
        """Adds the open run of links to a node's content: as such if it is long enough, else by its text."""
        if held[3]:
            held[1] = (held[1] * 31 ^ (1 if held[3] >= LEAST_LINKS else held[4])) & _M64
            held[3] = held[4] = 0

    def _flush(self) -> None:
        if not self._text:
            return
        text = " ".join("".join(self._text).split())
        self._text.clear()
        if text:
            path, links = tuple(self._path), self._short_links(text)
            self.blocks.append((text, path, links, *self._state[-1]))
            h = xxhash.xxh64_intdigest(text)
            for node in path:
                held = self.nodes[node]
                if links:
                    held[3] += links
                    held[4] = (held[4] * 31 ^ h) & _M64
                else:
                    self._settle(held)
                    held[1] = (held[1] * 31 ^ h) & _M64

    def _pop(self, depth: int) -> None:
        while len(self._tags) > depth:
            if self._tags[-1] in BLOCK:
                self._flush()
            self._held[self._tags.pop()] -= 1
            self._path.pop()
            self._state.pop()

    def _last(self, tag: str) -> int:
        return len(self._tags) - 1 - self._tags[::-1].index(tag)

    def _open(self, tag: str, attrs: str) -> None:
        if tag in BLOCK:
            self._flush()
            if tag in ENDS_P and self._held.get("p"):
                at = self._last("p")
                if not any(n in ("td", "th", "table", "button", "object") for n in self._tags[at:]):
                    self._pop(at)
            for other in SIBLINGS.get(tag, ()):
                if self._held.get(other):
                    scope = max((k for k, n in enumerate(self._tags) if n in ("ul", "ol", "dl", "table", "select")), default=0)
                    if self._last(other) > scope:
                        self._pop(self._last(other))
        if tag in VOID:
            if tag == "br":
                self._text.append(" ")
            return
        parent, (hidden, below, inside) = self._path[-1], self._state[-1]
        link = tag == "a"
        self._links += link
        node, off, named = _place(parent, tag, "" if link and "class" not in attrs and "id" not in attrs and "role" not in attrs and "hidden" not in attrs else attrs)
        off |= tag == "header" and not inside
        hidden |= off
        if named:
            self._named += 1
            below = (*below, self._named)
        if tag == "h1" and not hidden:
            self._titled.update(below)
        if tag in ("article", "main"):
            if not (hidden or below and inside):
                inside = max(inside, 1 if tag == "article" and (below or inside == 1) else 2)
                below, self.main = (), max(self.main, inside)
            self.kept.add(node)
        elif tag in ("html", "body"):
            self.kept.add(node)
        children = self.nodes[parent][0]
        if not children or children[-1] != node:
            children.append(node)
        if node not in self.nodes:
            self.nodes[node] = [[], 0, inside > 0, 0, 0]
        self._tags.append(tag)
        self._path.append(node)
        self._state.append((hidden, below, inside))
        self._held[tag] = self._held.get(tag, 0) + 1

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        self.kept: set[int] = set()
        search = _TAG.search
        while at < n:
            m = search(source, at)
            stop = m.start() if m else n
            if stop > at:
                part = source[at:stop]
                self._text.append(html.unescape(part) if "&" in part else part)
                if self._held.get("a"):
                    self._linked.append(self._text[-1])
            if not m:
                break
            at = m.end()
            cdata, close, tag, attrs = m.groups()
            if cdata:
                self._text.append(cdata)
            if not tag:
                continue
            tag = tag.lower()
            if close:
                if self._held.get(tag):
                    self._pop(self._last(tag))
                if tag in BLOCK:
                    self._flush()
                continue
            self._open(tag, attrs)
            if tag in RAW and not attrs.rstrip().endswith("/"):
                end = re.compile(f"</{tag}[\\s/>]", re.I).search(source, at)
                at = end.start() if end else n

    def text(self, low: frozenset[int] | set[int], links: bool = True) -> str:
        """The kept blocks, with or without those of short links. A page's own article, main, body and html elements are never low themselves."""
        low = low - self.kept
        rows = [(t, below) for t, path, short, hidden, below, inside in self.blocks if not hidden and inside >= self.main and (links or not short) and not low.intersection(path)]
        return "\n".join([t for t, below in rows if self._titled.issuperset(below)] or [t for t, _ in rows])


def host_of(column):
    """The host of a url in lower case, without user and port; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(column, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, node, inside, page, shape, content): a node's presentation and content on a page, which its own text names.

    Pages of equal text give equal rows, most of which a task already leaves out. inside: whether article or main holds it.
    """
    seen: set[tuple] = set()

    def rows() -> pa.RecordBatch:
        columns = list(zip(*seen, strict=True))
        seen.clear()
        types = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["host", "node", "inside", "page", "shape", "content"])

    for batch in batches:
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            page = Page(source)
            own = xxhash.xxh64_intdigest(page.text(frozenset(), links=False)) >> 1
            for node, (children, content, inside, *_) in page.nodes.items():
                shape = xxhash.xxh64_intdigest(np.array(children, np.uint64).tobytes())
                seen.add((host, node, inside, own, shape >> 1, content >> 1))
            if len(seen) > 200_000:
                yield rows()
    if seen:
        yield rows()


def low_importance(pages: DataFrame) -> DataFrame:
    """(host, node) of the branches to remove. pages: (host, html).

    Copies count once: a page is what it says before any branch is removed, so an article under other menus is the same
    page. With n different pages that have the node and k different variants, entropy is taken to base n: 0 where all
    pages have it alike, 1 where each has its own. Importance is the larger of presentation's and content's entropy. Links
    of a run do not tell pages apart. Nodes on too few pages of their host are low where `_common` has them as the host does.
    """
    found = pages.select("host", "html").mapInArrow(_variants, "host string, node long, inside boolean, page long, shape long, content long")
    # where copies differ in hidden parts, one of their variants counts
    once = found.groupBy("host", "node", "page").agg(F.max("inside").alias("inside"), F.min("shape").alias("shape"), F.min("content").alias("content"))
    counts = once.select("host", "node", "inside", "page", F.expr("stack(2, 0, shape, 1, content) as (side, variant)"))
    merged = counts.groupBy("host", "node", "side", "variant").agg(F.count("*").alias("n"), F.max("inside").alias("inside"), F.min("page").alias("first"))
    merged = written(merged, "style-nodes")
    sides = merged.groupBy("host", "node", "side").agg(F.sum("n").alias("pages"), _entropy("n"), F.max("inside").alias("inside"), F.min("variant").alias("lo"), F.max("variant").alias("hi"))
    own = F.when(F.col("lo") == F.col("hi"), F.col("lo"))
    nodes = sides.groupBy("host", "node").agg(
        F.max("pages").alias("pages"), F.max("e").alias("importance"), F.max("inside").alias("inside"), F.max(F.when(F.col("side") == 0, own)).alias("shape"), F.max(F.when(F.col("side") == 1, own)).alias("content")
    )
    enough = F.col("pages") >= F.when(F.col("inside"), LEAST_PAGES).otherwise(LEAST_OCCURRENCES)
    low = nodes.where((F.col("importance") < LEAST_IMPORTANCE) & enough & (F.col("node") != 0)).select("host", "node")
    few = nodes.where(~enough & F.col("shape").isNotNull() & F.col("content").isNotNull() & (F.col("node") != 0))
    return low.union(few.join(_common(merged), ["node", "shape", "content"]).select("host", "node"))


def _entropy(n: str):
    """`e`: the entropy of counts in n to the base of their sum; 1 for a single one."""
    total = F.sum(n)
    return F.when(total > 1, 1 - F.sum(F.col(n) * F.log(n)) / total / F.log(total)).otherwise(1.0).alias("e")


def _common(merged: DataFrame) -> DataFrame:
    """(node, shape, content) that hosts have alike: places of low importance over all hosts, with what most of them have.

    A host has one vote for each of its variants, by the first page that has it; votes by the same page count once, so
    that copies on many hosts are one.
    """
    votes = merged.groupBy("node", "side", "variant", "first").agg(F.lit(1)).groupBy("node", "side", "variant").agg(F.count("*").alias("votes"))
    sides = votes.groupBy("node", "side").agg(_entropy("votes"), F.max(F.struct("votes", "variant")).alias("top"))
    top = lambda k: F.max(F.when(F.col("side") == k, F.col("top.variant")))
    nodes = sides.groupBy("node").agg(F.max("e").alias("e"), F.min("top.votes").alias("votes"), top(0).alias("shape"), top(1).alias("content"))
    return nodes.where((F.col("e") < LEAST_IMPORTANCE) & (F.col("votes") >= LEAST_HOSTS)).select("node", "shape", "content")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    A null html gives an empty text; a null url or one without a host belongs to the host of the empty name. Equal pages
    on one host have equal texts. Nothing but branches is dropped, and text is never cut.
    """
    held = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    # a site's few repeated branches; written, so that Spark knows the table's size and broadcasts it only while it is small
    low = written(low_importance(held).groupBy("host").agg(F.collect_list("node").alias("low")), "low-nodes")
    joined = _with_low(held, low)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(h).text(frozenset(w or ())) for h, w in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def _with_low(held: DataFrame, low: DataFrame) -> DataFrame:
    """(page_id, url, html, low): pages with their host's list, a large host's pages dealt over as many parts as it needs.

    A part has about one in MOST_HOT of all pages at most, so there are no more than twice MOST_HOT further lists.
    """
    sizes = written(held.groupBy("host").agg(F.count("*").alias("rows")), "hosts")
    part = max(LEAST_HOT, -(-(sizes.agg(F.sum("rows")).first()[0] or 0) // MOST_HOT))
    hot = sizes.where(F.col("rows") >= part).select("host", F.ceil(F.col("rows") / part).alias("parts"))  # at most MOST_HOT rows
    of_host = F.coalesce("parts", F.lit(1))
    dealt = held.join(F.broadcast(hot), "host", "left").withColumn("part", F.pmod(F.xxhash64("page_id", "url"), of_host))
    lists = low.join(F.broadcast(hot), "host", "left").select("host", "low", F.explode(F.sequence(F.lit(0).cast("long"), of_host - 1)).alias("part"))
    return dealt.join(lists, ["host", "part"], "left").select("page_id", "url", "html", "low")


def op5_site_style_tree(spark, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of every page; edge cases as in `extract`."""
    return extract(table(spark, sf_dir, "pages"))
