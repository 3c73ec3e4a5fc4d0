"""Main text of web pages by site template removal (operator 1).

A tolerant parser walks each page once, in time linear in the page, and hashes every block element's subtree before anything is
judged by its name. Two hashes count: the subtree with its text, and its frame (where it lies, by tags and classes, and what
tags and classes it holds, repeated neighbours once, text apart). Spark counts on how many pages of its host each occurs. Pages
that differ only outside their main part count as one, so copies of an article don't turn it into a template.

* A text subtree is a template if it is on MIN_PAGES pages and SHARE of those that hold its layout (the same tags and classes,
  whatever the text), so a menu of one section goes alike on a small host and on one with many sections. A bare paragraph has the
  layout of all bare paragraphs, so a sentence that some articles share stays, and nothing in an article or main element goes.
* A frame is a template if it is on MIN_PAGES pages, wherever it holds at most SMALL of a page's text, once in the page, and lies
  neither in nor around the page's main container: the deepest one that holds half of its text, or an article. Menus, adverts and
  notices whose words change from page to page go by that.

The second walk deletes templates, and elements that by tag or role are menus, headers, footers, sidebars, forms, scripts or
styles. Elements of which only a class or id says so (adverts, notices, comments, sharing) go too, unless they wrap an article, main
or h1 element and half of the page's other text, or nothing would be left: no such word removes the wrapper of the main text.
If article elements hold half of what is left, only their text is
taken, else only that of main elements, if there are any.

Up to BROADCAST_ROWS templates reach the tasks as a broadcast table; more are joined with the pages' own subtrees, so that a page
gets the templates it holds and not all of its host.

Cases: null or empty html gives the empty text; cut-off pages are closed at their end, and a tag or reference that is cut off
stays text only if it decodes; a null url is a host of its own; a null page_id is kept as it is. Repeated rows are extracted each
for themselves and count once. Very long and very deep pages are read whole. Ties: counts don't depend on an order. An empty table
gives no row. Further columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, read_table, small

MIN_PAGES, SHARE, SMALL = 5, 0.25, 0.2
BROADCAST_ROWS = 200_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
DROP = frozenset("nav header footer aside form button select option input label dialog menu head svg canvas audio video object".split()) | RAW
BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body", "li", "dd", "dt"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}} | {t: {"tbody", "thead", "tfoot", "tr", "td", "th"} for t in ("tbody", "thead", "tfoot")}
BOUND = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}} | {t: {"table"} for t in ("tbody", "thead", "tfoot")}
#: dropped elements whose end tag isn't optional; what is inside implies no end outside
HOLDS = DROP - {"option", "input"}
BARRIERS = ("article", "main", "body", "html")
CONTAINERS = frozenset("div article section main td".split())
#: elements whose frame may be a template
FRAMES = frozenset("nav aside header footer div section ul ol dl table form details figure".split())
P_BOUND = tuple(HOLDS | {"table", "article", "main", "body", "div", "section", "td"})
BOUND = {tag: tuple(HOLDS | bounds) for tag, bounds in BOUND.items()}
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
#: "with-sidebar" is said of what lies beside a sidebar
MODIFIERS = frozenset("with has no without layout page main content".split())
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars widget widgets footer header masthead "
    "cookie cookies consent gdpr notice notices alert popup modal overlay comment comments disqus respond replies reply share sharing social related recommended newsletter subscribe subscription signup login pagination pager toolbar topbar copyright legal disclaimer".split()
)


@lru_cache(maxsize=32)
def _ends(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\s*>", re.I)


def _named(tag: str, attrs: str) -> bool:
    """By tag, role or the hidden attribute no part of the main text."""
    if tag in DROP:
        return True
    if not attrs or tag in ("main", "body", "html", "article"):
        return False
    return any(name.lower() == "role" and "".join(v).lower() in BAD_ROLES for name, *v in _ATTR.findall(attrs)) or "hidden" in attrs.lower().split()


def _worded(tag: str, attrs: str) -> bool:
    """By a word of its class or id no part of the main text."""
    if not attrs or tag in ("main", "body", "html"):
        return False
    words = set()
    for name, *v in _ATTR.findall(attrs):
        for part in "".join(v).lower().split() if name.lower() != "role" else ():
            own = _WORD.findall(part)
            if own and own[0] not in MODIFIERS:
                words.update(own)
    return bool(words & {"comment", "comments", "reply", "ad", "advert"} if tag == "article" else words & BAD_WORDS)


def _hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s) >> 1


class Node:
    """A block element: its blocks of text are first to end; exact, layout and frame are its hashes (0 without text)."""

    __slots__ = ("tag", "label", "parent", "path", "named", "worded", "first", "end", "exact", "layout", "frame", "inside", "parts", "below")

    def __init__(self, tag, label, parent, path, named, worded, first):
        self.tag, self.label, self.parent, self.path, self.named, self.worded, self.first = tag, label, parent, path, named, worded, first
        self.end, self.exact, self.layout, self.frame = first, 0, 0, 0
        self.inside = tag in ("article", "main") or parent is not None and parent.inside
        self.parts: list = []
        self.below: list[int] = []


class Walk:
    """One walk over a page: its blocks of text, and its block elements in the order of their ends."""

    def __init__(self, page: str):
        self.blocks: list[str] = []
        self.nodes: list[Node] = []
        self.stack: list[tuple[str, bool, Node | None]] = []  # tag, whether dropped, node of a block element
        self.at: dict[str, list[int]] = {}  # where on the stack each tag is open
        self.open: list[Node] = []
        self.dropped = 0  # open inline elements that are dropped
        self.doubt = 0  # open block elements that are named or worded
        self.text: list[str] = []
        self._run(page)

    def _flush(self) -> None:
        if self.text and not self.dropped:
            t = _SPACE.sub(" ", html.unescape("".join(self.text))).strip()
            self.text = []
            if t:
                self.blocks.append(t)
                if self.open:
                    self.open[-1].parts.append(t)

    def _push(self, tag: str, attrs: str, drop: bool) -> None:
        node = None
        if tag in BLOCK and not self.dropped and not drop:
            self._flush()
            label = " ".join(sorted("".join(v).lower() for k, *v in _ATTR.findall(attrs) if k.lower() == "class")) if attrs else ""
            parent = self.open[-1] if self.open else None
            node = Node(tag, label, parent, _hash(f"{parent.path if parent else 0}/{tag}|{label}"), _named(tag, attrs), _worded(tag, attrs), len(self.blocks))
            self.open.append(node)
            self.doubt += node.named or node.worded
        self.at.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, drop, node))
        self.dropped += drop

    def _pop(self) -> None:
        tag, drop, node = self.stack.pop()
        self.at[tag].pop()
        self.dropped -= drop
        if node is not None:
            self._flush()
            self.open.pop()
            self.doubt -= node.named or node.worded
            node.end = len(self.blocks)
            if node.parts:
                inner = [x for k, x in enumerate(node.below) if not k or x != node.below[k - 1]]
                node.exact = _hash(f"{node.tag}|{node.label}|{'|'.join(map(str, node.parts))}")
                node.layout = _hash(f"{node.tag}|{node.label}|{'|'.join(map(str, inner))}")
                node.frame = _hash(f"{node.path}:{node.layout}")
                if self.open:
                    self.open[-1].parts.append(node.exact)
                    self.open[-1].below.append(node.layout)
            node.parts, node.below = [], []
            self.nodes.append(node)

    def _top(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def _imply(self, tags, bounds: tuple) -> None:
        """Closes the open elements of tags above the last of bounds."""
        top = self._top(tags)
        if top < 0 or (bound := self._top(bounds)) > top:
            return
        last = min(k for t in tags for k in self.at.get(t, ())[bisect_right(self.at.get(t, ()), bound) :])
        while len(self.stack) > last:
            self._pop()

    def _run(self, page: str) -> None:
        at, n = 0, len(page)
        while at < n:
            m = _TOKEN.search(page, at)
            if m is None:
                if not self.dropped:
                    self.text.append(page[at:])
                break
            if not self.dropped and m.start() > at:
                self.text.append(page[at : m.start()])
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                if tag == "br":
                    self._space()
                elif self.at.get(tag):
                    last = self.at[tag][-1]
                    if tag in BARRIERS or last > self._top(BARRIERS):
                        while len(self.stack) > last:
                            self._pop()
                elif tag == "p":
                    self._flush()
                continue
            if tag in CLOSES_P:
                self._imply(("p",), P_BOUND)
            if tag in SAME:
                self._imply(SAME[tag], BOUND[tag])
            if tag in VOID:
                if tag in BLOCK:
                    self._flush()
                else:
                    self._space()
                continue
            if tag in RAW:
                self._space()
                if not m[3].rstrip().endswith("/"):
                    end = _ends(tag).search(page, at)
                    at = end.end() if end else n
                continue
            whole = m[3].rstrip().endswith("/")
            drop = not self.dropped and tag not in BLOCK and (_named(tag, m[3]) or _worded(tag, m[3])) or bool(self.dropped) and tag in DROP
            if drop and not self.dropped:
                self._space()
            if not drop or not whole:
                self._push(tag, m[3], drop)
                if whole and (drop or self.dropped or self.doubt):
                    self._pop()
        while self.stack:
            self._pop()
        self._flush()

    def _space(self) -> None:
        if not self.dropped:
            self.text.append(" ")

    def sizes(self) -> list[int]:
        """The characters before each block, and their total."""
        return [0, *accumulate(map(len, self.blocks))]

    def _kept(self, texts=frozenset(), frames=frozenset()) -> list[bool]:
        """Which blocks are left."""
        gone = [0] * (len(self.blocks) + 1)
        mine = self.candidates() if frames else {}

        def delete(node: Node) -> None:
            gone[node.first] += 1
            gone[node.end] -= 1

        for node in self.nodes:
            if node.named or node.exact in texts and not node.inside or node.frame in frames and mine.get(node.frame) is node:
                delete(node)
        out = [not k for k in accumulate(gone)][:-1]
        left = [0, *accumulate(len(t) * k for t, k in zip(self.blocks, out))]
        heads = [0] * (len(self.blocks) + 1)  # articles, main elements and first headings that begin before each block
        for node in self.nodes:
            if node.tag in ("article", "main", "h1") and node.exact and not node.named:
                heads[node.first] += 1
        heads = [0, *accumulate(heads)]
        named = gone[:]
        for node in self.nodes:
            wraps = node.tag not in ("article", "h1") and heads[node.end] > heads[node.first] and 2 * (left[node.end] - left[node.first]) >= left[-1]
            if node.worded and not wraps:
                delete(node)
        kept = [not k for k in accumulate(gone)][:-1]
        return kept if any(kept) else [not k for k in accumulate(named)][:-1]

    def candidates(self) -> dict[int, Node]:
        """The frames that may be templates: small, once in the page, neither in nor around its main container or an article."""
        if hasattr(self, "_candidates"):
            return self._candidates
        upto = self.sizes()
        total = upto[-1]
        size = {id(x): upto[x.end] - upto[x.first] for x in self.nodes}
        main = next((x for x in self.nodes if x.tag in CONTAINERS and 2 * size[id(x)] >= total), None)  # the deepest ends first
        covered: set[int] = set()
        for x in reversed(self.nodes):  # parents before children
            if x is main or x.tag in ("article", "main") or x.parent is not None and id(x.parent) in covered:
                covered.add(id(x))
        found: dict[int, Node | None] = {}
        for x in self.nodes:
            if x.frame and x.tag in FRAMES and id(x) not in covered and size[id(x)] <= SMALL * total:
                found[x.frame] = None if x.frame in found else x
        self._candidates = {f: x for f, x in found.items() if x is not None}
        return self._candidates

    def main_text(self, texts=frozenset(), frames=frozenset()) -> str:
        kept = self._kept(texts, frames)
        place = [0] * (len(self.blocks) + 1)
        for tag, value in (("main", 1), ("article", 1 << 20)):
            for node in self.nodes:
                if node.tag == tag:
                    place[node.first] += value
                    place[node.end] -= value
        left = [(p, t) for p, t, k in zip(accumulate(place), self.blocks, kept) if k]
        total = sum(len(t) for _, t in left)
        own = [t for p, t in left if p >= 1 << 20]
        if not own or 2 * sum(map(len, own)) < total:
            own = [t for p, t in left if p % (1 << 20)]
        if own:
            return "\n".join(own)
        return "\n".join(t for _, t in left)


def extract(page: str | None, templates=frozenset()) -> str:
    """templates: (kind, hash) pairs, kind 0 for text subtrees and 1 for frames."""
    return Walk(page or "").main_text({h for k, h in templates if k == 0}, {h for k, h in templates if k == 1})


def _host(column="url"):
    return F.coalesce(F.lower(F.regexp_extract(F.coalesce(column, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def subtree_rows(batches):
    """(host, kind, layout, subtree, context) once for each task and slice: context is the hash of the page's main text; kind -1 is the
    layout itself, 0 a subtree with its text, 1 a frame."""
    for b in small(batches):
        seen = set()
        for host, page in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
            w = Walk(page or "")
            context = _hash(w.main_text())
            for x in w.nodes:
                if x.exact and not x.inside:
                    seen.add((host, -1, x.layout, 0, context))
                    seen.add((host, 0, x.layout, x.exact, context))
            seen.update((host, 1, 0, f, context) for f in w.candidates())
        rows = list(zip(*seen)) or [(), (), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:])], ["host", "kind", "layout", "subtree", "context"])


def find_templates(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """host, kind, subtree of the subtrees and frames that recur on their host; pages: host, html."""
    rows = pages.select("host", "html").mapInArrow(subtree_rows, "host string, kind int, layout long, subtree long, context long")
    counts = rows.distinct().groupBy("host", "kind", "layout", "subtree").agg(F.count(F.lit(1)).alias("n"))
    often = cut(counts.where(F.col("n") >= min_pages), "op1-counts")
    total = often.where("kind = -1").select("host", "layout", F.col("n").alias("pages"))
    texts = often.where("kind = 0").join(total, ["host", "layout"]).where(F.col("n") >= share * F.col("pages")).select("host", "kind", "subtree")
    return texts.union(often.where("kind = 1").select("host", "kind", "subtree")).distinct()


def own_subtrees(batches):
    """(host, page, kind, subtree) of every page."""
    for b in small(batches):
        rows = set()
        for host, page, text in zip(*(b.column(c).to_pylist() for c in ("host", "page", "html"))):
            w = Walk(text or "")
            rows.update((host, page, 0, x.exact) for x in w.nodes if x.exact and not x.inside)
            rows.update((host, page, 1, f) for f in w.candidates())
        rows = list(zip(*rows)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.int64())], ["host", "page", "kind", "subtree"])


def main_texts(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, url, html -> page_id, url, text."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", _host().alias("host"))
    templates = cut(find_templates(pages, min_pages, share), "op1-templates")
    schema = "page_id long, url string, text string"
    if templates.limit(broadcast_rows + 1).count() <= broadcast_rows:
        by_host: dict[str, set[tuple[int, int]]] = {}
        for r in templates.collect():  # at most broadcast_rows rows
            by_host.setdefault(r.host, set()).add((r.kind, r.subtree))
        shared = pages.sparkSession.sparkContext.broadcast(by_host)

        def run(batches):
            for b in batches:
                none: frozenset = frozenset()
                own = shared.value
                texts = [extract(p, own.get(h, none)) for h, p in zip(b.column("host").to_pylist(), b.column("html").to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

        return pages.mapInArrow(run, schema)
    pages = pages.withColumn("page", F.xxhash64("html"))
    held = pages.select("host", "page", "html").mapInArrow(own_subtrees, "host string, page long, kind int, subtree long").join(templates, ["host", "kind", "subtree"])
    lists = held.groupBy("host", "page").agg(F.collect_set(F.struct("kind", "subtree")).alias("subtrees"))  # at most the page's own subtrees

    def run_joined(batches):
        for b in batches:
            texts = [extract(p, {(x["kind"], x["subtree"]) for x in s or ()}) for p, s in zip(b.column("html").to_pylist(), b.column("subtrees").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.join(lists, ["host", "page"], "left").select("page_id", "url", "html", "subtrees").mapInArrow(run_joined, schema)


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(read_table(spark, sf_dir, "pages", "page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))
