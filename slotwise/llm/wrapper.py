"""Main text of web pages by wrapper induction.

Pages become trees of block elements whose leaves are runs of text. Each host has up to three seed pages;
all its distinct pages are aligned with each seed by simple tree matching (order-preserving, equal labels,
equal text counting more). That gives, for each leaf of a seed, on how many pages its text stands there and
how much other text stands there instead. A leaf whose text most of the host's other distinct pages share
is template. The wrapper's main region is found from what varies: from the root down, as long as one
container holds most of the varying unlinked text. A page's text is what stands in the node aligned with
the main region of the seed that fits it best, less the template, with a varying headline before it.

Elements' and classes' names only help: regions that HTML names for what they are (navigation, footers,
asides, adverts, notices, forms, comments, scripts, styles) don't count as varying text and don't belong to
the text, unless, for regions that only a class or an id names, they hold most of a page's text; lists of
nothing but links are menus. main and article elements are looked at only where no wrapper fits: on hosts of
fewer than `least_pages` distinct pages and on pages of another layout. There a main or article element
that holds most of the text is the region, else one is found as in wrappers, from the page alone.

Every page takes part in the counts, which are summed before they are shuffled. Wrappers reach the pages
by broadcast while their size, which is measured, is small, and by a join on the host beyond that; a host
with a third of all pages is split by adaptive execution there. Tasks sort their pages by host, so that a
seed is parsed once for each run of its host.

Null html and pages without text give an empty string. A page without a host has no wrapper. Tags are
scanned in linear time, whatever quotes are left open; trees may be of any depth, and child lists of any
length are aligned with most weight in memory that grows with their lengths only. Repeated payloads of a
host count once and give a row each. Empty tables give no rows; only the named columns are read.
"""

from __future__ import annotations

import html
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.llm.arrow import column
from slotwise.session import ship_package, written

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TOKEN = re.compile(r"[a-z0-9]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp".split())
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in _RAW}
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
#: Blocks that can be the region of the text, and blocks that can be menus.
_CONTAINER = frozenset("#root html body main article section div center table tbody tr td".split())
_LIST = frozenset("ul ol dl div section table tr td menu".split())
#: Start tags that end an open element of these names.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead"}}
_DROPPED = frozenset("head nav aside footer form script style noscript template iframe svg button select textarea title dialog menu object xmp".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
#: Words of class and id attributes that name what is not the article.
_NAMES = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation menu menus sidebar footer masthead breadcrumb breadcrumbs cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup social share sharing comment comments commentlist disqus respond reply replies related recommended pagination pager popup modal overlay widget widgets toolbar login banner skip".split())
_CELLS = 1 << 22  # of a table kept for going back; longer lists are halved, which needs none


class Node:
    """A block element or a run of text (#text). drop: 1 by a class or id, 2 by its element or role, here or above."""

    __slots__ = ("tag", "label", "text", "kids", "drop", "article", "linked", "parent")

    def __init__(self, tag: str, label: str, text: str = "", drop: int = 0, article: int = 0, linked: bool = False, parent: Node | None = None):
        self.tag, self.label, self.text, self.drop, self.article, self.linked, self.parent = tag, label, text, drop, article, linked, parent
        self.kids: list[Node] = []


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def tags(source: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text before, name, whether an end tag, attributes) of each tag in turn, the last with an empty name; linear in the source.

    A > inside quotes doesn't end a tag. A quote that isn't closed is no quote, and once a tag would run
    to the end of the source that way, quotes are no longer looked at.
    """
    at, begin, n = 0, 0, len(source)
    last = {q: source.rfind(q) for q in "\"'"}
    quotes = True
    while True:
        at = source.find("<", at)
        if at < 0 or at + 1 >= n:
            yield source[begin:], "", False, ""
            return
        following = source[at + 1]
        if following in "!?":
            close = source.find("-->" if source.startswith("<!--", at) else ">", at + 2)
            yield source[begin:at], "", False, ""
            begin = at = n if close < 0 else close + (3 if source.startswith("<!--", at) else 1)
            continue
        ending = following == "/"
        name = _NAME.match(source, at + 1 + ending)
        if name is None:
            at += 1
            continue
        to = name.end()
        while quotes:
            stop = _STOP.search(source, to)
            if stop is None:
                quotes = False
                break
            to = stop.start()
            if stop[0] == ">":
                break
            to = source.index(stop[0], to + 1) + 1 if last[stop[0]] > to else to + 1
        if not quotes:
            to = source.find(">", name.end())
            if to < 0:  # no tag can end any more
                yield source[begin:], "", False, ""
                return
        yield source[begin:at], name[0].lower(), ending, source[name.end() : to]
        begin = at = to + 1
        if not ending and name[0].lower() in _RAW:
            end = _RAW_END[name[0].lower()].search(source, at)
            begin = at = end.end() if end else n


def parse(source: str) -> Node:
    """The tree of block elements; leaves named #text hold runs with single spaces."""
    root = Node("#root", "#root")
    stack: list[tuple[str, Node]] = [("#root", root)]  # open elements, inline ones with their block's node
    open_: dict[str, int] = {}
    run: list[str] = []
    links = 0
    linked_only = True

    def flush() -> None:
        nonlocal linked_only
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                owner = stack[-1][1]
                owner.kids.append(Node("#text", "#text", text, owner.drop, owner.article, linked_only, owner))
        linked_only = True

    def say(text: str) -> None:
        nonlocal linked_only
        if text:
            run.append(html.unescape(text) if "&" in text else text)
            if not links and not text.isspace():
                linked_only = False

    def close(to: int) -> None:
        nonlocal links
        while len(stack) > to:
            tag, _ = stack[-1]
            if tag in _BLOCK:
                flush()
            links -= tag == "a"
            open_[tag] -= 1
            stack.pop()

    for before, tag, ending, rest in tags(source):
        say(before)
        if not tag or tag in _RAW:
            continue
        if ending:  # an end tag closes the nearest open element of its name
            if open_.get(tag):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        close(k)
                        break
                    if tag not in _BLOCK and stack[k][0] in _BLOCK:
                        break
            continue
        if tag in _BLOCK:
            if open_.get("p"):
                for k in range(len(stack) - 1, 0, -1):  # a paragraph ends where another block begins
                    if stack[k][0] == "p":
                        close(k)
                        break
                    if stack[k][0] in _BLOCK:
                        break
            if any(open_.get(x) for x in _ENDS.get(tag, ())):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in _ENDS[tag]:
                        close(k)
                        break
                    if stack[k][0] in ("ul", "ol", "dl", "table", "select", "div", "body"):
                        break
            flush()
        elif tag == "br":
            say(" ")
        parent = stack[-1][1]
        attributes = _attributes(rest) if rest and not rest.isspace() else {}
        names = set(_TOKEN.findall(f"{attributes.get('class', '')} {attributes.get('id', '')}".lower())) if attributes else set()
        main = 2 if tag == "main" or attributes.get("role") == "main" else 1 if tag == "article" else 0
        drop = 2 if tag in _DROPPED or tag == "header" and not parent.article else 0
        if attributes and not main and tag not in ("body", "html"):
            if attributes.get("role", "").lower() in _ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", ""):
                drop = 2
            elif names & _NAMES:
                drop = max(drop, 1)
        if tag in _VOID or rest.rstrip().endswith("/") and tag not in _BLOCK:
            continue
        if tag in _BLOCK or drop > parent.drop:  # a dropped inline element is a region of its own
            if tag not in _BLOCK:
                flush()
            words = sorted(x for x in names if x.isalpha())  # numbers in names are often a page's own
            node = Node(tag, f"{tag}.{'.'.join(words)}" if words else tag, "", max(drop, parent.drop), max(parent.article, main), False, parent)
            parent.kids.append(node)
        else:
            node = parent
        links += tag == "a"
        open_[tag] = open_.get(tag, 0) + 1
        stack.append((tag, node))
    close(1)
    flush()
    return root


def nodes_of(root: Node) -> list[Node]:
    """All nodes in page order."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        out.append(x)
        todo.extend(reversed(x.kids))
    return out


def leaves(root: Node) -> list[Node]:
    return [x for x in nodes_of(root) if x.tag == "#text"]


class Alignment:
    """An order-preserving alignment of two trees with most weight (simple tree matching): 1 a pair of nodes, 1 more for runs of equal text.

    Regions dropped for their element or role are aligned as a whole, not inside, as nothing in them is ever used.
    """

    def __init__(self, a: Node, b: Node):
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))  # trees may be deep; Python's own frames are on the heap
        self.memo: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}
        self.weight = self.match(a, b)
        self.pairs: list[tuple[Node, Node]] = []
        todo = [(a, b)] if self.weight else []
        while todo:
            x, y = todo.pop()
            self.pairs.append((x, y))
            if x.kids and y.kids and x.drop < 2:
                todo += [(x.kids[i], y.kids[j]) for i, j in self.children(x, y)[1]]

    def match(self, x: Node, y: Node) -> int:
        if x.label != y.label:
            return 0
        if x.tag == "#text":
            return 1 + (x.text == y.text)
        if x.drop == 2 or not x.kids or not y.kids:
            return 1
        return 1 + self.children(x, y)[0]

    def children(self, x: Node, y: Node) -> tuple[int, list[tuple[int, int]]]:
        p, q = x.kids, y.kids
        if not p or not q:
            return 0, []
        if len(p) == len(q) == 1 and not p[0].kids:
            w = self.match(p[0], q[0])
            return w, [(0, 0)] if w else []
        key = (id(x), id(y))
        if key not in self.memo:
            self.memo[key] = self.small(p, q) if len(p) * len(q) <= 64 else self.large(p, q)
        return self.memo[key]

    def small(self, p: list[Node], q: list[Node]) -> tuple[int, list[tuple[int, int]]]:
        m, n = len(p), len(q)
        weight = [[self.match(x, y) for y in q] for x in p]
        best = [[0] * (n + 1)]
        for i in range(m):
            above, row, w = best[i], [0], weight[i]
            for j in range(n):
                row.append(max(above[j + 1], row[j], above[j] + w[j]))
            best.append(row)
        return best[m][n], _back(best, weight, m, n)

    def large(self, p: list[Node], q: list[Node]) -> tuple[int, list[tuple[int, int]]]:
        """As small, with rows as arrays; labels and texts of runs and paragraphs are told by numbers."""
        number: dict[str, int] = {}

        def facts(nodes: list[Node]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """Numbers of labels and texts, weight beyond the label's that equal texts can add, and places of nodes that aren't plain."""
            rows = []
            for i, x in enumerate(nodes):
                run = x if x.tag == "#text" else x.kids[0] if len(x.kids) == 1 and x.kids[0].tag == "#text" and x.drop < 2 else None
                text = -1 if run is None else number.setdefault(run.text, len(number))
                rows.append((number.setdefault(f"\0{x.label}", len(number)), text, run is not None and run is not x, i if x.kids and run is None and x.drop < 2 else -1))
            label, text, nested, odd = (np.array(c) for c in zip(*rows, strict=True))
            return label, text, nested.astype(np.int64), odd[odd >= 0]

        (p_label, p_text, p_nested, p_odd), (q_label, q_text, q_nested, q_odd) = facts(p), facts(q)

        def weights(a: int, b: int, lo: int, hi: int) -> np.ndarray:
            same = p_label[a:b, None] == q_label[lo:hi]
            w = same * (1 + (p_nested[a:b, None] & q_nested[lo:hi]) + ((p_text[a:b, None] == q_text[lo:hi]) & (p_text[a:b, None] >= 0)))
            rows, columns = p_odd[np.searchsorted(p_odd, a) : np.searchsorted(p_odd, b)], q_odd[np.searchsorted(q_odd, lo) : np.searchsorted(q_odd, hi)]
            for i in rows:
                for j in np.flatnonzero(same[i - a]):
                    w[i - a, j] = self.match(p[i], q[lo + j])
            for j in columns:
                for i in np.flatnonzero(same[:, j - lo]):
                    w[i, j - lo] = self.match(p[a + i], q[j])
            return w

        def step(above: np.ndarray, w: np.ndarray) -> np.ndarray:
            row = np.empty_like(above)
            row[0] = 0
            row[1:] = np.maximum(above[1:], above[:-1] + w)
            return np.maximum.accumulate(row, out=row)

        chosen: list[tuple[int, int]] = []
        todo = [(0, len(p), 0, len(q))]
        while todo:
            a, b, lo, hi = todo.pop()
            if a == b or lo == hi:
                continue
            if b - a == 1 or (b - a) * (hi - lo) <= _CELLS:
                kept = weights(a, b, lo, hi)
                best = [np.zeros(hi - lo + 1, np.int64)]
                for w in kept:
                    best.append(step(best[-1], w))
                chosen += [(a + i, lo + j) for i, j in _back(best, kept, b - a, hi - lo)]
                continue
            middle = (a + b) // 2  # the best place to part the other list, from both ends
            first = np.zeros(hi - lo + 1, np.int64)
            for i in range(a, middle):
                first = step(first, weights(i, i + 1, lo, hi)[0])
            second = np.zeros(hi - lo + 1, np.int64)
            for i in range(b - 1, middle - 1, -1):
                second = step(second, weights(i, i + 1, lo, hi)[0, ::-1])
            cut = lo + int(np.argmax(first + second[::-1]))
            todo += [(a, middle, lo, cut), (middle, b, cut, hi)]
        chosen.sort()
        return sum(self.match(p[i], q[j]) for i, j in chosen), chosen


def _back(best: list, weight: list, m: int, n: int) -> list[tuple[int, int]]:
    chosen, i, j = [], m, n
    while i and j:
        w = weight[i - 1][j - 1]
        if w and best[i][j] == best[i - 1][j - 1] + w:
            chosen.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return chosen[::-1]


def region(root: Node, worth: dict[int, float], most: float) -> tuple[Node, float]:
    """From the root down, the last container that still holds `most` of the worth of the one above it; and its worth."""
    total: dict[int, float] = {}
    for x in reversed(nodes_of(root)):
        total[id(x)] = worth.get(id(x), 0.0) + sum(total[id(k)] for k in x.kids)
    at = root
    while True:
        best = max((k for k in at.kids if k.tag in _CONTAINER), key=lambda k: total[id(k)], default=None)
        if best is None or not total[id(best)] or total[id(best)] < most * total[id(at)]:
            return at, total[id(at)]
        at = best


def own_drops(root: Node) -> set[int]:
    """Ids of nodes that belong to dropped regions. One that only a class or id names is none if it holds most of the text not dropped otherwise."""
    size: dict[int, int] = {}
    order = nodes_of(root)
    for x in reversed(order):
        size[id(x)] = (len(x.text) if x.tag == "#text" and x.drop < 2 and not x.linked else 0) + sum(size[id(k)] for k in x.kids)
    out: set[int] = set()
    for x in order:
        above = x.parent
        if above is not None and id(above) in out or x.drop == 2 and (above is None or above.drop < 2):
            out.add(id(x))
        elif x.drop == 1 and x.tag != "#text" and (above is None or not above.drop) and 2 * size[id(x)] <= size[id(root)]:
            out.add(id(x))
    return out


def menus(root: Node) -> set[int]:
    """Ids of runs inside blocks of three runs or more that are all links."""
    runs: dict[int, tuple[int, bool]] = {}
    out: set[int] = set()
    order = nodes_of(root)
    for x in reversed(order):
        if x.tag == "#text":
            runs[id(x)] = 1, x.linked
        else:
            below = [runs[id(k)] for k in x.kids]
            runs[id(x)] = sum(n for n, _ in below), all(f for _, f in below)
    for x in order:
        n, linked = runs[id(x)]
        if x.parent is not None and id(x.parent) in out or linked and n >= 3 and x.tag in _LIST:
            out.add(id(x))
    return out


def says(root: Node, within: list[Node], dropped: set[int], template: set[int]) -> str:
    inside = {id(y) for x in within for y in nodes_of(x)}
    return "\n".join(x.text for x in leaves(root) if id(x) in inside and id(x) not in dropped and id(x) not in template)


def text_alone(root: Node, template: set[int], share: float = 0.5, most: float = 0.8) -> str:
    """Text of a page that no wrapper fits."""
    dropped = own_drops(root) | menus(root)
    worth = {id(x): float(len(x.text)) for x in leaves(root) if id(x) not in dropped and id(x) not in template}
    level = max((x.article for x in nodes_of(root) if id(x) not in dropped), default=0)
    if level:
        named = [x for x in nodes_of(root) if x.article >= level and (x.parent is None or x.parent.article < level)]
        held = sum(worth.get(id(y), 0.0) for x in named for y in nodes_of(x))
        if held and held >= share * sum(worth.values()):
            return says(root, named, dropped, template)
    return says(root, [region(root, worth, most)[0]], dropped, template)


class Wrapper:
    """A seed page, its template leaves and its main region, from the counts of its leaves."""

    def __init__(self, source: str):
        self.tree = parse(source)
        self.number = {id(x): i for i, x in enumerate(leaves(self.tree))}
        self.template: set[int] = set()
        self.main: Node | None = None
        self.headline: Node | None = None

    def learn(self, slots: list[dict], n_others: int, least_same: float, most: float) -> Wrapper:
        """slots: slot, same (pages with the seed's text there), varied (characters of other texts there)."""
        of = {s["slot"]: s for s in slots}
        dropped = own_drops(self.tree) | menus(self.tree)
        worth = {}
        for x in leaves(self.tree):
            s = of.get(self.number[id(x)])
            if s is None:
                continue
            if s["same"] >= n_others * least_same:
                self.template.add(id(x))
            elif id(x) not in dropped and not x.linked:
                worth[id(x)] = float(s["varied"])
        node, held = region(self.tree, worth, most)
        if held:
            self.main = node
            inside = {id(x) for x in nodes_of(node)}
            before = []
            for x in nodes_of(self.tree):
                if x is node:
                    break
                if x.tag == "h1" and any(id(k) in worth for k in nodes_of(x)):
                    before.append(x)
            if before and not any(x.tag == "h1" for x in nodes_of(node)) and id(before[-1]) not in inside:
                self.headline = before[-1]
        return self

    def fit(self, page: Node) -> tuple[int, list[Node], set[int]]:
        """Weight of the alignment, the page's nodes in place of the headline and main region, and its template runs."""
        made = Alignment(self.tree, page)
        places = {id(x): y for x, y in made.pairs if x is self.main or x is self.headline}
        template = {id(y) for x, y in made.pairs if id(x) in self.template and x.text == y.text}
        main = places.get(id(self.main))
        return made.weight, [] if main is None else [y for x in (self.headline, self.main) if x is not None and (y := places.get(id(x)))], template


def main_text(source: str, wrappers: list[Wrapper]) -> str:
    page = parse(source)
    template: set[int] = set()
    best: tuple[int, list[Node]] = (-1, [])
    for w in wrappers:
        weight, places, fixed = w.fit(page)
        template |= fixed
        if places and weight > best[0]:
            best = weight, places
    if best[1]:
        text = says(page, best[1], own_drops(page) | menus(page), template)
        if text:
            return text
    return text_alone(page, template)


_parsed: dict[str, Wrapper] = {}


def _seed(source: str) -> Wrapper:
    if source not in _parsed:
        if len(_parsed) >= 64:
            _parsed.pop(next(iter(_parsed)))
        _parsed[source] = Wrapper(source)
    return _parsed[source]


def host_of(url: str) -> F.Column:
    return F.lower(F.regexp_extract(F.col(f"`{url}`").cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def count_slots(pages: DataFrame, sent: object | None) -> DataFrame:
    """Rows host, seed, slot, same, varied from distinct pages (host, html, and seeds where `sent`, the broadcast seeds by host, is none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, int, int], list[int]] = {}

        def out() -> pa.RecordBatch:
            rows = [(*k, *n) for k, n in counts.items()]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *[pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2, 3, 4)]], names=["host", "seed", "slot", "same", "varied"])

        for batch in batches:
            hosts, sources = column(batch, "host").to_pylist(), column(batch, "html").to_pylist()
            listed = column(batch, "seeds").to_pylist() if sent is None else [sent.value.get(h, ()) for h in hosts]
            for host, source, seeds in zip(hosts, sources, listed, strict=True):
                page = parse(source) if seeds else None
                for k, seed in enumerate(seeds):
                    if seed != source:
                        wrapper = _seed(seed)
                        for x, y in Alignment(wrapper.tree, page).pairs:
                            if x.tag == "#text":
                                n = counts.setdefault((host, k, wrapper.number[id(x)]), [0, 0])
                                if x.text == y.text:
                                    n[0] += 1
                                else:
                                    n[1] += len(y.text)
            if len(counts) > 100_000:
                yield out()
        yield out()

    return pages.mapInArrow(run, "host string, seed long, slot long, same long, varied long").groupBy("host", "seed", "slot").agg(F.sum("same").alias("same"), F.sum("varied").alias("varied"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html", least_pages: int = 5, least_same: float = 0.8, most: float = 0.8, broadcast_bytes: int = 8 << 20, n_seeds: int = 3) -> DataFrame:
    """Rows page_id, url, text, n_chars."""
    spark = pages.sparkSession
    ship_package(spark)
    p = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.nullif(host_of(url), F.lit("")).alias("host"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("html"))
    hashed = p.where("host is not null and html <> ''").select("page_id", "host", "html", F.xxhash64("html").alias("h"), F.xxhash64(F.lit(1), "html").alias("g"))
    payloads = written(hashed.groupBy("host", "h", "g").agg(F.min("page_id").alias("_page"), F.count(F.lit(1)).alias("_rows")), "payloads")
    fits = lambda df: F.broadcast(df) if df.limit(broadcast_bytes // 64 + 1).count() <= broadcast_bytes // 64 else df

    # the seeds of a host are the least payloads of as many parts of its hashes
    order = F.xxhash64("h", "g")
    least = payloads.groupBy("host", F.pmod(order, F.lit(n_seeds)).alias("_part")).agg(F.min_by(F.struct("h", "g", "_page"), F.struct(order, "h", "g")).alias("_s"), F.count(F.lit(1)).alias("_n"))
    hosts = least.groupBy("host").agg(F.sum("_n").alias("n_pages")).where(F.col("n_pages") >= least_pages)
    chosen = fits(written(least.join(hosts, "host").select("host", "n_pages", "_part", F.col("_s.h").alias("h"), F.col("_s.g").alias("g"), "_s._page"), "chosen"))
    single = hashed.join(chosen, ["host", "h", "g"]).where(F.col("page_id").eqNullSafe(F.col("_page"))).groupBy("host", "_part").agg(F.first("html").alias("html"), F.first("n_pages").alias("n_pages"))
    seed = written(single.groupBy("host").agg(F.first("n_pages").alias("n_pages"), F.sort_array(F.collect_list(F.struct("_part", "html"))).alias("_s")).select("host", "n_pages", F.col("_s.html").alias("seeds")), "seeds")
    bytes_ = seed.agg(F.coalesce(F.sum(F.octet_length(F.array_join("seeds", "")) + F.octet_length("host")), F.lit(0))).first()[0]
    small = bytes_ <= broadcast_bytes
    sent = spark.sparkContext.broadcast({r["host"]: r["seeds"] for r in seed.collect()}) if small else None  # of at most broadcast_bytes

    # a payload counts once: copies but one leave, and rows that are equal as a whole are made one
    repeated = fits(written(payloads.where("_rows > 1").select("host", "h", "g", "_page"), "repeated"))
    once = hashed.join(repeated, ["host", "h", "g"], "left_anti").select("host", "html")
    kept = hashed.join(repeated, ["host", "h", "g"]).where(F.col("page_id").eqNullSafe(F.col("_page"))).dropDuplicates(["host", "h", "g"]).select("host", "html")
    distinct = once.union(kept) if small else once.union(kept).join(seed.select("host", "seeds"), "host")
    counts = written(count_slots(distinct.sortWithinPartitions("host"), sent), "slots")
    slots = counts.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("seed", "slot", "same", "varied"))).alias("slots"))
    wrappers = written(seed.join(slots, "host").select("host", "n_pages", "seeds", "slots"), "wrappers")  # as many slots as the seeds have runs
    if small:
        sent.destroy()
        found = spark.sparkContext.broadcast({r["host"]: (r["n_pages"], r["seeds"], [s.asDict() for s in r["slots"]]) for r in wrappers.collect()})
        joined = p.select("page_id", "url", "html", "host")
    else:
        found = None
        joined = p.join(wrappers, "host", "left").select("page_id", "url", "html", "host", "n_pages", "seeds", "slots")
    schema = T.StructType([joined.schema["page_id"], joined.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, list[Wrapper]] = (None, [])
        for batch in batches:
            texts = []
            hosts_, sources = column(batch, "host").to_pylist(), column(batch, "html").to_pylist()
            for i, (host, source_) in enumerate(zip(hosts_, sources, strict=True)):
                if host != last[0]:
                    if found is not None:
                        known = found.value.get(host)
                    else:
                        known = None if column(batch, "seeds")[i].as_py() is None else tuple(column(batch, c)[i].as_py() for c in ("n_pages", "seeds", "slots"))
                    last = (host, [Wrapper(s).learn([x for x in known[2] if x["seed"] == k], known[0] - 1, least_same, most) for k, s in enumerate(known[1])] if known else [])
                texts.append(main_text(source_, last[1]))
            yield pa.RecordBatch.from_arrays([column(batch, "page_id"), column(batch, "url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return joined.sortWithinPartitions("host").mapInArrow(run, schema)
