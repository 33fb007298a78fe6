"""Main text of web pages by minimum-cut labelling.

A page is parsed into blocks of text. A linear classifier over tags, names, link density and prose gives every block a
capacity to the content terminal or to the boilerplate terminal; neighbouring blocks are tied by capacities that grow
with their proximity in the document tree. The minimum cut labels all blocks at once. Pages are independent, so the
job is one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without text of their own, elements that end a block, and elements and names of boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template svg math title iframe object canvas audio video map".split())
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead tr ul".split())
BAD_TAGS = frozenset("nav footer aside form button select textarea menu dialog fieldset".split())
GOOD_TAGS = frozenset("article main".split())
BAD_NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side footer masthead header topbar toolbar cookie cookies consent gdpr notice notices alert disclaimer popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations trending comment comments reply replies respond disqus discussion pagination pager widget tags copyright".split())
GOOD_NAMES = frozenset("article content main post story entry body text articlebody maincontent".split())
#: Parts of names of boilerplate, wherever they stand in a name; "commentary" is none.
BAD_STEMS = re.compile("comment(?!ar)|footer|sidebar|newsletter|cookie|advert|sponsor|breadcrumb|disqus|navbar|masthead|pagination|toolbar|subscri")
HEAD_TAGS = frozenset("base basefont bgsound link meta title script style noscript template".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Marked sections that the parser knows, by what ends them: ``]]>`` or ``]>``.
_SECTION = re.compile(r"<!\[(?:(cdata|temp|ignore|include|rcdata)|if|else|endif)(?![-_.a-z0-9])", re.IGNORECASE)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_ENDS = re.compile(r"[.!?…。！？][\"'”’)\]]*$")


class Block:
    """A run of text between block boundaries: its words, its place in the tree and what the classifier looks at.

    ``depth`` is the number of open elements, ``shared`` how many of them the block before has too, ``parent`` the
    element around the one that holds the text.
    """

    __slots__ = ("text", "depth", "shared", "parent", "linked", "bad", "good", "tag")

    def __init__(self, text: str, depth: int, shared: int, parent: int, linked: int, bad: int, good: int, tag: str):
        self.text, self.depth, self.shared, self.parent, self.linked, self.bad, self.good, self.tag = text, depth, shared, parent, linked, bad, good, tag


def _bad_name(names: set[str]) -> bool:
    return bool(names & BAD_NAMES) or any(BAD_STEMS.search(n) for n in names)


class _Page(HTMLParser):
    """Blocks of a page in one pass. Open elements are a stack, and each knows the nearest block element around it, so
    that the work grows with the page, however deeply and badly it is nested. Comments and sections that never end are
    text, and their end is looked for once."""

    def __init__(self, dropped: frozenset[str] = DROPPED) -> None:
        super().__init__(convert_charrefs=True)
        self.without = dropped
        self.blocks: list[Block] = []
        self.open: list[tuple[str, int, int, int, int]] = [("", 0, 0, 0, 0)]  # tag, number, bad, good, place of the nearest block element
        self.names: Counter[str] = Counter()
        self.inner: Counter[str] = Counter()  # elements that are open inside a dropped one
        self.parts: list[str] = []
        self.linked = self.in_link = self.count = 0
        self.dropped = False
        self.unclosed: set[str] = set()  # dropped elements that ended with one around them, or not at all
        self.low = 1  # the smallest height of the stack since the last block
        self.endless: set[str] = set()  # kinds of markup whose end does not come any more

    def parse_comment(self, i: int, report: bool = True) -> int:
        return self.once("comment", super().parse_comment, i, report)

    def parse_marked_section(self, i: int, report: bool = True) -> int:
        known = _SECTION.match(self.rawdata, i)
        if not known:  # browsers end any other one at the next bracket
            return self.rawdata.find(">", i) + 1 or -1
        return self.once("section" if known[1] else "condition", super().parse_marked_section, i, report)

    def once(self, kind: str, parse: Callable[[int, bool], int], i: int, report: bool) -> int:
        """What ``parse`` gives, or -1 without another look where an earlier one of the kind has no end."""
        end = -1 if kind in self.endless else parse(i, report)
        if end < 0:
            self.endless.add(kind)
        return end

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            _, _, bad, good, block = self.open[-1]
            parent = self.open[-2][1] if len(self.open) > 1 else -1
            self.blocks.append(Block(text, len(self.open), self.low, parent, min(self.linked, len(text)), bad, good, self.open[block][0]))
            self.low = len(self.open)
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.dropped:
            self.inner[tag] += tag not in VOID
            return
        if tag == "br":
            self.parts.append(" ")
        if self.names["head"] and tag not in HEAD_TAGS:
            self.close_tag("head")  # its end tag may be left out
        if tag in VOID:
            if tag == "hr":
                self.flush()
            return
        if tag in BLOCKS or tag == "head":
            self.flush()
            if tag not in ("html", "body", "head"):
                nearest = self.open[-1][4]
                if self.open[nearest][0] in (*CLOSED_BY.get(tag, ()), "p"):
                    self.cut(nearest)
        _, _, bad, good, block = self.open[-1]
        names = {n.lower() for k, v in attrs if k in ("class", "id") and v for n in _NAME.findall(v)}
        role = next((v for k, v in attrs if k == "role" and v), "").lower()
        inside = good > 0
        bad += (tag in BAD_TAGS) + (tag == "header" and not inside) + 2 * (tag == "head") + (role in BAD_ROLES)
        bad += _bad_name(names) and not (tag in GOOD_TAGS or tag in ("html", "body") or (tag in ("header", "h1") and inside))
        bad += any(k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and v and "display:none" in v.replace(" ", "").lower()) for k, v in attrs)
        good += (tag in GOOD_TAGS) + bool(names & GOOD_NAMES) + (role in ("main", "article"))
        self.count += 1
        self.open.append((tag, self.count, bad, good, len(self.open) if tag in BLOCKS else block))
        self.names[tag] += 1
        if tag in self.without:
            self.dropped = True
            self.inner.clear()
        elif tag == "a":
            self.in_link += 1

    def cut(self, i: int) -> None:
        for tag, *_ in self.open[i:]:
            self.in_link -= tag == "a"
            self.names[tag] -= 1
        del self.open[i:]
        self.low = min(self.low, len(self.open))

    def close_tag(self, tag: str) -> None:
        if self.names[tag]:
            self.cut(next(i for i in range(len(self.open) - 1, 0, -1) if self.open[i][0] == tag))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.dropped:
            return
        self.handle_starttag(tag, attrs)
        if tag not in VOID and (tag not in self.without or tag in ("svg", "math")):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.dropped:
            if self.inner[tag]:
                self.inner[tag] -= 1
                return
            if not self.names[tag]:
                return
            self.dropped = False
            if tag != self.open[-1][0]:
                self.unclosed.add(self.open[-1][0])
        if tag in BLOCKS:
            self.flush()
        self.close_tag(tag)

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.parts.append(data)
            if self.in_link:
                self.linked += len(data.strip())


def blocks(html: str) -> list[Block]:
    """The blocks of text of a page in order. An element without text of its own that never closes, other than a script,
    a style or a title, is read as if it had text: it must not swallow the page. No tag can end behind the last ``>``;
    what stands there is text."""
    dropped = DROPPED
    last = html.rfind(">") + 1
    html = html[:last] + html[last:].replace("<", "&lt;")
    while True:
        page = _Page(dropped)
        page.feed(html)
        page.close()
        page.flush()
        again = (page.unclosed | ({page.open[-1][0]} if page.dropped else set())) - {"script", "style", "title"}
        if not again:
            return page.blocks
        dropped -= again


def cost(b: Block, article: bool) -> float:
    """The classifier: positive for content, negative for boilerplate. ``article``: the page has an article element."""
    words = b.text.count(" ") + 1
    score = 0.4 * min(words, 20) / 20 + (0.8 if _ENDS.search(b.text) else -0.2)
    score += 0.6 * (b.tag in ("p", "pre", "blockquote")) + 0.3 * (b.tag in ("h1", "h2", "h3", "h4", "h5", "h6"))
    score -= 3.0 * (b.linked / len(b.text)) ** 2
    score -= 6.0 * min(b.bad, 2)
    score += 2.5 * min(b.good, 2) if b.good else (-2.0 if article else 0.0)
    return score - 0.3


def ties(page: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: between neighbours, by how much of their path in the tree they share, and between neighbouring
    blocks of one parent."""
    out, last = [], {}
    for j, b in enumerate(page):
        if j:
            out.append((j - 1, j, 0.8 / (1 + page[j - 1].depth + b.depth - 2 * b.shared)))
        i = last.get(b.parent)
        if i is not None and i < j - 1:
            out.append((i, j, 0.3))
        last[b.parent] = j
    return out


def min_cut(score: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The side of the content terminal in a minimum cut: terminal capacities max(0, score) and max(0, -score).

    A node whose terminal outweighs all its edges is on that side in every minimum cut; such nodes are settled first
    and what they add to their neighbours' terminals is carried over. A maximum flow by shortest augmenting paths, level
    by level, solves the rest.
    """
    n = len(score)
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for i, j, w in edges:
        near[i].append((j, w))
        near[j].append((i, w))
    score, side = list(score), [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if side[i] is None and abs(score[i]) >= sum(w for j, w in near[i] if side[j] is None):
            side[i] = score[i] > 0
            for j, w in near[i]:
                if side[j] is None:
                    score[j] += w if side[i] else -w
                    queue.append(j)
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        reached = _max_flow({i: max(0.0, score[i]) for i in rest}, {i: max(0.0, -score[i]) for i in rest}, {i: [(j, w) for j, w in near[i] if side[j] is None] for i in rest})
        for i in rest:
            side[i] = i in reached
    return side


def _max_flow(source: dict[int, float], sink: dict[int, float], near: dict[int, list[tuple[int, float]]]) -> set[int]:
    """The nodes that the source terminal (-1) still reaches when no flow to the other (-2) can be added."""
    flow: dict[int, dict[int, float]] = {-1: dict(source), -2: dict.fromkeys(sink, 0.0)}
    for i, own in near.items():
        flow[i] = {-1: 0.0, -2: sink[i]}
        for j, w in own:
            flow[i][j] = flow[i].get(j, 0.0) + w
    least = 1e-9
    while True:
        level, todo = {-1: 0}, deque([-1])
        while todo:
            i = todo.popleft()
            for j, room in flow[i].items():
                if room > least and j not in level:
                    level[j] = level[i] + 1
                    todo.append(j)
        if -2 not in level:
            return {i for i in level if i >= 0}
        arcs = {i: [*flow[i]] for i in level}
        at, path = dict.fromkeys(level, 0), [-1]
        while path:
            i = path[-1]
            if i == -2:
                steps = list(zip(path, path[1:], strict=False))
                push = min(flow[a][b] for a, b in steps)
                for a, b in steps:
                    flow[a][b] -= push
                    flow[b][a] += push
                del path[next(k for k, (a, b) in enumerate(steps) if flow[a][b] <= least) + 1 :]
            elif at[i] == len(arcs[i]):  # a dead end of this round
                path.pop()
                if path:
                    at[path[-1]] += 1
            elif flow[i][j := arcs[i][at[i]]] > least and level.get(j) == level[i] + 1:
                path.append(j)
            else:
                at[i] += 1


def main_text(html: str | None) -> str:
    """The content blocks of a page in order, joined by two line feeds."""
    page = blocks(html) if html else []
    if not page:
        return ""
    article = any(b.good for b in page)
    keep = min_cut([cost(b, article) for b in page], ties(page))
    return "\n\n".join(b.text for b, k in zip(page, keep, strict=True) if k)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without ``html_col`` and with text and n_chars (its code points).

    Null, empty and contentless pages have an empty text; a page of any length is read whole, in time and memory that
    grow with it, and an empty table gives an empty result. White space inside a block is one blank, character
    references are decoded. Columns of ``pages`` named text or n_chars are replaced; repeated rows are kept.
    """
    own = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column("__html")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*own, "text", "n_chars"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pages.schema if f.name in own)
    return pages.select(*own, F.col(html_col).cast("string").alias("__html")).mapInArrow(run, fields + "text string, n_chars long")
