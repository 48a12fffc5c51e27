"""Main text of web pages by minimum cut.

A page is read into blocks: runs of text between block-level tags, each with the elements it stands in. A
linear classifier gives each block a cost of being called content and one of being called boilerplate, from
those elements, the share of link text, length and punctuation; they are the block's capacities to the two
terminals. Blocks that follow one another, and blocks of one parent, are joined by edges that cost more to
cut the closer they stand in the tree. The minimum cut is the cheapest labelling; it is found by max-flow.
"""

from __future__ import annotations

import html
import re
from collections import deque
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybrook.llm import common as C

_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|!--|[!?/])")
_IN_TAG = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")

# Element names and the words of class and id names that tell parts of a page.
RAW = frozenset("script style noscript template textarea title iframe annotation annotation-xml select option datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTENT_TAGS = {"article": 4.0, "main": 2.0}
BOILER_TAGS = {"nav": 8.0, "footer": 8.0, "aside": 8.0, "form": 8.0, "menu": 8.0, "button": 8.0, "dialog": 8.0, "fieldset": 6.0, "header": 3.0, "head": 20.0, "label": 2.0, "address": 1.0}
BOILER_WORDS = frozenset(
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer discussion disqus dropdown footer foot gdpr header hidden login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup privacy promo promoted promotion recommended related replies reply respond response responses rail search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toc toolbar topbar warning widget".split()
)
#: Of these, the words that tell what a part is however much of the page it holds.
STICKY_WORDS = frozenset("ad ads adv advert advertisement advertising comment comments discussion disqus hidden related recommended replies reply respond response responses sponsor sponsored".split())
CONTENT_WORDS = frozenset("article body content entry main post story text".split())
ROLES = {"navigation": 8.0, "banner": 6.0, "contentinfo": 8.0, "complementary": 8.0, "search": 8.0, "form": 8.0, "dialog": 8.0, "alert": 6.0, "main": -2.0, "article": -4.0}
_BETWEEN = frozenset("address p dd dt li td th tr".split())
_CLOSES_P = BLOCK - {"body", "html", "head", "button"}
_SAME_KIND = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}


@dataclass(slots=True)
class Element:
    tag: str
    parent: Element | None
    depth: int
    own: float  # bias of its tag and attributes, without words of class and id names
    named: float  # bias of these words
    lifted: float  # the same if the element is a wrapper of most of the page
    chars: int = 0  # of text in it
    articles: int = 0  # article and main elements that it is or holds
    bias: float = 0.0  # content if negative; of it and of what it stands in


@dataclass(slots=True)
class Block:
    text: str
    element: Element
    heading: bool
    link_share: float


def _element(tag: str, attributes: str, parent: Element) -> Element:
    own, named, lifted = BOILER_TAGS.get(tag, 0.0) - CONTENT_TAGS.get(tag, 0.0), 0.0, 0.0
    if attributes and not attributes.isspace():
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
            if name in ("class", "id"):
                words = {w.lower() for w in _WORD.findall(value)}
                content = -2.0 if words & CONTENT_WORDS else 0.0
                if words & BOILER_WORDS and tag not in ("html", "body", "main"):
                    sticky = bool(words & STICKY_WORDS)
                    named += 12.0 if sticky else 6.0  # also within an article
                    lifted += 12.0 if sticky else content
                else:
                    named += content
                    lifted += content
            elif name == "role":
                own += ROLES.get(value.lower(), 0.0)
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                own += 12.0
    return Element(tag, parent, parent.depth + 1, own, named, lifted)


def _set_biases(elements: list[Element], found: list[Block]) -> None:
    """Biases of the elements, which are in document order.

    A class or id word doesn't tell boilerplate (STICKY_WORDS do) where its element holds over half of the page's
    text, and an article or main element if there are any: it names the page's layout.
    """
    for b in found:
        b.element.chars += len(b.text)
    for e in reversed(elements):
        e.articles += e.tag in CONTENT_TAGS
        if e.parent:
            e.parent.chars += e.chars
            e.parent.articles += e.articles
    root = elements[0]
    for e in elements[1:]:
        wraps = 2 * e.chars > root.chars and (e.articles > 0 or not root.articles)
        own, above = e.own + (e.lifted if wraps else e.named), e.parent.bias
        # What is boilerplate stays so inside: an article within comments is a comment.
        e.bias = above + own if own > 0 or above <= 0 else above


class _Markup:
    """The tags of a page, in order: (start, end, whether it ends an element, name, attributes); the name of a comment is empty.

    Each part of the page is read once, however damaged: what can't be found once is not sought again.
    """

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.quotes = {q: page.rfind(q) for q in "\"'"}
        self.never: set[str] = set()  # elements whose end stands nowhere after some place
        self.lower: str | None = None

    def _end(self, at: int) -> int:
        """The place of the tag's end; a quote that is never closed is a character like any other."""
        page = self.page
        while m := _IN_TAG.search(page, at):
            if m.group() == ">":
                return m.start()
            at = m.end()
            if m.start() < self.quotes[m.group()]:
                at = page.find(m.group(), at) + 1
        return -1

    def after(self, at: int):
        page = self.page
        while (m := _TAG.search(page, at)) and m.start() <= self.last:
            if m.group() == "<!--":
                end = page.find("-->", m.end())
                return m.start(), len(page) if end < 0 else end + 3, False, "", ""
            stop = self._end(m.end()) if m.group(2) else page.find(">", m.end())
            if stop < 0:  # all that is left stands in quotes: they are damaged
                self.quotes = dict.fromkeys(self.quotes, -1)
                stop = self._end(m.end())
            return m.start(), stop + 1, bool(m.group(1)), (m.group(2) or "").lower(), page[m.end() : stop]
        if m and m.group() == "<!--":
            return m.start(), len(page), False, "", ""
        return None

    def skip(self, tag: str, at: int) -> int:
        """The place after the end of an element whose content is no text; -1 if it has no end."""
        if tag in self.never:
            return -1
        if self.lower is None:
            self.lower = self.page.lower()
            if len(self.lower) != len(self.page):
                self.lower = self.page
        close = self.lower.find(f"</{tag}", at)
        if close < 0:
            self.never.add(tag)
            return -1
        end = self.page.find(">", close) if close < self.last else -1
        return end + 1 if end >= 0 else len(self.page)


def blocks(page: str) -> list[Block]:
    """The page's blocks of text, in order. Damaged markup is read as far as it goes, in time that grows with its length."""
    out: list[Block] = []
    root = Element("", None, 0, 0.0, 0.0, 0.0)
    stack, elements = [root], [root]
    open_: dict[str, int] = {}
    parts: list[str] = []
    linked, in_link, heading = 0, 0, False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, stack[-1], heading, linked / max(1, sum(map(len, parts)))))
            parts.clear()
        linked = 0

    def close(k: int) -> None:
        for e in stack[k:]:
            open_[e.tag] -= 1
        del stack[k:]

    at, end, markup = 0, len(page), _Markup(page)
    while at < end:
        found = markup.after(at)
        stop = found[0] if found else end
        if stop > at:
            parts.append(page[at:stop])
            linked += (stop - at) if in_link else 0
        if not found:
            break
        _, at, ends, tag, attributes = found
        if not tag:
            continue
        if ends:
            if tag == "a":
                in_link = max(0, in_link - 1)
            if tag not in BLOCK:
                continue
            flush()
            if open_.get(tag):
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            if tag[0] == "h" and tag[1:].isdigit():
                heading = False
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                after = markup.skip(tag, at)
                if after < 0 and tag in ("select", "option", "noscript", "datalist"):
                    continue  # never closed: its text is judged like any other
                at = after if after >= 0 else end
            parts.append(" ")
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "a":
            in_link = 1
            continue
        if tag not in BLOCK:
            continue
        flush()
        in_link = 0
        if tag in VOID:
            continue
        if tag in _CLOSES_P and stack[-1].tag == "p":
            close(len(stack) - 1)
        kinds = _SAME_KIND.get(tag, ())
        if any(open_.get(x) for x in kinds):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in kinds:
                    close(k)
                    break
                if stack[k].tag not in _BETWEEN:
                    break
        heading = tag[0] == "h" and tag[1:].isdigit()
        elements.append(_element(tag, attributes, stack[-1]))
        stack.append(elements[-1])
        open_[tag] = open_.get(tag, 0) + 1
    flush()
    _set_biases(elements, out)
    return out


def cost(block: Block) -> float:
    """Cost of content minus cost of boilerplate."""
    n = len(block.text)
    value = block.element.bias + 3.0 * block.link_share - 0.3
    if block.heading:
        value -= 0.5
    elif n >= 80:
        value -= 1.0 + min(1.0, n / 400)
    elif n >= 25 and block.text[-1:] in ".!?…»\"”":
        value -= 0.8
    elif n < 12:
        value += 0.2
    return value


def _nearness(a: Element, b: Element) -> float:
    """Weight of an edge: the fewer steps between two elements, the more."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
        if steps > 6:
            return 0.05
    return (2.0, 1.2, 1.0, 0.4, 0.3, 0.15, 0.1)[steps]


def minimum_cut(costs: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """For each node whether it is content: the labelling with the least sum of the costs of content nodes
    (negative: a gain) and of the edges between differing labels. Ties are boilerplate."""
    n = len(costs)
    source, sink = n, n + 1
    to, room, first = [], [], [[] for _ in range(n + 2)]

    def join(a: int, b: int, forth: int, back: int) -> None:
        first[a].append(len(to))
        to.append(b)
        room.append(forth)
        first[b].append(len(to))
        to.append(a)
        room.append(back)

    for k, c in enumerate(costs):
        if c < 0:
            join(source, k, -c, 0)
        elif c > 0:
            join(k, sink, c, 0)
    for a, b, w in edges:
        join(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            v = queue.popleft()
            for e in first[v]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        turn = [0] * (n + 2)
        path: list[int] = []
        v = source
        while True:
            if v == sink:
                least = min(room[e] for e in path)
                cut = len(path)
                for k in range(len(path) - 1, -1, -1):
                    e = path[k]
                    room[e] -= least
                    room[e ^ 1] += least
                    if not room[e]:
                        cut = k
                del path[cut:]
                v = to[path[-1]] if path else source
                continue
            own, moved = first[v], False
            while turn[v] < len(own):
                e = own[turn[v]]
                if room[e] and level[to[e]] == level[v] + 1:
                    path.append(e)
                    v = to[e]
                    moved = True
                    break
                turn[v] += 1
            if moved:
                continue
            if v == source:
                break
            level[v] = -1
            path.pop()
            v = to[path[-1]] if path else source


def main_text(page: str) -> str:
    """The blocks that are content, a line each."""
    found = blocks(page)
    if not found:
        return ""
    costs = [round(100 * cost(b)) for b in found]
    if all(c < 0 for c in costs):
        return "\n".join(b.text for b in found)
    if all(c >= 0 for c in costs):
        return ""
    edges, last = [], {}
    for k, b in enumerate(found):
        if k:
            edges.append((k - 1, k, round(100 * _nearness(found[k - 1].element, b.element))))
        parent = id(b.element.parent or b.element)
        if parent in last and last[parent] != k - 1:
            edges.append((last[parent], k, 50))
        last[parent] = k
    return "\n".join(b.text for b, keep in zip(found, minimum_cut(costs, edges), strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html).

    Null html is empty, and gives an empty text, as does a page without main text. Null ids and urls and
    repeated rows stay as they are; other columns are ignored. Pages of any length are read whole; the cut's time grows
    faster than a page's blocks (2.5 s for 16,000 of them). An empty table gives no rows.
    """

    def run(batches):
        for frame in batches:
            out = [main_text(x) for x in C.texts(frame["html"])]
            yield pd.DataFrame({"page_id": C.id_or_null(frame["page_id"]), "url": frame["url"], "text": out, "n_chars": [len(x) for x in out]})

    own = pages.select(C.id_column("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInPandas(run, "page_id long, url string, text string, n_chars long")
