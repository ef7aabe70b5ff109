"""Pages as trees of block nodes, with the features that the main-text model looks at."""

from __future__ import annotations

import html as markup
import re
from collections import Counter
from functools import cache

import numpy as np

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</([A-Za-z][^\s/>]*)[^>]*>|<([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)>", re.S)
_LAST = re.compile(r"<!--.*()()", re.S)  # a comment that nothing ends
_NAMES = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_PART = re.compile(r"[a-z]+")

# Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template title textarea iframe xmp".split())
DROPPED = frozenset("noscript svg object select button annotation annotation-xml".split())
ALONE = frozenset("noscript select button".split())  # a second start ends the first
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mtd semantics".split())
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
OUTER = CLOSES_P - {"p"} | {"body", "html"}  # their ends close what is open in them
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tbody", "tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
FENCES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}

# Tags and name parts that are features of their own.
TAGS = "article main nav header footer aside form section div p h1 h2 h3 ul ol li table td blockquote pre figure span".split()
WORDS = (
    "article content main post entry story body text page wrapper container row "
    "nav menu header masthead footer sidebar side aside rail ad ads advert sponsor sponsored banner promo "
    "notice alert cookie consent popup modal comment comments reply respond discussion share social related recommended "
    "widget breadcrumb breadcrumbs tags meta form search login signup subscribe newsletter copyright legal caption toolbar pagination "
    "navigation contentinfo complementary top topbar bottom toc"
).split()
_TAG_AT = {t: i for i, t in enumerate(TAGS)}
_WORD_AT = {w: i for i, w in enumerate(WORDS)}
NUMBERS = ("depth", "index", "later", "siblings", "chars", "share", "tags", "density", "links", "own", "stops", "same", "near", "parent_links", "p_children", "before")
WIDTH = len(NUMBERS) + 2 * len(TAGS) + 2 * len(WORDS)


def dropped_ends(source: str) -> dict[int, int]:
    """Start tags of dropped elements that their own end tag closes -> where that ends. Others are open by mistake."""
    ends: dict[int, int] = {}
    if not _DROP.search(source):
        return ends
    stack: list[tuple[str, int]] = []  # "" in place of one that was taken out
    places: dict[str, list[int]] = {}
    at, last = 0, source.rfind(">")
    while at <= last and (found := _TOKEN.search(source, at)):
        at = found.end()
        tag = (found[1] or found[2] or "").lower()
        if found[2] and tag in RAW:
            shut = _shut_raw(tag).search(source, at)
            at = shut.end() if shut else len(source)
        elif tag not in DROPPED and tag not in OUTER:
            continue
        elif found[2]:
            if found[3].endswith("/") and tag == "svg":
                continue
            own = places.setdefault(tag, [])
            if tag in ALONE and own:
                stack[own.pop()] = ("", 0)
            own.append(len(stack))
            stack.append((tag, found.start()))
        elif places.get(tag):
            k = places[tag][-1]
            if tag in DROPPED:
                ends[stack[k][1]] = at
            for t, _ in reversed(stack[k:]):
                if t:
                    places[t].pop()
            del stack[k:]
    return ends


_DROP = re.compile(r"<(?:noscript|svg|object|select|button|annotation)", re.I)


@cache
def _shut_raw(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\s*>", re.I)


class Node:
    __slots__ = ("tag", "parent", "depth", "words", "chars", "own", "link", "stops", "tags", "children", "inline")

    def __init__(self, tag: str, parent: int, depth: int, words: frozenset, inline: bool):
        self.tag, self.parent, self.depth, self.words, self.inline = tag, parent, depth, words, inline
        self.chars = self.own = self.link = self.stops = 0
        self.tags = 1
        self.children: list[int] = []


class Open:
    """Open elements, innermost last, with the places of each tag, so that no question walks through them."""

    def __init__(self):
        self.tags, self.nodes, self.blocks, self.places = ["#"], [0], [0], {}

    def push(self, tag: str, node: int) -> None:
        self.places.setdefault(tag, []).append(len(self.tags))
        self.tags.append(tag)
        self.nodes.append(node)
        self.blocks.append(self.blocks[-1] + (tag not in INLINE))

    def inner(self, tag: str) -> int:
        """Place of the innermost open ``tag``, 0 if there is none."""
        return self.places[tag][-1] if self.places.get(tag) else 0

    def count(self, tag: str) -> int:
        return len(self.places.get(tag, ()))

    def shut(self, place: int) -> None:
        """Close the element at ``place`` and all in it."""
        for tag in reversed(self.tags[place:]):
            self.places[tag].pop()
        del self.tags[place:], self.nodes[place:], self.blocks[place:]

    def shut_inner(self, tags: set, fences: set) -> None:
        """Close the innermost open elements of ``tags`` that stand one in another, unless a fence is further in."""
        fence = max(map(self.inner, fences), default=0)
        while (place := max(map(self.inner, tags))) and place > fence:
            self.shut(place)
            if self.tags[-1] not in tags:
                return


class Page:
    """``nodes`` in page order, and ``texts`` as (node, text); a node of -1 marks the end of a block."""

    def __init__(self, source: str):
        self.nodes = [Node("#", -1, 0, frozenset(), False)]
        self.texts: list[tuple[int, str]] = []
        self._read(source)
        for i in range(len(self.nodes) - 1, 0, -1):
            n, up = self.nodes[i], self.nodes[self.nodes[i].parent]
            up.chars, up.link, up.stops, up.tags = up.chars + n.chars, up.link + n.link, up.stops + n.stops, up.tags + n.tags

    def _read(self, source: str) -> None:
        open_ = Open()
        at, links, size, last = 0, 0, len(source), source.rfind(">")
        ends = dropped_ends(source)
        no_head_end = False
        while at < size:
            found = (_TOKEN if at <= last else _LAST).search(source, at)  # behind the last > no tag ends
            self._text(source[at : found.start() if found else size], open_.nodes[-1], links)
            if not found:
                break
            at = found.end()
            if found[1]:
                tag = found[1].lower()
                if depth := open_.inner(tag):
                    if tag in INLINE and open_.blocks[-1] > open_.blocks[depth]:
                        continue  # an inline end does not end the blocks in it
                    before = open_.count("a")
                    open_.shut(depth)
                    links -= before - open_.count("a")
                if tag not in INLINE:
                    self._end()
                elif tag == "a":
                    links = max(links, 0)
            elif found[2]:
                tag = found[2].lower()
                if tag in DROPPED:
                    at = ends.get(found.start(), at)
                    self._end()
                    continue
                if tag == "head" and no_head_end:
                    continue
                if tag in RAW or tag == "head":
                    shut = _shut_raw(tag).search(source, at)
                    if tag == "head" and not shut:
                        no_head_end = True
                        continue
                    at = size if not shut else shut.end()
                    if tag not in INLINE:
                        self._end()
                    continue
                if tag in VOID:
                    self._text(" ", open_.nodes[-1], 0)
                    if tag == "hr":
                        self._end()
                    continue
                if tag in CLOSES_P:
                    open_.shut_inner({"p"}, {"td", "th", "table", "li", "div", "article", "section"})
                if tag in SIBLINGS:
                    open_.shut_inner(SIBLINGS[tag], FENCES.get(tag, {"table"}))
                links = open_.count("a") if tag not in INLINE else links + (tag == "a")
                inline = tag in INLINE
                words = frozenset(w for m in _NAMES.finditer(found[3] or "") for w in _PART.findall(m[1].lower())) if found[3] else frozenset()
                if not inline or words and tag in ("span", "a", "small", "label"):
                    up = open_.nodes[-1]
                    self.nodes[up].children.append(len(self.nodes))
                    self.nodes.append(Node(tag, up, self.nodes[up].depth + 1, words, inline))
                    node = len(self.nodes) - 1
                    if not inline:
                        self._end()
                else:
                    node = open_.nodes[-1]
                if not found[3].endswith("/") or not inline:
                    open_.push(tag, node)
        self._end()

    def _end(self) -> None:
        if self.texts and self.texts[-1][0] >= 0:
            self.texts.append((-1, ""))

    def _text(self, raw: str, node: int, links: int) -> None:
        if not raw:
            return
        text = markup.unescape(raw) if "&" in raw else raw
        self.texts.append((node, text))
        n = self.nodes[node]
        size = len(text) if not text.isspace() else 0
        n.chars += size
        n.own += size
        n.link += size if links else 0
        n.stops += text.count(".") + text.count(",")

    def features(self) -> np.ndarray:
        """A row for each node."""
        nodes = self.nodes
        out = np.zeros((len(nodes), WIDTH), np.float32)
        whole = max(1, nodes[0].chars)
        tags, words = len(NUMBERS), len(NUMBERS) + 2 * len(TAGS)
        numbers, before = [], 0
        place = [0] * len(nodes)
        kinds = [Counter(nodes[c].tag for c in n.children) for n in nodes]
        for n in nodes:
            for k, c in enumerate(n.children):
                place[c] = k
        for i, n in enumerate(nodes):
            up = nodes[n.parent] if n.parent >= 0 else n
            around = len(up.children)
            others = max(1, around - 1)
            numbers.append((
                n.depth, place[i], around - place[i], around, np.log1p(n.chars), n.chars / whole, np.log1p(n.tags), n.chars / n.tags, n.link / max(1, n.chars), np.log1p(n.own), n.stops / max(1, n.chars),
                kinds[max(0, n.parent)][n.tag], np.log1p((up.chars - n.chars) / others), up.link / max(1, up.chars), kinds[i]["p"], before / whole,
            ))
            before += n.own
            if i and (t := _TAG_AT.get(n.tag)) is not None:
                out[i, tags + t] = 1
            for w in n.words:
                if (k := _WORD_AT.get(w)) is not None:
                    out[i, words + k] = 1
            if n.parent > 0:  # what stands above
                p = n.parent
                t, w = tags + len(TAGS), words + len(WORDS)
                out[i, t : t + len(TAGS)] = np.maximum(out[p, tags:t], out[p, t : t + len(TAGS)])
                out[i, w : w + len(WORDS)] = np.maximum(out[p, words:w], out[p, w : w + len(WORDS)])
        out[:, : len(NUMBERS)] = numbers
        return out

    def decode(self, p: np.ndarray, start: float = 1.0, stop: float = 1.2) -> np.ndarray:
        """Kept nodes: the most likely choice in which nothing under a dropped node of the main text is kept.

        Above the main text a node is outside; below an outside node main text may begin, at a cost; below a main-text
        node children are main text or, at a cost, dropped; all under a dropped node is dropped.
        """
        yes, no = np.log(np.clip(p, 1e-6, 1)), np.log(np.clip(1 - p, 1e-6, 1))
        n = len(self.nodes)
        dropped, main, outside = no.copy(), yes.copy(), no.copy()
        for i in range(n - 1, 0, -1):
            up = self.nodes[i].parent
            dropped[up] += dropped[i]
            main[up] += max(main[i], dropped[i] - stop)
            outside[up] += max(outside[i], main[i] - start, dropped[i])
        kept = np.zeros(n, bool)
        state = ["outside"] * n
        for i in range(1, n):
            above = state[self.nodes[i].parent]
            if above == "main":
                state[i] = "main" if main[i] > dropped[i] - stop else "dropped"
            elif above == "outside":
                state[i] = "main" if main[i] - start > max(outside[i], dropped[i]) else "outside" if outside[i] > dropped[i] else "dropped"
            else:
                state[i] = "dropped"
            kept[i] = state[i] == "main"
        return kept

    def text(self, kept: np.ndarray) -> str:
        """Blocks of kept nodes in page order, white space folded."""
        blocks, now = [], []
        for node, text in self.texts:
            if node < 0:
                if block := " ".join("".join(now).split()):
                    blocks.append(block)
                now = []
            elif kept[node]:
                now.append(text)
        return "\n".join(blocks)
