"""Main text of web pages by wrappers: union-free regular expressions inferred for each host.

A page is a stream of block tags and text slots in which adjacent repetitions are folded into repeated groups. The
distinct streams of a host are aligned with one another, a few at a time in rounds of Spark groups, until one wrapper
accepts them all: what two have in common is kept, a group that one of them repeats is repeated, and what only one has
becomes optional. Neighbours that follow one another in no order, as in long texts, become a flow: a repeated group of
their kinds, each optional. Streams of a host with little in common stay apart, as wrappers of their own.

Every page is then matched against its wrapper, which gives each of its texts a slot, and Spark gathers for each slot on
how many different pages it occurs, how many different texts it has, how long they are and how much of them is links. By
these figures slots whose text stays the same from page to page, lists of links and repeated teasers are template. The
article is the innermost element of the wrapper that holds most of the varying prose, with the headings beside it; its
slots that are no template are the main text. Names of elements, classes and roles weigh in as prior knowledge: text inside ``article`` or ``main``
counts more, and menus, headers, footers, sidebars, notices, adverts, forms and comments by name are left out unless the
host has next to no other prose. A page that has none of the article's slots keeps its own slots that are no template.

Edge cases: null pages are empty and have no text; broken or cut markup is read as far as it goes; a page without host
has a wrapper for its own stream; streams of any length and depth are aligned; equal pages of a host count
once in the figures, and where fewer than PAGES pages differ nothing counts as unchanging; each row gives one row, and
nothing is cut off. Two wrappers become one if they have COMMON of the smaller one's nodes in common and the result is no
more than GROWTH times its largest page (or SMALL nodes), which bounds what a host of pages that all differ holds in memory;
when the rounds end no two wrappers of a host would.
"""

from __future__ import annotations

import hashlib
import html as entities
import itertools
import re
import sys
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialise, small_batches
from .url_rules import host_and_path

#: About so many wrappers of a host are aligned in one task in a round; so many are held against as many others in the end.
FAN, BLOCK = 16, 64
#: In so many rounds wrappers are dealt by different sketches of their labels; when all find nothing, all pairs are tried.
SKETCHES = 4
#: Longest group of neighbours that is looked for in repetitions.
PERIOD = 6
#: The share of the smaller one's nodes that two wrappers must have in common to become one.
COMMON = 0.5
#: Neighbours that nothing names, with so many for each of their kinds once repetitions are folded, are in no order.
LOOSE = 8
#: A wrapper has at most so many times the nodes of its largest page, or so many.
GROWTH, SMALL = 8, 1000
#: From so many pairs of neighbours on the best alignment is computed a row at a time, with the same result.
CELLS = 2000
#: Frames of Python's own that nested elements may take; they are on the heap.
FRAMES = 1 << 24
#: From so many different pages on a slot with a quarter as many texts as occurrences is template.
PAGES, CHANGES = 4, 4
#: The innermost element with this share of the prose is the article.
SHARE = 0.75
#: Weight of prose in ``article`` or ``main``; characters a page from which prose counts in spite of its element's name.
MAIN_WEIGHT, LONG = 8, 500

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^>\"']+|\"[^\"]*\"|'[^']*')*)>|<(?P<broken>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: A start tag ends open elements of these kinds.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "div", "article", "main", "section", "body", "select", "td", "th", "blockquote", "aside", "nav", "form"}
#: Elements, roles and words of class or id that are no main text; ``header`` only outside the article.
NOT_MAIN = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu"}
#: Elements whose text is not looked at.
NO_TEXT = {"script", "style", "noscript", "template", "svg", "textarea", "iframe", "object", "head", "title", "noembed", "noframes", "xmp", "canvas", "audio", "video"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"}
NAMES = set("nav navbar navigation menu footer sidebar aside ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended recommendations breadcrumb breadcrumbs comment comments commentlist respond replies disqus pagination pager toolbar skip".split())
MAIN = {"article", "main"}
#: Elements that hold lists; and those that are part of a text, never the article.
LISTS = {"ul", "ol", "dl", "menu", "table"}
PARTS_OF_TEXT = set("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption caption tr th legend summary ul ol dl".split())
_WORD = re.compile(r"[A-Za-z]+")



_NAME = re.compile(r"[^.#@]*")


def hash64(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def boilerplate(sign: str, inside: bool) -> str | None:
    """Whether an element is no main text by its "tag" or its "name"; ``inside``: it stands in an article."""
    name = _NAME.match(sign)[0]
    if name in NOT_MAIN or name in NO_TEXT or name == "header" and not inside:
        return "tag"
    if any(r in ROLES for r in re.findall(r"@([a-z]+)", sign)):
        return "tag"
    if name not in ("html", "body", "article", "main") and any(w.lower() in NAMES or w.lower() == "header" and not inside for w in _WORD.findall(sign[len(name) :])):
        return "name"
    return None


class Page:
    """A page's stream of symbols (``<sign``, ``</sign`` and ``#`` for text), and for each ``#`` its text, the number of
    its block and how many of its characters are links. Elements inside a line count only where their name is one of
    boilerplate; every element of the stream is closed."""

    def __init__(self, text: str):
        self.symbols: list[str] = []
        self.parts: list[list[str]] = []
        self.blocks: list[int] = []
        self.links: list[int] = []
        self.block = self.linked = self.silent = 0
        self.stack: list[tuple[str, str | None]] = []  # name, sign if it is in the stream
        self.open: Counter[str] = Counter()
        at, n = 0, len(text)
        low = None
        while at < n:
            lt = text.find("<", at)
            if lt < 0:
                self._text(text[at:])
                break
            m = _MARKUP.match(text, lt)
            if m is None:  # a < that begins no tag
                nxt = text.find("<", lt + 1)
                self._text(text[at : nxt if nxt > 0 else n])
                at = nxt if nxt > 0 else n
                continue
            if lt > at:
                self._text(text[at:lt])
            at = m.end()
            if name := m["end"]:
                self._end(name.lower())
            elif name := (m["start"] or m["broken"]):
                name = name.lower()
                self._start(name, m["attrs"] or "")
                if name in RAW and not (m["attrs"] or "").endswith("/"):
                    low = text.lower() if low is None and len(text.lower()) == n else (low or text)
                    end = low.find(f"</{name}", at)
                    at = n if end < 0 else end
        self._pop(0)

    @property
    def texts(self) -> list[str]:
        return ["".join(p) for p in self.parts]

    def _text(self, raw: str) -> None:
        if self.silent:
            return
        if self.symbols[-1:] != ["#"] or self.blocks[-1] != self.block:
            if not raw.strip():
                return
            self.symbols.append("#")
            self.parts.append([])
            self.blocks.append(self.block)
            self.links.append(0)
        clean = entities.unescape(raw)
        self.parts[-1].append(clean)
        if self.linked:
            self.links[-1] += len(clean)

    def _start(self, name: str, attrs: str) -> None:
        if name in BLOCKS:
            self.block += 1
            if name != "hr":
                self._close({"p"} if name not in CLOSES else CLOSES[name])
        marks = []
        for m in _ATTR.finditer(attrs):
            if (key := m[1].lower()) in ("class", "id", "role"):
                value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4]
                marks.append({"class": ".", "id": "#", "role": "@"}[key] + re.sub(r"[0-9]+", "0", re.sub(r"[\s/<>]+", ".", value.strip())))
        sign = name + "".join(sorted(marks))
        seen = name in BLOCKS or bool(boilerplate(sign, True))
        if name == "br":
            self._text(" ")
        if seen and not self.silent:
            self.symbols.append("<" + sign)
        if name in VOID or attrs.endswith("/"):
            if seen and not self.silent:
                self.symbols.append("</" + sign)
            return
        self.stack.append((name, sign if seen and not self.silent else None))
        self.open[name] += 1
        self.linked += name == "a"
        self.silent += name in NO_TEXT

    def _close(self, names: set) -> None:
        if not any(self.open[x] for x in names):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in names:
                return self._pop(i)
            if self.stack[i][0] in HOLDS:
                return

    def _end(self, name: str) -> None:
        if name in BLOCKS:
            self.block += 1
        if self.open[name]:
            i = len(self.stack) - 1
            while self.stack[i][0] != name:
                i -= 1
            self._pop(i)

    def _pop(self, to: int) -> None:
        while len(self.stack) > to:
            name, sign = self.stack.pop()
            self.open[name] -= 1
            self.linked -= name == "a"
            self.silent -= name in NO_TEXT
            if sign is not None:
                self.symbols.append("</" + sign)


class Node:
    """A part of a wrapper or a page: ``#`` for text, an element's sign, ``(`` for a group of parts that are repeated
    together, or ``~`` for a flow, a group whose parts are each optional. A wrapper is a list of nodes; read in order, their tags and texts are its union-free expression."""

    __slots__ = ("label", "repeated", "optional", "parts", "_below")

    def __init__(self, label: str, repeated: bool = False, optional: bool = False, parts: list[Node] | None = None):
        self.label, self.repeated, self.optional, self.parts, self._below = label, repeated, optional, parts or [], None

    @property
    def below(self) -> frozenset:
        """The labels of the two levels below."""
        if self._below is None:
            self._below = frozenset([*(x.label for x in self.parts), *((x.label, y.label) for x in self.parts for y in x.parts)])
        return self._below

    @property
    def plain(self) -> bool:
        """Whether its label alone says what it is."""
        return self.label == "#" or _NAME.match(self.label)[0] in PARTS_OF_TEXT

    def alike(self, other: Node) -> float:
        """From 0 for nodes that can't stand for each other to 1."""
        if self.label != other.label:
            return 0.0
        if self.plain:
            return 1.0
        either = self.below | other.below
        return 0.2 + 0.8 * (len(self.below & other.below) / len(either) if either else 1.0)


Wrapper = list[Node]
GROUPS = ("(", "~")


def read(symbols: list[str]) -> list[Node]:
    """The nodes of a stream."""
    stack = [Node("")]
    for s in symbols:
        if s == "#":
            stack[-1].parts.append(Node("#"))
        elif s.startswith("</"):
            stack.pop()
        else:
            stack[-1].parts.append(Node(s[1:]))
            stack.append(stack[-1].parts[-1])
    return stack[0].parts


def _same(a: Node, b: Node) -> bool:
    """Whether neighbours may be repetitions of one another."""
    return a.label == b.label and (a.plain or a.below == b.below)


def runs(nodes: list[Node]) -> list[tuple[int, int, int]]:
    """Where groups begin in ``nodes``, their length and how often they follow one another, longest runs first; elements
    that nothing names are repetitions from three on."""
    out, i, n = [], 0, len(nodes)
    while i < n:
        best = (1, 1)
        for p in range(1, min(PERIOD, (n - i) // 2) + 1):
            k = 1
            while i + (k + 1) * p <= n and all(_same(nodes[i + j], nodes[i + k * p + j]) for j in range(p)):
                k += 1
            named = p > 1 or nodes[i].plain or any(c in nodes[i].label for c in ".#@")
            if k > (1 if named else 2) and k * p > (best[0] * best[1] if best[1] > 1 else 1):
                best = (p, k)
        out.append((i, *best))
        i += best[0] * best[1]
    return out


def fold(nodes: list[Node]) -> Wrapper:
    """Nodes with repetitions as repeated nodes and groups."""
    nodes = [Node(x.label, x.repeated, x.optional, fold(x.parts)) if x.parts else x for x in nodes]
    out: Wrapper = []
    for i, p, k in runs(nodes):
        one = nodes[i : i + p]
        for j in range(1, k):
            one = [_both(x, y)[0] for x, y in zip(one, nodes[i + j * p : i + (j + 1) * p], strict=True)]
        if k > 1:
            one = [Node(one[0].label, True, one[0].optional, one[0].parts)] if p == 1 else [Node("(", True, False, one)]
        out += one
    return out


def _both(a: Node, b: Node) -> tuple[Node, int]:
    parts, common = align(a.parts, b.parts)
    return Node(a.label, a.repeated or b.repeated, a.optional or b.optional, parts), common + (a.label not in GROUPS)


def refold(w: list[Node], groups: list[Node]) -> list[tuple[Node, list[list[Node]]]]:
    """``w`` with single passages that are some group's as groups: each node, and the parts it is made of."""
    wanted = sorted({tuple(x.label for x in g.parts) for g in groups}, key=lambda t: (-len(t), t))
    out: list[tuple[Node, list[list[Node]]]] = []
    i = 0
    while i < len(w):
        size = next((len(t) for t in wanted if tuple(x.label for x in w[i : i + len(t)]) == t), 0)
        if size:
            part = w[i : i + size]
            if out and out[-1][0].label == "(" and len(out[-1][1]) and [x.label for x in out[-1][0].parts] == [x.label for x in part]:
                out[-1][1].append(part)
            else:
                out.append((Node("(", True, all(x.optional for x in part), part), [part]))
            i += size
        else:
            out.append((w[i], []))
            i += 1
    return out


def _merged(w: list[Node], groups: list[Node]) -> Wrapper:
    """``w`` refolded, with the passages of each group made one."""
    out = []
    for node, passages in refold(w, groups):
        for part in passages[1:]:
            node = Node("(", True, node.optional and all(x.optional for x in part), [_both(x, y)[0] for x, y in zip(node.parts, part, strict=True)])
        out.append(node)
    return out


def _pairs(x: list[Node], y: list[Node]) -> list[tuple[int, int]]:
    """Pairs of the greatest likeness in all, from a table of what can be had from each pair of places on."""
    likes = [[s.alike(t) for t in y] for s in x]
    best = [[0.0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for p in range(len(x) - 1, -1, -1):
        for q in range(len(y) - 1, -1, -1):
            best[p][q] = max(best[p + 1][q], best[p][q + 1], best[p + 1][q + 1] + likes[p][q])
    p, q, out = 0, 0, []
    while p < len(x) and q < len(y):
        if likes[p][q] and best[p][q] == best[p + 1][q + 1] + likes[p][q]:
            out.append((p, q))
            p, q = p + 1, q + 1
        elif best[p][q] == best[p + 1][q]:
            p += 1
        else:
            q += 1
    return out


def _pairs_by_rows(x: list[Node], y: list[Node]) -> list[tuple[int, int]]:
    """The same pairs, for long lists. Of the table's rows, which follow from the last one up, one in sixteen is kept on
    each of a few levels and those between are computed again, so that memory grows with the rows' width alone."""
    kinds: dict[tuple, int] = {}
    code = lambda nodes: np.array([kinds.setdefault((t.label, None if t.plain else t.below), len(kinds)) for t in nodes])
    xs, ys = code(x), code(y)
    samples = dict(zip(ys.tolist(), y, strict=True))
    named: dict[str, list[int]] = {}
    for k, t in samples.items():
        named.setdefault(t.label, []).append(k)

    @lru_cache(256)
    def likes(kind: int, first: int) -> np.ndarray:
        out = np.zeros(len(kinds))
        for k in named.get(x[first].label, ()):
            out[k] = x[first].alike(samples[k])
        return out[ys]

    firsts: dict[int, int] = {}
    for p, k in enumerate(xs.tolist()):
        firsts.setdefault(k, p)
    like = lambda p: likes(int(xs[p]), firsts[int(xs[p])])

    def above(row: np.ndarray, p: int) -> np.ndarray:
        out = np.zeros(len(row))
        np.maximum(row[:-1], row[1:] + like(p), out=out[:-1])
        return np.maximum.accumulate(out[::-1])[::-1]

    out: list[tuple[int, int]] = []

    def walk(lo: int, hi: int, last: np.ndarray, q: int) -> int:
        """Pairs of x from ``lo`` to ``hi``, whose row is ``last``, with y from ``q`` on."""
        if q == len(y):
            return q
        step = -(-(hi - lo) // 16)
        rows, row = {hi: last}, last
        for p in range(hi - 1, lo - 1, -1):
            row = above(row, p)
            if (p - lo) % step == 0:
                rows[p] = row
        for p in range(lo, hi, step):
            if step > 1:
                q = walk(p, min(p + step, hi), rows[min(p + step, hi)], q)
                continue
            a, b, near = rows[p], rows[p + 1], like(p)
            while q < len(y):
                if near[q] and a[q] == b[q + 1] + near[q]:
                    out.append((p, q))
                    q += 1
                    break
                if a[q] == b[q]:
                    break
                q += 1
        return q

    walk(0, len(x), np.zeros(len(y) + 1), 0)
    return out


def match(a: list[Node], b: list[Node]) -> list[tuple[int, int]]:
    """Pairs of nodes that stand for each other, in order, of the greatest likeness in all."""
    most, i, j = min(len(a), len(b)), 0, 0
    sure = lambda x, y: x.label == y.label and (x.plain or x.below == y.below)
    while i < most and sure(a[i], b[i]):
        i += 1
    while j < most - i and sure(a[-1 - j], b[-1 - j]):
        j += 1
    x, y = a[i : len(a) - j], b[i : len(b) - j]
    between = (_pairs if len(x) * len(y) < CELLS else _pairs_by_rows)(x, y) if x and y else []
    return [(t, t) for t in range(i)] + [(i + p, i + q) for p, q in between] + [(len(a) - t, len(b) - t) for t in range(j, 0, -1)]


def _kinds(nodes: list[Node]) -> list[str]:
    """Labels of nodes that may be part of a flow; for groups those of their parts."""
    inner = [y.label for x in nodes for y in (x.parts if x.label in GROUPS else (x,))]
    return [x for x in inner if x not in GROUPS and not any(c in x for c in ".#@")]


def _flow(nodes: list[Node]) -> Node:
    parts: dict[str, Node] = {}
    for x in nodes:
        for y in x.parts if x.label in GROUPS else (x,):
            parts[y.label] = Node(y.label, True, True, _both(parts[y.label], y)[0].parts if y.label in parts else y.parts)
    return Node("~", True, False, [parts[k] for k in sorted(parts)])


def _ends(a: list[Node], b: list[Node]) -> tuple[int, int]:
    """How many nodes have the same labels at the beginning and at the end, but for flows."""
    i, j, most = 0, 0, min(len(a), len(b))
    while i < most and a[i].label == b[i].label != "~":
        i += 1
    while j < most - i and a[-1 - j].label == b[-1 - j].label != "~":
        j += 1
    return i, j


def _stretches(nodes: list[Node], kinds: set[str]) -> list[tuple[bool, list[Node]]]:
    """Neighbours of these kinds together, as a flow, others alone."""
    out: list[tuple[bool, list[Node]]] = []
    for x in nodes:
        flows = x.label in kinds or x.label in GROUPS and all(y.label in kinds for y in x.parts)
        if flows and out and out[-1][0]:
            out[-1][1].append(x)
        else:
            out.append((flows, [x]))
    return out


def _loosened(a: list[Node], b: list[Node]) -> list[list[tuple[bool, list[Node]]]]:
    """Both lists in stretches between ends of the same labels; none if nothing flows."""
    i, j = _ends(a, b)
    middle = [w[i : len(w) - j] for w in (a, b)]
    kinds = {y.label for x in (*a, *b) if x.label == "~" for y in x.parts}
    if not kinds:
        if min(map(len, middle)) == 0 or max(map(len, middle)) < LOOSE:
            return []
        own = [_kinds(x) for x in middle]
        if not all(k and len(k) >= LOOSE * len(set(k)) for k in own):
            return []
        kinds = {*own[0], *own[1]}
    return [[(False, [t]) for t in w[:i]] + _stretches(mid, kinds) + [(False, [t]) for t in w[len(w) - j :]] for w, mid in zip((a, b), middle, strict=True)]


def align(a: list[Node], b: list[Node]) -> tuple[Wrapper, int]:
    """The wrapper of both, and how many nodes they have in common; of flows, as many as their labels allow."""
    if not a or not b:
        return [Node(x.label, x.repeated, True, x.parts) for x in (*a, *b)], 0
    groups = [x for x in (*a, *b) if x.label == "("]
    if groups:
        a, b = _merged(a, groups), _merged(b, groups)
    if loose := _loosened(a, b):
        a, b = ([_flow(x) if flows else x[0] for flows, x in w] for w in loose)
    out: Wrapper = []
    common = at = bt = 0
    for i, j in [*match(a, b), (len(a), len(b))]:
        out += [Node(x.label, x.repeated, True, x.parts) for x in (*a[at:i], *b[bt:j])]
        if i < len(a):
            one, n = _both(a[i], b[j])
            if one.label == "~":
                one, n = _flow([a[i], b[j]]), (labels(loose[0][i][1]) & labels(loose[1][j][1])).total()
                one.optional = a[i].optional or b[j].optional
            out.append(one)
            common += n
        at, bt = i + 1, j + 1
    return out, common


def labels(w: list[Node]) -> Counter[str]:
    """How many nodes of each label a wrapper has, groups not counted."""
    out: Counter[str] = Counter()
    left = [w]
    while left:
        for x in left.pop():
            out[x.label] += 1
            if x.parts:
                left.append(x.parts)
    for x in GROUPS:
        del out[x]
    return out


def sketch(counts: Counter[str]) -> list[int]:
    """For each sketch the least hash of the labels: wrappers that share most of their labels mostly share it."""
    return [min((hash64(str(i), x) for x in counts), default=0) for i in range(SKETCHES)]


def pack(w: list[Node]) -> str:
    """A wrapper as text: each node opens with + or 1, ? or 1, and its label, and ends with a bracket."""
    out: list[str] = []

    def go(nodes: list[Node]) -> None:
        for x in nodes:
            out.append(("+" if x.repeated else "1") + ("?" if x.optional else "1") + x.label)
            go(x.parts)
            out.append(">")

    go(w)
    return " ".join(out)


def unpack(text: str) -> Wrapper:
    stack = [Node("")]
    for t in text.split():
        if t == ">":
            stack.pop()
        else:
            stack[-1].parts.append(Node(t[2:], t[0] == "+", t[1] == "?"))
            stack.append(stack[-1].parts[-1])
    return stack[0].parts


def place(w: Wrapper, symbols: list[str]) -> list[int]:
    """The slot in ``w`` (its texts numbered in order) of each text of a stream, or -1."""
    first: dict[int, int] = {}  # of each node the number of its first slot
    n = 0

    def number(nodes: list[Node]) -> None:
        nonlocal n
        for x in nodes:
            first[id(x)] = n
            n += x.label == "#"
            number(x.parts)

    number(w)
    out: list[int] = []
    found: dict[int, int] = {}

    def go(page: list[Node], here: list[Node]) -> None:
        """``page`` may repeat what ``here`` repeats."""
        flowing: dict[int, list[Node]] = {}
        if any(x.label == "~" for x in here):
            i, j = _ends(page, here)
            between = []
            for flows, nodes in _stretches(page[i : len(page) - j], {y.label for x in here if x.label == "~" for y in x.parts}):
                between.append(_flow(nodes) if flows else nodes[0])
                if flows:
                    flowing[id(between[-1])] = nodes
            page = [*page[:i], *between, *page[len(page) - j :]]
        groups = [x for x in here if x.label == "("]
        seq = refold(page, groups) if groups else [(x, []) for x in page]
        # neighbours that are one repeated node in the wrapper
        many = {x.label for x in here if x.repeated}
        firsts: list[tuple[Node, list[tuple[Node, list[list[Node]]]]]] = []
        for node, passages in seq:
            if firsts and node.label in many and _same(firsts[-1][0], node):
                firsts[-1][1].append((node, passages))
            else:
                firsts.append((node, [(node, passages)]))
        for i, j in match([x for x, _ in firsts], here):
            for node, passages in firsts[i][1]:
                if node.label == "#":
                    found[id(node)] = first[id(here[j])]
                elif node.label == "~":
                    kinds = {x.label: x for x in here[j].parts}
                    for x in flowing[id(node)]:
                        if x.label == "#" and "#" in kinds:
                            found[id(x)] = first[id(kinds["#"])]
                        elif x.label in kinds:
                            go(x.parts, kinds[x.label].parts)
                elif node.label == "(":
                    for part in passages:
                        go(part, here[j].parts)
                else:
                    go(node.parts, here[j].parts)

    nodes = read(symbols)
    go(nodes, w)

    def collect(nodes: list[Node]) -> None:
        for x in nodes:
            if x.label == "#":
                out.append(found.get(id(x), -1))
            collect(x.parts)

    collect(nodes)
    return out


class Element(NamedTuple):
    """An element of a wrapper: the number of the one around it, its sign, whether it is in ``article`` or ``main``, what
    speaks against it ("tag" or "name"), whether it is in a list, and the repeated element of several texts it is in."""

    around: int
    sign: str
    inside: bool
    against: str | None
    listed: bool
    teaser: bool

    @property
    def name(self) -> str:
        return _NAME.match(self.sign)[0]


class Slot(NamedTuple):
    """A text's place in a wrapper: the number of its element, and whether it is repeated."""

    element: int
    repeated: bool


def _worse(a: str | None, b: str | None) -> str | None:
    return "tag" if "tag" in (a, b) else a or b


def tree_of(w: Wrapper) -> tuple[list[Element], list[Slot]]:
    """The elements of a wrapper, each behind the one around it, the root first; and its slots in order."""
    elements, slots = [Element(-1, "", False, None, False, False)], []

    def several(nodes: list[Node]) -> bool:
        """Whether there is more than one text."""
        n, left = 0, [nodes]
        while left and n < 2:
            for x in left.pop():
                n += x.label == "#"
                if x.parts:
                    left.append(x.parts)
        return n > 1

    def go(nodes: list[Node], at: int, repeated: bool) -> None:
        for x in nodes:
            if x.label == "#":
                slots.append(Slot(at, repeated or x.repeated))
            elif x.label in GROUPS:
                go(x.parts, at, True)
            else:
                around = elements[at]
                name = _NAME.match(x.label)[0]
                inside = around.inside or name in MAIN
                teaser = around.teaser or x.repeated and not x.plain and several(x.parts)
                elements.append(Element(at, x.label, inside, _worse(around.against, boilerplate(x.label, inside)), around.listed or name in LISTS, teaser))
                go(x.parts, len(elements) - 1, repeated or x.repeated)

    go(w, 0, False)
    return elements, slots


class Figures(NamedTuple):
    """Of a slot over all pages: different pages, different texts, different texts by page, characters, those in links."""

    pages: int = 0
    texts: int = 0
    pairs: int = 0
    chars: int = 0
    links: int = 0


def choose(elements: list[Element], slots: list[Slot], figures: dict[int, Figures]) -> tuple[list[bool], list[bool]]:
    """For each slot whether it is main text, and whether it is no template, which counts on pages without main text."""
    figs = [figures.get(i, Figures()) for i in range(len(slots))]
    template, prose = [], []
    for s, f in zip(slots, figs, strict=True):
        e = elements[s.element]
        same = f.pages >= PAGES and CHANGES * f.texts <= f.pairs and not e.inside
        template.append(same or 2 * f.links > f.chars and (e.listed or s.repeated))
        counts = not (template[-1] or e.against == "tag" or e.against == "name" and not (f.pages >= PAGES and f.chars >= LONG * f.pages))
        prose.append((f.chars - f.links) * (MAIN_WEIGHT if e.inside else 1) * (0.1 if e.against else 1) * (0.2 if e.teaser and not e.inside else 1) if counts else 0.0)
    spare = [not t and elements[s.element].against is None for s, t in zip(slots, template, strict=True)]
    total = sum(prose)
    if not total:
        return spare, spare
    mass = [0.0] * len(elements)
    for s, x in zip(slots, prose, strict=True):
        mass[s.element] += x
    for i in range(len(elements) - 1, 0, -1):
        mass[elements[i].around] += mass[i]
    way = [slots[max(range(len(slots)), key=prose.__getitem__)].element]
    while way[-1]:
        way.append(elements[way[-1]].around)
    article = 0
    for i in way[-2::-1]:  # from the outside to the slot with most prose
        if elements[i].name in PARTS_OF_TEXT or elements[article].name in MAIN or mass[i] < SHARE * total:
            break
        article = i
    # what has only headings and paragraphs beside it, as under a title, is not the whole
    beside: dict[int, list[int]] = {}
    for i, e in enumerate(elements):
        beside.setdefault(e.around, []).append(i)
    while article and elements[article].name not in MAIN and all(i == article or elements[i].name in PARTS_OF_TEXT - LISTS for i in beside[elements[article].around]):
        article = elements[article].around
    # in the article, and nothing below it speaks against
    under, against = [article == 0], [None]
    for i, e in enumerate(elements[1:], 1):
        under.append(i == article or under[e.around])
        against.append(_worse(against[e.around], boilerplate(e.sign, e.inside)) if under[e.around] else None)
    main = [under[s.element] and against[s.element] is None and not t for s, t in zip(slots, template, strict=True)]
    # repeated elements of several texts below the article: sections, if most of the text is theirs, else comments, teasers
    teaser = [elements[s.element].teaser and not elements[s.element].inside and not elements[article].teaser for s in slots]
    chars = lambda want: sum(f.chars for f, m, t in zip(figs, main, teaser, strict=True) if m and t == want)
    if chars(True) < chars(False):
        main = [m and not t for m, t in zip(main, teaser, strict=True)]
    return main, spare


def text_of(texts: list[str], blocks: list[int], kept: list[bool]) -> str:
    """Blocks of main text in page order, white space as one space, joined by line breaks."""
    out: list[list[str]] = []
    last = None
    for t, b, k in zip(texts, blocks, kept, strict=True):
        if b != last:
            out.append([])
            last = b
        if k:
            out[-1].append(t)
    return "\n".join(x for parts in out if (x := " ".join("".join(parts).split())))


_PARSED = pa.schema([("skey", pa.int64()), ("page", pa.int64()), ("stream", pa.string()), ("key", pa.int64()), ("wrapper", pa.string()), ("nodes", pa.int64()), ("marks", pa.list_(pa.int64())), ("texts", pa.list_(pa.string())), ("blocks", pa.list_(pa.int32())), ("chars", pa.list_(pa.int32())), ("links", pa.list_(pa.int32())), ("hashes", pa.list_(pa.int64()))])
PARSED = "host string, skey long, page long, stream string, key long, wrapper string, nodes long, marks array<long>, texts array<string>, blocks array<int>, chars array<int>, links array<int>, hashes array<long>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages read once: texts with their figures, and the key of host and stream; where a stream is first met in a task
    also the stream itself, folded as a first wrapper, that one's key, number of nodes and sketches."""
    sys.setrecursionlimit(FRAMES)
    seen: set[int] = set()
    for batch in batches:
        rows = []
        for host, page in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            p = Page(page or "")
            stream = " ".join(p.symbols)
            skey = hash64(host, stream)
            first = (None,) * 5
            if skey not in seen:
                seen.add(skey)
                w = fold(read(p.symbols))
                folded, counts = pack(w), labels(w)
                first = (stream, hash64(host, folded) if host else skey, folded, counts.total(), sketch(counts))
            texts = p.texts
            hashes = [hash64(" ".join(t.split())) for t in texts]
            rows.append((skey, hash64(*map(str, hashes)), *first, texts, p.blocks, list(map(len, texts)), p.links, hashes))
        if rows:
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PARSED.types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *cols], names=["page_id", "url", "host", *_PARSED.names])


class Candidate(NamedTuple):
    """A wrapper on its way: its text, how many nodes it has of each label, and how many its largest page has."""

    text: str
    counts: Counter[str]
    nodes: int


def _ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(["wrapper", "key"], key=lambda c: c.str.len() if c.name == "wrapper" else c, ascending=[False, True])


def together(a: Candidate, b: Candidate) -> Candidate | None:
    """The wrapper of both, if they have enough in common. What they have in common is no more than their labels tell, which
    mostly settles it."""
    small, shared = min(a.counts.total(), b.counts.total()), (a.counts & b.counts).total()
    nodes = max(a.nodes, b.nodes)
    if shared < COMMON * small or a.counts.total() + b.counts.total() - shared > max(GROWTH * nodes, SMALL):
        return None
    w, common = align(unpack(a.text), unpack(b.text))
    return Candidate(pack(w), labels(w), nodes) if common >= COMMON * small else None


def _candidates(pdf: pd.DataFrame) -> list[Candidate]:
    sys.setrecursionlimit(FRAMES)
    return [Candidate(t, labels(unpack(t)), n) for t, n in zip(pdf["wrapper"].tolist(), pdf["nodes"].tolist(), strict=True)]


def _merge(key, pdf):
    """Wrappers of some streams or wrappers of a host: (host, key, to, wrapper, nodes, marks), the last three on one row of
    each wrapper."""
    rows = _ordered(pdf)
    found: dict[int, Candidate] = {}
    to = []
    for k, one in zip(rows["key"].tolist(), _candidates(rows), strict=True):
        for name, have in found.items():
            if (both := together(have, one)) is not None:
                found[name] = both
                to.append(name)
                break
        else:
            found[k] = one
            to.append(k)
    out = [(h, k, t, found[k].text, found[k].nodes, sketch(found[k].counts)) if k == t else (h, k, t, None, None, None) for h, k, t in zip(rows["host"], rows["key"].tolist(), to, strict=True)]
    return pd.DataFrame(out, columns=["host", "key", "to", "wrapper", "nodes", "marks"]).astype({"nodes": "Int64"})


def _links(key, pdf):
    """(a, b) for the wrappers of two blocks of a host, or of one, that would become one."""
    rows = _ordered(pdf)
    known = list(zip(rows["key"].tolist(), rows["block"].tolist(), _candidates(rows), strict=True))
    pairs = ((a, b) for (a, i, x), (b, j, y) in itertools.combinations(known, 2) if (i != j or key[1] == key[2]) and together(x, y) is not None)
    return pd.DataFrame(list(pairs), columns=["a", "b"], dtype="int64")


def _pairs_of_blocks(now: DataFrame, sizes: DataFrame) -> DataFrame:
    """(a, b): those of a host with more wrappers than a task aligns that would still become one."""
    n = F.ceil(F.col("n") / BLOCK)
    dealt = now.join(sizes.filter(F.col("n") > FAN), "host").select("host", "key", "wrapper", "nodes", F.pmod(F.xxhash64("key"), n).alias("block"), F.explode(F.sequence(F.lit(0), n - 1)).alias("other"))
    return dealt.groupBy("host", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).applyInPandas(_links, "a long, b long")


def infer(streams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From the distinct streams (host, skey, key, wrapper, nodes, marks), each folded as a first wrapper: which wrapper
    each has in the end (skey, key), and the wrappers (key, wrapper).

    A host of few wrappers is one part. Of others those go to one part that share a sketch, a different one each round;
    when all sketches find nothing, blocks of wrappers meet block by block, and what would still become one does."""
    route, now = streams.select("skey", "key"), streams.select("host", "key", "wrapper", "nodes", "marks").dropDuplicates(["key"])
    active = None

    def settle(parts: DataFrame) -> DataFrame | None:
        """Merge each part; the hosts in which something did."""
        nonlocal route, now
        merged = materialise(parts.groupBy("host", "part").applyInPandas(_merge, "host string, key long, to long, wrapper string, nodes long, marks array<long>"), "merged")
        moved = merged.filter("key <> to").select("host", "key", "to")
        if moved.isEmpty():
            return None
        now = now.join(merged.select("key"), "key", "left_anti").unionByName(merged.filter("wrapper IS NOT NULL").select("host", "key", "wrapper", "nodes", "marks"))
        route = route.join(moved.select("key", "to"), "key", "left").select("skey", F.coalesce("to", "key").alias("key"))
        return moved.select("host").distinct()

    sizes = lambda: now.filter("host <> ''").groupBy("host").agg(F.count("*").alias("n")).filter("n > 1")
    turn = quiet = 0
    while quiet < SKETCHES:
        some = now.join(sizes(), "host")
        if turn:  # hosts of one part are done once nothing moves
            some = some.filter(F.col("n") > FAN) if active is None else some.join(active.withColumn("again", F.lit(True)), "host", "left").filter(F.col("again") | (F.col("n") > FAN))
        some = some.withColumn("mark", F.when(F.col("n") <= FAN, 0).otherwise(F.element_at("marks", turn % SKETCHES + 1)))
        many = some.groupBy("host", "mark").agg(F.count("*").alias("m")).filter("m > 1")
        dealt = some.join(many, ["host", "mark"]).withColumn("part", F.struct("mark", F.pmod(F.xxhash64("key", F.lit(turn)), F.ceil(F.col("m") / FAN)).alias("nth")))
        active = settle(dealt.select("host", "part", "key", "wrapper", "nodes"))
        turn, quiet = turn + 1, 0 if active is not None else quiet + 1
        if quiet and sizes().filter(F.col("n") > FAN).isEmpty():
            break
    while quiet == SKETCHES:
        links = materialise(_pairs_of_blocks(now, sizes()), "links")
        if links.isEmpty():
            break
        # each goes to the least of those it would become one with: so do all that the least of all has links to
        ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("key")).agg(F.min("b").alias("b"))
        settle(now.join(ends, "key").select("host", F.least("key", "b").alias("part"), "key", "wrapper", "nodes"))
    return route, now.select("key", "wrapper")


def _plain(symbols: list[str]) -> list[bool]:
    """Of each text of a stream whether nothing around it speaks against it."""
    elements, slots = tree_of(read(symbols))
    return [elements[s.element].against is None for s in slots]


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slots of each stream's texts in its wrapper, and what a text without a slot is by its path alone."""
    sys.setrecursionlimit(FRAMES)
    last, w = None, []
    for batch in batches:
        rows = []
        for stream, wrapper in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if wrapper != last:
                last, w = wrapper, unpack(wrapper)
            symbols = stream.split(" ") if stream else []
            rows.append((place(w, symbols), _plain(symbols)))
        if rows:
            a, b = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(a, pa.list_(pa.int32())), pa.array(b, pa.list_(pa.bool_()))], names=["skey", "key", "slots", "plain"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pages that differ (key, slots, hashes, chars, links): (key, slot, hash, pages, pairs, chars, links) of each batch.
    A page counts for a slot with the first of its texts there, and as a pair with each text that differs."""
    names = ["key", "slot", "hash", "pages", "pairs", "chars", "links"]
    for batch in batches:
        n = np.array([len(x) for x in batch.column(1)], dtype=np.int64)
        cols = [batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in range(1, 5)]
        all_texts = pd.DataFrame({"row": np.repeat(np.arange(len(n)), n), "key": np.repeat(batch.column(0).to_numpy(), n), **dict(zip(["slot", "hash", "chars", "links"], cols, strict=True))})
        one = all_texts[all_texts["slot"] >= 0].groupby(["row", "key", "slot", "hash"], as_index=False).sum()
        one["pages"] = (~one.duplicated(["row", "slot"])).astype("int64")
        one["pairs"] = 1
        out = one.groupby(["key", "slot", "hash"], as_index=False)[["pages", "pairs", "chars", "links"]].sum()
        yield pa.RecordBatch.from_arrays([pa.array(out[c].to_numpy(), pa.int32() if c == "slot" else pa.int64()) for c in names], names=names)


def gather(texts: DataFrame) -> DataFrame:
    """(key, slot, pages, texts, pairs, chars, links) from the pages that differ (key, slots, hashes, chars, links), exactly:
    rows meet by text first, so that what leaves a task is a row for each text that differs there."""
    counted = texts.mapInArrow(_count, "key long, slot int, hash long, pages long, pairs long, chars long, links long")
    sums = lambda *names: [F.sum(c).alias(c) for c in names]
    return counted.groupBy("key", "slot", "hash").agg(*sums("pages", "pairs", "chars", "links")).groupBy("key", "slot").agg(F.count("*").alias("texts"), *sums("pages", "pairs", "chars", "links"))


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sys.setrecursionlimit(FRAMES)
    for batch in batches:
        rows = []
        for wrapper, figures in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            rows.append(choose(*tree_of(unpack(wrapper)), {f["slot"]: Figures(*(f[c] for c in Figures._fields)) for f in figures or ()}))
        if rows:
            a, b = zip(*rows, strict=True)
            kind = pa.list_(pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a, kind), pa.array(b, kind)], names=["key", "main", "spare"])


def decide(parsed: DataFrame, route: DataFrame, wrappers: DataFrame) -> DataFrame:
    """(skey, kept): for each stream which of its texts are main text."""
    streams = parsed.filter("stream IS NOT NULL").select("skey", "stream").dropDuplicates(["skey"])
    wrappers = materialise(wrappers, "wrappers")
    placed = streams.join(route, "skey").join(wrappers, "key").select("skey", "key", "stream", "wrapper").mapInArrow(_slots, "skey long, key long, slots array<int>, plain array<boolean>")
    placed = materialise(placed, "slots")
    differ = parsed.select("skey", "page", "hashes", "chars", "links").groupBy("skey", "page").agg(F.min(F.struct("hashes", "chars", "links")).alias("t"))
    figures = gather(differ.join(placed.select("skey", "key", "slots"), "skey").select("key", "slots", "t.hashes", "t.chars", "t.links"))
    # as many entries as the wrapper has slots
    figures = figures.groupBy("key").agg(F.collect_list(F.struct("slot", *Figures._fields)).alias("figures"))
    chosen = materialise(wrappers.join(figures, "key", "left").select("key", "wrapper", "figures").mapInArrow(_choose, "key long, main array<boolean>, spare array<boolean>"), "chosen")
    flag = lambda have: F.zip_with("slots", "plain", lambda s, p: F.when(s >= 0, F.try_element_at(have, s + 1)).otherwise(p))
    both = placed.join(chosen, "key").select("skey", flag(F.col("main")).alias("main"), flag(F.col("spare")).alias("spare"))
    return both.select("skey", F.when(F.exists("main", lambda x: x), F.col("main")).otherwise(F.col("spare")).alias("kept"))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text."""
    small_batches(pages.sparkSession)
    host, _ = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).alias("html"))
    kind = pages.schema[id_col].dataType.simpleString()
    parsed = materialise(rows.mapInArrow(_parse, f"page_id {kind}, url string, {PARSED}"), "parsed", "zstd")
    route, wrappers = infer(parsed.filter("stream IS NOT NULL").select("host", "skey", "key", "wrapper", "nodes", "marks").dropDuplicates(["skey"]))
    kept = materialise(decide(parsed, route, wrappers), "kept")
    joined = parsed.select("page_id", "url", "skey", "texts", "blocks").join(kept, "skey").select("page_id", "url", "texts", "blocks", "kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_of(*row) for row in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return joined.mapInArrow(run, f"page_id {kind}, url string, text string")
