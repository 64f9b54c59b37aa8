"""A forgiving HTML reader: element nodes in page order, their texts, and features of each node."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S
)
_CUT_TAG = re.compile(r"<[a-zA-Z/!?]")
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop|hidden|style|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Fixed values of HTML: elements without content, with raw text, never shown, and those that part blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head template select datalist object svg math audio video canvas noscript button dialog".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead tr ul".split()
)
#: A start tag of the key closes an open element of the values that is nearer than any of the stops.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"})}
CLOSES |= {"td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ENDS_P = BLOCK - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dt", "dd", "option", "optgroup", "legend"}

#: Words of tags, classes, ids and roles by what they tell; also those that begin with a word of five letters or more.
GROUPS = (
    frozenset("article content post entry story main body text prose hentry articlebody".split()),
    frozenset("nav navigation menu menubar breadcrumb breadcrumbs toc pagination pager skip".split()),
    frozenset("header footer masthead topbar bottom copyright colophon legal banner contentinfo branding".split()),
    frozenset("aside sidebar related recommended widget complementary rail trending popular teaser".split()),
    frozenset("ad ads advert adverts advertisement advertorial sponsor sponsored promo promotion promoted commercial affiliate".split()),
    frozenset("cookie cookies notice consent gdpr popup modal overlay alert alertdialog toast paywall warning disclaimer".split()),
    frozenset("comment comments reply replies discussion disqus respond reader readers feedback thread".split()),
    frozenset("form search subscribe subscription newsletter login signup register share sharing social contact input poll survey".split()),
)
_PREFIXES = [(w, g) for g, words in enumerate(GROUPS) for w in words if len(w) >= 5]
KINDS = ({"h1", "h2", "h3", "h4", "h5", "h6"}, {"p", "blockquote", "pre"}, {"ul", "ol", "li", "dl", "dt", "dd"}, {"table", "tr", "td", "th", "tbody"}, {"a"}, {"div", "section"}, {"input", "label", "fieldset", "button"})
_masks: dict[str, int] = {}


def group_mask(words: str) -> int:
    """Bits of GROUPS that a tag name or an attribute value speaks of."""
    if words not in _masks:
        if len(_masks) > 50_000:
            _masks.clear()
        out = 0
        for w in _WORDS.findall(words):
            w = w.lower()
            for g, group in enumerate(GROUPS):
                if w in group:
                    out |= 1 << g
            for prefix, g in _PREFIXES:
                if w.startswith(prefix):
                    out |= 1 << g
        _masks[words] = out
    return _masks[words]


@dataclass
class Page:
    """Nodes in page order (node 0 is the page). texts: (node, raw text) and (-1, '') where a block ends."""

    tag: list[str] = field(default_factory=lambda: ["html"])
    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    mask: list[int] = field(default_factory=lambda: [0])
    above: list[int] = field(default_factory=lambda: [0])
    end: list[int] = field(default_factory=lambda: [0])
    texts: list[tuple[int, str]] = field(default_factory=list)
    #: Nodes with the attribute that read() was told to look for.
    marked: list[bool] = field(default_factory=lambda: [False])


def read(html: str | None, mark: str = "") -> Page:
    page = Page()
    html = html or ""
    stack = [0]
    hidden = 0  # open elements that are not shown
    open_: Counter[str] = Counter()  # open elements by tag: looking for one that is not there would cost the whole stack
    texts = page.texts

    def pop() -> None:
        nonlocal hidden
        node = stack.pop()
        open_[page.tag[node]] -= 1
        page.end[node] = len(page.tag)
        if page.tag[node] in HIDDEN or page.depth[node] < 0:
            hidden -= 1
        if page.tag[node] in BLOCK:
            texts.append((-1, ""))

    at, size = 0, len(html)
    last = html.rfind(">") + 1  # no tag ends beyond, and one that begins there is cut off
    cut = _CUT_TAG.search(html, last)
    while at < size:
        m = TOKEN.search(html, at, last)
        to = m.start() if m else max(at, cut.start()) if cut else size
        if to > at and not hidden:
            texts.append((stack[-1], html[at:to]))
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name:
            if m[0].startswith("<!--") and not m[0].endswith(("-->", "--!>")):
                at = size
            continue
        name, close, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if close:
            for k in range(len(stack) - 1, 0, -1) if open_[name] > 0 else ():
                if page.tag[stack[k]] == name:
                    while len(stack) > k:
                        pop()
                    break
            continue
        if name in RAW:
            found = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, at)
            stop = found.start() if found else size
            rest = html.find(">", stop)
            at = size if rest < 0 else rest + 1
            continue
        if name in ("html", "body"):
            page.mask[0] |= group_mask(" ".join(v for a, *q in _ATTRIBUTE.findall(attributes) for v in q)) & 1 if attributes else 0
            continue
        if name in BLOCK:
            if name in ENDS_P and open_["p"] > 0:
                for k in range(len(stack) - 1, 0, -1):
                    if page.tag[stack[k]] == "p":
                        while len(stack) > k:
                            pop()
                        break
                    if page.tag[stack[k]] in ("td", "th", "caption"):
                        break
            texts.append((-1, ""))
        elif name == "br":
            texts.append((stack[-1], " "))
        if name in CLOSES:
            own, stops = CLOSES[name]
            while any(open_[t] > 0 for t in own) and (k := next((k for k in range(len(stack) - 1, 0, -1) if page.tag[stack[k]] in own | stops), 0)) and page.tag[stack[k]] in own:
                while len(stack) > k:
                    pop()
        if name in VOID and name != "input":
            continue
        mask, unseen = group_mask(name), False
        if attributes and not attributes.isspace():
            for a, x, y, z in _ATTRIBUTE.findall(attributes):
                a, value = a.lower(), x or y or z
                if a == "hidden" or a == "aria-hidden" and value == "true" or a == "style" and "display:none" in value.replace(" ", "").lower():
                    unseen = True
                elif a != "style":
                    mask |= group_mask(value)
        up = stack[-1]
        node = len(page.tag)
        page.tag.append(name)
        page.parent.append(up)
        page.depth.append(-page.depth[up] - 1 if unseen and page.depth[up] >= 0 else (abs(page.depth[up]) + 1))
        page.mask.append(mask)
        page.marked.append(bool(mark) and mark in attributes.split())
        page.above.append(page.above[up] | page.mask[up])
        page.end.append(node + 1)
        if name == "input":
            continue
        hidden += name in HIDDEN or page.depth[node] < 0
        open_[name] += 1
        stack.append(node)
    while stack:
        node = stack[-1]
        if node == 0:
            page.end[0] = len(page.tag)
            break
        pop()
    return page


FEATURES = 2 * len(GROUPS) + len(KINDS) + 17


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
    """Features [nodes, FEATURES] of all nodes of the pages laid end to end, and the first node of each page."""
    sizes = np.array([len(p.tag) for p in pages], np.int64)
    first = np.concatenate(([0], np.cumsum(sizes)))
    n = int(first[-1])
    parent = np.concatenate([np.array(p.parent) + f for p, f in zip(pages, first, strict=False)]) if n else np.zeros(0, np.int64)
    parent[first[:-1]] = first[:-1]
    end = np.concatenate([np.array(p.end) + f for p, f in zip(pages, first, strict=False)]) if n else np.zeros(0, np.int64)
    own = np.zeros((n, 3))  # characters, words, marks
    for p, f in zip(pages, first.tolist(), strict=False):
        for node, text in p.texts:
            if node >= 0:
                own[f + node, 0] += len(text)
                own[f + node, 1] += text.count(" ") + 1
                own[f + node, 2] += text.count(".") + text.count(",") + text.count("!") + text.count("?")
    kind = np.zeros((n, len(KINDS)), bool)
    names = np.array([t for p in pages for t in p.tag], object)
    for k, tags in enumerate(KINDS):
        kind[:, k] = [t in tags for t in names]
    mask = np.array([m for p in pages for m in p.mask], np.int64)
    above = np.array([m for p in pages for m in p.above], np.int64)
    depth = np.abs(np.array([d for p in pages for d in p.depth], np.float64))
    bits = np.arange(len(GROUPS))
    flags = np.concatenate((mask[:, None] >> bits & 1, above[:, None] >> bits & 1), axis=1)

    def below(values: np.ndarray) -> np.ndarray:
        run = np.concatenate((np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)))
        return run[end] - run[:n]

    links = np.zeros(n)
    anchor = np.flatnonzero(kind[:, 4])
    edge = np.zeros(n + 1)
    np.add.at(edge, anchor, 1)
    np.add.at(edge, end[anchor], -1)
    links = np.where(np.cumsum(edge[:-1]) > 0, own[:, 0], 0)
    text, words, marks = below(own).T
    link_text, nodes = below(links), below(np.ones(n))
    kinds = below(kind.astype(float))
    siblings = np.bincount(parent, minlength=n).astype(float)
    siblings[first[:-1]] -= 1
    nth = np.zeros(n)
    order = np.argsort(parent, kind="stable")
    nth[order] = np.arange(n) - np.searchsorted(parent[order], parent[order])
    among = np.maximum(siblings[parent], 1)
    whole = np.repeat(text[first[:-1]], sizes)
    x = [
        depth, np.log1p(text), link_text / np.maximum(text, 1), text / np.maximum(nodes, 1), marks / np.maximum(words, 1), text / np.maximum(whole, 1),
        np.log1p(kinds[:, 1]), kinds[:, 2] / np.maximum(nodes, 1), np.log1p(nodes), np.log1p(kinds[:, 6]), np.log1p(among), nth / among,
        text / np.maximum(text[parent], 1), text / np.maximum(text[parent] / among, 1), np.log1p(own[:, 0]), own[:, 0] / np.maximum(text, 1), kinds[:, 4] / np.maximum(nodes, 1),
    ]
    return np.column_stack((flags, kind, *x)), first
