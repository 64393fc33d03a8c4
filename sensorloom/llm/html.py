"""Main text of web pages by gradient-boosted trees over the nodes of the document tree.

A tolerant parser builds the tree of block elements; text between them forms text nodes, with
inline markup folded in. Every node is described by its tag, its and its ancestors' attribute
tokens, depth, sibling statistics, and the text, link and tag density of its subtree. Trees fitted
on generated pages give the chance that a node holds a part of the article. The choice is made for
the whole page at once: of all choices where a node is chosen just if some text in it is, the most
likely one, by dynamic programming; so no text is kept inside a dropped part, and no part for nothing.

Character references are decoded; white space inside a block becomes one space; blocks are
joined by an empty line.

Defined cases: a null or empty page, or one without text, gives an empty text; unclosed, crossed
and unknown tags are tolerated at any depth; repeated rows give equal texts; other columns pass
through ``annotate`` untouched.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbt
from .common import bounded
from .pages import training_pages

# Element names of the HTML standard.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math semantics mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup mover munder".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe svg head title textarea".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
TAGS = "#text p div section article main nav header footer aside form ul ol li h1 h2 h3 h4 table tr td th blockquote pre figure figcaption select option button fieldset dl dt dd address details body html noscript".split()
ABOVE = "article main nav header footer aside form ul ol table blockquote figure noscript".split()

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}


class Node:
    __slots__ = ("tag", "tokens", "parent", "kids", "text", "linked", "inner", "index", "depth", "size", "links", "tags", "paragraphs", "place", "alike")

    def __init__(self, tag: str, parent, tokens=()):
        self.tag, self.parent, self.tokens = tag, parent, tokens
        self.kids: list[Node] = []
        self.text, self.linked, self.inner, self.place, self.alike = "", 0, 0, 0, 1
        if parent is not None:
            parent.kids.append(self)


def parse(page: str | None) -> Node:
    """Root of the tree of block elements and text nodes."""
    root = Node("html", None)
    here, inline, pieces = root, [], []
    linked = inner = 0
    page, at = page or "", 0

    def flush():
        nonlocal pieces, linked, inner
        text = " ".join("".join(pieces).split())
        if text:
            node = Node("#text", here)
            node.text, node.linked, node.inner = text, min(linked, len(text)), inner
        pieces, linked, inner = [], 0, 0

    def leave(names, until):
        nonlocal here
        node = here
        while node is not root and node.tag not in until:
            if node.tag in names:
                flush()
                here = node.parent
                return
            node = node.parent

    while True:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            plain = entities.unescape(text)
            pieces.append(plain)
            if "a" in inline:
                linked += len(" ".join(plain.split()))
        if not m:
            break
        at = m.end()
        closing, tag = m[1], (m[2] or "").lower()
        if not tag:
            continue
        if tag in RAW:
            if not closing and not m[3].rstrip().endswith("/") and tag != "head":
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else len(page)
            elif tag == "head" and not closing:
                end = _RAW_END[tag].search(page, at) or re.compile(r"(?=<body\b)", re.I).search(page, at)
                at = end.end() if end else at
            continue
        if tag in INLINE:
            if tag == "br":
                pieces.append(" ")
            elif closing:
                if tag in inline:
                    del inline[len(inline) - 1 - inline[::-1].index(tag)]
            elif tag not in VOID:
                inline.append(tag)
            inner += 1
            continue
        flush()
        if tag in ("html", "body"):
            if not closing and tag == "body" and here is root:
                here = Node("body", root)
            continue
        if closing:
            node = here
            while node is not root and node.tag != tag:
                node = node.parent
            if node is not root:
                here = node.parent
                if tag not in ("p", "li"):
                    inline = []
            continue
        if tag in CLOSES_P:
            leave({"p"}, {"div", "td", "li", "blockquote", "section", "article", "body"})
        if tag in SAME:
            leave(SAME[tag], SCOPES[tag])
        if tag[0] == "h" and tag[1:].isdigit():
            leave({"h1", "h2", "h3", "h4", "h5", "h6"}, {"div", "section", "article", "body"})
        if tag in VOID:
            continue
        tokens = tuple(dict.fromkeys(w.lower() for a in _ATTR.finditer(m[3]) for w in _TOKEN.findall(a[1] or a[2] or a[3] or ""))) if m[3] else ()
        here = Node(tag, here, tokens)
        inline = [x for x in inline if x != "a"]
    flush()
    return root


def flat(root: Node) -> list[Node]:
    """Nodes in page order with their subtree sums; deep pages need no recursion."""
    nodes, todo = [], [root]
    while todo:
        node = todo.pop()
        node.index, node.depth = len(nodes), 0 if node.parent is None else node.parent.depth + 1
        nodes.append(node)
        todo.extend(reversed(node.kids))
        kinds: dict[str, int] = {}
        for k, kid in enumerate(node.kids):
            kid.place = k
            kinds[kid.tag] = kinds.get(kid.tag, 0) + 1
        for kid in node.kids:
            kid.alike = kinds[kid.tag]
    for node in nodes:
        node.size, node.links, node.tags, node.paragraphs = len(node.text), node.linked, node.inner + 1, int(node.tag == "p")
    for node in reversed(nodes):
        if node.parent is not None:
            up = node.parent
            up.size += node.size
            up.links += node.links
            up.tags += node.tags
            up.paragraphs += node.paragraphs
    return nodes


_TAG_AT = {t: i for i, t in enumerate(TAGS)}
_ABOVE_AT = {t: i for i, t in enumerate(ABOVE)}
NUMBERS = ["depth", "kids", "place", "siblings", "alike", "size", "links", "density", "left", "right", "up_links", "up_density", "paragraphs", "stops", "words"]


def describe(nodes: list[Node], vocabulary: dict[str, int]) -> np.ndarray:
    """A row per node: numbers, tag, tags above, own tokens, tokens above."""
    v = len(vocabulary)
    x = np.zeros((len(nodes), len(NUMBERS) + len(TAGS) + len(ABOVE) + 2 * v))
    tag_at, above_at = len(NUMBERS), len(NUMBERS) + len(TAGS)
    own_at, up_at = above_at + len(ABOVE), above_at + len(ABOVE) + v
    for i, n in enumerate(nodes):
        up = n.parent
        row = x[i]
        if up is not None:
            row[above_at:own_at] = x[up.index, above_at:own_at]
            row[up_at:] = np.maximum(x[up.index, up_at:], x[up.index, own_at:up_at])
            if up.tag in _ABOVE_AT:
                row[above_at + _ABOVE_AT[up.tag]] = 1
        else:
            up = n
        kids = up.kids
        k = len(kids)
        at = n.place
        left, right = kids[at - 1].size if at and k else 0, kids[at + 1].size if at + 1 < k else 0
        text = n.text
        row[: len(NUMBERS)] = (n.depth, len(n.kids), at / max(1, k - 1), k, n.alike, np.log1p(n.size), n.links / max(1, n.size), n.size / n.tags, np.log1p(left), np.log1p(right), up.links / max(1, up.size), up.size / up.tags, n.paragraphs, sum(map(text.count, ".!?")) / max(1, len(text) / 60), text.count(" ") + 1 if text else 0)
        if n.tag in _TAG_AT:
            row[tag_at + _TAG_AT[n.tag]] = 1
        for t in n.tokens:
            if t in vocabulary:
                row[own_at + vocabulary[t]] = 1
    return x


def choose(nodes: list[Node], chance: np.ndarray, none: float = 1.0) -> np.ndarray:
    """Most likely of the consistent choices: a node is chosen just if some text in it is.

    ``none`` is how likely it is beforehand that a page has no article at all.
    """
    yes, no = np.log(np.clip(chance, 1e-9, 1)), np.log(np.clip(1 - chance, 1e-9, 1))
    keep, drop = yes.copy(), no.copy()
    nearest = np.full(len(nodes), -np.inf)  # of each node, the least that keeping one of its children costs
    for i in range(len(nodes) - 1, -1, -1):
        node = nodes[i]
        if not node.text:
            keep[i] += min(0.0, nearest[i])
        if i:
            up = node.parent.index
            drop[up] += drop[i]
            keep[up] += max(keep[i], drop[i])
            nearest[up] = max(nearest[up], keep[i] - drop[i])
    chosen = np.zeros(len(nodes), bool)
    chosen[0] = keep[0] > drop[0] + np.log(none)
    for i, n in enumerate(nodes):
        if not chosen[i]:
            continue
        gains = [(keep[k.index] - drop[k.index], -k.index) for k in n.kids if np.isfinite(keep[k.index])]
        for gain, k in gains:
            chosen[-k] = gain > 0
        if gains and not n.text and max(gains)[0] <= 0:
            chosen[-max(gains)[1]] = True
    return chosen


class Extractor:
    def __init__(self, trees: gbt.Trees, vocabulary: dict[str, int], none: float):
        self.trees, self.vocabulary, self.none = trees, vocabulary, none

    def texts(self, pages: list[str | None]) -> list[str]:
        """Main texts of some pages, whose nodes are scored together."""
        forest = [flat(parse(p)) for p in pages]
        if not forest:
            return []
        chance = self.trees.chance(np.concatenate([describe(nodes, self.vocabulary) for nodes in forest]))
        out, at = [], 0
        for nodes in forest:
            chosen = choose(nodes, chance[at : at + len(nodes)], self.none)
            at += len(nodes)
            out.append("\n\n".join(n.text for n, c in zip(nodes, chosen, strict=True) if c and n.text))
        return out


def labelled(page: str, parts: set[str]) -> tuple[list[Node], np.ndarray]:
    """Nodes of a generated page, and whether each holds one of its article's blocks."""
    nodes = flat(parse(page))
    y = np.array([float(n.text in parts) if n.text else 0.0 for n in nodes])
    for i in range(len(nodes) - 1, 0, -1):
        up = nodes[i].parent.index
        y[up] = max(y[up], y[i])
    return nodes, y


@lru_cache(maxsize=2)
def trained(pages: int = 900, seed: int = 4, vocabulary_size: int = 60) -> Extractor:
    """The extractor, fitted on generated pages."""
    from collections import Counter

    made = [labelled(page, parts) for page, parts in training_pages(pages, seed)]
    seen = Counter(t for nodes, _ in made for n in nodes for t in n.tokens)
    vocabulary = {t: i for i, (t, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:vocabulary_size])}
    x = np.concatenate([describe(nodes, vocabulary) for nodes, _ in made])
    none = (sum(not y.any() for _, y in made) + 0.5) / (len(made) + 1)
    return Extractor(gbt.fit(x, np.concatenate([y for _, y in made])), vocabulary, none)


def annotate(pages: DataFrame, html: str = "html", out: str = "text", extractor: Extractor | None = None) -> DataFrame:
    """Adds the main text of every page."""
    bounded(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(extractor or trained())

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            rows, done = b.tolist(), []
            part, size = [], 0
            for i, p in enumerate(rows):
                part.append(p)
                size += len(p or "")
                if size > 1 << 20 or i == len(rows) - 1:
                    done += shared.value.texts(part)
                    part, size = [], 0
            yield pd.Series(done, dtype=object)

    return pages.withColumn(out, extract(F.col(html)))


def report(pages: DataFrame) -> DataFrame:
    """The digest of query op2."""
    return annotate(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
