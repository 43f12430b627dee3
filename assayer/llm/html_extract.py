"""Main text of HTML pages by boosted trees over DOM nodes.

A node's label says whether its subtree holds main text. Gradient-boosted trees
give each node a probability from its own subtree (density of text, links and
controls), its attribute tokens, its depth and its siblings. Hierarchical decoding
then picks the likeliest consistent labelling: below a rejected node nothing is
kept, so ancestors and descendants never contradict each other.

The trees are fitted by ``pyspark.ml`` on pages drawn from layout rules with known
labels, ``TRAIN_PAGES`` of them.
"""

from __future__ import annotations

import html
import math
import random
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from assayer.llm._common import map_rows

TRAIN_PAGES = 400
AT_ONCE = 64  # pages whose nodes are scored together

# Elements by their part in the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol option p pre search section select summary"
    " table tbody td textarea tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - frozenset("body html button option select td th tr tbody thead tfoot caption".split())
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
TAGS = "p div section article main nav header footer aside form ul li table h1 h2 h3 figure blockquote span a".split()
# Words of class, id and role names that the drawn training pages use.
TOKENS = {
    "main": "article articlebody body content entry main post story text prose page",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs",
    "ad": "ad ads advert advertisement adsense sponsor sponsored promo promotion banner dfp",
    "comment": "comment comments reply replies discussion disqus respond thread",
    "side": "aside sidebar side related widget recommended trending popular more teaser",
    "foot": "footer foot copyright legal colophon",
    "head": "header masthead logo topbar branding site hero",
    "form": "form search login signup subscribe newsletter register contact",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay warning message",
    "share": "share social sharing follow meta tags byline author date",
}
TOKENS_KEPT = 5_000  # attribute words whose weight is learned, at most
SEEN = 3  # nodes that a word must mark to get a weight

#: Comments, declarations and tags. Outside quotes a tag ends before the next "<", so a failed one costs its own length.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^<>]*>|<\?[^<>]*>"
    r"|<(/?)([A-Za-z][^\s/<>]*)(?:((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|([^<>]*+)>)",
    re.S,
)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")
SPACE = re.compile(r"\s+")


LINK, CONTROL = -1, -2  # parts of a node that are counted only


class Node:
    __slots__ = ("attrs", "children", "depth", "parent", "parts", "tag")

    def __init__(self, tag: str, parent: int, depth: int, attrs: str) -> None:
        self.tag, self.parent, self.depth, self.attrs = tag, parent, depth, attrs
        self.children: list[int] = []
        self.parts: list[str | int] = []  # own text, children and marks, in order


class Open:
    """Open elements from the root down, with the places of each tag, so that none is searched for."""

    def __init__(self) -> None:
        self.tags = ["html"]
        self.node = [0]  # block that each is in
        self.places: dict[str, list[int]] = {"html": [0]}
        self.blocks = [0]

    def push(self, tag: str, node: int) -> None:
        self.places.setdefault(tag, []).append(len(self.tags))
        if tag in BLOCK:
            self.blocks.append(len(self.tags))
        self.tags.append(tag)
        self.node.append(node)

    def close(self, to: int) -> None:
        while len(self.tags) > to:
            self.places[self.tags.pop()].pop()
            self.node.pop()
            if self.blocks[-1] == len(self.tags):
                self.blocks.pop()

    def last(self, tags: set[str] | frozenset[str]) -> int:
        """Place of the innermost of these, -1 if none is open."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    def end(self, tag: str) -> None:
        """An end tag closes the innermost element of its name; that of an inline element stays in its block."""
        place = self.last(HEADINGS if tag in HEADINGS else {tag})
        if place > 0 and (tag in BLOCK or place > self.blocks[-1]):
            self.close(place)

    def begin(self, tag: str) -> None:
        """Close what a start tag ends by itself."""
        if tag in CLOSES_P and self.blocks[-1] and self.tags[self.blocks[-1]] == "p":
            self.close(self.blocks[-1])
        if tag in CLOSED_BY:
            closes, until = CLOSED_BY[tag]
            bound = max(0, self.last(until))
            inside = [p[k] for t in closes if (p := self.places.get(t)) and (k := bisect_right(p, bound)) < len(p)]
            if inside:
                self.close(min(inside) if tag == "tr" else self.last(closes))


def parse(page: str) -> list[Node]:
    """Block elements of a page in document order; inline elements melt into their block. Linear in the page."""
    nodes = [Node("html", -1, 0, "")]
    open_, unclosed = Open(), set()
    at, end = 0, len(page)

    def text(a: int, b: int) -> None:
        if b > a:
            nodes[open_.node[-1]].parts.append(html.unescape(page[a:b]))

    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            text(at, end)
            break
        text(at, m.start())
        at = m.end()
        name = m[2]
        if not name:
            continue
        tag, attrs = name.lower(), m[3] if m[3] is not None else m[4]
        if m[1]:
            open_.end(tag)
            continue
        if tag in RAW or tag == "title":
            stop = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if stop is None:
                unclosed.add(tag)
            at = stop.end() if stop else (end if tag in ("script", "style", "title") else at)
            continue
        if tag == "br" or tag == "hr":
            nodes[open_.node[-1]].parts.append(" ")
        if tag in VOID or tag in ("html", "head"):
            continue
        if tag == "body":
            nodes[0].attrs += attrs
            continue
        open_.begin(tag)
        block = open_.node[-1]
        if tag in BLOCK:
            n = len(nodes)
            nodes.append(Node(tag, block, nodes[block].depth + 1, attrs))
            nodes[block].children.append(n)
            nodes[block].parts.append(n)
            open_.push(tag, n)
        else:
            if tag == "a":
                nodes[block].parts.append(LINK)
            if tag in ("input", "label"):
                nodes[block].parts.append(CONTROL)
            if not attrs.rstrip().endswith("/"):
                open_.push(tag, block)
    return nodes


def attribute_words(attrs: str) -> list[str]:
    """The words in class, id and role."""
    found = []
    for m in NAMED.finditer(attrs):
        found += [w.lower() for w in SPLIT.split(m[1] or m[2] or m[3] or "") if w]
    return found


def word_weights(nodes: list[Node], labels: list[bool]) -> dict[str, float]:
    """Weight of evidence of each attribute word: how much likelier it is on nodes with main text than on others."""
    seen: dict[str, list[int]] = {}
    for x, y in zip(nodes, labels, strict=True):
        for w in set(attribute_words(x.attrs)):
            seen.setdefault(w, [0, 0])[y] += 1
    yes = max(1, sum(labels))
    no = max(1, len(labels) - yes)
    often = sorted((w for w, n in seen.items() if sum(n) >= SEEN), key=lambda w: (-sum(seen[w]), w))[:TOKENS_KEPT]
    return {w: math.log((seen[w][1] + 0.5) / (yes + 1)) - math.log((seen[w][0] + 0.5) / (no + 1)) for w in often}


WITHIN = {t: 1 << i for i, t in enumerate("nav header footer aside form article main".split())}
TAG_AT = {t: i for i, t in enumerate(TAGS)}
CONTROLS = frozenset("button select textarea option fieldset".split())


def node_rows(nodes: list[Node], weights: dict[str, float]) -> list[list[float]]:
    """Plain numbers of each node; ``features`` makes columns of them."""
    own, marks, above, within = [], [], [], []
    for x in nodes:
        text = " ".join([p for p in x.parts if p.__class__ is str])
        row = [0.0, 0.0, 0.0, float(x.tag in CONTROLS), 0.0, 0.0, 0.0, 0.0]
        if text and not text.isspace():
            words = len(text.split())
            ends = text.count(".") + text.count("!") + text.count("?")
            row = [len(text), words, x.parts.count(LINK), row[3] + x.parts.count(CONTROL), ends, text.count(","), x.tag == "p", "©" in text]
        own.append(row)
        known = [weights[w] for w in attribute_words(x.attrs) if w in weights] if x.attrs else []
        marks.append([sum(known), min(known, default=0.0), max(known, default=0.0)])
        p = x.parent
        within.append(within[p] | WITHIN.get(nodes[p].tag, 0) if p >= 0 else 0)
        above.append([min(above[p][0], marks[p][1]), max(above[p][1], marks[p][2])] if p >= 0 else [0.0, 0.0])
    total, blocks, height = [r[:] for r in own], [1] * len(nodes), [0] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[i].parent
        total[p] = [a + b for a, b in zip(total[p], total[i], strict=True)]
        blocks[p] += blocks[i]
        height[p] = max(height[p], height[i] + 1)
    out: list[list[float]] = [[]] * len(nodes)
    page = total[0][0] or 1

    def put(i: int, sib: list[float]) -> None:
        x = nodes[i]
        out[i] = [*total[i], own[i][0], blocks[i], height[i], x.depth, *marks[i], *above[i], within[i], TAG_AT.get(x.tag, -1), *sib]

    put(0, [1, 0, 1, 1, 1, 0, 0, 0])
    for x in nodes:
        c = x.children
        if not c:
            continue
        chars = [total[i][0] for i in c]
        most, middle, same = max(chars) or 1, sorted(chars)[len(chars) // 2], {}
        for i in c:
            same[nodes[i].tag] = same.get(nodes[i].tag, 0) + 1
        for k, i in enumerate(c):
            put(i, [len(c), k / len(c), same[nodes[i].tag] / len(c), chars[k] / page, chars[k] / most, middle, chars[k + 1] if k + 1 < len(c) else 0, nodes[i].tag in HEADINGS])
    return out


def features(rows: list[list[float]]) -> np.ndarray:
    """One row a node: subtree, attribute, depth and sibling statistics."""
    x = np.array(rows, np.float64)
    ratio = lambda a, b: (x[:, a] / np.maximum(1, x[:, b]))[:, None]
    within = (x[:, 17].astype(np.int64)[:, None] >> np.arange(len(WITHIN))) & 1
    tag = x[:, 18].astype(np.int64)[:, None] == np.arange(len(TAGS))
    return np.column_stack(
        [
            np.log1p(x[:, [0, 1, 8]]), ratio(0, 9), ratio(2, 1), x[:, [2, 3]], ratio(4, 1), ratio(5, 1), x[:, [6, 7]],
            ratio(0, 1), x[:, 9:17], x[:, 19:25], np.log1p(x[:, [25]]), x[:, [26]], within, tag,
        ]
    )


class Trees:
    """Fitted trees as arrays: all trees walk all rows at once."""

    def __init__(self, trees: list[str], weights: list[float], words: dict[str, float]) -> None:
        self.words = words  # attribute words and what they say
        self.nodes: list[list[float]] = []  # feature, threshold, left, right, prediction
        self.roots = [self._read(iter([x.strip() for x in t.splitlines()[1:] if x.strip()])) for t in trees]
        table = np.array(self.nodes)
        self.feature, self.left, self.right = (table[:, c].astype(np.int64) for c in (0, 2, 3))
        self.threshold, self.value = table[:, 1], table[:, 4]
        self.weights = np.array(weights)

    def _read(self, lines: Iterator[str]) -> int:
        """Parse Spark's printed form of a tree."""
        line, n = next(lines), len(self.nodes)
        if line.startswith("Predict:"):
            self.nodes.append([0, np.inf, n, n, float(line.split(":")[1])])
            return n
        feature, threshold = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        self.nodes.append([int(feature), float(threshold), 0, 0, 0])
        left = self._read(lines)
        next(lines)  # Else
        self.nodes[n][2:4] = [left, self._read(lines)]
        return n

    def probability(self, x: np.ndarray) -> np.ndarray:
        at = np.repeat(np.array(self.roots)[:, None], len(x), axis=1)
        rows = np.arange(len(x))
        while True:
            low = x[rows, self.feature[at]] <= self.threshold[at]
            after = np.where(low, self.left[at], self.right[at])
            if (after == at).all():
                return 1 / (1 + np.exp(-2 * (self.weights @ self.value[at])))
            at = after


def pooled(nodes: list[Node], p: np.ndarray) -> np.ndarray:
    """Probabilities in which the plain paragraphs of one parent share the mean of their log odds.

    No markup tells such siblings apart, so an odd line does not fall out of its text.
    """
    plain: dict[int, list[int]] = {}
    for i, x in enumerate(nodes):
        if x.tag == "p" and not x.children and not x.attrs.strip():
            plain.setdefault(x.parent, []).append(i)
    p = np.clip(p, 1e-4, 1 - 1e-4)
    odds = np.log(p / (1 - p))
    for own in plain.values():
        odds[own] = odds[own].mean()
    return 1 / (1 + np.exp(-odds))


def decode(nodes: list[Node], p: np.ndarray) -> list[bool]:
    """Likeliest labels under the rule that a rejected node has only rejected ones below."""
    p = np.clip(pooled(nodes, p), 1e-4, 1 - 1e-4)
    yes, no = np.log(p).tolist(), np.log(1 - p).tolist()
    for i in range(len(nodes) - 1, -1, -1):
        for c in nodes[i].children:
            yes[i] += max(yes[c], no[c])
            no[i] += no[c]
    keep = [False] * len(nodes)
    for i, x in enumerate(nodes):
        keep[i] = (i == 0 or keep[x.parent]) and yes[i] > no[i]
    return keep


def main_text(nodes: list[Node], keep: list[bool]) -> str:
    """Kept blocks in page order: white space as one space, one line a block."""
    out: list[str] = []

    def block(parts: list[str]) -> None:
        line = SPACE.sub(" ", "".join(parts)).strip()
        if line:
            out.append(line)

    todo: list[tuple[int, int]] = [(0, 0)] if keep[0] else []
    while todo:
        i, k = todo.pop()
        run: list[str] = []
        parts = nodes[i].parts
        while k < len(parts):
            part = parts[k]
            k += 1
            if isinstance(part, str):
                run.append(part)
            elif part < 0:
                continue
            elif keep[part]:
                block(run)
                run = []
                todo += [(i, k), (part, 0)]
                break
            else:
                block(run)
                run = []
        else:
            block(run)
    return "\n".join(out)


def draw_page(seed: int) -> str:
    """A page from layout rules; main text carries marked words, for the labels."""
    r = random.Random(seed)
    chars = "aeioubcdfghlmnprstvwéèñüßçóäöí"
    word = lambda: "".join(r.choice(chars) for _ in range(r.randint(1, 9)))
    said = lambda n: " ".join(word() + r.choice(["", "", "", "", ",", ".", "###"]) for _ in range(n)).capitalize() + "."
    links = lambda n: "".join(f'<li><a href="/{word()}">{said(r.randint(1, 4))}</a></li>' for _ in range(n))
    name = lambda group: r.choice(TOKENS[group].split())
    bare = r.random() < 0.2  # a page of nothing but divisions, tables and links

    def attrs(group: str, chance: float = 0.8) -> str:
        if r.random() > chance:
            return ""
        return r.choice([' class="{}"', ' id="{}"', ' class="{} ' + word() + '"', ' class="site-{}"', " class='x_{}'"]).format(name(group))

    def odd(n: int) -> str:
        """Lines that are no sentences: words without an end, one word again and again, columns of words."""
        again = [f"{w} " * r.randint(2, 30) for w in (word() for _ in range(r.randint(1, 8)))]
        return r.choice([" ".join(word() for _ in range(n)), "".join(again).strip(), f"{word()} " * n, " | ".join(word() for _ in range(n))])

    def para() -> str:
        n = r.choice([1, 2, 5, 12, 30, 60, 120, 200])
        inner = "MAIN " + (said(n) if r.random() < 0.8 else odd(n))
        if r.random() < 0.2:
            inner = f"MAIN <b>{said(3)}</b> {said(n)} <a href='/{word()}'>{word()}</a> {said(4)}"
        if r.random() < 0.15 and not bare:
            inner = f"<b>MAIN {said(n) if r.random() < 0.7 else odd(n)}<br>"
            return f"<p>{inner}"
        kind = r.random()
        if kind < 0.04:
            return "<ul>" + "".join(f"<li>MAIN {said(r.randint(2, 15))}</li>" for _ in range(r.randint(2, 6))) + "</ul>"
        if kind < 0.08:
            return f"<blockquote><p>MAIN {said(20)}</p></blockquote>"
        if kind < 0.12:
            return f"<h{(h := r.choice('234'))}>MAIN {said(r.randint(1, 6))}</h{h}>"
        if kind < 0.15:
            return f"<table><tr><td>MAIN {said(3)}</td><td>MAIN {said(2)}</td></tr></table>"
        if kind < 0.25:
            return f"<div>{inner}</div>"
        return f"<p>{inner}</p>" if bare or r.random() < 0.8 else f"<p>{inner}"

    advert = lambda: r.choice(["<div{}>{}</div>", "<div{}><p>{}</p></div>", "<section{}><a href='/x'>{}</a></section>", "<aside{}>{}</aside>"]).format(attrs("ad", 1), said(r.randint(2, 20)))
    share = lambda: f"<div{attrs('share', 1)}>{said(2)} <a href='/{word()}'>{word()}</a> <a href='/'>{word()}</a></div>"
    notice = lambda: f"<div{attrs('notice', 1)}><p>{said(r.randint(5, 30))}</p><button>{word()}</button></div>"
    form = lambda: f"<form{attrs('form', 0.5)}><label>{said(2)}</label><input name='q'><button>{word()}</button></form>"
    side = lambda: r.choice(["<aside{}>{}</aside>", "<div{}>{}</div>"]).format(attrs("side", 1), f"<h3>{said(2)}</h3><ul>{links(r.randint(2, 8))}</ul>" + (f"<p>{said(15)}</p>" if r.random() < 0.4 else ""))
    rows = lambda n: r.choice([" ", " | ", ""]).join(f'<a href="/{word()}">{said(r.randint(1, 3))}</a>' for _ in range(n))
    menu = lambda: r.choice(["<nav{0}><ul>{1}</ul></nav>", "<div{2}><ul>{1}</ul></div>", "<div{2}>{3}</div>"]).format(attrs("menu", 0.4), links(r.randint(3, 12)), attrs("menu", 1), rows(r.randint(2, 9)))
    head = lambda: f"<header{attrs('head', 0.5)}><a href='/'>{said(2)}</a>{r.choice(['', f'<p>{said(6)}</p>', menu()])}</header>"
    foot = lambda: r.choice(["<footer{0}>&copy; {1}</footer>", "<div{2}><p>{1}</p></div>", "<footer{0}><ul>{3}</ul><p>&copy; {1}</p></footer>"]).format(attrs("foot", 0.3), said(r.randint(3, 25)), attrs("foot", 1), links(3))

    def comments() -> str:
        each = "".join(
            f"<{t}{attrs('comment', 0.7)}><p><b>{word()}</b></p><p>{said(r.randint(3, 60))}</p></{t}>"
            for t in [r.choice(["div", "li", "article"])] * r.randint(1, 6)
        )
        return r.choice(["<section{}><h3>{}</h3>{}</section>", "<div{}><h2>{}</h2>{}</div>", "<ol{}><li>{}</li>{}</ol>"]).format(attrs("comment", 1), said(2), each)

    body = [f"<h1>MAIN {said(r.randint(1, 10))}</h1>"] * (r.random() < 0.8)
    for _ in range(r.choice([1, 2, 4, 8, 15, 25])):
        body.append(para())
        if r.random() < 0.06 and not bare:
            body.append(r.choice([advert, share, side, form])())
    inside = "".join(body)
    if r.random() < 0.25:
        inside += r.choice([share, share if bare else comments, side])()
    if r.random() < 0.3:
        inside = f"<div{attrs('main', 0.7)}>{inside}</div>"
    shell = r.choice(["<article{}>{}</article>", "<main{}>{}</main>", "<div{}>{}</div>", "<article{}>{}</article>"])
    main = shell.format(attrs("main", 1 if shell.startswith("<div") else 0.3), inside)
    marked = 0 if bare else 1  # what only its names tell from the article needs names
    before = [f() for f, c in ((head, 0.5), (menu, 0.8), (notice, 0.3 * marked), (advert, 0.5 * marked), (form, 0.2)) if r.random() < c]
    after = [f() for f, c in ((comments, 0.4 * marked), (side, 0.4), (advert, 0.3 * marked), (form, 0.2), (notice, 0.2 * marked), (foot, 0.85)) if r.random() < c]
    r.shuffle(before)
    if bare and r.random() < 0.5:
        main = inside  # no shell at all
    middle = [main]
    if r.random() < 0.3 and not bare:
        middle = [f"<div{attrs('side', 0)}>{main}{after.pop(0) if after else ''}</div>"]
    if bare and r.random() < 0.2:
        middle = [f"<table><tr><td>{menu()}</td><td>{main}</td></tr></table>"]
    inner = "".join(before + middle + after)
    if bare:
        inner = re.sub(r"<(/?)(?:article|main|section|header|footer|nav|aside)\b[^>]*>", r"<\1div>", inner)
        inner = re.sub(r"<(div|p|ul|ol|li|form)\s[^>]*>", r"<\1>", inner)
        if r.random() < 0.5:
            inner = re.sub(r"<(/?)p>", r"<\1div>", inner)
    page = f"<!DOCTYPE html><html><head><title>{said(3)}</title><style>p{{}}</style></head><body>{inner}"
    return page + ("</body></html>" if r.random() < 0.9 else "")


def labelled_nodes(pages: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, dict[str, float]]:
    """Features and labels of the nodes of drawn pages, and the learned weights of attribute words."""
    drawn: list[list[Node]] = []
    ys: list[bool] = []
    for i in range(pages):
        nodes = parse(draw_page(seed + i))
        label = [any(isinstance(p, str) and "MAIN" in p for p in x.parts) for x in nodes]
        for j in range(len(nodes) - 1, 0, -1):
            label[nodes[j].parent] |= label[j]
        for x in nodes:
            x.parts = [p.replace("MAIN ", "") if isinstance(p, str) else p for p in x.parts]
        drawn.append(nodes)
        ys += label
    words = word_weights([x for nodes in drawn for x in nodes], ys)
    return features([row for nodes in drawn for row in node_rows(nodes, words)]), np.array(ys, float), words


HEADING_AT = -1 - len(TAGS) - len(WITHIN)  # the column that tells headings
FITTED: dict[int, Trees] = {}


def fit(spark: SparkSession, pages: int = TRAIN_PAGES) -> Trees:
    """Gradient-boosted trees on the nodes of ``pages`` drawn pages; fitted once a process."""
    if pages not in FITTED:
        x, y, words = labelled_nodes(pages)
        schema = T.StructType([T.StructField("features", VectorUDT()), *[T.StructField(c, T.DoubleType()) for c in ("label", "weight")]])
        # Headings of the text are few and short, yet as much a part of it as paragraphs; others fall with what they are in.
        heavy = 1.0 + 9.0 * x[:, HEADING_AT] * y
        rows = [(Vectors.dense(a), b, c) for a, b, c in zip(x.tolist(), y.tolist(), heavy.tolist(), strict=True)]
        train = spark.createDataFrame(rows, schema).coalesce(2).persist()
        model = GBTClassifier(maxIter=50, maxDepth=5, stepSize=0.3, maxBins=48, seed=1, cacheNodeIds=False, weightCol="weight").fit(train)
        train.unpersist()
        FITTED[pages] = Trees([t.toDebugString for t in model.trees], list(model.treeWeights), words)
    return FITTED[pages]


def extract_texts(pages: list[str], trees: Trees) -> list[str]:
    out: list[str] = []
    for at in range(0, len(pages), AT_ONCE):
        parsed = [parse(p) for p in pages[at : at + AT_ONCE]]
        p = trees.probability(features([row for x in parsed for row in node_rows(x, trees.words)]))
        k = 0
        for nodes in parsed:
            out.append(main_text(nodes, decode(nodes, p[k : k + len(nodes)])))
            k += len(nodes)
    return out


def extract(df: DataFrame, trees: Trees, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Main text of every whole page, in column ``text``, beside the columns ``keep``.

    Null and empty pages, and pages without main text, give an empty text. Broken
    markup is read as far as it goes. Repeated rows and null ids are kept; other
    columns are not read. Pages are parsed where they are read: no shuffle.
    """
    held = df.sparkSession.sparkContext.broadcast(trees)

    def setup():  # noqa: ANN202
        return lambda pages: {"text": pa.array(extract_texts(pages, held.value), pa.string())}

    return map_rows(df, list(keep), html_col, setup, "text string")
