"""Main-content extraction: boosted trees over DOM nodes, decoded along the hierarchy.

A tolerant parser (void elements, implied end tags, raw text of scripts and
styles, stray end tags) makes a tree. Each element is described by depth,
kind of tag, hashed tokens of its ``class``, ``id`` and ``role``, lengths of its own
and its subtree's text, subtree density (text by tag), link share, punctuation,
children, siblings and its place among them, shares of its parent's and the
page's text, and kind of parent. Gradient-boosted trees (numpy, logistic loss,
histograms of 32 bins) give the probability that it is content.

Decoding chooses, for the whole tree at once, the likeliest labels under which every
descendant of a content node is content: from the leaves up, a subtree is either all
content or its root is not and its children decide for themselves. So no node is
taken from a subtree twice and no boilerplate is inside chosen content.

The trees learn from pages that mark their content themselves, with exactly one
``article`` or ``main`` element, at most ``train_pages`` of them by a hash of
``page_id``; both tags count as ``div`` among the features, so that nothing
but the other signs is learnt. Pages are only mapped over: no shuffle.

Defined cases: a null or empty page has a null title and empty text; text outside all
elements belongs to the root; a tag that has no end is text; of elements nested deeper
than 512 one takes the other's place, as in browsers, and their text stays; with no page to learn from all text outside of scripts
is content; null ids and repeated rows are treated like others; an empty table
gives an empty table; other columns aren't part of the result.
"""

from __future__ import annotations

import bisect
import html as entities
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillmill.llm.sample import least
from quillmill.runtime import read_table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "noscript", "template", "iframe"))
BLOCK = frozenset(
    "address article aside blockquote body br dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: An element of the first kind ends open ones of the second, up to one of the third.
_IMPLIED = {t: (frozenset(a.split()), frozenset(b.split())) for ts, a, b in (
    ("li", "li", "ul ol"), ("dt dd", "dt dd", "dl"), ("tr", "tr td th", "table"), ("td th", "td th", "tr table"), ("option", "option", "select"),
    ("thead tbody tfoot", "thead tbody tfoot tr td th", "table"),
    ("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul", "p", "td th li div section article body"),
) for t in ts.split()}
_KINDS = {t: k for k, ts in enumerate(("p pre blockquote", "h1 h2 h3 h4 h5 h6", "li dd dt option", "ul ol dl select", "a", "nav", "header footer aside", "form input button textarea label", "table tbody thead tfoot tr td th", "b i em strong span u small code sub sup br font", "div section article main figure", "head title meta link base", "html body", "script style noscript template iframe"), 1) for t in ts.split()}
#: A comment, a declaration, or a tag; its attributes are matched as far as no quoted ``<`` or ``>`` comes up, so that no search runs further than to the next of these.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?]|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>\"']++|\"[^\"<>]*+\"|'[^'<>]*+')*+)(>?)", re.S)
_STEP = re.compile(r"[>\"']")
#: Elements that are open at a time; one more takes the place of the last.
MAX_DEPTH = 512
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_TITLE = "title"
BUCKETS = 16
N_FEATURES = 18 + BUCKETS


@dataclass
class Tree:
    tag: list
    parent: list
    depth: list
    attrs: list
    pieces: list  # (node, text, number of the block it is in)


class _Ends:
    """Where tags end whose attributes have a quoted bracket, or a quote that isn't closed.

    A scan that finds no end remembers the stretches outside of quotes that it passed: no tag that begins there has an end
    either. So the scans together pass a page three times at most, one for each way of reading its quotes.
    """

    def __init__(self, page: str):
        self.page, self.dead = page, []

    def after_quotes(self, at: int) -> int:
        """The place of the first ``>`` outside of quotes, -1 for none."""
        for begins, ends in self.dead:
            k = bisect.bisect_right(begins, at) - 1
            if k >= 0 and at <= ends[k]:
                return -1
        begins, ends, page = [at], [], self.page
        while True:
            m = _STEP.search(page, at)
            if not m:
                ends.append(len(page))
                break
            if m[0] == ">":
                return m.start()
            ends.append(m.start())
            at = page.find(m[0], m.end()) + 1
            if not at:
                break
            begins.append(at)
        self.dead.append((begins, ends))
        return -1


def parse(page: str) -> Tree:
    """The elements in document order below a root (number 0), and the text between tags. Linear in the page."""
    tree = Tree(["#root"], [-1], [0], [""], [])
    tag, parent, depth, pieces = tree.tag, tree.parent, tree.depth, tree.pieces
    opened, at, block, last = [0], 0, 0, page.rfind(">")
    places: dict[str, list[int]] = {}  # where in ``opened`` the elements of a name are
    ends = _Ends(page)
    find = _TOKEN.search

    def close(k: int) -> None:
        for node in reversed(opened[k:]):
            places[tag[node]].pop()
        del opened[k:]

    def top(names) -> int:
        return max((places[t][-1] for t in names if places.get(t)), default=0)

    while True:
        m = find(page, at)
        if m and m.start() > last and not page.startswith("<!--", m.start()):
            m = None
        text = page[at : m.start()] if m else page[at:]
        if text and not text.isspace():
            pieces.append((opened[-1], text, block))
        elif text:
            pieces.append((opened[-1], " ", block))
        if not m:
            break
        at = m.end()
        name = m.group(2)
        if not name:
            at = page.find(">", at) + 1 if len(m[0]) == 2 else at
            continue
        name = name.lower()
        attrs = m.group(3)
        if not m.group(4):
            stop = ends.after_quotes(m.end(2))
            stop = page.find(">", m.end(2)) if stop < 0 else stop
            attrs, at = page[m.end(2) : stop], stop + 1
        if name in BLOCK:
            block += 1
        if m.group(1):
            if places.get(name):
                close(places[name][-1])
            continue
        if name in _IMPLIED:
            k = top(_IMPLIED[name][0])
            if k and k > top(_IMPLIED[name][1] - _IMPLIED[name][0]):
                close(k)
        if len(opened) > MAX_DEPTH:
            close(len(opened) - 1)
        node = len(tag)
        tag.append(name)
        parent.append(opened[-1])
        depth.append(len(opened))
        tree.attrs.append(attrs)
        if name in RAW:
            if not attrs.endswith("/"):
                end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
        elif name not in VOID and not attrs.endswith("/"):
            places.setdefault(name, []).append(len(opened))
            opened.append(node)
    return tree


class Pages:
    """Trees of many pages as one forest, with features for every node."""

    def __init__(self, trees: list[Tree]):
        self.trees = trees
        self.start = np.concatenate([[0], np.cumsum([len(t.tag) for t in trees])]).astype(np.int64)
        n = self.start[-1]
        self.page = np.repeat(np.arange(len(trees)), np.diff(self.start))
        self.parent = np.concatenate([np.array(t.parent, np.int64) + np.where(np.array(t.parent) >= 0, s, 0) for t, s in zip(trees, self.start)]) if trees else np.zeros(0, np.int64)
        self.depth = np.array([d for t in trees for d in t.depth], np.int64)
        order = np.argsort(self.depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(self.depth[order])) + 1) if n else []
        self.features = self._features(int(n))

    def up(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees."""
        total = values.astype(float)
        for level in reversed(self.levels[1:]):
            np.add.at(total, self.parent[level], total[level])
        return total

    def _features(self, n: int) -> np.ndarray:
        own, marks = np.zeros(n), np.zeros(n)
        kind, names, buckets = np.zeros(n), np.zeros(n, np.int64), np.zeros((n, BUCKETS))
        for t, s in zip(self.trees, self.start.tolist()):
            for node, text, _ in t.pieces:
                size = len(text)
                if size > 1:
                    own[s + node] += size
                    marks[s + node] += text.count(".") + text.count(",")
            for k, name in enumerate(t.tag, s):
                kind[k] = _KINDS.get(name, 0)
                names[k] = zlib.crc32(name.encode())
            for k, attrs in enumerate(t.attrs, s):
                if attrs:
                    for m in _ATTRIBUTE.finditer(attrs):
                        for token in re.findall(r"[a-z]+", (m.group(1) or m.group(2) or m.group(3) or "").lower()):
                            buckets[k, zlib.crc32(token.encode()) % BUCKETS] = 1
        names[np.isin(names, [zlib.crc32(b"article"), zlib.crc32(b"main")])] = zlib.crc32(b"div")
        text, tags, point = self.up(own), self.up(np.ones(n)), self.up(marks)
        link = np.where(kind == _KINDS["a"], text, 0)
        for level in self.levels[1:]:
            link[level] = np.where(kind[self.parent[level]] == _KINDS["a"], 0, link[level])
        linked, links = self.up(link), self.up(kind == _KINDS["a"])
        up = np.where(self.parent >= 0, self.parent, np.arange(n))
        children = np.bincount(self.parent[self.parent >= 0], minlength=n) if n else np.zeros(0)
        siblings = np.where(self.parent >= 0, children[up], 1) if n else children
        order = np.lexsort((np.arange(n), up))
        first = np.concatenate([[True], up[order][1:] != up[order][:-1]]) if n else np.zeros(0, bool)
        place = np.zeros(n)
        place[order] = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0)) if n else 0
        _, same, count = np.unique(up * (1 << 32) + names, return_inverse=True, return_counts=True) if n else (0, np.zeros(0, int), np.zeros(0))
        root = self.start[self.page]
        share = lambda a, b: np.divide(a, b, out=np.zeros(n), where=b > 0)
        columns = [
            np.minimum(self.depth, 30), kind, np.log1p(own), np.log1p(text), np.log1p(tags), text / tags, share(linked, text), np.log1p(links), share(point, text) * 100,
            np.log1p(children), np.log1p(siblings), share(place, np.maximum(1, siblings - 1)), np.log1p(count[same]) if n else count, share(text, text[up]), share(text, text[root]),
            share(np.arange(n) - root, tags[root]), kind[up], kind[up[up]],
        ]
        return np.column_stack([*columns, buckets]).astype(np.float32)

    def marked(self) -> tuple[np.ndarray, np.ndarray]:
        """For each node whether it is in the page's article or main, and whether its page has exactly one such."""
        mark = np.array([name in ("article", "main") for t in self.trees for name in t.tag], bool)
        count = np.bincount(self.page[mark], minlength=len(self.trees))
        inside = mark.copy()
        for level in self.levels[1:]:
            inside[level] |= inside[self.parent[level]]
        return inside, (count == 1)[self.page]

    def decode(self, p: np.ndarray) -> np.ndarray:
        """The likeliest labels under which descendants of content are content."""
        p = np.clip(p, 1e-6, 1 - 1e-6)
        whole, best = np.log(p), np.log1p(-p)
        whole = self.up(whole)
        for level in reversed(self.levels):
            best[level] = np.maximum(best[level], whole[level])
            if level[0] and (self.parent[level] >= 0).all():
                np.add.at(best, self.parent[level], best[level])
        chosen = np.zeros(len(p), bool)
        for level in self.levels:
            above = np.where(self.parent[level] >= 0, chosen[self.parent[level]], False)
            chosen[level] = above | (whole[level] >= best[level])
        return chosen


@dataclass
class Boosted:
    """Trees of fixed depth in heap order over binned features."""

    edges: list
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves
    base: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(self.edges)]).astype(np.uint8) if len(x) else np.zeros((0, len(self.edges)), np.uint8)

    def probability(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        flat, at = np.ascontiguousarray(b).reshape(-1), np.arange(len(b)) * b.shape[1]
        score, inner = np.full(len(b), self.base), self.feature.shape[1]
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(b), np.int64)
            while inner and len(node) and node[0] < inner:
                node = 2 * node + 1 + (flat[at + f[node]] > c[node])
            score += leaf[node - inner]
        return 1 / (1 + np.exp(-score))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32, penalty: float = 1.0) -> Boosted:
    """Second-order boosting of the logistic loss."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Boosted(edges, np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), 255, np.int64), np.zeros((trees, 2**depth)), float(np.log(p / (1 - p))))
    b, score = model.bins(x).astype(np.int64), np.full(len(x), model.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(x), np.int64)
        for d in range(depth):
            wide, first = 2**d, 2**d - 1
            at = (node - first) * bins
            gain, split = np.zeros((x.shape[1], wide)), np.zeros((x.shape[1], wide), np.int64)
            for j in range(x.shape[1]):
                gs = np.bincount(at + b[:, j], g, wide * bins).reshape(wide, bins).cumsum(1)
                hs = np.bincount(at + b[:, j], h, wide * bins).reshape(wide, bins).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                value = gs**2 / (hs + penalty) + (gt - gs) ** 2 / (ht - hs + penalty) - gt**2 / (ht + penalty)
                split[j] = value.argmax(1)
                gain[j] = value.max(1)
            best = gain.argmax(0)
            model.feature[t, first : first + wide] = best
            model.cut[t, first : first + wide] = np.where(gain.max(0) > 1e-9, split[best, np.arange(wide)], 255)
            node = 2 * node + 1 + (b[np.arange(len(x)), model.feature[t, node]] > model.cut[t, node])
        leaf = node - (2**depth - 1)
        model.leaf[t] = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + penalty)
        score += model.leaf[t][leaf]
    return model


def train(pages: DataFrame, train_pages: int = 400) -> Boosted | None:
    """Boosted trees from at most ``train_pages`` pages that mark their content."""
    some = least(pages.where(r"html rlike '(?i)<(article|main)[\\s>]'"), F.xxhash64("page_id", "url"), F.col("html").cast("string"), train_pages)

    def learn(batches):
        for batch in batches:
            forest = Pages([parse(h) for h in batch.column(0).to_pylist()])
            inside, usable = forest.marked()
            yield pa.RecordBatch.from_arrays([pa.array([forest.features[usable].tobytes()], pa.binary()), pa.array([inside[usable].tobytes()], pa.binary())], names=["x", "y"])

    rows = some.mapInArrow(learn, "x binary, y binary").collect()
    x = np.concatenate([np.frombuffer(r["x"], np.float32) for r in rows] or [np.zeros(0, np.float32)]).reshape(-1, N_FEATURES)
    y = np.concatenate([np.frombuffer(r["y"], bool) for r in rows] or [np.zeros(0, bool)])
    return boost(x, y.astype(float)) if 0 < y.sum() < len(y) else None


def _text(tree: Tree, chosen: np.ndarray) -> str:
    out, last = [], None
    for node, text, block in tree.pieces:
        if chosen[node]:
            if last is not None and block != last:
                out.append("\n")
            out.append(re.sub(r"\s+", " ", text))
            last = block
    text = entities.unescape("".join(out)) if out else ""
    return "\n".join(line for line in (re.sub(r"[ \t\xa0]+", " ", x).strip() for x in text.split("\n")) if line)


def _title(tree: Tree) -> str | None:
    for k, name in enumerate(tree.tag):
        if name == _TITLE:
            return " ".join(entities.unescape("".join(t for node, t, _ in tree.pieces if node == k)).split()) or None
    return None


def extract_pages(pages: list[str | None], model: Boosted | None) -> list[tuple]:
    """Title, text, nodes and content nodes of each page."""
    out = []
    for at in range(0, len(pages), 200):
        forest = Pages([parse(p or "") for p in pages[at : at + 200]])
        p = model.probability(forest.features) if model else np.ones(len(forest.page))
        chosen = forest.decode(p)
        for t, a, b in zip(forest.trees, forest.start[:-1], forest.start[1:]):
            mine = chosen[a:b]
            out.append((_title(t), _text(t, mine), int(b - a) - 1, int(mine.sum())))
    return out


def extract(pages: DataFrame, model: Boosted | None) -> DataFrame:
    """``page_id, url, title, text, nodes, content_nodes`` for every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            title, text, nodes, content = zip(*extract_pages(batch.column(2).to_pylist(), shared.value)) if batch.num_rows else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(title, pa.string()), pa.array(text, pa.string()), pa.array(nodes, pa.int32()), pa.array(content, pa.int32())], names=["page_id", "url", "title", "text", "nodes", "content_nodes"]
            )

    narrow = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return narrow.mapInArrow(run, "page_id long, url string, title string, text string, nodes int, content_nodes int")


def query(spark, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return extract(pages, train(pages))
