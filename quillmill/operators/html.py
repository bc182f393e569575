"""Rule-based text extraction from pages: a tolerant tree, boilerplate rules, content scores, and metrics.

``main_content`` is ``top1`` (the best element alone) or ``subtree`` (the lowest element
that holds all qualifying ones); equal scores go to the earlier element. Cleaning
collapses blanks first, so extracted text is one line unless ``keep_newlines``.

A null or empty page gives empty fields and isn't valid; repeated rows are extracted alike; of elements
nested deeper than 512 one takes the other's place; every step is linear in the page.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BOILER_TAGS = frozenset("aside embed footer header iframe menu nav noscript object script style".split())
BOILER_WORDS = tuple("ad ads advertisement analytics banner breadcrumb comment footer header menu modal nav navigation pagination plugin popup share sidebar social tracking widget".split())
BOILER_IDS = frozenset("ad ads banner comments footer header menu modal nav navigation popup sidebar".split())
CONTENT_TAGS = frozenset("article div h1 h2 h3 h4 h5 h6 main p section".split())
_CLOSES = {"p": "p", "li": "li", "td": "td", "th": "th", "tr": "tr", "dt": "dt", "dd": "dd", "option": "option"}


@dataclass(eq=False)
class Element:
    tag: str
    attrs: dict = field(default_factory=dict)
    children: list = field(default_factory=list)
    parts: list = field(default_factory=list)  # text and elements in order

    @cached_property
    def text(self) -> str:
        return " ".join("".join(p for p in self.parts if isinstance(p, str)).split())

    def walk(self):
        stack = [self]
        while stack:
            e = stack.pop()
            yield e
            stack.extend(reversed(e.children))


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("#root")
        self.open = [self.root]
        self.count: dict[str, int] = {}  # of the open elements by name

    def _close(self, k: int) -> None:
        for e in self.open[k:]:
            self.count[e.tag] -= 1
        del self.open[k:]

    def handle_starttag(self, tag, attrs):
        if (tag in _CLOSES and self.open[-1].tag == tag) or len(self.open) > 512:
            self._close(len(self.open) - 1)
        e = Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(e)
        self.open[-1].parts.append(e)
        if tag not in VOID:
            self.open.append(e)
            self.count[tag] = self.count.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag):
        if self.count.get(tag):
            k = len(self.open) - 1
            while self.open[k].tag != tag:
                k -= 1
            self._close(k)

    def handle_data(self, data):
        self.open[-1].parts.append(data)


def parse(page: str) -> Element:
    b = _Builder()
    b.feed(page)
    b.close()
    return b.root


def is_boilerplate(e: Element) -> bool:
    return e.tag in BOILER_TAGS or any(w in e.attrs.get("class", "").lower() for w in BOILER_WORDS) or e.attrs.get("id", "").lower() in BOILER_IDS


def is_navigation(e: Element) -> bool:
    return e.tag == "nav" or bool({"nav", "navigation", "menu"} & set(e.attrs.get("class", "").split())) or e.attrs.get("id") in ("nav", "navigation")


def is_advertisement(e: Element) -> bool:
    return any(w in e.attrs.get(a, "") for a in ("class", "id") for w in ("ad", "banner", "sponsor"))


def is_content(e: Element) -> bool:
    return e.tag in CONTENT_TAGS or any(w in e.attrs.get("class", "") for w in ("article", "body", "content", "entry", "main", "post", "text"))


def content_score(e: Element) -> float:
    n = len(e.text.encode())
    score = 10.0 * is_content(e) - 20.0 * is_boilerplate(e) - 15.0 * is_navigation(e) - 25.0 * is_advertisement(e) + min(n / 10, 20.0)
    density = 100.0 * sum(c.tag == "a" for c in e.children) / n if n else 0.0
    return score - density * (density > 5)


def text_density(e: Element) -> float:
    nodes = list(e.walk())
    return sum(len(x.text.encode()) for x in nodes) / len(nodes)


def prune(e: Element) -> Element:
    for x in e.walk():
        gone = {id(c) for c in x.children if is_boilerplate(c)}
        if gone:
            x.children = [c for c in x.children if id(c) not in gone]
            x.parts = [p for p in x.parts if isinstance(p, str) or id(p) not in gone]
    return e


def main_content(root: Element, how: str = "top1") -> Element | None:
    scored = [(content_score(e), -k, e) for k, e in enumerate(root.walk()) if e.text and e.tag not in ("title", "head")]
    good = [x for x in scored if x[0] > 5]
    if not good:
        return None
    if how == "top1":
        return max(good, key=lambda x: x[:2])[2]
    wanted = {id(e) for _, _, e in good}
    held: dict[int, int] = {}
    for e in reversed(list(root.walk())):
        held[id(e)] = (id(e) in wanted) + sum(held[id(c)] for c in e.children)
    at = root
    while id(at) not in wanted:
        whole = [c for c in at.children if held[id(c)] == len(good)]
        if not whole:
            break
        at = whole[0]
    return at


def element_text(e: Element) -> str:
    out, stack = [], [e]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag not in ("script", "style", "title"):
            if x.tag in ("p", "div", "br") or x.tag.startswith("h"):
                stack.append("\n")
            stack.extend(reversed(x.parts))
    return "".join(out)


#: Letters in UTF-8 that were read as Latin-1.
_BROKEN = {c.encode().decode("latin-1"): c for c in "áéíóúèìòùâêîôûãñçà"}
_REPAIR = re.compile("|".join(map(re.escape, _BROKEN)))
_MARKS = str.maketrans({" ": " ", "–": "-", "‘": "'", "’": "'", "“": '"', "”": '"', "…": "..."})


def clean_text(text: str, keep_newlines: bool = False) -> str:
    text = _REPAIR.sub(lambda m: _BROKEN[m[0]], unescape(text)).translate(_MARKS)
    text = re.sub(r"<[^>]*>", "", text)
    if not keep_newlines:
        return " ".join(text.split())
    lines = [" ".join(line.split()) for line in text.split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip("\n")


_RESULT = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("headings", T.ArrayType(T.StringType())), T.StructField("links", T.ArrayType(T.StringType())),
    T.StructField("text_ratio", T.DoubleType()), T.StructField("paragraphs", T.IntegerType()), T.StructField("link_density", T.DoubleType()), T.StructField("is_valid", T.BooleanType()), T.StructField("quality_score", T.DoubleType()),
    T.StructField("language", T.StringType()), T.StructField("text_density", T.DoubleType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])


def extract_page(page: str | None, how: str = "top1", keep_newlines: bool = False) -> tuple:
    """The fields of the result for one page; null and empty pages give empty, not valid, ones."""
    page = page or ""
    root = parse(page)
    title = next((e.text for e in root.walk() if e.tag == "title"), "")
    links = [e.attrs["href"] for e in root.walk() if e.tag == "a" and e.attrs.get("href")]
    metas = [e.attrs for e in root.walk() if e.tag == "meta"]
    metadata = {m["name"].lower(): m.get("content", "") for m in reversed(metas) if m.get("name")}
    language = metadata.get("language") or next((e.attrs["lang"] for e in root.walk() if e.tag == "html" and e.attrs.get("lang")), "")
    body = prune(root)
    best = main_content(body, how)
    text = clean_text(element_text(best if best is not None else body), keep_newlines)
    headings = [e.text for e in body.walk() if re.fullmatch("h[0-9]", e.tag) and e.text]
    size, whole = len(text.encode()), len(page.encode())
    ratio = size / whole if whole else 0.0
    paragraphs = text.count("\n\n") + 1 if keep_newlines and text else 0
    density = 100.0 * len(links) / size if size else 0.0
    score = 0.4 * min(1.0, size / 1000) + 0.3 * min(1.0, ratio * 2) + 0.3 * min(1.0, paragraphs / 5)
    return title, text, headings, links, round(ratio, 6), paragraphs, round(density, 6), size >= 50 and ratio >= 0.1, round(score, 6), language, round(text_density(body), 6), metadata


def extract(pages: DataFrame, how: str = "top1", keep_newlines: bool = False, column: str = "html") -> DataFrame:
    """``pages`` with a struct ``extracted``."""

    @F.pandas_udf(_RESULT)
    def run(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extract_page(h, how, keep_newlines) for h in html], columns=_RESULT.names)

    return pages.withColumn("extracted", run(F.col(column).cast("string")))


def report(extracted: DataFrame) -> DataFrame:
    """One row: pages, valid ones, mean quality and length."""
    return extracted.agg(F.count("*").alias("pages"), F.count_if("extracted.is_valid").alias("valid"), F.round(F.avg("extracted.quality_score"), 4).alias("mean_quality"), F.round(F.avg(F.length("extracted.text")), 2).alias("mean_length"))
