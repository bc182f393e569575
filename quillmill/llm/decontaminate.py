"""Benchmark decontamination by a generalised suffix automaton of the test items.

Texts and items are read as tokens: lower-cased runs of Unicode letters and
digits. The automaton of all items is walked with the tokens of a document and
gives, at every token, the length of the longest suffix that some item contains.
A match with an item is removed when it reaches

* the length limit, ``max_match`` tokens, or
* the coverage limit, ``item_coverage`` of the item's tokens (for short items),
  but never under ``min_match`` tokens.

An item of fewer than ``min_match`` tokens is too common a phrase to be cut out of texts;
a document that consists of nothing but such an item is dropped.

A removed token goes together with the separators that follow it. A document of
whose tokens ``doc_coverage`` or more were removed is dropped.

Only stretches in which every four consecutive tokens occur in the items can hold
such a match; a bitmap of hashed four-grams finds them and the automaton walks
these alone, which changes no result since ``min_match`` is at least four.

The benchmark is not the corpus and does not grow with it. Its automaton is
broadcast in parts of at most ``max_automaton_tokens`` tokens; more parts mean
more passes, each over the original texts. The spans of all parts are merged
before a document is cut and judged, once, so the parts change no result.

Defined cases: a null or empty text, and a text without tokens, has no match and
stays as it is; null and empty items are ignored; a null ``doc_id`` and repeated
rows are treated like any other row; an empty benchmark or corpus changes
nothing; other columns, whatever their names, pass through.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from quillmill.runtime import broadcast_if_small, materialize, read_table

_GATE = 4


@dataclass(frozen=True)
class Limits:
    max_match: int = 13
    item_coverage: float = 0.8
    min_match: int = 8
    doc_coverage: float = 0.6
    max_automaton_tokens: int = 200_000

    def __post_init__(self):
        if not _GATE <= self.min_match <= self.max_match:
            raise ValueError(f"{_GATE} <= min_match <= max_match must hold")

    def need(self, tokens: int) -> int:
        """How long a match with an item of so many tokens has to be."""
        return min(self.max_match, max(self.min_match, math.ceil(round(self.item_coverage * tokens, 6))))


def words(text: str) -> list[str]:
    """The tokens of a text."""
    low = text.lower()
    if len(low) == len(text):
        return re.findall(r"[^\W_]+", low)
    return [w.lower() for w in re.findall(r"[^\W_]+", text)]


class Automaton:
    """Generalised suffix automaton over token numbers.

    ``need`` is, for every state, the least match length that any item holding
    the state's strings asks for; ``inner`` the longest string of a state further
    up the suffix links that satisfies its own need.
    """

    def __init__(self, items: list[list[str]], limits: Limits, whole=()):
        self.whole = frozenset(whole)  # short items, that only match as a document
        self.vocabulary: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.need = [-1], [0], [1 << 30]
        grams = []
        for item in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in item]
            last, need = 0, limits.need(len(ids))
            for t in ids:
                last = self._extend(last, t)
                self.need[last] = min(self.need[last], need)
            grams.append(self._grams(np.array(ids, np.int64)))
        order = sorted(range(1, len(self.next)), key=lambda s: -self.length[s])
        for s in order:
            p = self.link[s]
            if p > 0:
                self.need[p] = min(self.need[p], self.need[s])
        self.inner = [0] * len(self.next)
        for s in reversed(order):
            p = self.link[s]
            if p > 0:
                self.inner[s] = self.length[p] if self.length[p] >= self.need[p] else self.inner[p]
        self.gate = np.zeros(1 << 20, bool)
        for g in grams:
            self.gate[g[g >= 0]] = True
        self.least = min((limits.need(len(i)) for i in items), default=limits.max_match)

    def _extend(self, last: int, t: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if t in nxt[last]:
            q = nxt[last][t]
            return q if length[q] == length[last] + 1 else self._split(last, t, q)
        new = self._state({}, length[last] + 1, 0)
        p = last
        while p >= 0 and t not in nxt[p]:
            nxt[p][t] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][t]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, t, q)
        return new

    def _split(self, p: int, t: int, q: int) -> int:
        clone = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(t) == q:
            self.next[p][t] = clone
            p = self.link[p]
        return clone

    def _state(self, nxt: dict[int, int], length: int, link: int) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        self.need.append(1 << 30)
        return len(self.next) - 1

    def _grams(self, ids: np.ndarray) -> np.ndarray:
        """Bitmap places of the four-grams, -1 where a token is in no item."""
        if len(ids) < _GATE:
            return np.zeros(0, np.int64)
        n = len(ids) - _GATE + 1
        h, known = np.zeros(n, np.uint64), np.ones(n, bool)
        for k in range(_GATE):
            part = ids[k : k + n]
            known &= part >= 0
            h = h * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return np.where(known, (h >> np.uint64(44)).astype(np.int64), -1)

    def matches(self, tokens: list[str]) -> tuple[list[tuple[int, int]], int]:
        """Spans ``(first, after last)`` to remove, disjoint and in order, and the longest match among them."""
        if self.whole and tuple(tokens) in self.whole:
            return [(0, len(tokens))], len(tokens)
        if len(tokens) < self.least:
            return [], 0
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in tokens), np.int64, len(tokens))
        place = self._grams(ids)
        edge = np.flatnonzero(np.diff((self.gate[place] & (place >= 0)).view(np.int8), prepend=0, append=0))
        spans, longest = [], 0
        for a, b in zip(edge[::2], edge[1::2]):
            if b - a + _GATE - 1 >= self.least:
                longest = max(longest, self._walk(ids[a : b + _GATE - 1].tolist(), int(a), spans))
        return spans, longest

    def _walk(self, ids: list[int], offset: int, spans: list) -> int:
        nxt, link, length, need, inner = self.next, self.link, self.length, self.need, self.inner
        state = size = longest = 0
        for i, t in enumerate(ids, offset):
            while state and t not in nxt[state]:
                state = link[state]
                size = length[state]
            if t in nxt[state]:
                state = nxt[state][t]
                size += 1
            found = size if size >= need[state] else inner[state]
            if found:
                longest = max(longest, found)
                first = i - found + 1
                while spans and spans[-1][1] >= first:
                    first = min(first, spans.pop()[0])
                spans.append((first, i + 1))
        return longest


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the tokens of the spans and the separators after them."""
    chunks = re.findall(r"[^\W_]+[\W_]*", text)
    out, at = [text[: len(text) - sum(map(len, chunks))]], 0
    for a, b in spans:
        out += chunks[at:a]
        at = b
    return "".join(out + chunks[at:])


def _automata(benchmark: DataFrame, limits: Limits) -> Iterator[Automaton]:
    """In parts: items are streamed to the driver, which holds one part of them at a time."""
    items, short, size = [], [], 0
    for row in benchmark.select("text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        item = words(row[0])
        if size and size + len(item) > limits.max_automaton_tokens:
            yield Automaton(items, limits, short)
            items, short, size = [], [], 0
        if len(item) >= limits.min_match:
            items.append(item)
        elif item:
            short.append(tuple(item))
        size += len(item)
    if items or short:
        yield Automaton(items, limits, short)


_REPORT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("removed_tokens", T.LongType()),
    T.StructField("n_spans", T.LongType()), T.StructField("longest_match", T.LongType()), T.StructField("dropped", T.BooleanType()), T.StructField("text", T.StringType()),
])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of several parts as ``Automaton.matches`` gives those of one: disjoint and in order, touching ones joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def _scan(texts: list[str | None], automaton: Automaton) -> Iterator[tuple]:
    """Tokens, longest match and spans of every text."""
    for text in texts:
        tokens = words(text or "")
        spans, longest = automaton.matches(tokens)
        yield len(tokens), longest, spans


def _spans(texts: DataFrame, parts: list) -> DataFrame:
    """``key, n, longest, spans`` of the texts that match, from rows ``key, text``; the spans, of all parts, as a flat list."""
    found = None
    for shared in parts:

        def scan(batches, shared=shared):
            for batch in batches:
                got = zip(batch.column(0).to_pylist(), _scan(batch.column(1).to_pylist(), shared.value))
                rows = [(k, n, longest, [x for s in spans for x in s]) for k, (n, longest, spans) in got if spans]
                if rows:
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["key", "n", "longest", "spans"])

        part = texts.mapInArrow(scan, "key string, n long, longest long, spans array<long>")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("key").agg(F.max("n").alias("n"), F.max("longest").alias("longest"), F.flatten(F.collect_set("spans")).alias("spans"))


def _judged(docs: DataFrame, benchmark: DataFrame, limits: Limits, give, schema, every: bool) -> DataFrame | None:
    """``give(batch, verdicts)`` for the documents, or for those that match alone; None if no item is left.

    A verdict is the tokens, removed tokens, spans, longest match, whether the document goes, and its text.
    With several parts the matches are looked up by a digest of the text, as they depend on nothing else.
    """
    parts = [docs.sparkSession.sparkContext.broadcast(a) for a in _automata(benchmark, limits)]
    if not parts:
        return None
    at, width, one = docs.columns.index("text"), len(docs.columns), parts[0] if len(parts) == 1 else None
    if one is None:
        key = max(docs.columns, key=len) + "_"
        text = F.col("text").cast("string")
        found = broadcast_if_small(materialize(_spans(docs.select(F.sha2(text, 256), text).where("text is not null"), parts)))
        found = found.toDF(*[key + "_" * k for k in range(4)])
        docs = docs.withColumn(key, F.sha2(text, 256)).join(found, key, "left" if every else "inner").select(*docs.columns, *found.columns[1:])

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            if one is not None:
                got = _scan(texts, one.value)
            else:
                got = ((n or 0, longest or 0, merged(list(zip(s[::2], s[1::2]))) if s else []) for n, longest, s in zip(*(batch.column(k).to_pylist() for k in range(width, width + 3))))
            verdicts = []
            for text, (n, longest, spans) in zip(texts, got):
                removed = sum(b - a for a, b in spans)
                verdicts.append((n, removed, len(spans), longest, bool(removed) and removed >= limits.doc_coverage * n, cut(text, spans) if spans else text))
            yield from give(batch.select(range(width)), verdicts)

    return docs.mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The contaminated documents: ``doc_id, n_tokens, removed_tokens, n_spans, longest_match, dropped`` and the text that is left."""

    def give(batch, verdicts):
        rows = [(i, *v) for i, v in zip(batch.column(0).to_pylist(), verdicts) if v[1]]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [*[pa.int64()] * 5, pa.bool_(), pa.string()])], names=_REPORT.names)

    found = _judged(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), benchmark, limits, give, _REPORT, every=False)
    return found if found is not None else docs.sparkSession.createDataFrame([], _REPORT)


def decontaminate(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The documents, in the columns they have, without matches and without those that are dropped."""
    at = docs.columns.index("text")

    def give(batch, verdicts):
        columns = batch.columns
        columns[at] = pa.array([v[5] for v in verdicts], batch.schema.field(at).type)
        yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array([not v[4] for v in verdicts], pa.bool_()))

    found = _judged(docs, benchmark, limits, give, docs.schema, every=True)
    return docs if found is None else found


def query(spark, sf_dir: str) -> DataFrame:
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH item AS (
  SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM benchmark WHERE text IS NOT NULL
), sized AS (
  SELECT item_id, t, least(13, greatest(8, CAST(ceil(round(0.8 * len(t), 6)) AS INTEGER))) AS n FROM item WHERE len(t) >= 8
), item_gram AS (
  SELECT item_id, n, p, array_to_string(t[p:p + n - 1], ' ') AS gram
  FROM (SELECT item_id, t, n, unnest(range(1, len(t) - n + 2)) AS p FROM sized)
), doc AS (
  SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents WHERE text IS NOT NULL
), doc_gram AS (
  SELECT doc_id, n, p, array_to_string(t[p:p + n - 1], ' ') AS gram
  FROM (SELECT doc_id, t, n, unnest(range(1, len(t) - n + 2)) AS p FROM doc, (SELECT DISTINCT n FROM sized))
), hit AS (
  SELECT doc_id, item_id, d.n, d.p AS dp, i.p AS ip FROM doc_gram d JOIN item_gram i ON d.n = i.n AND d.gram = i.gram
  UNION ALL SELECT doc_id, item_id, CAST(len(t) AS INTEGER), 1, 1 FROM doc JOIN item USING (t) WHERE len(t) BETWEEN 1 AND 7
), longest AS (
  SELECT doc_id, max(run) AS longest_match FROM (
    SELECT doc_id, n - 1 + count(*) AS run FROM (
      SELECT doc_id, item_id, n, dp, ip, dp - row_number() OVER (PARTITION BY doc_id, item_id, dp - ip ORDER BY dp) AS island FROM hit)
    GROUP BY doc_id, item_id, n, dp - ip, island)
  GROUP BY doc_id
), gone AS (
  SELECT doc_id, list_sort(list(DISTINCT q)) AS qs FROM (SELECT doc_id, unnest(range(dp, dp + n)) AS q FROM hit) GROUP BY doc_id
), cut AS (
  SELECT doc_id, text, t, qs, regexp_extract_all(text, '[\p{L}\p{N}]+[^\p{L}\p{N}]*') AS chunk,
         regexp_extract(text, '^[^\p{L}\p{N}]*') AS head
  FROM doc JOIN gone USING (doc_id)
)
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(qs) AS BIGINT) AS removed_tokens,
       CAST(len(list_filter(qs, lambda q: NOT list_contains(qs, q - 1))) AS BIGINT) AS n_spans,
       CAST(longest_match AS BIGINT) AS longest_match, len(qs) >= 0.6 * len(t) AS dropped,
       head || array_to_string(list_transform(list_filter(range(1, len(chunk) + 1), lambda i: NOT list_contains(qs, i)), lambda i: chunk[i]), '') AS text
FROM cut JOIN longest USING (doc_id)
"""
