"""Model-based quality: the surface that models plug into, and the closed-form stand-ins behind it.

No trained model comes with these operators: "perplexity" is a rule over digits,
symbols and repeated ten-grams, the "classifier" counts indicator words. A real model
is any function from a text column to a struct ``(score, confidence)``; see ``Registry``.
Texts under ten bytes have no repeated ten-gram. Null counts as empty.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T_

from quillmill.functions import text as T
from quillmill.functions.dialect import BLANK, Dialect, Layers
from quillmill.operators.quality import WITH_BYTES, with_bytes

GOOD = "analysis approach conclusion discussion evidence experiment findings framework investigation literature methodology research results study".split()
BAD = "amazing click easy free guaranteed hack instant lose money quick secret shocking simple trick unbelievable weight win".split()
WEIGHTS, CONFIDENCES = {"perplexity": 1.0, "keyword": 1.5, "encoder": 2.0}, {"perplexity": 0.8, "keyword": 0.7, "encoder": 0.9}
MAX_PERPLEXITY, STAGES = 50.0, (("keyword", 0.3), ("perplexity", 0.7))


_DIGITS, _BLANKS = b"0123456789", b" \t\n\x0b\f\r"
_PLAIN = _DIGITS + _BLANKS + bytes(range(65, 91)) + bytes(range(97, 123))
_GOOD, _BAD = ([w.encode() for w in words] for words in (GOOD, BAD))


def _repeats(low: bytes) -> int:
    """Ten-byte stretches less the distinct ones: the closed form of counting those that occur again."""
    n = len(low) - 9
    if n < 2:
        return 0
    power = [np.uint64(pow(1_000_003, k, 1 << 64)) for k in (1, 2, 4, 8)]
    one = np.frombuffer(low, np.uint8).astype(np.uint64)
    two = one[:-1] + one[1:] * power[0]
    four = two[:-2] + two[2:] * power[1]
    h = four[:n] + four[4 : 4 + n] * power[2] + two[8 : 8 + n] * power[3]
    h ^= h >> np.uint64(31)
    h.sort()
    return n - 1 - int(np.count_nonzero(h[1:] != h[:-1]))


@F.pandas_udf(T_.LongType())
def repeated_grams(text: pd.Series) -> pd.Series:
    """``_repeats`` of the text with ASCII letters in lower case."""
    return pd.Series([_repeats(t.encode().lower()) if t else 0 for t in text], dtype=np.int64)


#: What the scores need of a text, counted in one pass: bytes, digits, symbols, sentence ends, bytes with runs of blanks as one, indicator words, repeated ten-grams.
_COUNTS = ("n", "digit_n", "symbol_n", "stops", "collapsed_n", "good", "bad", "repeats")


@F.pandas_udf(T_.StructType([T_.StructField(k, T_.LongType()) for k in _COUNTS]))
def _counted(text: pd.Series) -> pd.DataFrame:
    rows = np.zeros((len(text), len(_COUNTS)), np.int64)
    for k, t in enumerate(text):
        if t:
            b = t.encode()
            low = b.lower()
            pieces = b.split()
            blanks = len(pieces) - 1 + (b[0] in _BLANKS) + (b[-1] in _BLANKS) if pieces else 1
            rows[k] = (
                len(b), len(b) - len(b.translate(None, _DIGITS)), len(b.translate(None, _PLAIN)), b.count(b".") + b.count(b"!") + b.count(b"?"),
                sum(map(len, pieces)) + blanks, sum(w in low for w in _GOOD), sum(w in low for w in _BAD), _repeats(low),
            )
    return pd.DataFrame(rows, columns=_COUNTS)


def _n(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def _keyword(d: Dialect, x: str, low: str, out: str, counted: tuple = ()) -> list[dict]:
    """``counted``: columns that have the sentence ends, the bytes and the numbers of either kind of words."""
    stops, length, good, bad = counted or (T.sentences(d, x), d.octets(x), d.how_many(low, GOOD), d.how_many(low, BAD))
    mean = f"CAST(floor({length} / {_n('1')} / greatest(1, {stops})) AS BIGINT)"
    score = (
        f"{_n('0.5')} + ({good} * {_n('0.05')} - {bad} * {_n('0.1')}) + (CASE WHEN {length} > 500 THEN {_n('0.1')} ELSE {_n('0')} END)"
        f" - (CASE WHEN {length} < 50 THEN {_n('0.2')} ELSE {_n('0')} END) + (CASE WHEN {stops} > 0 AND {mean} > 20 AND {mean} < 200 THEN {_n('0.1')} ELSE {_n('0')} END)"
    )
    return [{out: f"greatest({_n('0')}, least({_n('1')}, round({score}, 9)))"}]


def _scores(d: Dialect) -> list[dict]:
    """Needs ``repeats``; for Spark ``__m``, the counts."""
    total = " + ".join(f"{_n(WEIGHTS[m] * 1000)} / 1000 * {_n(CONFIDENCES[m])}" for m in WEIGHTS)
    mixed = " + ".join(f"{_n(WEIGHTS[m])} * {_n(CONFIDENCES[m])} * {m}_score" for m in WEIGHTS)
    stages = "CASE " + " ".join(f"WHEN round({m}_score, 9) < {t} THEN {k}" for k, (m, t) in enumerate(STAGES)) + " ELSE -1 END"
    if d.name == "spark":
        # indicator words have no blanks and blanks are no sentence ends: their numbers are the same with blanks collapsed
        counts = [{k: f"__m.{k}" for k in _COUNTS}, {f"{k}_ratio": d.ratio(f"{k}_n", "n") for k in ("digit", "symbol")}]
        words = ("stops", "collapsed_n", "good", "bad"), ("stops", "n", "good", "bad")
    else:
        counts, words = [T.base(d), {**T.bytes_of(d), "low": d.lower("t")}, {**T.ratios(d), "collapsed": d.sub("low", f"[{BLANK}]+", " ")}], ((), ())
    return [
        *counts,
        {"perplexity": f"CASE WHEN n = 0 THEN {_n('10')} ELSE {_n('10')} + digit_ratio * 50 + symbol_ratio * 30 + repeats * {_n('2')} END"},
        {"perplexity_score": f"greatest({_n('0')}, 1 - perplexity / {_n(MAX_PERPLEXITY)})"}, *_keyword(d, "collapsed", "collapsed", "keyword_score", words[0]), *_keyword(d, "t", "low", "encoder_score", words[1]),
        {"ensemble_score": f"({mixed}) / ({total})", "rejected_at": stages},
        {"result": "CASE WHEN rejected_at >= 0 OR round(ensemble_score, 9) < 0.5 THEN 'REJECT' ELSE 'KEEP' END"},
    ]


_R = lambda *names: [f"round({n}, 6) AS {n}" for n in names]
SCORES = Layers(_scores, ["doc_id", *_R("perplexity", "perplexity_score", "keyword_score", "encoder_score", "ensemble_score"), "rejected_at", "result"])
_HEX = "hex(encode(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')))"
_COUNTED = f"SELECT doc_id, count(*) - count(DISTINCT g) AS r FROM (SELECT doc_id, substr(h, 2 * p - 1, 20) AS g FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 - 8)) AS p FROM (SELECT doc_id, {_HEX} AS h FROM documents WHERE strlen(text) >= 10))) GROUP BY doc_id"
#: DuckDB's documents with ``repeats``.
GRAMS = f"(SELECT d.*, coalesce(r, 0) AS repeats FROM documents d LEFT JOIN ({_COUNTED}) USING (doc_id))"


def scores(docs: DataFrame) -> DataFrame:
    """The models' scores, the ensemble and the decision in stages; ``rejected_at`` is the stage, -1 for none."""
    return SCORES.spark(docs.select("doc_id", _counted(F.col("text").cast("string")).alias("__m")))


def single_stage(docs: DataFrame, threshold: float = STAGES[0][1]) -> DataFrame:
    """``doc_id, ensemble_score, result``: one decision, by the first model's threshold."""
    return scores(docs).select("doc_id", "ensemble_score", F.when(F.col("ensemble_score") >= threshold, "KEEP").otherwise("REJECT").alias("result"))


def window_perplexities(text: str | None, size: int, stride: int) -> list[float]:
    """The perplexity rule on every stretch of ``size`` bytes, from 0 on every ``stride``, that fits; none for a shorter text."""
    b = np.frombuffer((text or "").encode(), np.uint8)
    n = len(b)
    if n < size:
        return []
    digit = (b >= 48) & (b <= 57)
    alpha = ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122))
    symbol = ~(digit | alpha | np.isin(b, list(b" \t\n\x0b\f\r")))
    digits, symbols = (np.concatenate([[0], np.cumsum(m)]) for m in (digit, symbol))
    low = np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint64)
    h = np.zeros(max(0, n - 9), np.uint64)
    for k in range(10):
        h += low[k : k + len(h)] * np.uint64(pow(1_000_003, k, 1 << 64))
    h ^= h >> np.uint64(31)
    out = []
    for at in range(0, n - size + 1, stride):
        own = h[at : at + max(0, size - 9)]
        repeats = len(own) - len(np.unique(own))
        out.append(10 + 50 * int(digits[at + size] - digits[at]) / size + 30 * int(symbols[at + size] - symbols[at]) / size + 2.0 * repeats)
    return out


def sliding_perplexity(docs: DataFrame, size: int = 512, stride: int = 256) -> DataFrame:
    """``doc_id, windows, mean_perplexity, max_perplexity`` over the windows of a text; nulls where none fits."""

    @F.pandas_udf(T_.ArrayType(T_.DoubleType()))
    def run(text: pd.Series) -> pd.Series:
        return pd.Series([window_perplexities(t, size, stride) for t in text])

    made = docs.select("doc_id", run(F.col("text").cast("string")).alias("p"))
    mean = F.when(F.size("p") > 0, F.aggregate("p", F.lit(0.0), lambda s, x: s + x) / F.size("p"))
    return made.select("doc_id", F.size("p").alias("windows"), F.round(mean, 6).alias("mean_perplexity"), F.round(F.array_max("p"), 6).alias("max_perplexity"))


def sliding_sql(size: int = 512, stride: int = 256) -> str:
    return f"""
WITH b AS (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS b, hex(encode(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS low FROM documents WHERE strlen(text) >= {size}),
w AS (SELECT doc_id, b[p + 1:p + {size}] AS b, substr(low, 2 * p + 1, {2 * size}) AS low, p FROM (SELECT *, unnest(range(0, len(b) - {size} + 1, {stride})) AS p FROM b)),
v AS (SELECT doc_id, 10 + 50 * len(list_filter(b, lambda x: x BETWEEN '30' AND '39')) / CAST({size} AS DOUBLE)
  + 30 * len(list_filter(b, lambda x: NOT (x BETWEEN '30' AND '39' OR x BETWEEN '41' AND '5A' OR x BETWEEN '61' AND '7A' OR x IN ('20', '09', '0A', '0B', '0C', '0D')))) / CAST({size} AS DOUBLE)
  + 2.0 * ({size - 9} - len(list_distinct(list_transform(range(0, {size - 9}), lambda k: substr(low, 2 * k + 1, 20))))) AS perplexity FROM w),
s AS (SELECT doc_id, CAST(count(*) AS INT) AS windows, round(avg(perplexity), 6) AS mean_perplexity, round(max(perplexity), 6) AS max_perplexity FROM v GROUP BY doc_id)
SELECT doc_id, coalesce(windows, 0) AS windows, mean_perplexity, max_perplexity FROM documents LEFT JOIN s USING (doc_id)"""


def _features(d: Dialect) -> list[dict]:
    plain = d.all("t", f"[^{BLANK}]+")
    return [
        T.base(d), {**T.bytes_of(d), "plain": plain, "stops": T.sentences(d)},
        {**T.ratios(d), "word_count": d.count("t", " ") + " + 1", "punct_n": d.letters("t", r"!-/:-@\[-`{-~"), "pauses": d.count("t", "[,;:]")},
        {
            "mean_sentence": d.ratio("word_count", "stops"), "punct_ratio": d.ratio("punct_n", "n"), "richness": d.ratio(d.size(d.distinct("plain")), d.size("plain")), "complexity": d.ratio("pauses", "stops"),
            "bert_tokens": f"least(510, {d.size('plain')})",
        },
        {"readability": f"CASE WHEN stops = 0 THEN {_n('0')} WHEN mean_sentence <= 8 THEN {_n('0.9')} WHEN mean_sentence <= 15 THEN {_n('0.7')} WHEN mean_sentence <= 25 THEN {_n('0.5')} ELSE {_n('0.3')} END"},
    ]


FEATURES = Layers(_features, ["doc_id", "word_count", "stops AS sentence_count", "n AS char_count", *_R("mean_sentence", "alpha_ratio", "digit_ratio", "punct_ratio", "entropy", "richness", "complexity", "readability"), "bert_tokens"])


def features(docs: DataFrame) -> DataFrame:
    return FEATURES.spark(with_bytes(docs))


def unigram_perplexity(docs: DataFrame) -> DataFrame:
    """``doc_id, perplexity`` of a text under the frequencies of its own words, 0 without words."""
    from quillmill.functions.dialect import SPARK

    listed = docs.selectExpr("doc_id", f"{SPARK.words('text')} AS w")
    counts = listed.select("doc_id", F.size("w").alias("n"), F.explode("w").alias("w")).groupBy("doc_id", "n", "w").agg(F.count("*").alias("c"))
    sums = counts.groupBy("doc_id").agg(F.exp(-F.sum(F.col("c") * F.ln(F.col("c") / F.col("n"))) / F.first("n")).alias("p"))
    return docs.select("doc_id").join(sums, "doc_id", "left").select("doc_id", F.round(F.coalesce("p", F.lit(0.0)), 4).alias("perplexity"))


def unigram_sql() -> str:
    from quillmill.functions.dialect import DUCK

    return f"""
WITH w AS (SELECT doc_id, len(w) AS n, unnest(w) AS w FROM (SELECT doc_id, {DUCK.words('text')} AS w FROM documents)), c AS (SELECT doc_id, n, w, count(*) AS c FROM w GROUP BY ALL),
s AS (SELECT doc_id, exp(-sum(c * ln(c / n)) / min(n)) AS p FROM c GROUP BY doc_id)
SELECT doc_id, round(coalesce(p, 0), 4) AS perplexity FROM documents LEFT JOIN s USING (doc_id)"""


def accuracy(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Share of the labelled documents on whose quality each model agrees (score over one half)."""
    found = scores(docs).join(labels.select("doc_id", "quality"), "doc_id")
    return found.agg(F.count("*").alias("labelled"), *(F.round(F.avg(((F.col(f"{m}_score") > 0.5) == (F.col("quality") == 1)).cast("double")), 6).alias(m) for m in (*WEIGHTS, "ensemble")))


def accuracy_sql() -> str:
    means = ", ".join(f"round(avg(CAST(({m}_score > 0.5) = (quality = 1) AS DOUBLE)), 6) AS {m}" for m in (*WEIGHTS, "ensemble"))
    return f"SELECT count(*) AS labelled, {means} FROM ({SCORES.duck(GRAMS)}) JOIN labels USING (doc_id)"


def statistics(docs: DataFrame) -> DataFrame:
    """Documents, kept, mean perplexity by decile of the ensemble score."""
    bin_of = F.least(F.lit(9), F.floor(F.col("ensemble_score") * 10)).cast("int")
    return scores(docs).groupBy(bin_of.alias("bin")).agg(F.count("*").alias("documents"), F.count_if(F.col("result") == "KEEP").alias("kept"), F.round(F.avg("perplexity"), 3).alias("mean_perplexity"))


def stats_sql() -> str:
    return f"SELECT CAST(least(9, floor(ensemble_score * 10)) AS INT) AS bin, count(*) AS documents, count(*) FILTER (result = 'KEEP') AS kept, round(avg(perplexity), 3) AS mean_perplexity FROM ({SCORES.duck(GRAMS)}) GROUP BY 1"


class Registry:
    """Models by name; each is a function of the text column that gives a struct with ``score`` and ``confidence``."""

    def __init__(self):
        self._models: dict[str, tuple[Callable[[Column], Column], float]] = {}

    def add(self, name: str, model: Callable[[Column], Column], weight: float = 1.0) -> None:
        self._models[name] = (model, weight)

    def remove(self, name: str) -> None:
        self._models.pop(name, None)

    def names(self) -> list[str]:
        return list(self._models)

    def predict(self, docs: DataFrame) -> DataFrame:
        """``doc_id``, each model's score and the ensemble, weighted by weight and confidence; 0 with no model."""
        made = docs.select("doc_id", *(m(F.col("text")).alias(f"__{n}") for n, (m, _) in self._models.items()))
        total = sum((F.col(f"__{n}.confidence") * w for n, (_, w) in self._models.items()), F.lit(0.0))
        mixed = sum((F.col(f"__{n}.score") * F.col(f"__{n}.confidence") * w for n, (_, w) in self._models.items()), F.lit(0.0))
        return made.select("doc_id", *(F.col(f"__{n}.score").alias(n) for n in self._models), F.when(total > 0, mixed / total).otherwise(0.0).alias("ensemble_score"))
