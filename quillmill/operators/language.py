"""Language detection by stop words, script mixture, and the language filter.

The languages' lists are sets of twenty words; of equal scores the language that
comes first in ``LANGUAGES`` wins. A plug-in model can take the place of the word
lists (``detect_with``). Words are counted in Arrow batches, the twins count in SQL.

Null counts as empty; repeated rows are detected alike; an empty table gives an empty one; columns
named like one of the result are replaced.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from quillmill.config import LanguageConfig
from quillmill.functions.dialect import BLANK, PUNCT, Dialect, Layers
from quillmill.functions.measures import PUNCTUATION

LANGUAGES = {
    "en": "a and are as at be for in is it of on or that the this to was with you",
    "es": "al con da de el en es la le lo no para por que se son su te un y",
    "fr": "avec avoir ce dans de en et il le ne pour que se son sur un une à être",
    "de": "als auf das dem den der des die ein eine für im in ist mit nicht sich und von zu",
    "it": "al che con da degli del della di il in la le lo non per si sulla un una è",
    "pt": "a com da de do e em mais na no não o os para por que se um uma é",
    "ru": "а быть в все да его и к на не но он она по с так ты у это я",
}
NAMES = dict(
    zip(
        "ar cs da de en es fi fr hi hu id it ja ko ms nl no pl pt ro ru sk sv sw th tl vi zh".split(),
        "Arabic Czech Danish German English Spanish Finnish French Hindi Hungarian Indonesian Italian Japanese Korean Malay Dutch Norwegian Polish Portuguese Romanian Russian Slovak Swedish Swahili Thai Filipino Vietnamese Chinese".split(),
    )
)
CODES = {v: k for k, v in NAMES.items()}


def name_of(code: str) -> str:
    return NAMES.get(code, "Unknown")


def code_of(name: str) -> str:
    return CODES.get(name, "unknown")


def is_code(code: str) -> bool:
    return len(code) == 2 and all("a" <= c <= "z" for c in code)


def confidence_for_length(confidence: float, length: int) -> float:
    """Short texts are less certain."""
    return confidence * next((f for most, f in ((20, 0.5), (50, 0.7), (100, 0.9)) if length < most), 1.0)


def clean(d: Dialect, x: str) -> str:
    """Without web and mail addresses; the mail expression is only tried where there is an ``@``."""
    x = d.sub(x, f"https?://[^{BLANK}]+|www[.][^{BLANK}]+", " ")
    return d.blanks(f"CASE WHEN contains({x}, '@') THEN {d.sub(x, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+[.][a-zA-Z]{2,}', ' ')} ELSE {x} END")


def _detect(d: Dialect, x: str) -> list[dict]:
    word = d.map(d.all(d.lower(x), f"[^{BLANK}]+"), "w", d.sub("w", f"[{PUNCT}]+", ""))
    count = {f"c_{k}": d.size(d.keep("lw", "w", d.has_item(d.array([d.text(w) for w in v.split()]), "w"))) for k, v in LANGUAGES.items()}
    best = "CASE " + " ".join(f"WHEN s_{k} = top_score THEN '{k}'" for k in LANGUAGES) + " END"
    return [
        *([] if d.name == "spark" else [{"lw": word, "len_b": d.octets(x)}, {**count, "n_lw": d.size("lw")}]),
        {f"s_{k}": d.ratio(f"c_{k}", "n_lw") for k in LANGUAGES}, {"top_score": f"greatest({', '.join(f's_{k}' for k in LANGUAGES)})"},
        {"language": f"CASE WHEN len_b < 10 OR top_score = 0 THEN 'unknown' ELSE {best} END", "confidence": f"CASE WHEN len_b < 10 THEN {d.number('0')} ELSE least({d.number('1')}, top_score * 2) END"},
    ]


_KNOWN = {w: [k for k, v in LANGUAGES.items() if w in v.split()] for v in LANGUAGES.values() for w in v.split()}
_OF_WORD = {w.encode(): tuple(list(LANGUAGES).index(k) for k in ks) for w, ks in _KNOWN.items()}
_URL = re.compile(rb"https?://[^ \t\n\x0b\f\r]+|www[.][^ \t\n\x0b\f\r]+")
_MAIL = re.compile(rb"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+[.][a-zA-Z]{2,}")


def count_words(text: str | None, cleaned: bool) -> tuple:
    """The bytes of the text, cleaned or as it is, whether it mixes scripts, its words, and how many of each language's list."""
    b = (text or "").encode()
    if cleaned:
        if b"://" in b or b"www." in b:
            b = _URL.sub(b" ", b)
        pieces = b.split()
        if b"@" in b:
            pieces = b" ".join(_MAIL.sub(b" ", w) if b"@" in w else w for w in pieces).split()
        b = b" ".join(pieces)
    pieces = b.lower().split()
    found = [0] * len(LANGUAGES)
    for word, n in Counter(w.translate(None, PUNCTUATION) for w in pieces).items():
        for k in _OF_WORD.get(word, ()):
            found[k] += n
    return len(b), not b.isascii() and any(c in _LETTERS for c in b), len(pieces), *found


_LETTERS = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_COUNTS = ("len_b", "mixed_b", "n_lw", *(f"c_{k}" for k in LANGUAGES))


def _counted(cleaned: bool):
    """A function that adds the counts of the text to a frame."""

    @F.pandas_udf(T.StructType([T.StructField(n, T.BooleanType() if n == "mixed_b" else T.IntegerType()) for n in _COUNTS]))
    def run(text: pd.Series) -> pd.DataFrame:
        rows = [count_words(t, cleaned) for t in text]
        return pd.DataFrame({n: np.array(c, bool if n == "mixed_b" else np.int32) for n, c in zip(_COUNTS, zip(*rows) if rows else [[]] * len(_COUNTS))})

    def add(docs: DataFrame) -> DataFrame:
        own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in _COUNTS]
        return docs.select(*own, run(F.col("text").cast("string")).alias("__words")).select(*own, "__words.*")

    return add


DETECT = Layers(lambda d: [{"t": "coalesce(text, '')"}, *_detect(d, "t")], ["doc_id", "language", "round(confidence, 6) AS confidence"], prepare=_counted(False))


def mixed_scripts(d: Dialect, x: str) -> str:
    """An ASCII letter and a byte from 0xC0: any accented Latin text counts."""
    return "mixed_b" if d.name == "spark" else f"({d.has(x, '[A-Za-z]')} AND {d.octets(x)} > {d.chars(x)})"


def language_filter(config: LanguageConfig = LanguageConfig()) -> Layers:
    """``language, confidence, decision``; too short and mixed texts aren't detected."""
    wanted = ", ".join(f"'{t}'" for t in config.targets)

    def layers(d: Dialect) -> list[dict]:
        out = [{"t": "coalesce(text, '')"}, {} if d.name == "spark" else {"x": clean(d, "t") if config.preprocess else "t"}, *_detect(d, "x")]
        mixed = mixed_scripts(d, "x") if config.reject_mixed else "FALSE"
        keep = f"confidence >= {config.min_confidence}" + (f" AND language IN ({wanted})" if wanted else "")
        return [*out, {"decision": f"CASE WHEN {d.octets('t')} < {config.min_length} THEN 'too_short' WHEN {mixed} THEN 'mixed' WHEN {keep} THEN 'keep' ELSE 'reject' END"}]

    undetected = "decision IN ('too_short', 'mixed')"
    return Layers(layers, ["doc_id", f"CASE WHEN {undetected} THEN NULL ELSE language END AS language", f"CASE WHEN {undetected} THEN NULL ELSE round(confidence, 6) END AS confidence", "decision"], prepare=_counted(config.preprocess))


FILTER = language_filter()


def detect_with(docs: DataFrame, model, config: LanguageConfig = LanguageConfig()) -> DataFrame:
    """``doc_id, language, confidence, decision`` of a model: a function of the text column that gives a struct ``(language, confidence)``.

    With None for a model every language is ``unknown`` and the confidence 0, as for texts that are too short.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    said = model(text) if model else F.struct(F.lit("unknown").alias("language"), F.lit(0.0).alias("confidence"))
    rows = docs.select("doc_id", (F.octet_length(text) < config.min_length).alias("__short"), said.alias("__said"))
    rows = rows.select("doc_id", "__short", F.when(F.col("__short"), "unknown").otherwise(F.coalesce("__said.language", F.lit("unknown"))).alias("language"), F.when(F.col("__short"), 0.0).otherwise(F.coalesce("__said.confidence", F.lit(0.0))).alias("confidence"))
    wanted = F.col("language").isin(*config.targets) if config.targets else F.lit(True)
    decision = F.when(F.col("__short"), "too_short").when((F.col("confidence") >= config.min_confidence) & wanted, "keep").otherwise("reject")
    return rows.select("doc_id", "language", "confidence", decision.alias("decision"))


def statistics(docs: DataFrame) -> DataFrame:
    """Documents and mean confidence by detected language."""
    return DETECT.spark(docs).groupBy("language").agg(F.count("*").alias("documents"), F.round(F.avg("confidence"), 4).alias("mean_confidence"))


def stats_sql() -> str:
    return f"SELECT language, count(*) AS documents, round(avg(confidence), 4) AS mean_confidence FROM ({DETECT.duck('documents')}) GROUP BY language"
