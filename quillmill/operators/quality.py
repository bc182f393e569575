"""Quality filters: length, gibberish, repetition, format, metadata, and the processor that combines them.

What is counted in a text comes from one pass in Arrow batches (``functions.measures``); the twins
count in SQL. The decisions are expressions that both share.

Every filter adds ``result``, ``confidence`` and its metrics; violations are counted
into the confidence. Format, metadata and the combination follow definitions of this
engine, since only their interfaces are given; they are labelled so below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillmill.config import FormatConfig, GibberishConfig, LengthConfig, QualityConfig, RepetitionConfig
from quillmill.functions import text as T
from quillmill.functions.bytes import BYTE_STATS_SQL, byte_stats
from quillmill.functions.dialect import BLANK, PUNCT, Dialect, Layers
from quillmill.functions.measures import FIELDS, measures

#: DuckDB's documents with byte statistics.
WITH_BYTES = f"(SELECT d.*, coalesce(entropy, 0) AS entropy, coalesce(top_byte, 0) AS top_byte, coalesce(longest_run, 0) AS longest_run FROM documents d LEFT JOIN ({BYTE_STATS_SQL}) USING (doc_id))"


def with_bytes(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__b", byte_stats("text")).select("*", "__b.entropy", "__b.top_byte", "__b.longest_run").drop("__b")


def _num(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def _times(*factors: tuple[str, str]) -> str:
    return " * ".join(f"(CASE WHEN {c} THEN {_num(f)} ELSE {_num('1')} END)" for c, f in factors)


def _violations(names: list[str]) -> str:
    return " + ".join(f"CAST({n} AS INT)" for n in names)


# length

def length_layers(d: Dialect, c: LengthConfig) -> list[dict]:
    either, both = ("OR", "OR") if c.strict else ("AND", "AND")
    return [
        {"word_count": "n_words", "char_count": "solid_n"},
        {"too_short": f"word_count < {c.min_words} {either} char_count < {c.min_chars}", "too_long": f"word_count > {c.max_words} {both} char_count > {c.max_chars}"},
        {"length_result": "CASE WHEN too_short OR too_long THEN 'REJECT' ELSE 'KEEP' END", "length_reason": "CASE WHEN too_short THEN 'TOO_SHORT' WHEN too_long THEN 'TOO_LONG' ELSE 'CUSTOM' END",
         "length_confidence": f"CASE WHEN too_short OR too_long THEN {_num('0.95')} WHEN word_count < 20 THEN {_num('0.8')} WHEN word_count > 10000 THEN {_num('0.9')} ELSE {_num('1')} END"},
    ]


# gibberish

_GIBBERISH = (
    "[a-zA-Z]{50,}", "[0-9]{50,}", r"[!@#$%^&*()_+={}\[\]|\\:\x22;\x27<>?,./]{10,}", "[b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z]{10,}", r"\b[a-zA-Z]{2,}[0-9]+[a-zA-Z]{2,}\b",
)


def gibberish_counts(d: Dialect) -> list[dict]:
    return [{
        "vowel_n": d.letters("t", "AEIOUaeiou"), "word_bytes": d.total(d.map("words", "w", f"CAST({d.octets('w')} AS BIGINT)")), "long_words": d.size(d.keep("words", "w", f"{d.octets('w')} > 20")),
        "pattern_text": "(" + " OR ".join(d.has("t", p) for p in _GIBBERISH) + ")",
    }]


def gibberish_layers(d: Dialect, c: GibberishConfig) -> list[dict]:
    return [
        *([] if d.name == "spark" else gibberish_counts(d)),
        {
            "repetition_ratio": f"CASE WHEN n < 10 THEN {_num('0')} ELSE CAST(top_byte AS DOUBLE) / n END",
            "vowel_ratio": f"CASE WHEN alpha_n > vowel_n THEN CAST(vowel_n AS DOUBLE) / (alpha_n - vowel_n) WHEN vowel_n > 0 THEN {_num('999')} ELSE {_num('0')} END",
            "mean_word": d.ratio("word_bytes", "n_words"), "long_share": d.ratio("long_words", "n_words"),
            "pattern": "(pattern_text OR longest_run > 20)",
        },
        {
            "v_alpha": f"alpha_ratio < 1 - {_num(str(c.max_non_alpha))}", "v_digit": f"digit_ratio > {c.max_digit}", "v_symbol": f"symbol_ratio > {c.max_symbol}", "v_repeat": f"repetition_ratio > {c.max_repetition}",
            "v_run": f"longest_run > {c.max_run}", "v_entropy": f"entropy < {c.min_entropy}", "v_pattern": "pattern",
            "v_linguistic": "NOT (vowel_ratio >= 0.1 AND vowel_ratio <= 2.0 AND n_words > 0 AND mean_word >= 2.0 AND mean_word <= 15.0 AND long_share < 0.1)",
        },
        {"gibberish_k": f"CASE WHEN n = 0 THEN 0 ELSE {_violations(['v_alpha', 'v_digit', 'v_symbol', 'v_repeat', 'v_run', 'v_entropy', 'v_pattern', 'v_linguistic'])} END"},
        {"gibberish_result": "CASE WHEN gibberish_k > 0 THEN 'REJECT' ELSE 'KEEP' END",
         "gibberish_confidence": f"CASE WHEN n = 0 THEN {_num('1')} WHEN gibberish_k > 0 THEN least({_num('0.95')}, {_num('0.5')} + gibberish_k * {_num('0.1')}) ELSE {_times(('alpha_ratio < 0.7', '0.95'), ('entropy < 3.0', '0.9'), ('repetition_ratio > 0.2', '0.9'))} END"},
    ]


# repetition

_BOILER = (
    r"(?i)\bcopyright\b.*\ball rights reserved\b", r"(?i)\b(cookie policy|privacy policy|terms of service)\b", r"(?i)\bclick here\b.*\bmore information\b",
    r"(?i)\bsubscribe\b.*\bnewsletter\b", r"(?i)\bfollow us\b.*\bsocial media\b", r"(?i)\b(created|designed|powered) by\b",
)


def repetition_counts(d: Dialect, c: RepetitionConfig) -> list[dict]:
    shape = "l"
    for pattern, to in (("[^\\x00-\\x7F]", "X"), ("[A-Za-z]", "A"), ("[0-9]", "9"), (f"[{PUNCT}]", "X")):
        shape = d.sub(shape, pattern, to)
    counts = lambda xs: f"(SELECT {{'rep': CAST(coalesce(sum(k) FILTER (k > 1), 0) AS INT), 'top': CAST(coalesce(max(k), 0) AS INT)}} FROM (SELECT count(*) AS k FROM (SELECT unnest({xs}) AS v) GROUP BY v))"
    return [
        {
            "clean_lines": d.keep(d.map("line_list", "l", d.blanks("l")), "l", "l <> ''"), "shapes": d.keep(d.map("line_list", "l", d.blanks(shape)), "l", "l <> ''"),
            "word_grams": d.windows("words", c.ngram), "unique_words": d.size(d.distinct("words")), "unique_low": d.size(d.distinct(d.map("words", "w", d.lower("w")))),
            "common": "(" + " OR ".join(d.has("t", p) for p in _BOILER) + ")",
        },
        {"line_c": counts("clean_lines"), "gram_c": counts("word_grams"), "shape_c": counts("shapes")},
        {"line_n": d.size("clean_lines"), "line_rep": "line_c.rep", "gram_n": d.size("word_grams"), "gram_rep": "gram_c.rep", "shape_top": "shape_c.top"},
    ]


def repetition_layers(d: Dialect, c: RepetitionConfig) -> list[dict]:
    return [
        *([] if d.name == "spark" else repetition_counts(d, c)),
        {
            "line_repetition": d.ratio("line_rep", "line_n"), "ngram_repetition": d.ratio("gram_rep", "gram_n"), "unique_ratio": d.ratio("unique_words", "n_words"), "diversity": d.ratio("unique_low", "n_words"),
            "template": f"n > 0 AND n_lines >= 5 AND shape_top > {_num('0.3')} * n_lines",
        },
        {"boilerplate_score": f"least({_num('1')}, (CASE WHEN common THEN {_num('0.3')} ELSE {_num('0')} END) + line_repetition * {_num('0.4')} + (CASE WHEN diversity < 0.3 THEN ({_num('0.3')} - diversity) * 2 ELSE {_num('0')} END) + (CASE WHEN template THEN {_num('0.2')} ELSE {_num('0')} END))"},
        {"r_line": f"line_repetition > {c.max_line}", "r_gram": f"ngram_repetition > {c.max_ngram}", "r_unique": f"unique_words < {c.min_unique_words} OR unique_ratio < {c.min_unique_ratio}", "r_boiler": f"boilerplate_score > {c.max_boilerplate}"},
        {"repetition_k": f"CASE WHEN n = 0 THEN 0 ELSE {_violations(['r_line', 'r_gram', 'r_unique', 'r_boiler', 'template'])} END"},
        {"repetition_result": "CASE WHEN repetition_k > 0 THEN 'REJECT' ELSE 'KEEP' END",
         "repetition_confidence": f"CASE WHEN n = 0 THEN {_num('1')} WHEN repetition_k > 0 THEN least({_num('0.95')}, {_num('0.6')} + repetition_k * {_num('0.1')}) ELSE {_times(('line_repetition > 0.2', '0.9'), ('unique_ratio < 0.5', '0.9'), ('diversity < 0.3', '0.85'))} END"},
    ]


# format (a definition of this engine)

_CODE = (r"\b(class|const|def|from|function|import|let|var)\b", r"\{[^}]*\}", r"\([^)]*\)[ \t\n]*\{", "#define|#ifdef|#include", r"\b(private|protected|public|static)\b", "[a-zA-Z_][a-zA-Z0-9_]*[ \\t\\n]*=[ \\t\\n]*[^;]+;")
_BULLET = f"^[{BLANK}]*(?:[-*•◦▪▫‣⁃]|[0-9]+[.)])[{BLANK}]+"


def format_counts(d: Dialect) -> list[dict]:
    return [{
        "tag_bytes": f"n - {d.octets(d.sub('t', '<[a-zA-Z/!][^>]*>', ''))}", "tag_count": d.count("t", "<[a-zA-Z/!][^>]*>"),
        "code_lines": d.size(d.keep("line_list", "l", d.has("l", f"[;{{}}][{BLANK}]*$|^[{BLANK}]*(?:#include|#define|import |from [a-z.]+ import|def |class |function )"))),
        "list_lines": d.size(d.keep("line_list", "l", d.has("l", _BULLET))), "open_lines": d.size(d.keep("line_list", "l", f"l <> '' AND NOT {d.has('l', '[.!?:;\\x22\\x27)][ \\t\\r]*$')}")),
        "code_pattern": "(" + " OR ".join(d.has("t", p) for p in _CODE) + ")",
        "error_page": d.has("t", r"(?i)\b(404 not found|403 forbidden|access denied|internal server error|page not found)\b"),
    }]


def format_layers(d: Dialect, c: FormatConfig) -> list[dict]:
    """HTML share of the bytes, share of lines that look like code, of one-sentence lines without a stop, and of list items."""
    return [
        *([] if d.name == "spark" else format_counts(d)),
        {"html_ratio": d.ratio("tag_bytes", "n"), "code_ratio": d.ratio("code_lines", "n_lines"), "list_ratio": d.ratio("list_lines", "n_lines"), "single_line_ratio": d.ratio("open_lines", "n_lines")},
        {"list_like": f"n_lines >= 3 AND list_ratio > {c.max_list}", "f_html": f"html_ratio > {c.max_html}", "f_code": f"code_ratio > {c.max_code}", "f_line": f"n_lines >= 3 AND single_line_ratio > {c.max_single_line}"},
        {"format_k": f"CASE WHEN n = 0 THEN 0 ELSE {_violations(['f_html', 'f_code', 'f_line', 'error_page'])} END"},
        {"format_result": "CASE WHEN format_k > 0 THEN 'REJECT' ELSE 'KEEP' END", "format_confidence": f"CASE WHEN format_k > 0 THEN least({_num('0.95')}, {_num('0.6')} + format_k * {_num('0.1')}) ELSE {_times(('list_like', '0.9'), ('code_pattern', '0.95'))} END"},
    ]


# metadata (a definition of this engine)

_SPAM = ("buy cheap", "casino", "click here now", "earn money", "free money", "limited time offer", "lose weight", "viagra", "winner")
_TRANSLATED = ("automatically translated", "auto-translated", "machine translation", "translated by", "translated from")
_GENERATED = ("as a language model", "as an ai", "i cannot fulfill", "i'm sorry, but i cannot")


def metadata_layers(d: Dialect, url: str | None = None) -> list[dict]:
    """Spam, translation and generation signs in the text; a blocked host or a spam word in the URL, if there is one."""
    u = f"coalesce({url}, '')" if url else "''"
    counts = [] if d.name == "spark" else [{"low": d.lower("t")}, {"spam_signs": d.how_many("low", _SPAM), "translated": d.any_of("low", _TRANSLATED), "ai_signs": d.any_of("low", _GENERATED), "null_byte": "contains(t, chr(0))"}]
    return [
        *counts,
        {"low_url": d.lower(u)},
        {"url_spam": d.any_of("low_url", ("casino", "click-farm", "porn", "spam", "viagra"))},
        {"metadata_k": _violations(["spam_signs >= 2", "translated", "ai_signs", "url_spam", "null_byte"])},
        {"metadata_result": "CASE WHEN metadata_k > 0 THEN 'REJECT' ELSE 'KEEP' END", "metadata_confidence": f"CASE WHEN metadata_k > 0 THEN least({_num('0.95')}, {_num('0.6')} + metadata_k * {_num('0.1')}) ELSE {_times(('spam_signs = 1', '0.9'))} END"},
    ]


def _base(d: Dialect) -> list[dict]:
    if d.name == "spark":
        return [T.ratios(d)]
    return [T.base(d), {**T.bytes_of(d), **T.word_lists(d)}, {**T.ratios(d), "n_words": d.size("words"), "n_lines": d.size("line_list")}]


def measured(parts=(), ngram: int = 3):
    """A function that adds the counts of ``parts`` to a frame."""
    names = [n for p in FIELDS if p == "bytes" or p in parts for n in FIELDS[p]]

    def add(docs: DataFrame) -> DataFrame:
        docs = docs.drop(*(c for c in docs.columns if c.lower() in names))
        own = [F.col(f"`{c}`") for c in docs.columns]
        return docs.select(*own, measures("text", parts, ngram, (_SPAM, _TRANSLATED, _GENERATED)).alias("__measures")).select(*own, "__measures.*")

    return add


def _r(*names: str) -> list[str]:
    return [f"round({n}, 6) AS {n}" for n in names]


def length(config: LengthConfig = LengthConfig()) -> Layers:
    return Layers(lambda d: [*_base(d), *length_layers(d, config)], ["doc_id", "word_count", "char_count", "length_result", "length_reason", "length_confidence"], prepare=measured())


def gibberish(config: GibberishConfig = GibberishConfig()) -> Layers:
    """DuckDB's twin is over ``WITH_BYTES``."""
    return Layers(lambda d: [*_base(d), *gibberish_layers(d, config)], ["doc_id", *_r("alpha_ratio", "digit_ratio", "symbol_ratio", "entropy", "repetition_ratio", "vowel_ratio"), "longest_run", "gibberish_k", "gibberish_result", *_r("gibberish_confidence")], prepare=measured(("gibberish",)))


def repetition(config: RepetitionConfig = RepetitionConfig()) -> Layers:
    return Layers(lambda d: [*_base(d), *repetition_layers(d, config)], ["doc_id", *_r("line_repetition", "ngram_repetition", "unique_ratio", "diversity", "boilerplate_score"), "unique_words", "template", "repetition_k", "repetition_result", *_r("repetition_confidence")], prepare=measured(("repetition",), config.ngram))


def formats(config: FormatConfig = FormatConfig()) -> Layers:
    return Layers(lambda d: [*_base(d), *format_layers(d, config)], ["doc_id", *_r("html_ratio", "code_ratio", "list_ratio", "single_line_ratio"), "tag_count", "list_like", "format_k", "format_result", *_r("format_confidence")], prepare=measured(("format",)))


def metadata(url: str | None = None) -> Layers:
    return Layers(lambda d: [*_base(d), *metadata_layers(d, url)], ["doc_id", "spam_signs", "translated", "ai_signs", "url_spam", "metadata_k", "metadata_result", *_r("metadata_confidence")], prepare=measured(("metadata",)))


FILTERS = ("length", "gibberish", "repetition", "format", "metadata")


def processor(config: QualityConfig = QualityConfig()) -> Layers:
    """All filters in order. The overall score is the weighted mean of the confidences, a rejection counting ``1 - confidence``; rejected if a filter rejects or the score is under the limit."""
    total = sum(config.weights)
    score = " + ".join(f"{_num(str(w))} * (CASE WHEN {f}_result = 'KEEP' THEN {f}_confidence ELSE 1 - {f}_confidence END)" for f, w in zip(FILTERS, config.weights))

    def layers(d: Dialect) -> list[dict]:
        first = "CASE " + " ".join(f"WHEN {f}_result = 'REJECT' THEN '{r}'" for f, r in zip(FILTERS, ("LENGTH", "GIBBERISH", "HIGH_REPETITION", "POOR_FORMAT", "METADATA_ISSUE"))) + " ELSE 'CUSTOM' END"
        return [
            *_base(d), *length_layers(d, config.length), *gibberish_layers(d, config.gibberish), *repetition_layers(d, config.repetition), *format_layers(d, config.format), *metadata_layers(d),
            {"overall_score": f"({score}) / {_num(repr(total))}", "reason": first}, {"final_result": f"CASE WHEN reason <> 'CUSTOM' OR round(overall_score, 9) < {config.reject_below} THEN 'REJECT' ELSE 'KEEP' END"},
        ]

    return Layers(layers, ["doc_id", *(f"{f}_result" for f in FILTERS), *_r("overall_score"), "reason", "final_result"], prepare=measured(tuple(FIELDS), config.repetition.ngram))


def keep(docs: DataFrame, config: QualityConfig = QualityConfig(), extra=()) -> DataFrame:
    """The documents that pass, in the columns they have; ``extra`` are further conditions (columns that are true to keep)."""
    for condition in extra:
        docs = docs.where(condition)
    return processor(config).keep(docs, "final_result = 'KEEP'")


def statistics(docs: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """Documents and mean score by final result and reason."""
    found = processor(config).spark(docs)
    return found.groupBy("final_result", "reason").agg(F.count("*").alias("documents"), F.round(F.avg("overall_score"), 4).alias("mean_score"))


def processor_sql(config: QualityConfig = QualityConfig()) -> str:
    """The processor from the filters' own twins, joined."""
    parts = [length(config.length).duck("documents"), gibberish(config.gibberish).duck(WITH_BYTES), repetition(config.repetition).duck("documents"), formats(config.format).duck("documents"), metadata().duck("documents")]
    score = " + ".join(f"{w} * (CASE WHEN {f}_result = 'KEEP' THEN {f}_confidence ELSE 1 - {f}_confidence END)" for f, w in zip(FILTERS, config.weights))
    joined = f"({parts[0]}) " + " ".join(f"JOIN ({p}) USING (doc_id)" for p in parts[1:])
    reason = "CASE WHEN length_result = 'REJECT' THEN 'LENGTH' WHEN gibberish_result = 'REJECT' THEN 'GIBBERISH' WHEN repetition_result = 'REJECT' THEN 'HIGH_REPETITION' WHEN format_result = 'REJECT' THEN 'POOR_FORMAT' WHEN metadata_result = 'REJECT' THEN 'METADATA_ISSUE' ELSE 'CUSTOM' END"
    return f"""
WITH f AS (SELECT *, ({score}) / {sum(config.weights)!r} AS s, {reason} AS reason FROM {joined})
SELECT doc_id, {", ".join(f + "_result" for f in FILTERS)}, round(s, 6) AS overall_score, reason, CASE WHEN reason <> 'CUSTOM' OR round(s, 9) < {config.reject_below} THEN 'REJECT' ELSE 'KEEP' END AS final_result FROM f"""


def stats_sql() -> str:
    return f"SELECT final_result, reason, count(*) AS documents, round(avg(overall_score), 4) AS mean_score FROM ({processor_sql()}) GROUP BY ALL"
