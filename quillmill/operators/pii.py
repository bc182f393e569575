"""Personal data: spans, counts, risk, and masked text.

Spans are characters. Matches that look like sample data, or stand near words that
announce such, are left out; of overlapping ones the earlier stays (of equal starts the
kind listed first). Without placeholders, replacements are drawn from a hash of the match,
so that a rerun gives the same text. Null counts as empty.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from quillmill.config import PiiConfig
from quillmill.functions.dialect import Dialect, Layers

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|0?[0-9]{1,2})"
_STREETS = "avenue|ave|boulevard|blvd|court|ct|drive|dr|lane|ln|place|pl|road|rd|street|st"
#: In the order of detection. The first six also count in SQL.
PATTERNS = {
    "EMAIL": r"(?i)\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b",
    "PHONE": r"\b(?:\+?1[-. ]?)?\(?[0-9]{3}\)?[-. ]?[0-9]{3}[-. ]?[0-9]{4}\b",
    "SSN": r"\b(?:[0-9]{9}|[0-9]{3}-[0-9]{2}-[0-9]{4})\b",
    "CREDIT_CARD": r"\b(?:3[0-9]{13}|3[47][0-9]{13}|4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|6(?:011|5[0-9]{2})[0-9]{12})\b",
    "IP_ADDRESS": rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b",
    "PHYSICAL_ADDRESS": rf"(?i)\b[0-9]+[ \t\n]+[a-z \t\n]+(?:{_STREETS})\b",
    "PERSON_NAME": r"\b[A-Z][a-z]+[ \t\n]+[A-Z][a-z]+\b",
    "GOVERNMENT_ID": r"\b(?:[A-Z]{2}[0-9]{6}[A-Z]?|[0-9]{2}-[0-9]{7})\b",
}
_SWITCH = {"EMAIL": "emails", "PHONE": "phones", "SSN": "ssn", "CREDIT_CARD": "cards", "IP_ADDRESS": "ips", "PHYSICAL_ADDRESS": "addresses", "PERSON_NAME": "names"}
RISK = {"SSN": 1.0, "CREDIT_CARD": 1.0, "PHYSICAL_ADDRESS": 0.7, "PHONE": 0.5, "PERSON_NAME": 0.4, "EMAIL": 0.3, "IP_ADDRESS": 0.2}
SAFE_DOMAINS = frozenset("demo.net donotreply.com example.com no-reply.com noreply.com placeholder.edu sample.org test.com".split())
_SAMPLE = re.compile("dummy|example|placeholder|sample|test", re.I)
_CONTEXT = re.compile(r"demo|e\.g\.|example|sample|such as|test", re.I)
_MASK = {"EMAIL": "[EMAIL]", "PHONE": "[PHONE]", "PHYSICAL_ADDRESS": "[ADDRESS]", "PERSON_NAME": "[PERSON]"}
CONFIDENCE = 0.8
#: Digits, full stops and blanks of a text as marks, and what of them every match of a kind has: most texts are spared its expression.
_SHAPE = bytes(48 if 48 <= c <= 57 else 46 if c == 46 else 32 if c in b" \t\n" else 120 for c in range(256))
_NEEDS = {"PHONE": b"0000", "SSN": b"0000", "CREDIT_CARD": b"0" * 13, "IP_ADDRESS": b"0.0", "PHYSICAL_ADDRESS": b"0 ", "GOVERNMENT_ID": b"000000"}


def luhn(number: str) -> bool:
    """Whether the check digit of a card number is right."""
    digits = [int(c) for c in number if c.isdigit()]
    total = sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(digits)))
    return bool(digits) and total % 10 == 0


def detect(text: str | None, config: PiiConfig = PiiConfig(), patterns: dict | None = None) -> list[tuple[str, int, int, str]]:
    """``kind, start, end, match`` in order of place."""
    if not text:
        return []
    safe = SAFE_DOMAINS | set(config.safe_domains)
    found, shape = [], text.encode("utf-8", "replace").translate(_SHAPE)
    for rank, (kind, pattern) in enumerate({**PATTERNS, **(patterns or {})}.items()):
        if (kind == "GOVERNMENT_ID" and not config.government_ids) or (kind in _SWITCH and kind == "PERSON_NAME" and not config.names) or (kind == "EMAIL" and "@" not in text):
            continue
        if kind not in (patterns or {}) and _NEEDS.get(kind, b"") not in shape:
            continue
        for m in re.finditer(pattern, text, re.A):
            word, near = m.group(), text[max(0, m.start() - 50) : m.start() + 50]
            if _SAMPLE.search(word) or _CONTEXT.search(near) or (kind == "CREDIT_CARD" and not luhn(word)) or (kind == "EMAIL" and word.partition("@")[2] in safe) or (kind == "PERSON_NAME" and not 4 <= len(word) <= 50):
                continue
            found.append((m.start(), rank, m.end(), kind, word))
    out, last = [], -1
    for start, _, end, kind, word in sorted(found):
        if start >= last:
            out.append((kind, start, end, word))
            last = end
    return out


def replacement(kind: str, match: str, config: PiiConfig = PiiConfig()) -> str:
    if not config.anonymize:
        return "[REDACTED]" if config.placeholders else ""
    if config.placeholders or kind not in _MASK or kind == "PERSON_NAME":
        return _MASK.get(kind, "[REDACTED]")
    n = int(hashlib.md5(match.encode()).hexdigest()[:8], 16)
    return {"EMAIL": f"user{n % 10000}@example.com", "PHONE": f"555-0{100 + n % 900}", "PHYSICAL_ADDRESS": f"{100 + n % 900} Example St"}[kind]


def sanitize(text: str | None, config: PiiConfig = PiiConfig(), found: list | None = None) -> str | None:
    """The text with its spans (``found``, if they are known) replaced."""
    out, at = [], 0
    for kind, start, end, word in detect(text, config) if found is None else found:
        out += [text[at:start], replacement(kind, word, config)]
        at = end
    return text if not out else "".join(out) + text[at:]


_RESULT = T.StructType([
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("match", T.StringType()), T.StructField("replacement", T.StringType())]))),
    T.StructField("sanitized", T.StringType()), T.StructField("risk", T.DoubleType()), T.StructField("result", T.StringType()),
])


def evaluate(docs: DataFrame, config: PiiConfig = PiiConfig()) -> DataFrame:
    """``docs`` with a struct ``pii``: spans, masked text, privacy risk, and KEEP, SANITIZE or REJECT."""

    @F.pandas_udf(_RESULT)
    def run(text: pd.Series) -> pd.DataFrame:
        rows = []
        for t in text:
            found = detect(t, config)
            sensitive = any(getattr(config, _SWITCH.get(k, "ssn")) for k, *_ in found)
            result = "KEEP" if not sensitive else "SANITIZE" if config.placeholders or config.anonymize else "REJECT"
            risk = round(min(1.0, sum(RISK.get(k, 0.0) * CONFIDENCE for k, *_ in found) / 3), 6)
            rows.append(([{"kind": k, "start": s, "end": e, "match": w, "replacement": replacement(k, w, config)} for k, s, e, w in found], sanitize(t, config, found) if found else None, risk, result))
        return pd.DataFrame(rows, columns=_RESULT.names)

    text = F.col("text").cast("string")
    # a text without a span stays in the JVM
    return docs.withColumn("pii", run(text)).withColumn("pii", F.col("pii").withField("sanitized", F.coalesce("pii.sanitized", text)))


def spans(docs: DataFrame, config: PiiConfig = PiiConfig()) -> DataFrame:
    """``doc_id`` and one row for each span."""
    return evaluate(docs, config).select("doc_id", F.explode("pii.spans").alias("s")).select("doc_id", "s.*")


def _counts(d: Dialect) -> list[dict]:
    kinds = {f"{k.lower()}_candidates": p for k, p in list(PATTERNS.items())[:6]}
    if d.name != "spark":
        return [{"t": "coalesce(text, '')"}, {k: d.count("t", p) for k, p in kinds.items()}]
    # no pattern matches a character beyond ASCII but the two that (?i) folds to ASCII letters: with a mark in place of the others Java's own, faster boundaries are RE2's
    plain = {"odd": "t RLIKE r'[\u017f\u212a]'", "plain": r"regexp_replace(t, r'[^\x00-\x7F]+', '\u00a7')"}
    return [{"t": "coalesce(text, '')"}, plain, {k: f"CASE WHEN odd THEN {d.count('t', p)} ELSE regexp_count(plain, r'{p}') END" for k, p in kinds.items()}]


#: Candidates by kind, before sample data is left out; the part that SQL expresses.
COUNTS = Layers(_counts, ["doc_id", *(f"{k.lower()}_candidates" for k in list(PATTERNS)[:6])])
