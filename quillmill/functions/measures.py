"""All raw measures of a text for the quality filters, in one pass over Arrow batches.

The text is split once; what the filters decide from these numbers stays in expressions.
Every step is linear in the text. The DuckDB twins spell the same measures as SQL.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_IDENTIFIER = bytes(c for c in range(128) if chr(c).isalnum() or c == 95)
_ASCII = np.arange(256)
_ALPHA = ((_ASCII >= 65) & (_ASCII <= 90)) | ((_ASCII >= 97) & (_ASCII <= 122))
_DIGIT = (_ASCII >= 48) & (_ASCII <= 57)
_SPACE, _VOWEL = np.isin(_ASCII, list(b" \t\n\x0b\f\r")), np.isin(_ASCII, list(b"AEIOUaeiou"))
_CLASSES = np.stack([_ALPHA, _DIGIT, _SPACE, _VOWEL]).astype(np.int64)
_SHAPE = bytes(65 if _ALPHA[c] else 57 if _DIGIT[c] else 88 if c in PUNCTUATION else c for c in range(256))

_LONG = re.compile(rb"[a-zA-Z]{50}|[0-9]{50}|[!@#$%^&*()_+={}\[\]|\\:\x22;\x27<>?,./]{10}|[b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z]{10}")
_INNER = re.compile(rb"[A-Za-z][0-9]+[A-Za-z]")
_MIXED = re.compile(rb"\b[a-zA-Z]{2,}[0-9]+[a-zA-Z]{2,}\b")
_BOILER = [(k, re.compile(p)) for k, p in (
    ((b"copyright", b"all rights reserved"), rb"\bcopyright\b.*\ball rights reserved\b"), ((b"policy",), rb"\b(?:cookie policy|privacy policy)\b"), ((b"terms of service",), rb"\bterms of service\b"),
    ((b"click here", b"more information"), rb"\bclick here\b.*\bmore information\b"), ((b"subscribe", b"newsletter"), rb"\bsubscribe\b.*\bnewsletter\b"), ((b"follow us", b"social media"), rb"\bfollow us\b.*\bsocial media\b"),
    ((b"ed by",), rb"\b(?:created|designed|powered) by\b"),
)]
_TAG = re.compile(rb"<[a-zA-Z/!][^>]*>")
_KEYWORD = re.compile(rb"\b(?:class|const|def|from|function|import|let|var|private|protected|public|static)\b")
_CODE_START = re.compile(rb"[ \t\n\x0b\f\r]*(?:#include|#define|import |from [a-z.]+ import|def |class |function )")
_ITEM = re.compile(rb"[ \t\n\x0b\f\r]*(?:[-*]|" + "|".join("•◦▪▫‣⁃").encode() + rb"|[0-9]+[.)])[ \t\n\x0b\f\r]+")
_STOPS = tuple(bytes([c]) for c in b".!?:;\"')")
_ERROR = ((b"404 not found", b"403 forbidden", b"access denied", b"internal server error", b"page not found"), re.compile(rb"\b(?:404 not found|403 forbidden|access denied|internal server error|page not found)\b"))
_BLOCK_OPENS = re.compile(rb"\)[ \t\n]*\{")

FIELDS = {
    "bytes": dict.fromkeys(("n", "alpha_n", "digit_n", "symbol_n", "solid_n", "n_words", "n_lines"), "int"),
    "gibberish": {"vowel_n": "int", "word_bytes": "long", "long_words": "int", "pattern_text": "boolean", "entropy": "double", "top_byte": "long", "longest_run": "long"},
    "repetition": {**dict.fromkeys(("line_n", "line_rep", "gram_n", "gram_rep", "shape_top", "unique_words", "unique_low"), "int"), "common": "boolean"},
    "format": {**dict.fromkeys(("tag_bytes", "tag_count", "code_lines", "list_lines", "open_lines"), "int"), "code_pattern": "boolean", "error_page": "boolean"},
    "metadata": {"spam_signs": "int", "translated": "boolean", "ai_signs": "boolean", "null_byte": "boolean"},
}


def _repeats(items) -> tuple[int, int]:
    """How many items occur more than once, all their occurrences, and the most that one has."""
    counts = Counter(items).values()
    return sum(c for c in counts if c > 1), max(counts, default=0)


def _gibberish(b: bytes, h: np.ndarray, words: list[bytes], pieces: list[bytes]) -> tuple:
    n = len(b)
    entropy, top, run = 0.0, 0, 0
    if n:
        p = h[h > 0] / n
        data = np.frombuffer(b, np.uint8)
        edge = np.flatnonzero(np.concatenate([[True], data[1:] != data[:-1], [True]]))
        entropy, top, run = float(-(p * np.log2(p)).sum()), int(h.max()), int(np.diff(edge).max())
    sizes = list(map(len, words))
    wide = b" ".join(x for x in pieces if len(x) >= 10)
    pattern = bool(_LONG.search(wide)) or bool(_INNER.search(b) and _MIXED.search(b))
    return int(_VOWEL @ h), sum(sizes), sum(s > 20 for s in sizes), pattern, entropy, top, run


def _repetition(t: str, low: bytes, words: list[bytes], lines: list[bytes], size: int) -> tuple:
    clean = [x for x in (b" ".join(line.split()) for line in lines) if x]
    shapes = t.encode("ascii", "replace").translate(_SHAPE)
    shapes = shapes[:-1] if shapes.endswith(b"\n") else shapes
    line_rep, _ = _repeats(clean)
    _, shape_top = _repeats(x for x in (b" ".join(line.split()) for line in shapes.split(b"\n")) if x)
    gram_rep, _ = _repeats(zip(*(words[k:] for k in range(size))))
    common = any(all(k in low for k in keys) and pattern.search(low) for keys, pattern in _BOILER)
    return len(clean), line_rep, max(0, len(words) - size + 1), gram_rep, shape_top, len(set(words)), len({w.lower() for w in words}), common


def _assigns(b: bytes) -> bool:
    """A name, ``=``, something, and a semicolon."""
    last, at, before = b.rfind(b";"), b.find(b"="), 0
    while 0 <= at < last - 1:
        part = b[before:at].rstrip(b" \t\n")
        name = part[len(part.rstrip(_IDENTIFIER)) :]
        if name.strip(b"0123456789") and b[at + 1 : at + 2] != b";":
            return True
        before, at = at + 1, b.find(b"=", at + 1)
    return False


def _blocks(b: bytes) -> bool:
    """Parentheses, and an opening brace after them."""
    for m in _BLOCK_OPENS.finditer(b):
        if b.find(b"(", b.rfind(b")", 0, m.start()) + 1, m.start()) >= 0:
            return True
    return False


def _format(b: bytes, low: bytes, lines: list[bytes]) -> tuple:
    tags = _TAG.findall(b, 0, b.rfind(b">") + 1) if b"<" in b else []
    code = items = loose = 0
    for line in lines:
        end = line.rstrip()
        code += end.endswith((b";", b"{", b"}")) or _CODE_START.match(line) is not None
        items += _ITEM.match(line) is not None
        loose += line != b"" and not line.rstrip(b" \t\r").endswith(_STOPS)
    brace = b.find(b"{")
    pattern = bool(_KEYWORD.search(b)) or (brace >= 0 and (b.find(b"}", brace) >= 0 or _blocks(b))) or any(k in b for k in (b"#define", b"#ifdef", b"#include")) or (b"=" in b and b";" in b and _assigns(b))
    return sum(map(len, tags)), len(tags), code, items, loose, pattern, any(k in low for k in _ERROR[0]) and bool(_ERROR[1].search(low))


def measure(text: str | None, parts, size: int, signs) -> tuple:
    """The fields of ``parts``, in their order."""
    t = text or ""
    b = t.encode()
    h = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    pieces = b.split()
    words = [w for w in (x.strip(PUNCTUATION) for x in pieces) if w]
    lines = (b[:-1] if b.endswith(b"\n") else b).split(b"\n")
    alpha, digit, blank, _ = (_CLASSES @ h).tolist()
    out = [len(b), alpha, digit, len(b) - alpha - digit - blank, len(b) - blank, len(words), len(lines)]
    low = b.lower() if len(parts) > 1 else b
    if "gibberish" in parts:
        out += _gibberish(b, h, words, pieces)
    if "repetition" in parts:
        out += _repetition(t, low, words, lines, size)
    if "format" in parts:
        out += _format(b, low, lines)
    if "metadata" in parts:
        spam, translated, generated = signs
        out += sum(k in low for k in spam), any(k in low for k in translated), any(k in low for k in generated), b"\0" in b
    return tuple(out)


def measures(column: str, parts=(), size: int = 3, signs=((), (), ())) -> Column:
    """A struct of the fields of ``bytes`` and of the further ``parts``; ``size`` is that of the word n-grams, ``signs`` the phrases of the metadata filter."""
    parts = tuple(p for p in FIELDS if p == "bytes" or p in parts)
    fields = {n: k for p in parts for n, k in FIELDS[p].items()}
    phrases = tuple(tuple(x.encode() for x in s) for s in signs)

    @F.pandas_udf(T.StructType([T.StructField(n, {"int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}[k]) for n, k in fields.items()]))
    def run(text: pd.Series) -> pd.DataFrame:
        rows = [measure(t, parts, size, phrases) for t in text]
        kinds = {"int": np.int32, "long": np.int64, "double": np.float64, "boolean": bool}
        return pd.DataFrame({n: np.array(c, kinds[k]) for (n, k), c in zip(fields.items(), zip(*rows) if rows else [[]] * len(fields))})

    return run(column)
