"""Runs of words or characters that a table may hold, found in Arrow batches: windows are hashed from sums over the bytes, and only those whose hash is in a bitmap become strings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillmill.functions.dialect import LOWER, UPPER

_P = 0x9E3779B97F4A7C15 | 5
_PUNCT = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_LOW = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Bits of a bitmap at most, as a power of two.
BITS = 27


def normal(text: str | None, c) -> bytes:
    """The text in which windows of units are stretches of bytes: words with one space between them, or the characters."""
    b = (text or "").encode()
    if c.case_insensitive:
        b = b.translate(_LOW)
    if c.remove_punctuation:
        b = b.translate(None, _PUNCT)
    return b if c.characters and not c.normalize_whitespace else b" ".join(b.split())


def windows(texts: list[bytes], n: int, characters: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and after last byte of every window of ``n`` units in the joined texts, the text it is of, its number in the text, and the numbers of windows of the texts."""
    sizes = np.array([len(x) for x in texts], np.int64)
    edge = np.concatenate([[0], np.cumsum(sizes)])
    b = np.frombuffer(b"".join(texts), np.uint8)
    opens = np.zeros(len(b) + 1, bool)
    opens[edge] = True
    if characters:
        start = np.flatnonzero((b & 0xC0) != 0x80)
        end = np.append(start[1:], len(b))
    else:
        solid = b != 32
        start = np.flatnonzero(solid & (opens[:-1] | np.concatenate([[True], ~solid[:-1]])))
        end = np.flatnonzero(solid & (opens[1:] | np.concatenate([~solid[1:], [True]]))) + 1
    cut = np.searchsorted(start, edge)
    many = np.maximum(0, np.diff(cut) - n + 1)
    of = np.repeat(np.arange(len(texts)), many)
    number = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    first = cut[of] + number
    return start[first], end[first + n - 1] if len(first) else end[:0], of, number, many


def hashes(b: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of stretches of ``b``."""
    power, back = (np.cumprod(np.full(len(b) + 1, x, np.uint64)) for x in (_P, pow(_P, -1, 1 << 64)))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((np.frombuffer(b, np.uint8).astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)])
    h = (total[end] - total[start]) * back[start]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(29)


def bitmap(table: DataFrame, column: str = "gram") -> np.ndarray:
    """Bits of the hashes of a string column, eight or more for each row up to ``1 << BITS``."""
    bits = min(BITS, max(16, (8 * table.count()).bit_length()))

    def run(batches):
        out = np.zeros(1 << bits - 3, np.uint8)
        for batch in batches:
            texts = [x.encode() for x in batch.column(0).to_pylist() if x is not None]
            if texts:
                edge = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
                h = hashes(b"".join(texts), edge[:-1], edge[1:]) >> np.uint64(64 - bits)
                np.bitwise_or.at(out, (h >> np.uint64(3)).astype(np.int64), np.uint8(1) << (h & np.uint64(7)).astype(np.uint8))
        for k, part in enumerate(np.split(out, max(1, len(out) >> 16))):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([part.tobytes()], pa.binary())], names=["k", "part"])

    found = np.zeros(1 << bits - 3, np.uint8)
    size = min(len(found), 1 << 16)
    for k, part in table.select(column).coalesce(table.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "k long, part binary").toLocalIterator():
        found[k * size : (k + 1) * size] |= np.frombuffer(part, np.uint8)
    return found


def candidates(docs: DataFrame, table: DataFrame, c, column: str = "gram") -> DataFrame:
    """``doc_id, total_ngrams, hits`` of every row: the windows, ``position`` and ``gram``, that ``column`` of a written table holds, and few others. Texts never become one row for each window."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(table, column))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        shift = np.uint64(64 - (len(bits.value) * 8).bit_length() + 1)
        for batch in batches:
            for row in range(0, len(batch), 256):
                part = batch.slice(row, 256)
                texts = [normal(t, c) for t in part.column(1).to_pylist()]
                b = b"".join(texts)
                start, end, of, number, many = windows(texts, c.n, c.characters)
                h = hashes(b, start, end) >> shift if len(start) else np.zeros(0, np.uint64)
                k = np.flatnonzero(bits.value[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8) & 1)
                grams = pa.array([b[x:y].decode() for x, y in zip(start[k].tolist(), end[k].tolist())], pa.string())
                hits = pa.StructArray.from_arrays([pa.array(number[k], pa.int32()), grams], names=["position", "gram"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of[k], np.arange(len(texts) + 1)), pa.int32()), hits)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(many, pa.int32()), lists], names=["doc_id", "total_ngrams", "hits"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, total_ngrams int, hits array<struct<position: int, gram: string>>")
