"""Token and shingle hashes for whole Arrow batches, in numpy.

A token here is a maximal run of ASCII letters, ASCII digits and bytes of
non-ASCII characters; ASCII letters are lower-cased. Its hash is a polynomial
over its bytes modulo 2**64, taken from prefix sums, so that no Python object
is made for a token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_TABLES: dict = {}
#: Bytes of text worked on at a time; a longer document is a block of its own.
BLOCK_BYTES = 1 << 19


def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse up to ``n``, and the byte classes."""
    if _TABLES.get("n", 0) < n:
        n = max(n, BLOCK_BYTES + 1024)
        inverse = pow(_BASE, -1, 1 << 64)
        up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
        up[0] = down[0] = 1
        byte = np.zeros(256, np.uint8)
        for c in range(256):
            if c >= 128 or chr(c).isalnum():
                byte[c] = ord(chr(c).lower()) if c < 128 else c
        _TABLES.update(n=n, up=np.multiply.accumulate(up), down=np.multiply.accumulate(down), byte=byte)
    return _TABLES["up"], _TABLES["down"], _TABLES["byte"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about BLOCK_BYTES: first row, row after the last, their bytes with a zero after each row, and the rows' starts in these."""
    data, offsets = text_bytes(column)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, "right")) - 1)
        end = min(end, len(column))
        lengths = np.diff(offsets[row : end + 1]) + 1
        starts = np.concatenate([[0], np.cumsum(lengths)])
        out = np.zeros(starts[-1], np.uint8)
        for i in range(end - row):
            out[starts[i] : starts[i + 1] - 1] = data[offsets[row + i] : offsets[row + i + 1]]
        yield row, end, out, starts
        row = end


def token_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every token of a block."""
    up, down, byte = _tables(len(data) + 1)
    low = byte[data]
    inside = low != 0
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(low * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start]), start, end


def shingles(token: np.ndarray, width: int) -> np.ndarray:
    """Hashes of ``width`` consecutive tokens; a shorter sequence is one shingle, an empty one none."""
    if not len(token):
        return token
    width = min(width, len(token))
    out = np.zeros(len(token) - width + 1, np.uint64)
    for k in range(width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + token[k : k + len(out)]
    return mix(out)


def documents(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and token hashes of every row."""
    for row, end, data, starts in blocks(column):
        token, start, _ = token_hashes(data)
        cut = np.searchsorted(start, starts)
        for i in range(end - row):
            yield row + i, token[cut[i] : cut[i + 1]]
