"""Substring deduplication: every window of a passage's width that an earlier document repeats, exactly.

A text is its sequence of shingles of five tokens. A window of ``width`` shingles is a
repetition if ``share`` of them or more (``need``) are in one document with a lesser ``doc_id``,
wherever they are in it. What is sought for each window is the least such document.

1. Documents are written in blocks of about two megabytes. A block sends its distinct
   shingles, each with the least document of the block that holds it, to buckets of the
   hash; a bucket answers with the least document of the corpus and the number of documents,
   where that is one from before the block's. So a shingle of every document costs a row for
   each block, and a window with under ``need`` shingles of earlier documents is done with.
2. The ``need``-th of a window's least documents in order is the first that can repeat it, as any before it
   lacks too many. If ``need`` of the shingles have it as their least, it does: this
   settles most windows. The others are compared as classes of equal windows, of which only the first
   document's is sought; the others have the same answer, or that document.
3. Their first document that can repeat them is tried.
4. What is still open is sought among all documents: one that repeats a window
   of ``m`` shingles of earlier documents lacks ``m - need`` of them at most, so it holds one of any
   ``m - need + 1``, and the rarest are looked up. Each document that has one is compared:
   first by a sketch of 512 bits of its shingles, which can only show too many of them, as
   pairs that share a short phrase alone grow faster than the input; then by the shingles.

No list is cut and no window is sampled. Steps 3 and 4 read of every document only shingles that are
in an open window, told by a bitmap of bounded size, which lets others pass but loses none.

The result has, for every document, the token spans that repeat passages of
documents with a lesser ``doc_id``, merged where they touch, each with the least
document that repeats a part of it. So it has at most one row for each passage length of
text, however many documents share a passage. Repetition within a document doesn't count.

Defined cases: a null or empty text, and one of fewer than ``passage`` tokens, has no
passage; a row without ``doc_id`` is left out; rows that share a ``doc_id`` are one document
of several texts and aren't compared with each other; an empty table gives an empty
table; other columns aren't part of the result. Equal shingles are told by 63 bits of their hashes,
in step 1 by 48 and those of the bucket, equal windows by 64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quillmill.llm import tokens
from quillmill.runtime import keep, materialize, read_table, temporary

_TOP = np.uint64(1 << 63)
#: Text of a block and of a bucket, in bytes; bits of the bitmap at most.
_BLOCK, _BUCKET, _BITS = 2 << 20, 24 << 20, 27


@dataclass(frozen=True)
class PassageConfig:
    passage: int = 50
    shingle: int = 5
    share: float = 0.8

    def __post_init__(self):
        if not (1 <= self.shingle < self.passage and 0 < self.share <= 1):
            raise ValueError("shingle < passage and 0 < share <= 1 must hold")

    @property
    def width(self) -> int:
        """The shingles of a passage."""
        return self.passage - self.shingle + 1

    @property
    def need(self) -> int:
        """The shingles of a window that have to be shared."""
        return int(np.ceil(round(self.share * self.width, 6)))


def compact_windows(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``c, l, r`` (inclusive) of all windows of at least ``width`` places, and for every stretch of ``width`` places the number of the window that its least is in, -1 for none.

    Zeros separate sequences; the first of equal values is the lesser.
    """
    n = len(values)
    bits = np.uint64(max(20, (n + 2).bit_length()))
    place = np.arange(n + 2, dtype=np.uint64)
    key = place.copy()
    inner = values != 0
    key[1:-1][inner] |= (values[inner] >> bits << bits) | _TOP
    low, size = key, 1
    while 2 * size <= width:
        low, size = np.minimum(low[:-size], low[size:]), 2 * size
    if width > size and len(low) > width - size:
        low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
    least = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    begins = np.diff(least, prepend=-1) != 0
    nodes = least[begins]
    at, order = nodes.tolist(), key[nodes].tolist()
    left, right, stack = [0] * len(at), [n + 1] * len(at), []
    for i, v in enumerate(order):
        while stack and order[stack[-1]] > v:
            right[stack.pop()] = at[i]
        left[i] = at[stack[-1]] if stack else 0
        stack.append(i)
    c, lo, hi = nodes - 1, np.array(left, np.int64), np.array(right, np.int64) - 2
    real = (nodes > 0) & (nodes <= n)
    real[real] = inner[c[real]]
    real &= hi - lo + 1 >= width
    number = np.where(real, np.cumsum(real) - 1, -1)
    return c[real], lo[real], hi[real], number[np.cumsum(begins) - 1]


def shingle_rows(column: pa.Array, width: int):
    """For each block of rows: first row, shingle hashes at every token (zero where none of the row's begins), row of each place, place in the row."""
    for row, end, data, starts in tokens.blocks(column):
        token, begin, _ = tokens.token_hashes(data)
        if len(token) < width:
            continue
        cut = np.searchsorted(begin, starts)
        of = np.repeat(np.arange(end - row), np.diff(cut))
        values = np.zeros(len(token), np.uint64)
        values[: len(token) - width + 1] = tokens.shingles(token, width) | np.uint64(1)
        values[np.arange(len(token)) + width > cut[of + 1]] = 0
        yield row, values, of, np.arange(len(token)) - cut[of]


def repeated_spans(a: np.ndarray, b: np.ndarray, width: int, need: int) -> list[tuple[int, int]]:
    """Spans ``[first, after last)`` of ``a`` covered by windows of ``width`` of which ``need`` or more are in ``b``."""
    if len(a) < width:
        return []
    total = np.concatenate([[0], np.cumsum(np.isin(a, b))])
    hit = total[width:] - total[:-width] >= need
    edge = np.flatnonzero(np.diff(hit.view(np.int8), prepend=0, append=0))
    out: list[tuple[int, int]] = []
    for x, y in zip(edge[::2].tolist(), edge[1::2].tolist()):
        if out and x <= out[-1][1]:
            out[-1] = out[-1][0], y + width - 1
        else:
            out.append((x, y + width - 1))
    return out


def _blocks(docs: DataFrame) -> DataFrame:
    """``block, size, data``: documents in blocks, as compressed Arrow streams."""

    def pack(number: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, parts[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
            to.write_table(pa.Table.from_batches(parts).combine_chunks())
        block = TaskContext.get().partitionId() << 24 | number
        return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([sum(x.nbytes for x in parts)]), pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["block", "size", "data"])

    def run(batches):
        parts, size, number = [], 0, 0
        for batch in batches:
            _, offsets = tokens.text_bytes(batch.column(1))
            row = 0
            while row < len(batch):
                end = min(len(batch), max(row + 1, int(np.searchsorted(offsets, offsets[row] + _BLOCK - size, "right")) - 1))
                parts.append(batch.slice(row, end - row))
                size += int(offsets[end] - offsets[row])
                row = end
                if size >= _BLOCK or row < len(batch):
                    yield pack(number, parts)
                    parts, size, number = [], 0, number + 1
        if parts:
            yield pack(number, parts)

    narrow = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "block long, size long, data binary")


class _Block:
    """The shingles of a block: ``values`` and ``doc`` at every token, ``row`` and ``place`` of the token, and the distinct ones by bucket and document."""

    def __init__(self, data: bytes, config: PassageConfig, bits: int | None = None):
        table = pa.ipc.open_stream(data).read_all()
        ids = np.asarray(table.column(0).combine_chunks(), np.int64)
        found = [(v, row + of, place) for row, v, of, place in shingle_rows(table.column(1).combine_chunks(), config.shingle)]
        self.values, self.row, self.place = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.doc = ids[self.row]
        if bits is None:
            return
        at = np.flatnonzero(self.values)
        by = at[np.argsort(self.doc[at], kind="stable")]
        value, first, inverse, self.count = np.unique(self.values[by], return_index=True, return_inverse=True, return_counts=True)
        self.least = self.doc[by[first]]
        bucket = (value >> np.uint64(64 - bits)).astype(np.int64)
        order = np.lexsort((self.least, bucket))
        self.value, self.least, self.count = value[order], self.least[order], self.count[order]
        self.cut = np.searchsorted(bucket[order], np.arange((1 << bits) + 1))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.number = np.full(len(self.values), -1)
        self.number[by] = rank[inverse]


def _binaries(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if len(c) and isinstance(c[0], bytes) else pa.int64()) for c in columns], names=names)


def _packed(values: np.ndarray) -> bytes:
    """Ascending integers: the first, then the steps between them, as narrow as the widest."""
    steps = np.diff(values.view(np.uint64))
    return values[:1].tobytes() + _narrow(steps)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    steps = _wide(data[8:], n - 1)
    return np.cumsum(np.concatenate([np.frombuffer(data, np.uint64, 1), steps]), dtype=np.uint64).view(np.int64)


def _narrow(values: np.ndarray) -> bytes:
    """Unsigned integers in the least width that holds all."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0)))).tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // n}").astype(np.uint64) if n else np.zeros(0, np.uint64)


def _asked(blocks: DataFrame, bits: int, config: PassageConfig) -> DataFrame:
    """``bucket, block, high, low, doc, many``: the distinct shingles that a block sends to a bucket, about eight bytes for each: 48 bits of the hash, the step to the document from that of the one before, and how many more documents of the block hold it."""

    def ask(batches):
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                b = _Block(data.as_buffer(), config, bits)
                key = b.value << np.uint64(bits) >> np.uint64(16)
                high, low, many = (key >> np.uint64(16)).astype(np.uint32), key.astype(np.uint16), np.minimum(b.count - 1, 65535).astype(np.uint16)
                full = np.flatnonzero(np.diff(b.cut))
                for some in np.array_split(full, max(1, len(full) // 64)):
                    rows = [(int(k), block, high[z].tobytes(), low[z].tobytes(), _packed(b.least[z]), _narrow(many[z])) for k in some for z in (slice(b.cut[k], b.cut[k + 1]),)]
                    if rows:
                        yield _binaries(list(zip(*rows)), ["bucket", "block", "high", "low", "doc", "many"])

    return blocks.select("block", "data").mapInArrow(ask, "bucket long, block long, high binary, low binary, doc binary, many binary")


def _answers(blocks: DataFrame, bits: int, config: PassageConfig) -> DataFrame:
    """``block, bucket, at, least, many``: of the distinct shingles that a block sent to a bucket, the numbers of those that earlier documents hold, the least of these documents and how many there are."""

    def answer(table: pa.Table) -> pa.Table:
        def column(name, kind):
            return np.frombuffer(b"".join(x.as_buffer() for x in table.column(name)), kind)

        key = column("high", np.uint32).astype(np.uint64) << np.uint64(16) | column("low", np.uint16)
        sizes = [len(x.as_buffer()) // 4 for x in table.column("high")]
        doc = np.concatenate([_unpacked(x.as_py(), n) for x, n in zip(table.column("doc"), sizes)])
        times = np.concatenate([_wide(x.as_py(), n).astype(np.uint16) for x, n in zip(table.column("many"), sizes)])
        cut = np.concatenate([[0], np.cumsum(sizes)])
        order = np.argsort(key)
        key = key[order]
        begins = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.flatnonzero(begins)
        del key
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(begins) - 1
        least = np.minimum.reduceat(doc[order], first)
        many = np.minimum(np.add.reduceat(times[order].astype(np.int64) + 1, first), (1 << 32) - 1).astype(np.uint32)
        hit = np.flatnonzero(least[of] < doc)
        ends, rows = np.searchsorted(hit, cut), []
        bucket = table.column("bucket")[0].as_py()
        for k, block in enumerate(table.column("block").to_pylist()):
            x = hit[ends[k] : ends[k + 1]]
            if len(x):
                rows.append((block, bucket, (x - cut[k]).astype(np.uint32).tobytes(), least[of[x]].tobytes(), many[of[x]].tobytes()))
        names = ["block", "bucket", "at", "least", "many"]
        kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 3]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=names)

    return _asked(blocks, bits, config).groupBy("bucket").applyInArrow(answer, "block long, bucket long, at binary, least binary, many binary")


def _runs(places: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ascending places, the first and last numbers of runs of neighbours that agree in ``same``."""
    if not len(places):
        return places, places
    new = np.diff(places) != 1
    for x in same:
        new |= x[1:] != x[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1]), np.concatenate([np.flatnonzero(new), [len(places) - 1]])


def _windows(values: np.ndarray, k: np.ndarray, width: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(values, width)[k]


_SETTLED = "run long, a long, first long, after long, b long, s binary, least binary, many binary, same binary"


def _settled(blocks: DataFrame, answers: DataFrame, bits: int, config: PassageConfig) -> DataFrame:
    """Spans ``a, first, after, b``, and open runs of windows: ``run, a, first`` and, for all places, shingles (zero where no earlier document has it), their least documents and how many hold them, and a digest of every window."""
    width, need = config.width, config.need
    odd = tokens.mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for data in left.column("data"):
            b = _Block(data.as_buffer(), config, bits)
            if len(b.values) < width:
                continue
            known, many = b.least.copy(), b.count.copy()
            for bucket, at, least, count in zip(right.column("bucket").to_pylist(), *(right.column(c) for c in ("at", "least", "many"))):
                x = b.cut[bucket] + np.frombuffer(at.as_buffer(), np.uint32)
                known[x], many[x] = np.frombuffer(least.as_buffer(), np.int64), np.frombuffer(count.as_buffer(), np.uint32)
            if not len(known):
                continue
            least, many = known[b.number], many[b.number].astype(np.uint32)
            shared = (b.values != 0) & (least < b.doc)
            least[~shared] = np.iinfo(np.int64).max
            total = np.concatenate([[0], np.cumsum(shared)])
            last = np.arange(width - 1, len(b.values))
            k = np.flatnonzero((total[width:] - total[:-width] >= need) & (b.values[last] != 0) & (b.row[last] == b.row[: len(last)]))
            source, sure = np.zeros(len(k), np.int64), np.zeros(len(k), bool)
            for c in range(0, len(k), 1 << 15):
                w = _windows(least, k[c : c + (1 << 15)], width)
                x = np.partition(w, need - 1, axis=1)[:, need - 1]
                source[c : c + len(x)], sure[c : c + len(x)] = x, (w == x[:, None]).sum(1) >= need
            block = left.column("block")[0].as_py()
            for x, y in zip(*_runs(k[sure], source[sure], b.row[k[sure]])):
                u, v = k[sure][x], k[sure][y]
                rows.append((None, b.doc[u], b.place[u], b.place[v] + width, source[sure][x], None, None, None, None))
            open_ = k[~sure]
            own = np.where(shared, b.values, np.uint64(0))
            for number, (x, y) in enumerate(zip(*_runs(open_, b.row[open_]))):
                u, v = int(open_[x]), int(open_[y])
                same = np.concatenate([tokens.mix(_windows(b.values, np.arange(c, min(v + 1, c + 8192)), width) @ odd) for c in range(u, v + 1, 8192)])
                z = slice(u, v + width)
                rows.append((block << 22 | number, b.doc[u], b.place[u], b.place[v] + width, None, own[z].tobytes(), least[z].tobytes(), many[z].tobytes(), same.tobytes()))
        kinds = [*[pa.int64()] * 5, *[pa.binary()] * 4]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 9, kinds)], names=[x.split()[0] for x in _SETTLED.split(", ")])

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, _SETTLED)


def _bitmap(hashes: DataFrame, column: str) -> np.ndarray:
    """Bits of the hashes in a binary column, of a power of two not over ``1 << _BITS``."""
    n = hashes.agg(F.sum(F.octet_length(column))).first()[0] or 0
    bits = min(_BITS, max(16, (2 * n).bit_length()))

    def run(batches):
        out = np.zeros(1 << bits, bool)
        for batch in batches:
            for x in batch.column(0):
                out[(tokens.mix(np.frombuffer(x.as_buffer(), np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)] = True
        packed = np.packbits(out)
        for k, part in enumerate(np.split(packed, max(1, len(packed) >> 16))):
            if part.any():
                yield _binaries([[k], [part.tobytes()]], ["k", "part"])

    found = np.zeros(1 << bits - 3, np.uint8)
    size = min(len(found), 1 << 16)
    for k, part in hashes.select(column).coalesce(hashes.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "k long, part binary").toLocalIterator():
        found[k * size : (k + 1) * size] |= np.frombuffer(part, np.uint8)
    return found


def _passing(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    x = (tokens.mix(values) >> np.uint64(64 - (len(bitmap) * 8).bit_length() + 1)).astype(np.int64)
    return (bitmap[x >> 3] >> (7 - (x & 7)).astype(np.uint8) & 1).astype(bool)


def _holdings(blocks: DataFrame, bitmap, config: PassageConfig) -> DataFrame:
    """``b, held, sketch``: the shingles of every document that pass the bitmap, and 512 bits in which each sets one."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                x = _Block(data.as_buffer(), config)
                at = np.flatnonzero(x.values)
                at = at[_passing(bitmap.value, x.values[at])]
                by = at[np.lexsort((x.values[at], x.doc[at]))]
                doc, value = x.doc[by], x.values[by].view(np.int64)
                new = np.ones(len(by), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
                doc, value = doc[new], value[new]
                first = np.flatnonzero(np.diff(doc, prepend=doc[:1] - 1))
                if len(first):
                    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)), pa.int32()), pa.array(value))
                    yield pa.RecordBatch.from_arrays([pa.array(doc[first]), lists], names=["b", "held"])

    made = blocks.select("data").mapInArrow(run, "b long, held array<long>")

    def sketch(batches):
        for batch in batches:
            lists = batch.column(1)
            sizes = np.asarray(lists.value_lengths())
            bits = np.zeros((len(batch), 512), bool)
            bits[np.repeat(np.arange(len(batch)), sizes), _bit(np.asarray(lists.flatten()).view(np.uint64))] = True
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array([x.tobytes() for x in np.packbits(bits, axis=1, bitorder="little")], pa.binary())], names=["b", "held", "sketch"])

    return made.groupBy("b").agg(F.flatten(F.collect_list("held")).alias("held")).mapInArrow(sketch, "b long, held array<long>, sketch binary")


def _bit(values: np.ndarray) -> np.ndarray:
    """The bit of a sketch that a shingle sets."""
    return (tokens.mix(values ^ _TOP) >> np.uint64(55)).astype(np.int64)


def _likely(pairs: DataFrame, open_: DataFrame, held: DataFrame, config: PassageConfig) -> DataFrame:
    """The ``pairs(run, b)`` of which a window has enough shingles by the document's sketch."""
    width, need = config.width, config.need

    def run(batches):
        for batch in batches:
            own = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(2)]
            if not own:
                continue
            sizes = np.array([len(x) for x in own])
            flat, of = np.concatenate(own), np.repeat(np.arange(len(own)), sizes)
            bit = _bit(flat)
            sketches = np.frombuffer(b"".join(x.as_buffer() for x in batch.column(3)), np.uint8).reshape(-1, 64)
            total = np.concatenate([[0], np.cumsum((flat != 0) & (sketches[of, bit >> 3] >> (bit & 7).astype(np.uint8) & 1 > 0))])
            enough = (total[width:] - total[:-width] >= need) & (of[width - 1 :] == of[: len(of) - width + 1])
            keep = np.unique(of[np.flatnonzero(enough)])
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep)) for k in range(2)], names=["run", "b"])

    both = pairs.join(held.select("b", "sketch"), "b").join(open_.select("run", "s"), "run").select("run", "b", "s", "sketch")
    return both.mapInArrow(run, "run long, b long")


def _compared(pairs: DataFrame, open_: DataFrame, held: DataFrame, config: PassageConfig) -> DataFrame:
    """``run, k, b``: of the windows that a document of ``pairs(run, b)`` repeats, by number in the run, the least such document."""
    width, need = config.width, config.need

    def run(batches):
        for batch in batches:
            for r, b, s, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                own = np.frombuffer(s.as_buffer(), np.uint64)
                total = np.concatenate([[0], np.cumsum(np.isin(own, np.asarray(h.values).view(np.uint64)))])
                k = np.flatnonzero(total[width:] - total[:-width] >= need)
                if len(k):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), r)), pa.array(k), pa.array(np.full(len(k), b))], names=["run", "k", "b"])

    # a run is shorter than a document's list, so that it is the run that goes along with each pair
    both = pairs.join(open_.select("run", "s"), "run").join(held.select("b", "held"), "b").select("run", "b", "s", "held")
    return both.mapInArrow(run, "run long, k long, b long").groupBy("run", "k").agg(F.min("b").alias("b"))


def _sought(asked: DataFrame, open_: DataFrame, make, schema: str) -> DataFrame:
    """``make(run, a, numbers of the asked windows, shingles, least documents, how many)`` for every run that has windows in ``asked(run, k)``."""

    def run(batches):
        for batch in batches:
            parts = []
            for r, a, k, *x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *batch.columns[2:]):
                s, least, many = (np.frombuffer(y.as_buffer(), t) for y, t in zip(x, (np.uint64, np.int64, np.uint32)))
                parts.append(make(r, a, np.sort(np.asarray(k.values)), s, least, many))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=[x.split()[0] for x in schema.split(", ")])

    lists = asked.groupBy("run").agg(F.collect_list("k").alias("ks"))
    return open_.join(lists, "run").select("run", "a", "ks", "s", "least", "many").mapInArrow(run, schema)


def _open_spans(open_: DataFrame, blocks: DataFrame, config: PassageConfig) -> DataFrame:
    """``a, first, after, b`` of the windows of open runs that an earlier document repeats."""
    width, need = config.width, config.need

    def digests(batches):
        for batch in batches:
            for r, a, first, x in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
                same = np.frombuffer(x.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(same), pa.array(np.full(len(same), a)), pa.array(np.full(len(same), r)), pa.array(np.arange(len(same))), pa.array(first + np.arange(len(same)))], names=["same", "a", "run", "k", "first"])

    every = open_.select("run", "a", "first", "same").mapInArrow(digests, "same long, a long, run long, k long, first long")
    heads = materialize(every.groupBy("same").agg(F.min(F.struct("a", "run", "k")).alias("x")).select("same", F.col("x.a").alias("head"), "x.run", "x.k"))

    def nearest(r, a, k, s, least, many):
        out = np.unique(np.concatenate([np.partition(_windows(least, k[c : c + (1 << 14)], width), need - 1, axis=1)[:, need - 1] for c in range(0, len(k), 1 << 14)]))
        return np.full(len(out), r), out

    def rarest(r, a, k, s, least, many):
        order = np.where(s != 0, many.astype(np.int64), 1 << 40)
        pick = np.zeros(len(s), bool)
        for c in range(0, len(k), 1 << 14):
            part = k[c : c + (1 << 14)]
            w = _windows(order, part, width)
            by = np.argsort(w, axis=1, kind="stable")
            spare = (w < 1 << 40).sum(1) - need + 1
            chosen = np.arange(width) < spare[:, None]
            pick[(part[:, None] + by)[chosen]] = True
        out, low = np.unique(s[pick]).view(np.int64), nearest(r, a, k, s, least, many)[1][0]
        return np.full(len(out), r), np.full(len(out), a), np.full(len(out), low), out

    sc = open_.sparkSession.sparkContext
    bitmap = sc.broadcast(_bitmap(open_, "s"))
    held = materialize(_holdings(blocks, bitmap, config))
    near = materialize(_compared(_sought(heads, open_, nearest, "run long, b long"), open_, held, config))
    rest = heads.join(near, ["run", "k"], "left_anti")
    probes = materialize(_sought(rest, open_, rarest, "run long, a long, low long, h long"))
    holders = held.select("b", F.explode("held").alias("h")).join(probes, "h").where("low < b AND b < a").select("run", "b").distinct()
    likely = materialize(_likely(holders, open_, held, config))
    far = materialize(_compared(likely, open_, held, config))
    found = heads.join(near.unionByName(far).groupBy("run", "k").agg(F.min("b").alias("b")), ["run", "k"], "left").select("same", "head", "b")
    return every.join(found, "same").select("a", "first", (F.col("first") + width).alias("after"), F.expr("coalesce(b, CASE WHEN head < a THEN head END)").alias("b")).where("b is not null")


def _merged(spans: DataFrame) -> DataFrame:
    """``doc_id, source_doc_id, first_token, after_token``: the spans ``a, b, first, after`` of a document, those that touch as one."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc, own in zip(batch.column(0).to_pylist(), batch.column(1)):
                first, after, b = (np.asarray(own.values.field(k)) for k in range(3))
                by = np.lexsort((after, first))
                first, after, b = first[by], after[by], b[by]
                begins = np.flatnonzero(np.concatenate([[True], first[1:] > np.maximum.accumulate(after)[:-1]]))
                rows += zip([doc] * len(begins), np.minimum.reduceat(b, begins).tolist(), first[begins].tolist(), np.maximum.reduceat(after, begins).tolist())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "source_doc_id", "first_token", "after_token"])

    return spans.groupBy("a").agg(F.collect_set(F.struct("first", "after", "b")).alias("s")).mapInArrow(run, "doc_id long, source_doc_id long, first_token long, after_token long")


def repeated_passages(docs: DataFrame, config: PassageConfig = PassageConfig()) -> DataFrame:
    """``doc_id, source_doc_id, first_token, after_token``: spans of a document's tokens that repeat passages of earlier documents."""
    blocks = materialize(_blocks(docs))
    size = blocks.agg(F.sum("size")).first()[0] or 0
    bits = max(4, (size // _BUCKET).bit_length())
    with temporary(docs.sparkSession) as made:
        # written before they meet the blocks, so that the questions, of every shingle, are gone when the blocks are shuffled
        answers = materialize(_answers(blocks, bits, config))
        settled = materialize(_settled(blocks, answers, bits, config))
        kept = made.pop()
    keep(kept)
    spans = settled.where("run is null").select("a", "first", "after", "b")
    open_ = settled.where("run is not null")
    if not open_.isEmpty():
        spans = spans.unionByName(_open_spans(open_, blocks, config))
    # a span of w shingles is one of w + shingle - 1 tokens
    return _merged(spans.withColumn("after", F.col("after") + config.shingle - 1))


def query(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(read_table(spark, sf_dir, "documents"))
