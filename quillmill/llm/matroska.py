"""Matroska files in binary columns: packet tables from EBML, and a muxer that tests them.

The parser walks the variable-length elements of a file: header, tracks, clusters
with simple blocks and block groups in all four lacings, and cues. Elements of
unknown size end where one begins that can't be their child. A packet has its
track, timestamp, flags and byte range, so that it can be cut out of the file later.

Timestamps are in nanoseconds: cluster and block times by the segment's scale;
the frames of a lace follow each other by the track's default duration.

``cued`` says that a cue point of the track names the packet's cluster.

Several files or segments may follow each other in one value; tracks, cues and the
scale are each segment's own, packets and clusters are counted on. A segment of
unknown size ends where a header or a segment begins.

A file that isn't Matroska, or is cut off, gives the packets before the fault and
one row more, with ``error`` and without a track.

Defined cases: a null or empty column value gives no rows; in muxing, a null or
empty text gives a file without clusters; ids may be null and rows repeated, as
each row is a file of its own; an empty table gives an empty table; other
columns of the table are not part of the packet table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillmill.runtime import read_table

EBML, SEGMENT, VOID = 0x1A45DFA3, 0x18538067, 0xEC
SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, CHAPTERS, TAGS, ATTACHMENTS = 0x114D9B74, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B, 0x1043A770, 0x1254C367, 0x1941A469
TOP = {SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, CHAPTERS, TAGS, ATTACHMENTS}
SCALE, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC, LANGUAGE, DEFAULT_DURATION = 0x2AD7B1, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x22B59C, 0x23E383
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
LACINGS = ("none", "xiph", "fixed", "ebml")
PACKET = "packet_no long, track long, codec string, timestamp_ns long, duration_ns long, keyframe boolean, lacing string, cluster_no long, byte_offset long, byte_size long, cued boolean, error string"


def vint(data: bytes, at: int) -> tuple[int | None, int]:
    """A size: its value, None if unknown, and the offset after it."""
    first = data[at]
    if not first:
        raise ValueError("size over eight bytes")
    n = 9 - first.bit_length()
    if at + n > len(data):
        raise IndexError
    value = int.from_bytes(data[at : at + n], "big") & ((1 << 7 * n) - 1)
    return (None if value == (1 << 7 * n) - 1 else value), at + n


def element(data: bytes, at: int, limit: int) -> tuple[int, int, int | None]:
    """Id, start of the content and its end, None if unknown."""
    first = data[at]
    n = 9 - first.bit_length()
    if not 1 <= n <= 4:
        raise ValueError("no element begins here")
    name = int.from_bytes(data[at : at + n], "big")
    size, start = vint(data, at + n)
    if size is not None and start + size > limit:
        raise ValueError("an element exceeds the one around it")
    return name, start, None if size is None else start + size


def children(data: bytes, at: int, end: int):
    while at < end:
        name, start, stop = element(data, at, end)
        stop = end if stop is None else stop
        yield name, start, stop
        at = stop


def unsigned(data: bytes, start: int, end: int) -> int:
    return int.from_bytes(data[start:end], "big")


def frames(data: bytes, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Track, relative time, flags and the byte ranges of the frames of a block; nothing past the block is read."""
    start, block = at, data[at:end]
    try:
        track, at = vint(block, 0)
        time = int.from_bytes(block[at : at + 2], "big", signed=True)
        flags = block[at + 2]
        at += 3
        kind = flags >> 1 & 3
        if not kind:
            return track, time, flags, [(start + at, len(block) - at)]
        count, sizes = block[at] + 1, []
        at += 1
        if kind == 1:
            for _ in range(count - 1):
                size = 0
                while block[at] == 255:
                    size += 255
                    at += 1
                sizes.append(size + block[at])
                at += 1
        elif kind == 3:
            for k in range(count - 1):
                before = at
                value, at = vint(block, at)
                if value is None:
                    value = (1 << 7 * (at - before)) - 1
                sizes.append(value if not k else sizes[-1] + value - ((1 << (7 * (at - before) - 1)) - 1))
        else:
            if (len(block) - at) % count:
                raise ValueError("a fixed lace that doesn't divide")
            sizes = [(len(block) - at) // count] * (count - 1)
    except IndexError:
        raise ValueError("truncated block") from None
    sizes.append(len(block) - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("a lace exceeds its block")
    out = []
    for size in sizes:
        out.append((start + at, size))
        at += size
    return track, time, flags, out


@dataclass
class File:
    scale: int = 1_000_000
    tracks: dict = field(default_factory=dict)  # number: {"codec", "language", "type", "duration"}
    cues: list = field(default_factory=list)  # (time_ns, track, offset of the cluster)
    packets: list = field(default_factory=list)
    error: str | None = None


def parse(data: bytes) -> File:
    """All of a file that can be read; ``error`` says what ended it early."""
    whole = File()
    at = number = 0
    headed = False
    try:
        while at < len(data):
            name, start, end = element(data, at, len(data))
            if name == EBML and end is not None:
                headed, at = True, end
            elif not headed:
                raise ValueError("no EBML header")
            elif name == SEGMENT:
                out, clusters = File(), []
                try:
                    at = _segment(data, start, end, number, out, clusters)
                finally:
                    number += len(clusters)
                    cued = _cued(out.cues, clusters, number - len(clusters))
                    whole.scale, whole.tracks = out.scale, out.tracks
                    whole.cues += out.cues
                    whole.packets += [(*p, (p[0], p[6]) in cued) for p in out.packets]
                headed = None  # further segments may do without a header
            elif headed:
                raise ValueError("no segment")
            else:
                at = len(data) if end is None else end
        if headed is not None:
            raise ValueError("no segment" if headed else "no EBML header")
    except IndexError:
        whole.error = "truncated file"
    except ValueError as e:
        whole.error = str(e)
    return whole


def _segment(data: bytes, at: int, end: int | None, number: int, out: File, clusters: list) -> int:
    base, limit = at, len(data) if end is None else end
    while at < limit:
        begin = at
        name, start, stop = element(data, at, limit)
        if end is None and name in (EBML, SEGMENT):
            return begin
        if name == CLUSTER:
            clusters.append(begin - base)
            at = _cluster(data, start, stop, limit, number + len(clusters) - 1, out)
            continue
        stop = limit if stop is None else stop
        if name == INFO:
            for n, a, b in children(data, start, stop):
                out.scale = unsigned(data, a, b) if n == SCALE else out.scale
        elif name == TRACKS:
            for n, a, b in children(data, start, stop):
                if n == TRACK_ENTRY:
                    _track(data, a, b, out)
        elif name == CUES:
            for n, a, b in children(data, start, stop):
                if n == CUE_POINT:
                    _cue(data, a, b, out)
        at = stop
    return limit


def _cued(cues: list, clusters: list, first: int = 0) -> set:
    number = {o: k for k, o in enumerate(clusters, first)}
    return {(t, number[o]) for _, t, o in cues if o in number}


def _track(data: bytes, at: int, end: int, out: File) -> None:
    number, info = None, {"codec": None, "language": "eng", "type": None, "duration": None}
    for n, a, b in children(data, at, end):
        if n == TRACK_NUMBER:
            number = unsigned(data, a, b)
        elif n == CODEC:
            info["codec"] = data[a:b].rstrip(b"\0").decode("ascii", "replace")
        elif n == LANGUAGE:
            info["language"] = data[a:b].rstrip(b"\0").decode("ascii", "replace")
        elif n == TRACK_TYPE:
            info["type"] = unsigned(data, a, b)
        elif n == DEFAULT_DURATION:
            info["duration"] = unsigned(data, a, b)
    out.tracks[number] = info


def _cue(data: bytes, at: int, end: int, out: File) -> None:
    time, places = 0, []
    for n, a, b in children(data, at, end):
        if n == CUE_TIME:
            time = unsigned(data, a, b)
        elif n == CUE_POSITIONS:
            inner = {m: unsigned(data, c, d) for m, c, d in children(data, a, b)}
            places.append((inner.get(CUE_TRACK), inner.get(CUE_CLUSTER)))
    out.cues += [(time * out.scale, *p) for p in places]


def _cluster(data: bytes, at: int, stop: int | None, end: int, number: int, out: File) -> int:
    time, limit = 0, end if stop is None else stop
    while at < limit:
        name, a, b = element(data, at, limit)
        if stop is None and name in (*TOP, EBML, SEGMENT):
            return at
        if b is None:
            raise ValueError("an element of unknown size in a cluster")
        if name == TIMESTAMP:
            time = unsigned(data, a, b)
        elif name == SIMPLE_BLOCK:
            _block(data, a, b, time, None, None, number, out)
        elif name == BLOCK_GROUP:
            inner = {n: (c, d) for n, c, d in children(data, a, b)}
            if BLOCK in inner:
                duration = unsigned(data, *inner[BLOCK_DURATION]) if BLOCK_DURATION in inner else None
                _block(data, *inner[BLOCK], time, REFERENCE not in inner, duration, number, out)
        at = b
    return at


def _block(data: bytes, at: int, end: int, time: int, key: bool | None, duration: int | None, number: int, out: File) -> None:
    track, relative, flags, ranges = frames(data, at, end)
    info = out.tracks.get(track, {})
    each = info.get("duration")
    lasts = duration * out.scale // len(ranges) if duration is not None else each
    first = (time + relative) * out.scale
    for k, (offset, size) in enumerate(ranges):
        out.packets.append((track, info.get("codec"), first + k * (lasts or 0), lasts, bool(flags & 0x80) if key is None else key, LACINGS[flags >> 1 & 3], number, offset, size))


def packets(table: DataFrame, media: str, key: str) -> DataFrame:
    """``key`` and the columns of PACKET for every packet of every file in column ``media``."""
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    names, types = zip(*(x.split() for x in PACKET.split(", ")))

    def run(batches):
        for batch in batches:
            rows = []
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if raw:
                    found = parse(raw)
                    rows += [(i, k, *p, None) for k, p in enumerate(found.packets)]
                    if found.error:
                        rows.append((i, len(found.packets), *[None] * (len(names) - 2), found.error))
                if len(rows) > 20_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64(), *(kinds[t] for t in types)])], names=[key, *names])

    return table.select(F.col(key).cast("long"), F.col(media)).mapInArrow(run, f"`{key}` long, {PACKET}")


def size_of(value: int) -> bytes:
    """The shortest size field."""
    n = 1
    while value >= (1 << 7 * n) - 1:
        n += 1
    return (value | 1 << 7 * n).to_bytes(n, "big")


def write(name: int, content: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + size_of(len(content)) + content


def number(name: int, value: int) -> bytes:
    return write(name, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def block(track: int, time: int, parts: list[bytes], lacing: int, key: bool = True, simple: bool = True) -> bytes:
    """The content of a block with the frames ``parts``."""
    head = size_of(track) + time.to_bytes(2, "big", signed=True) + bytes([(0x80 if key and simple else 0) | lacing << 1])
    if lacing:
        head += bytes([len(parts) - 1])
    if lacing == 1:
        for p in parts[:-1]:
            head += b"\xff" * (len(p) // 255) + bytes([len(p) % 255])
    elif lacing == 3:
        head += size_of(len(parts[0])) if len(parts) > 1 else b""
        for a, b in zip(parts, parts[1:-1]):
            d, n = len(b) - len(a), 1
            while not -((1 << (7 * n - 1)) - 1) <= d <= (1 << (7 * n - 1)) - 1:
                n += 1
            head += (d + (1 << (7 * n - 1)) - 1 | 1 << 7 * n).to_bytes(n, "big")
    return head + b"".join(parts)


STEP_MS, LINES = 1000, 6


def mux(text: str | None, lang: str | None) -> bytes:
    """A text as a file: its lines are the packets of a subtitle track, one a second; their lengths are those of a data track.

    Clusters hold six lines and have known and unknown sizes by turns; the lacing
    goes through all kinds. Every other cluster is in the cues.
    """
    lines = [x.encode() for x in text.split("\n")] if text else []
    second = STEP_MS * 1_000_000
    tracks = write(TRACKS, b"".join(
        write(TRACK_ENTRY, number(TRACK_NUMBER, n) + number(TRACK_UID, n) + number(TRACK_TYPE, kind) + write(CODEC, codec) + write(LANGUAGE, (lang or "und").encode()) + number(DEFAULT_DURATION, second))
        for n, kind, codec in ((1, 17, b"S_TEXT/UTF8"), (2, 33, b"D_LENGTHS"))
    ))
    body, cues = [write(INFO, number(SCALE, 1_000_000)), tracks, write(VOID, bytes(9))], b""
    at = sum(map(len, body))
    for k, first in enumerate(range(0, len(lines), LINES)):
        part, start = lines[first : first + LINES], first * STEP_MS
        content = number(TIMESTAMP, start)
        half = part[:3], part[3:]
        content += write(SIMPLE_BLOCK, block(1, 0, half[0], (0, 1, 3)[k % 3] if len(half[0]) == 1 else (1, 3)[k % 2]))
        for j, line in enumerate(half[1]):
            content += write(BLOCK_GROUP, write(BLOCK, block(1, (3 + j) * STEP_MS, [line], 0, simple=False)) + number(BLOCK_DURATION, STEP_MS) + (number(REFERENCE, 1) if j else b""))
        lengths = [len(x).to_bytes(4, "big") for x in part]
        content += write(SIMPLE_BLOCK, block(2, 0, lengths, 2))
        cluster = write(CLUSTER, content) if k % 2 else CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + content
        if k % 2 == 0:
            cues += write(CUE_POINT, number(CUE_TIME, start) + write(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at)))
        body.append(cluster)
        at += len(cluster)
    if cues:
        body.append(write(CUES, cues))
    return write(EBML, write(0x4282, b"matroska")) + SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + b"".join(body)


def mux_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, media``: every document as a file."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                ids, texts, langs = (c.to_pylist() for c in batch.slice(at, 500).columns)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([mux(t, x) for t, x in zip(texts, langs)], pa.binary())], names=["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(run, "doc_id long, media binary")


def query(spark, sf_dir: str) -> DataFrame:
    """The packet table of all documents as files."""
    return packets(mux_documents(read_table(spark, sf_dir, "documents")), "media", "doc_id")
