"""Quality classifier: votes of the nearest labelled documents in a latent-semantic space.

Features of a text are its lower-cased words, pairs of neighbouring bytes that
belong to no word (punctuation and blanks), and classes of eight measures (capitals,
bytes outside words, digits, distinct words, share of the commonest word, words
that repeat the one before, word length, text length). A feature counts with ``log(1 + n)`` times its correlation with a label;
features that don't correlate are left out. A truncated singular value
decomposition of the labelled documents' weighted rows gives the latent space.

Every document's vector is compared with all labelled vectors: blocks of exact
cosine products. The ``neighbours`` nearest vote for both labels, quality and
toxicity, with their similarity as weight; neighbours as near as the last of these
(to five decimals) vote too. A document is rejected when quality has less than
half of the votes or toxicity at least half.

The model is fitted on the driver from at most ``per_class`` labelled documents of
each of three classes (bad; good but toxic; good), those with the least hash of
``doc_id``; what is broadcast, these documents' vectors and the features that
correlate in them, is bounded by that, whatever the size of the corpus. Documents
are only mapped over: no shuffle.

Defined cases: a null or empty text, or one without any feature of a space, has the
constant feature alone and votes are counted as for any other; label rows with a null are ignored; with no
usable label all scores are null and everything is kept; a null ``doc_id`` and
repeated rows are scored like others; an empty table gives an empty table; other
columns, whatever their names, pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillmill.llm import tokens
from quillmill.runtime import read_table


@dataclass(frozen=True)
class QualityConfig:
    per_class: int = 1500
    least_chi2: float = 25.0
    least_documents: int = 3
    rank: int = 64
    constant: float = 0.1
    neighbours: int = 15
    seed: int = 7


def _named(kind: int, value: np.ndarray) -> np.ndarray:
    return tokens.mix(np.asarray(value).astype(np.uint64) + np.uint64((kind + 1) << 40))


def features(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every feature occurrence of a block (see ``tokens.blocks``)."""
    rows = len(starts) - 1
    word, begin, end = tokens.token_hashes(data)
    cut = np.searchsorted(begin, starts)
    of_word = np.repeat(np.arange(rows), np.diff(cut))
    outside = tokens._tables(1)[2][data] == 0
    pair = np.flatnonzero(outside[:-1] & outside[1:] & (data[:-1] != 0) & (data[1:] != 0))
    of_pair = np.searchsorted(starts, pair, "right") - 1
    size = np.maximum(1, np.diff(starts) - 1)

    def share(mask):
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[starts[1:]] - total[starts[:-1]]) / size

    count = np.diff(cut)
    again = np.concatenate([[0], np.cumsum(np.concatenate([[False], word[1:] == word[:-1]]))])
    repeats = (again[cut[1:]] - again[np.minimum(cut[:-1] + 1, cut[1:])]) / np.maximum(1, count)
    distinct, top = np.zeros(rows), np.zeros(rows)
    for i in np.flatnonzero(count):
        w = np.sort(word[cut[i] : cut[i + 1]])
        edge = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1], [True]]))
        distinct[i], top[i] = (len(edge) - 1) / len(w), np.diff(edge).max() / len(w)
    length = np.concatenate([[0], np.cumsum(end - begin)])
    mean = (length[cut[1:]] - length[cut[:-1]]) / np.maximum(1, count)
    ratios = [share((data >= 65) & (data <= 90)) * 25, share(outside) * 25, share((data >= 48) & (data <= 57)) * 25, distinct * 10, top * 20, repeats * 20, mean, np.log2(size)]
    has = np.flatnonzero(np.diff(starts) > 1)
    row = np.concatenate([of_word, of_pair, *(has for _ in ratios)])
    name = np.concatenate([word, _named(0, data[pair].astype(np.uint64) * np.uint64(256) + data[pair + 1]), *(_named(k, np.minimum(24, r[has].astype(np.int64))) for k, r in enumerate(ratios, 1))])
    return row, name


@dataclass
class Space:
    hashes: np.ndarray  # of the features, sorted
    weights: np.ndarray
    axes: np.ndarray  # features and the constant x rank
    vectors: np.ndarray  # labelled documents x rank, of length 1
    labels: np.ndarray
    bias: float
    prior: float
    neighbours: int

    def embed(self, row: np.ndarray, name: np.ndarray, rows: int) -> np.ndarray:
        """Latent vectors of length 1."""
        width = len(self.hashes)
        at = np.searchsorted(self.hashes, name)
        at[at == width] = 0
        known = np.flatnonzero(self.hashes[at] == name) if width else np.zeros(0, np.int64)
        cell, count = np.unique(row[known] * width + at[known], return_counts=True)
        r, f = cell // max(1, width), cell % max(1, width)
        value = (np.log1p(count) * self.weights[f]).astype(np.float32)
        out = np.tile(np.float32(self.bias) * self.axes[-1], (rows, 1))
        edge = np.searchsorted(r, np.arange(rows + 1))
        step = 1 << 14
        for first in range(0, len(cell), step):  # few products at a time
            s = slice(first, first + step)
            part = self.axes[f[s]] * value[s, None]
            begins = np.unique(np.clip(edge[:-1][edge[1:] > edge[:-1]], first, None))
            begins = begins[begins < min(first + step, len(cell))] - first
            if not len(begins) or begins[0]:
                begins = np.concatenate([[0], begins])
            out[r[first + begins]] += np.add.reduceat(part, begins, 0)
        return unit(out)

    def vote(self, vectors: np.ndarray) -> np.ndarray:
        """The label's share of the votes for each vector."""
        out = np.full(len(vectors), self.prior)
        rows = np.flatnonzero(vectors.any(1))
        for at in range(0, len(rows), 512):
            part = rows[at : at + 512]
            cosine = np.round(vectors[part] @ self.vectors.T, 5)
            k = cosine.shape[1] - min(self.neighbours, cosine.shape[1])
            last = np.partition(cosine, k, 1)[:, k]
            weight = np.where(cosine >= last[:, None], np.maximum(cosine, 0), 0).astype(np.float64)
            total = weight.sum(1)
            out[part[total > 0]] = (weight @ self.labels)[total > 0] / total[total > 0]
        return np.round(out, 6)


def _biased(x: np.ndarray, bias: float) -> np.ndarray:
    return np.concatenate([x, np.full((len(x), 1), bias, np.float32)], 1)


def unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 1e-9)


def _svd_axes(x: np.ndarray, rank: int, seed: int) -> np.ndarray:
    """Right singular vectors by randomised subspace iteration."""
    rank = min(rank, *x.shape)
    q = np.random.default_rng(seed).standard_normal((x.shape[1], min(rank + 16, *x.shape))).astype(np.float32)
    for _ in range(5):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :rank]


def fit(counts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, config: QualityConfig = QualityConfig()) -> list[Space] | None:
    """A space for each column of ``labels``. ``counts``: for each labelled document its feature hashes and how often each occurs."""
    if not len(counts):
        return None
    names, at = np.unique(np.concatenate([c[0] for c in counts]), return_inverse=True)
    row = np.repeat(np.arange(len(counts)), [len(c[0]) for c in counts])
    number = np.concatenate([c[1] for c in counts])
    return [_space(names, at, row, number, y.astype(float), config) for y in labels.T]


def _space(names: np.ndarray, at: np.ndarray, row: np.ndarray, number: np.ndarray, y: np.ndarray, config: QualityConfig) -> Space:
    n, p = len(y), y.mean()
    df = np.bincount(at, minlength=len(names)).astype(float)
    hit = np.bincount(at, weights=y[row], minlength=len(names))
    phi = np.abs(hit - df * p) / np.sqrt(np.maximum(1e-9, p * (1 - p) * df * (n - df)))
    phi[(df < config.least_documents) | (df >= n) | (phi**2 * n < config.least_chi2)] = 0
    chosen = np.flatnonzero(phi > 0)
    index = np.full(len(names), -1)
    index[chosen] = np.arange(len(chosen))
    x = np.zeros((n, len(chosen)), np.float32)
    keep = index[at] >= 0
    x[row[keep], index[at[keep]]] = np.log1p(number[keep])
    weights = phi[chosen] * np.log(n / df[chosen])
    bias = config.constant * float(weights.max()) if len(chosen) else 1.0
    x = _biased(x * weights.astype(np.float32), bias)
    axes = _svd_axes(unit(x), config.rank, config.seed)
    return Space(names[chosen], weights, axes, unit(x @ axes), y, bias, float(p), config.neighbours)


def train(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> list[Space] | None:
    """The model, from a bounded sample of the labelled documents."""
    usable = labels.where("doc_id is not null and quality is not null and toxic is not null").select(
        F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("q"), F.col("toxic").cast("int").alias("t")
    )
    order = (F.xxhash64(F.lit(config.seed), "id"), "id", "q", "t")
    sample = None
    for which in ("q = 0", "q <> 0 AND t <> 0", "q <> 0 AND t = 0"):
        part = usable.where(which).orderBy(*order).limit(config.per_class)
        sample = part if sample is None else sample.unionByName(part)

    def count(batches):
        for batch in batches:
            for at, end, data, starts in tokens.blocks(batch.column(2)):
                row, name = features(data, starts)
                by = np.argsort(row, kind="stable")
                cut = np.searchsorted(row[by], np.arange(end - at + 1))
                out = [np.unique(name[by[cut[i] : cut[i + 1]]], return_counts=True) for i in range(end - at)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, end - at), batch.column(1).slice(at, end - at), pa.array([a.tobytes() for a, _ in out], pa.binary()), pa.array([b.astype(np.int32).tobytes() for _, b in out], pa.binary())],
                    names=["q", "t", "names", "counts"],
                )

    # at most three times per_class ids: small whatever the corpus
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "id").select("q", "t", "text")
    got = rows.mapInArrow(count, "q int, t int, names binary, counts binary").toPandas()
    got = got.sort_values(["q", "t", "names", "counts"], ignore_index=True)
    counts = [(np.frombuffer(a, np.uint64), np.frombuffer(b, np.int32)) for a, b in zip(got["names"], got["counts"])]
    return fit(counts, np.stack([got["q"] != 0, got["t"] != 0], 1) if len(got) else np.zeros((0, 2)), config)


def _scores(model: list[Space], column: pa.Array) -> np.ndarray:
    parts = []
    for at, end, data, starts in tokens.blocks(column):
        row, name = features(data, starts)
        parts.append(np.stack([space.vote(space.embed(row, name, end - at)) for space in model], 1))
    return np.concatenate(parts) if parts else np.zeros((0, 2))


def classify(docs: DataFrame, model: list[Space] | None) -> DataFrame:
    """``doc_id, quality_score, toxic_score, keep`` for every row."""
    schema = "doc_id long, quality_score double, toxic_score double, keep boolean"
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if model is None:
        return narrow.select("doc_id", F.lit(None).cast("double").alias("quality_score"), F.lit(None).cast("double").alias("toxic_score"), F.lit(True).alias("keep"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            s = _scores(shared.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s[:, 0]), pa.array(s[:, 1]), pa.array((s[:, 0] >= 0.5) & (s[:, 1] < 0.5))], names=["doc_id", "quality_score", "toxic_score", "keep"])

    return narrow.mapInArrow(run, schema)


def reject(docs: DataFrame, model: list[Space] | None) -> DataFrame:
    """The documents that are kept, in the columns they have."""
    if model is None:
        return docs
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            s = _scores(shared.value, batch.column(at))
            yield batch.filter(pa.array((s[:, 0] >= 0.5) & (s[:, 1] < 0.5)))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return classify(docs, train(docs, read_table(spark, sf_dir, "labels")))
