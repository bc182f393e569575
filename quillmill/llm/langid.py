"""Language identification by a convolutional network over bytes.

A text is cut into windows of ``window`` bytes, the last one filled up with zeros.
The network embeds bytes, convolves the embeddings with filters of widths 2, 4 and
6, takes each filter's maximum over the window, and a dense layer with softmax
gives the languages' probabilities. A document's scores are the means of its
windows' log-probabilities, weighted by their bytes: all of its text counts.

Training is in numpy (Adam, cross-entropy) on windows of a bounded sample of
labelled documents: about ``per_language`` of each language, chosen by a hash of
``doc_id`` and text, one at least and equal texts once, and ``windows_per_doc`` places in
each, spread over the text. Every language that has a labelled text can be predicted.

For inference the embedding and the filters are multiplied out into tables over
pairs of bytes, so that a filter of width 6 is the sum of three table rows.
Documents are only mapped over: no shuffle.

Defined cases: a null or empty text has a null language and confidence 0; with no
labelled text at all every language is null; a null ``doc_id`` and repeated rows are
treated like others; an empty table gives an empty table; equal scores go to the
lesser name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillmill.llm import tokens
from quillmill.runtime import broadcast_if_small, materialize, read_table

WIDTHS = (2, 4, 6)
_SPAN = max(WIDTHS)


@dataclass(frozen=True)
class LangConfig:
    per_language: int = 500
    windows_per_doc: int = 4
    window: int = 256
    filters: int = 8
    embedding: int = 8
    epochs: int = 6
    seed: int = 3


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray  # 256 x d
    kernels: list[np.ndarray]  # for each width: width x d x filters
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray
    window: int

    def tables(self) -> list[np.ndarray]:
        """For the pair of bytes at offset 0, 2 and 4: what it adds to each filter that reaches so far."""
        out = []
        for k in range(0, _SPAN, 2):
            parts = [(self.embed @ w[k])[:, None, :] + (self.embed @ w[k + 1])[None, :, :] for w in self.kernels if len(w) > k]
            out.append(np.concatenate(parts, -1).reshape(65536, -1).astype(np.float32))
        return out

    def log_probabilities(self, windows: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        pair = windows[:, :-1].astype(np.uint16) * np.uint16(256) + windows[:, 1:]
        n = pair.shape[1] - (_SPAN - 2)
        total = np.take(tables[0], pair[:, :n], 0)
        for k, table in enumerate(tables[1:], 1):
            total[:, :, -table.shape[1] :] += np.take(table, pair[:, 2 * k : 2 * k + n], 0)
        pooled = np.maximum(total.max(1) + self.bias, 0)
        return log_softmax(pooled @ self.dense + self.dense_bias)


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(1, keepdims=True)
    return x - np.log(np.exp(x).sum(1, keepdims=True))


def fit(windows: np.ndarray, target: np.ndarray, languages: list[str], config: LangConfig = LangConfig()) -> Network:
    """A network trained on ``windows`` (rows of bytes) with ``target`` indices into ``languages``."""
    rng = np.random.default_rng(config.seed)
    d, f = config.embedding, config.filters
    p = [rng.normal(0, 0.3, (256, d)), *(rng.normal(0, 1 / np.sqrt(w * d), (w, d, f)) for w in WIDTHS), np.zeros(f * len(WIDTHS)), rng.normal(0, 0.2, (f * len(WIDTHS), len(languages))), np.zeros(len(languages))]
    p = [x.astype(np.float32) for x in p]
    m, v, step = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
    n = windows.shape[1] - _SPAN + 1
    for _ in range(config.epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), 64):
            x, y = windows[order[at : at + 64]], target[order[at : at + 64]]
            r = np.arange(len(x))
            embedded = p[0][x]
            best, pooled = [], []
            for kernel in p[1 : 1 + len(WIDTHS)]:
                conv = sum(embedded[:, k : k + n] @ kernel[k] for k in range(len(kernel)))
                best.append(conv.argmax(1))
                pooled.append(np.take_along_axis(conv, best[-1][:, None, :], 1)[:, 0])
            z = np.concatenate(pooled, 1) + p[-3]
            h = np.maximum(z, 0)
            delta = np.exp(log_softmax(h @ p[-2] + p[-1]))
            delta[r, y] -= 1
            delta /= len(x)
            grad = [np.zeros_like(q) for q in p]
            grad[-1], grad[-2] = delta.sum(0), h.T @ delta
            dz = (delta @ p[-2].T) * (z > 0)
            grad[-3] = dz.sum(0)
            for j, kernel in enumerate(p[1 : 1 + len(WIDTHS)]):
                g = dz[:, j * f : (j + 1) * f]
                for k in range(len(kernel)):
                    where = best[j] + k
                    grad[1 + j][k] = np.einsum("nfd,nf->df", embedded[r[:, None], where], g)
                    np.add.at(grad[0], x[r[:, None], where], g[:, :, None] * kernel[k].T[None])
            step += 1
            for i, g in enumerate(grad):
                m[i] += 0.1 * (g - m[i])
                v[i] += 0.001 * (g * g - v[i])
                p[i] -= 0.01 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Network(languages, p[0], p[1 : 1 + len(WIDTHS)], p[-3], p[-2], p[-1], config.window)


def _cut(data: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the rows of a block, the row of each, and how many of its bytes are text."""
    length = np.diff(starts) - 1
    count = -(-length // size)
    row = np.repeat(np.arange(len(length)), count)
    first = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros((first[-1], size), np.uint8)
    flat = out.reshape(-1)
    for i in np.flatnonzero(length):
        flat[first[i] * size : first[i] * size + length[i]] = data[starts[i] : starts[i] + length[i]]
    within = np.arange(first[-1]) - first[row]
    return out, row, np.minimum(size, length[row] - within * size)


def train(docs: DataFrame, config: LangConfig = LangConfig()) -> Network | None:
    """A network for the languages in ``docs.lang``."""
    draw = F.pmod(F.xxhash64(F.lit(config.seed), "doc_id", "text"), F.lit(1_000_000)) / F.lit(1_000_000.0)
    known = docs.where("lang is not null and text is not null and length(text) > 0").select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).withColumn("draw", draw)
    counts = materialize(known.groupBy("lang").agg(F.count("*").alias("n"), F.min("draw").alias("least")))
    languages = sorted(r["lang"] for r in counts.select("lang").collect())
    if not languages:
        return None
    chance = broadcast_if_small(counts.select("lang", F.greatest(F.col("least"), F.lit(float(config.per_language)) / F.col("n")).alias("rate")))
    sample = known.join(chance, "lang").where("draw <= rate").dropDuplicates(["lang", "text"])
    size, many = config.window, config.windows_per_doc

    def places(batches):
        for batch in batches:
            out = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = text.encode()
                spare = max(0, len(raw) - size)
                for at in sorted({spare * k // max(1, many - 1) for k in range(many)}):
                    out.append((lang, raw[at : at + size].ljust(size, b"\0")))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["lang", "window"])

    got = sample.select("lang", "text").mapInArrow(places, "lang string, window binary").toPandas()
    if not len(got):
        return None
    got = got.sort_values(["lang", "window"], ignore_index=True)
    windows = np.frombuffer(b"".join(got["window"]), np.uint8).reshape(len(got), size)
    return fit(windows, np.searchsorted(languages, got["lang"]), languages, config)


def identify(docs: DataFrame, network: Network | None) -> DataFrame:
    """``doc_id, predicted_lang, confidence`` for every row."""
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if network is None:
        return narrow.select("doc_id", F.lit(None).cast("string").alias("predicted_lang"), F.lit(0.0).alias("confidence"))
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        net = shared.value
        tables = net.tables()
        names = np.array([*net.languages, None], object)
        for batch in batches:
            label, sure = np.full(batch.num_rows, len(net.languages)), np.zeros(batch.num_rows)
            for at, end, data, starts in tokens.blocks(batch.column(1)):
                windows, row, weight = _cut(data, starts, net.window)
                score = np.zeros((end - at, len(net.languages)))
                for k in range(0, len(windows), 512):
                    part = net.log_probabilities(windows[k : k + 512], tables)
                    np.add.at(score, row[k : k + 512], part * weight[k : k + 512, None])
                has = np.flatnonzero(np.diff(starts) > 1)
                score = np.exp(log_softmax(score[has] / (np.diff(starts)[has] - 1)[:, None]))
                label[at + has], sure[at + has] = score.argmax(1), np.round(score.max(1), 6)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[label], pa.string()), pa.array(sure)], names=["doc_id", "predicted_lang", "confidence"])

    return narrow.mapInArrow(run, "doc_id long, predicted_lang string, confidence double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
