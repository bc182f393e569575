"""Near-duplicate removal with bottom-k sketches of one hash function.

A document is the set of its shingles of three words, each hashed once to 64
bits. Its sketch is the ``sketch`` least values. The steps:

1. Documents with equal sets are one from here on (a 128-bit digest).
2. Inverted lists of the retained values. A pair passes the estimate of step 3 only
   if ``threshold - margin`` of either sketch are in both, so that one of the values
   they share is among the first ``size - needed + 1`` of each in any order common to
   all. The order here is by how many documents hold a value, the rarest first: values
   of one document alone make no list, and passages that many documents share come
   last. A document is in the lists of these values; no pair is lost by that.
   The documents of a list whose sizes allow the threshold are candidates. A long
   list is dealt into blocks of ``list_block`` rows and every two blocks are compared
   in a task of their own, so that a list of any length is handled exactly and
   no task grows.
3. The sketch of the union of a pair estimates its Jaccard similarity; pairs
   under ``threshold - margin`` go.
4. The exact Jaccard similarity of the sets decides. Groups are the connected
   components of the pairs that reach ``threshold``.

Steps 3 and 4 are taken twice. First a list's documents are paired with its first
one alone, which is linear, and each document is verified against the least
partner it has left. Then all pairs of a list are candidates except those already
in one component, as these change nothing: the groups are those of all pairs.

Ids, sizes and values are what is shuffled; texts move once, those of candidates.

What can be missed is a pair whose estimate is ``margin`` under its similarity: at the
threshold itself, 2.4 standard deviations, one pair of 130; more similar ones more rarely.

Defined cases: a null or empty text, and one without a word, is in no group;
texts of fewer than three words are one shingle, so that only equal ones group;
the document with the least ``doc_id`` of a group stays; rows that share a
``doc_id`` are one document, similar to whatever one of its texts is similar to, and
stay or go together; a row without ``doc_id`` stays and is in no group; an empty
table gives an empty table; other columns, whatever their names, pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quillmill.llm import tokens
from quillmill.llm.components import connected_components
from quillmill.runtime import broadcast_if_small, materialize, read_table


@dataclass(frozen=True)
class NearConfig:
    shingle: int = 3
    threshold: float = 0.6
    sketch: int = 64
    margin: float = 0.15
    list_block: int = 256

    @property
    def least(self) -> float:
        """The estimate that a pair has to reach."""
        return self.threshold - self.margin


def _sets(docs: DataFrame, width: int, make, schema: str) -> DataFrame:
    """``make(doc_id, sorted distinct shingle hashes)`` for every document that has any."""
    names, types = zip(*(x.split() for x in schema.split(", ")))
    kinds = [{"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}[t] for t in types]

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [make(ids[k], np.unique(tokens.shingles(t, width))) for k, t in tokens.documents(batch.column(1)) if len(t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def sketches(docs: DataFrame, config: NearConfig = NearConfig()) -> DataFrame:
    """``id, n, digest, sketch``: size and digest of the set, and its least values, in order as unsigned numbers."""

    def make(doc_id, values):
        return doc_id, len(values), xxhash.xxh3_128_digest(values.tobytes()), values[: config.sketch].view(np.int64)

    return _sets(docs, config.shingle, make, "id long, n long, digest binary, sketch array<long>")


def listable(nodes: DataFrame, config: NearConfig) -> DataFrame:
    """``id, n, sketch, values`` of the rows ``row, id, n, sketch`` that are in a list: ``values`` are those whose lists they are in."""
    entry = nodes.select("row", F.explode("sketch").alias("value"))
    shared = entry.groupBy("value").agg(F.count("*").alias("c")).where("c > 1")
    # at most as many as the sketch has
    own = entry.join(shared, "value").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("c", "value"))).alias("v"))
    first = F.expr(f"size(v) - (ceil({config.least!r}D * size(sketch) - 1e-9D) - 1)").cast("int")  # those of one document alone come before
    return own.join(nodes, "row").select("id", "n", "sketch", F.slice("v.value", 1, F.greatest(F.lit(0), first)).alias("values")).where("size(values) > 0")


def _lists(found: DataFrame, config: NearConfig) -> DataFrame:
    """Rows ``value, id, n, m, i`` of the lists of two or more: ``m`` blocks, of which the row is in ``i``."""
    entry = found.select("id", "n", F.explode("values").alias("value"))
    count = entry.groupBy("value").agg(F.count("*").alias("c")).where("c > 1")
    blocks = F.ceil(F.col("c") / config.list_block)
    return entry.join(count, "value").select("value", "id", "n", blocks.cast("int").alias("m"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("i"))


def _sizes(config: NearConfig) -> str:
    return f"x.id < y.id AND least(x.n, y.n) >= {config.threshold} * greatest(x.n, y.n)"


def _first_pairs(listed: DataFrame, config: NearConfig) -> DataFrame:
    """``a < b``: the first document of a list with every other."""
    first = listed.groupBy("value").agg(F.min(F.struct("id", "n")).alias("f")).select("value", "f.*")
    pairs = first.alias("x").join(listed.alias("y"), F.expr("x.value = y.value AND " + _sizes(config)))
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def _other_pairs(listed: DataFrame, label: DataFrame, config: NearConfig) -> DataFrame:
    """``a < b``: all pairs of a list whose components differ."""
    rows = materialize(listed.join(label, "id", "left").withColumn("label", F.coalesce("label", "id")))
    mixed = rows.groupBy("value").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("value")
    dealt = rows.join(mixed, "value").select("value", "id", "n", "label", "i", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("j"))
    dealt = dealt.select("value", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", "id", "n", "label")
    pairs = dealt.alias("x").join(dealt.alias("y"), F.expr("x.value = y.value AND x.lo = y.lo AND x.hi = y.hi AND (x.lo = x.hi OR x.i <> y.i) AND x.label <> y.label AND " + _sizes(config)))
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def estimate(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Jaccard similarity of pairs from the union of their sketches.

    ``a`` and ``b`` hold a sketch a row, filled up with the greatest 64-bit value.
    """
    both = np.sort(np.concatenate([a, b], 1), 1)
    real = both != np.uint64(0xFFFFFFFFFFFFFFFF)
    again = np.zeros_like(real)
    again[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
    place = np.cumsum(real & ~again, 1)
    inside = (place <= k) & real
    return (again & inside).sum(1) / np.maximum(1, (inside & ~again).sum(1))


def _matrix(column: pa.Array, k: int) -> np.ndarray:
    size = np.asarray(column.value_lengths())
    out = np.full((len(column), k), 0xFFFFFFFFFFFFFFFF, np.uint64)
    out[np.arange(k) < size[:, None]] = np.asarray(column.flatten()).view(np.uint64)
    return out


def _estimated(pairs: DataFrame, sketch: DataFrame, config: NearConfig) -> DataFrame:
    k, least = config.sketch, config.least

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                yield part.select([0, 1]).filter(pa.array(estimate(_matrix(part.column(2), k), _matrix(part.column(3), k), k) >= least - 1e-9))

    first = sketch.select(F.col("id").alias("a"), F.col("sketch").alias("u"))
    second = sketch.select(F.col("id").alias("b"), F.col("sketch").alias("v"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "u", "v").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    def run(batches):
        for batch in batches:
            keep = []
            for u, v in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(u.as_buffer(), np.uint64), np.frombuffer(v.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(common >= threshold * (len(both) - common) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    first = sets.select(F.col("id").alias("a"), F.col("set").alias("u"))
    second = sets.select(F.col("id").alias("b"), F.col("set").alias("v"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "u", "v").mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, config: NearConfig = NearConfig()) -> DataFrame:
    """``doc_id, group_id`` of every document in a group of two or more; the group's id is its least ``doc_id``."""
    sketch = materialize(sketches(docs, config).withColumn("row", F.monotonically_increasing_id()))
    copies = sketch.groupBy("digest").agg(F.min("id").alias("rep"), F.min("row").alias("first"), F.count("*").alias("c")).where("c > 1")
    copy = materialize(sketch.select("id", "row", "digest").join(copies, "digest").select("id", "rep", "row", "first"))
    again = broadcast_if_small(materialize(copy.where("row <> first").select("row")))
    # of equal sets one row stays, under their least id
    named = sketch.join(again, "row", "left_anti").join(broadcast_if_small(materialize(copy.where("row = first and id <> rep").select("row", "rep"))), "row", "left")
    nodes = named.select("row", F.coalesce("rep", "id").alias("id"), "n", "sketch")
    found = materialize(listable(nodes, config))
    listed = materialize(_lists(found, config))

    def verified(pairs):
        ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        ends = broadcast_if_small(materialize(ends))
        sets = _sets(docs.join(ends, docs["doc_id"] == ends["id"], "left_semi"), config.shingle, lambda i, v: (i, v.tobytes()), "id long, set binary")
        return materialize(_verified(pairs, materialize(sets), config.threshold).distinct())

    first = _estimated(_first_pairs(listed, config), found, config)
    star = verified(materialize(first.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")))
    label = materialize(connected_components(star))
    rest = verified(materialize(_estimated(_other_pairs(listed, label, config), found, config).distinct()))
    label = connected_components(star.unionByName(rest).unionByName(copy.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))))
    return label.select(F.col("id").alias("doc_id"), F.col("label").alias("group_id"))


def deduplicate(docs: DataFrame, config: NearConfig = NearConfig()) -> DataFrame:
    """The documents, in the columns they have, with one of every group."""
    gone = broadcast_if_small(materialize(groups(docs, config).where("doc_id <> group_id").select(F.col("doc_id").alias("id"))))
    return docs.join(gone, docs["doc_id"] == gone["id"], "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return groups(read_table(spark, sf_dir, "documents")).withColumn("keep", F.expr("doc_id = group_id"))


SQL = r"""
WITH RECURSIVE word AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?:[a-z0-9]|[^\x00-\x7f])+') AS w
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS p FROM word WHERE len(w) > 0)
), size AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), pair AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2
), edge AS (
  SELECT a, b FROM pair JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE c >= 0.6 * (p.n + q.n - c) - 1e-9
), arc AS (
  SELECT a, b FROM edge UNION ALL SELECT b, a FROM edge
), reach(id, other) AS (
  SELECT a, b FROM arc UNION SELECT r.id, e.b FROM reach r JOIN arc e ON r.other = e.a
)
SELECT id AS doc_id, min(least(id, other)) AS group_id, id = min(least(id, other)) AS keep FROM reach GROUP BY id
"""
