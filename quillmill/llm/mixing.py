"""Mixing of sources to target weights by Sainte-Laguë apportionment.

The corpus is cut into shards by a seeded hash of ``doc_id``, as many as give a
shard about ``shard_tokens`` tokens. In a shard the documents of a source, in
seeded order, are cut into blocks of ``block_tokens`` tokens; a document belongs
to the block in which it starts. A block takes as many seats as its documents run
over nominal blocks: one, or more if a long document leaves the next ones without a
start, so that seats measure tokens. A shard's seats, ``keep`` of those its blocks
take, go one by one to the source with the highest quotient ``weight / (2 a + 1)``,
``a`` being the seats it has; ties go to the lesser name; a source whose blocks are
used up gets no more. The quotas are integers, and the blocks that fill them are the
first in seeded order, the last of them if at least half of it fits.

Weights are per source; a source that isn't named has ``other`` (1 by default:
equal shares). Tokens are runs of characters other than blanks.

Every window is over one shard, so its size doesn't grow with the corpus, however
large a source is. Only ids and counts are shuffled until the kept ids meet the
documents in a semi-join.

Defined cases: a null source is the source ``''``; a null or empty text has 0
tokens and goes with the block at its place; documents without tokens in a source
that has no tokens in the shard form one block; rows that share a ``doc_id`` are kept or
dropped together, and so are those without one, as one document; an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quillmill.runtime import broadcast_if_small, materialize, read_table


@dataclass(frozen=True)
class Mixture:
    weights: dict = field(default_factory=dict)
    other: float = 1.0
    keep: float = 0.8
    block_tokens: int = 2_000
    shard_tokens: int = 2_000_000
    seed: int = 1


def _hash(seed: str, value: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(value.cast("string"), F.lit("null")))), 1, 8), 16, 10).cast("long")


def _tokens(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("source"), F.lit("")).alias("src"),
        F.coalesce(F.regexp_count("text", F.lit(r"[^ \t\r\n]+")), F.lit(0)).cast("long").alias("tokens"),
    )


def _weight(mixture: Mixture) -> Column:
    out = F.lit(float(mixture.other))
    for name, w in sorted(mixture.weights.items()):
        out = F.when(F.col("src") == name, float(w)).otherwise(out)
    return out


def _widths(blocks: DataFrame, mixture: Mixture) -> DataFrame:
    """``shard, src, block, width``: the seats a block takes, up to the next block that has a document."""
    each = blocks.groupBy("shard", "src", "block").agg(F.sum("tokens").alias("tokens"))
    source = W.partitionBy("shard", "src")
    after = F.coalesce(F.lead("block").over(source.orderBy("block")), F.ceil(F.sum("tokens").over(source) / mixture.block_tokens))
    return each.select("shard", "src", "block", F.greatest(F.lit(1), after - F.col("block")).cast("long").alias("width"))


def allocate(docs: DataFrame, mixture: Mixture = Mixture()) -> tuple[DataFrame, DataFrame]:
    """Documents with their blocks, and the quotas ``shard, src, blocks, seats``; ``blocks`` is the seats that all blocks of the source take."""
    counted = materialize(_tokens(docs))
    total = counted.agg(F.sum("tokens")).first()[0] or 0
    shards = max(1, math.ceil(total / mixture.shard_tokens))
    placed = counted.select("*", (_hash(f"{mixture.seed}:s:", F.col("id")) % shards).alias("shard"), _hash(f"{mixture.seed}:o:", F.col("id")).alias("o"))
    before = F.coalesce(F.sum("tokens").over(W.partitionBy("shard", "src").orderBy("o", "id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = placed.select("id", "src", "shard", "tokens", F.floor(before / mixture.block_tokens).cast("long").alias("block"))
    sizes = _widths(blocks, mixture).groupBy("shard", "src").agg(F.sum("width").alias("blocks"))
    seat = sizes.select("shard", "src", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("a")).where(_weight(mixture) > 0)
    seat = seat.select("shard", "src", F.row_number().over(W.partitionBy("shard").orderBy((_weight(mixture) / (2 * F.col("a") + 1)).desc(), "src", "a")).alias("rank"))
    seats = sizes.groupBy("shard").agg(F.ceil(mixture.keep * F.sum("blocks")).cast("long").alias("total"))
    won = seat.join(seats, "shard").where("rank <= total").groupBy("shard", "src").agg(F.count("*").alias("seats"))
    return blocks, sizes.join(won, ["shard", "src"], "left").select("shard", "src", "blocks", F.coalesce("seats", F.lit(0)).alias("seats"))


def chosen(docs: DataFrame, mixture: Mixture = Mixture()) -> DataFrame:
    """``id`` of the kept documents with ``shard``, ``src``, ``block`` and ``tokens``."""
    blocks, quotas = allocate(docs, mixture)
    order = _hash(f"{mixture.seed}:b:", F.concat_ws(":", "shard", "src", "block"))
    upto = F.sum("width").over(W.partitionBy("shard", "src").orderBy(order, "block").rowsBetween(W.unboundedPreceding, W.currentRow))
    ranked = _widths(blocks, mixture).select("shard", "src", "block", "width", upto.alias("k"))
    taken = ranked.join(quotas, ["shard", "src"]).where("2 * k - width <= 2 * seats").select("shard", "src", "block")
    return blocks.join(taken, ["shard", "src", "block"])


def mix(docs: DataFrame, mixture: Mixture = Mixture()) -> DataFrame:
    """The documents of the chosen blocks, in the columns they have."""
    kept = broadcast_if_small(materialize(chosen(docs, mixture).select("id").distinct()))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["id"]), "left_semi")


#: The target of the registered query: shares in proportion to 1, but for these sources.
TARGET = {"src0": 0.5, "src1": 2.0, "src2": 1.5}


def query(spark, sf_dir: str) -> DataFrame:
    kept = chosen(read_table(spark, sf_dir, "documents"), Mixture(weights=TARGET))
    return kept.select(F.col("id").alias("doc_id"), F.col("src").alias("source"), "shard", "block", "tokens")


def sql(mixture: Mixture = Mixture(weights=TARGET), docs: str = "documents") -> str:
    """DuckDB's query for the documents of the chosen blocks."""
    weight = "CASE src " + " ".join(f"WHEN '{n}' THEN CAST({w} AS DOUBLE)" for n, w in sorted(mixture.weights.items())) + f" ELSE CAST({mixture.other} AS DOUBLE) END" if mixture.weights else f"CAST({mixture.other} AS DOUBLE)"
    draw = lambda kind, value: f"CAST('0x' || substr(md5('{mixture.seed}:{kind}:' || {value}), 1, 8) AS BIGINT)"
    return rf"""
WITH counted AS (
  SELECT doc_id AS id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS name, coalesce(source, '') AS src,
         coalesce(len(regexp_extract_all(text, '[^ \t\r\n]+')), 0) AS tokens FROM {docs}
), size AS (SELECT greatest(1, CAST(ceil(sum(tokens) / {mixture.shard_tokens}.0) AS BIGINT)) AS shards FROM counted
), placed AS (
  SELECT id, src, tokens, {draw('s', 'name')} % shards AS shard, {draw('o', 'name')} AS o FROM counted, size
), blocks AS (
  SELECT id, src, shard, tokens, CAST(floor(coalesce(sum(tokens) OVER (PARTITION BY shard, src ORDER BY o, id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / {mixture.block_tokens}.0) AS BIGINT) AS block FROM placed
), width AS (
  SELECT shard, src, block, greatest(1, coalesce(lead(block) OVER (PARTITION BY shard, src ORDER BY block), CAST(ceil(sum(t) OVER (PARTITION BY shard, src) / {mixture.block_tokens}.0) AS BIGINT)) - block) AS width
  FROM (SELECT shard, src, block, sum(tokens) AS t FROM blocks GROUP BY shard, src, block)
), sizes AS (SELECT shard, src, CAST(sum(width) AS BIGINT) AS blocks, {weight} AS weight FROM width GROUP BY shard, src
), seat AS (
  SELECT shard, src, row_number() OVER (PARTITION BY shard ORDER BY weight / (2 * a + 1) DESC, src, a) AS rank
  FROM (SELECT shard, src, weight, unnest(range(0, blocks)) AS a FROM sizes WHERE weight > 0)
), won AS (
  SELECT shard, src, count(*) AS seats FROM seat JOIN (SELECT shard, ceil({mixture.keep} * sum(blocks)) AS total FROM sizes GROUP BY shard) USING (shard) WHERE rank <= total GROUP BY shard, src
), ranked AS (
  SELECT shard, src, block, width, sum(width) OVER (PARTITION BY shard, src ORDER BY {draw('b', "shard || ':' || src || ':' || block")}, block ROWS UNBOUNDED PRECEDING) AS k FROM width
), kept AS (
  SELECT id, src, shard, block, tokens FROM blocks JOIN (SELECT shard, src, block FROM ranked LEFT JOIN won USING (shard, src) WHERE 2 * k - width <= 2 * coalesce(seats, 0)) USING (shard, src, block)
)
SELECT id AS doc_id, src AS source, shard, block, CAST(tokens AS BIGINT) AS tokens FROM kept
"""
