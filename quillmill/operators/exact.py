"""Exact deduplication: grouping by digest, keep policies, groups, statistics and soft weights.

Texts are compared byte by byte; empty texts are copies of each other, null counts as
empty. Digests of 256 bits are what is shuffled, with partial aggregation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quillmill.config import ExactConfig, SoftConfig


def digest(text: Column, algorithm: str = "sha256") -> Column:
    """What copies have in common; the 64-bit ``xxhash64`` may merge texts that differ."""
    text = F.coalesce(text, F.lit(""))
    return {"md5": lambda: F.md5(text), "sha1": lambda: F.sha1(text), "sha256": lambda: F.sha2(text, 256), "xxhash64": lambda: F.xxhash64(text), "text": lambda: text}[algorithm]()


def hash64(text: Column, algorithm: str) -> Column:
    """The first eight bytes of a digest, big-endian, as a signed number."""
    if algorithm == "xxhash64":
        return F.xxhash64(text)
    return F.conv(F.substring(digest(text, algorithm), 1, 16), 16, -10).cast("long")


def keepers(docs: DataFrame, config: ExactConfig = ExactConfig()) -> DataFrame:
    """``doc_id, n_copies``: the first (or last) document of every distinct text."""
    pick = F.min if config.keep_first else F.max
    return docs.groupBy(digest(F.col("text"), config.algorithm).alias("h")).agg(pick("doc_id").alias("doc_id"), F.count("*").alias("n_copies")).select("doc_id", "n_copies")


def deduplicate(docs: DataFrame, config: ExactConfig = ExactConfig()) -> DataFrame:
    """The kept documents, in the columns they have; of rows with equal ``doc_id`` and text one stays."""
    order = F.col("doc_id") if config.keep_first else F.col("doc_id").desc()
    names = docs.columns
    ranked = docs.select("*", F.row_number().over(W.partitionBy(digest(docs["text"], config.algorithm)).orderBy(order)).alias("__rank"))
    return ranked.where("__rank = 1").select(*names)


def duplicate_groups(docs: DataFrame, config: ExactConfig = ExactConfig()) -> DataFrame:
    """``group_id, doc_id, size`` for every document whose text occurs more than once; the id is the group's least ``doc_id``.

    A row for each member: a text of any number of copies is counted with map-side combine and never gathered.
    """
    keyed = docs.select("doc_id", digest(F.col("text"), config.algorithm).alias("h"))
    groups = keyed.groupBy("h").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("size")).where("size > 1")
    return keyed.join(groups, "h").select("group_id", "doc_id", "size")


def statistics(docs: DataFrame, config: ExactConfig = ExactConfig()) -> DataFrame:
    """One row: documents, kept, removed, duplicate groups, largest group, reduction in percent."""
    sizes = docs.groupBy(digest(F.col("text"), config.algorithm).alias("h")).agg(F.count("*").alias("c"))
    total = F.coalesce(F.sum("c"), F.lit(0))
    return sizes.agg(
        total.alias("documents"), F.count("*").alias("kept"), (total - F.count("*")).alias("removed"), F.count_if(F.col("c") > 1).alias("duplicate_groups"),
        F.coalesce(F.max("c"), F.lit(0)).alias("largest_group"), F.round(F.when(total > 0, 100.0 * (total - F.count("*")) / total).otherwise(0.0), 6).alias("reduction_percent"),
    )


def soft_weights(docs: DataFrame, config: SoftConfig = SoftConfig(), algorithm: str = "sha256") -> DataFrame:
    """``doc_id, weight``: the k-th copy of a text weighs ``decay ** (k - 1)``, at least ``min_weight``. (A definition of this engine.)

    Only the first copies, up to the one that has ``min_weight``, are ranked; each task sends so many of a text
    at most. Rows with equal ``doc_id`` and text are one copy.
    """
    floor, decay = config.min_weight, config.decay
    keyed = docs.select("doc_id", digest(F.col("text"), algorithm).alias("h"))
    ranked = keyed.distinct().withColumn("k", F.row_number().over(W.partitionBy("h").orderBy("doc_id")))
    if 0 < floor < 1 and 0 < decay < 1:
        ranked = ranked.where(F.col("k") <= math.ceil(math.log(floor) / math.log(decay)) + 1)
    ranked = ranked.select(F.col("h").alias("g"), F.col("doc_id").alias("id"), "k")
    weight = F.greatest(F.lit(floor), F.pow(F.lit(decay), (F.col("k") - 1).cast("double")))
    return keyed.join(ranked, F.expr("h = g AND doc_id <=> id"), "left").select("doc_id", F.coalesce(weight, F.lit(floor)).alias("weight"))


def hashes(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", *(hash64(text, a).alias(f"{a}_64") for a in ("md5", "sha1", "sha256")))


def _first8(x: str) -> str:
    n = f"CAST(CAST(('0x' || substr({x}, 1, 16)) AS UBIGINT) AS HUGEINT)"
    return f"CAST(CASE WHEN {n} > 9223372036854775807 THEN {n} - 18446744073709551616 ELSE {n} END AS BIGINT)"


SQL = {
    "exact_dedup": "SELECT min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY coalesce(text, '')",
    "exact_dedup_last": "SELECT max(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY coalesce(text, '')",
    "exact_groups": "SELECT min(doc_id) OVER w AS group_id, doc_id, count(*) OVER w AS size FROM documents WINDOW w AS (PARTITION BY coalesce(text, '')) QUALIFY count(*) OVER w > 1",
    "exact_stats": """
SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS documents, count(*) AS kept, CAST(coalesce(sum(c), 0) AS BIGINT) - count(*) AS removed, count(*) FILTER (c > 1) AS duplicate_groups,
       coalesce(max(c), 0) AS largest_group, round(CASE WHEN sum(c) > 0 THEN 100.0 * (sum(c) - count(*)) / sum(c) ELSE 0 END, 6) AS reduction_percent
FROM (SELECT count(*) AS c FROM documents GROUP BY coalesce(text, ''))""",
    "soft_weights": "SELECT doc_id, greatest(0.1, pow(CAST(0.5 AS DOUBLE), row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id) - 1)) AS weight FROM documents",
    "text_hashes": f"SELECT doc_id, {_first8('md5(text)')} AS md5_64, {_first8('sha1(text)')} AS sha1_64, {_first8('sha256(text)')} AS sha256_64 FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)",
}
