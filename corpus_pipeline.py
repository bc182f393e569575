"""The corpus pipeline: classify, remove repeated lines, near duplicates and benchmark passages, then mix the sources.

``STAGES`` lists the stages in order; each takes ``(spark, docs, sf_dir)`` and returns
the documents it keeps, in the columns of ``documents``. ``run`` writes every stage's
result as Parquet in the shared folder and reads it as the next one's input.

Nulls, empty texts, ties, repeated rows and clashing column names are treated as
each stage's operator says; a row without ``doc_id`` passes through all stages
(quality may reject it, and mixing may leave out its block); an empty table gives
an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmill.llm import decontaminate, lines, mixing, near, quality
from quillmill.runtime import drop, materialize, read_table, temporary


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled documents reject, as bad or toxic, go."""
    return quality.reject(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of windows of three lines go."""
    return lines.deduplicate_lines(docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates stays."""
    return near.deduplicate(docs)


def remove_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans that match benchmark items go, and documents that consist of them."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of the sources in the target mixture."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", classify_quality),
    ("line dedup", remove_repeated_lines),
    ("near dedup", remove_near_duplicates),
    ("benchmark decontamination", remove_benchmark_passages),
    ("source mixing", mix_sources),
]

#: The classifier, a fitted model, is beyond SQL; every stage and the whole run are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that all stages keep. What a stage wrote on its way goes when it is done, its result when the next one is."""
    docs, last = read_table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        with temporary(spark) as made:
            docs = materialize(stage(spark, docs, sf_dir))
            path = made.pop()
        if last:
            drop(spark, last)
        last = path
    return docs
