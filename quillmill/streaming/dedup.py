"""Deduplication and filtering of streams.

``deduplicate`` keeps every digest for ever, as a stream without time has to;
``deduplicate_within`` forgets those older than the watermark: a copy that comes later than
``delay`` after the first may pass, and rows later than the watermark are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillmill.operators.exact import digest


def deduplicate(stream: DataFrame, text: str = "text", algorithm: str = "sha256") -> DataFrame:
    """The first row of every text; empty and null texts are dropped."""
    return stream.where(f"{text} <> ''").withColumn("__digest", digest(F.col(text), algorithm)).dropDuplicates(["__digest"]).drop("__digest")


def deduplicate_within(stream: DataFrame, time: str, delay: str, text: str = "text", algorithm: str = "sha256") -> DataFrame:
    """As above, among rows within ``delay`` of each other."""
    rows = stream.where(f"{text} <> ''").withColumn("__digest", digest(F.col(text), algorithm)).withWatermark(time, delay)
    return rows.dropDuplicatesWithinWatermark(["__digest"]).drop("__digest")


def filtered(stream: DataFrame, layers, where: str) -> DataFrame:
    """Rows of a stream that pass a filter's layers, in the columns they have."""
    return layers.keep(stream, where)
