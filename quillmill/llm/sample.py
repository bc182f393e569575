"""Bounded samples by a hash, without moving anything but hashes to choose them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def least(frame: DataFrame, key: Column, value: Column, n: int) -> DataFrame:
    """``value``, one for each of the at most ``n`` least values of ``key``, of rows with equal keys the least.

    Every task sends at most ``n`` keys to find the last of them; then only rows up to that one move.
    """
    rows = frame.select(key.alias("k"), value.alias("value"))
    last = rows.select("k").orderBy("k").limit(n).agg(F.max("k")).first()[0]
    if last is None:
        return rows.select("value").limit(0)
    return rows.where(F.col("k") <= last).groupBy("k").agg(F.min("value").alias("value")).orderBy("k").limit(n).select("value")
