"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillmill.runtime import materialize

#: Edges up to this number (16 MB) are joined on the driver; the result is the same either way.
LOCAL_EDGES = 500_000


def _local(edges: DataFrame) -> DataFrame:
    table = edges.toPandas()
    ends, number = np.unique(table[["a", "b"]].to_numpy(np.int64), return_inverse=True)
    label = np.arange(len(ends))
    a, b = number.reshape(-1, 2).T
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    out = pa.table({"id": pa.array(ends, pa.int64()), "label": pa.array(ends[label], pa.int64())})
    return edges.sparkSession.createDataFrame(out.to_pandas(), "id long, label long")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 30)))).first())


def connected_components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``id, label`` for every end of ``edges(a, b)``; the label is the least id of the component.

    Alternates large-star and small-star steps until a step changes nothing; every
    step is written to the shared folder. No edges give an empty table.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    edges = materialize(edges)
    if edges.count() <= local_edges:
        return _local(edges)
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("x"), F.col("a").alias("y")).where("x < y")
        edges = materialize(small.unionByName(low.select(F.col("m").alias("x"), F.col("b").alias("y"))).distinct().toDF("a", "b"))
        now = _state(edges)
        if now == state:
            break
        state = now
    return edges.select(F.col("b").alias("id"), F.col("a").alias("label")).unionByName(edges.select("a").distinct().select(F.col("a").alias("id"), F.col("a").alias("label")))
