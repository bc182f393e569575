"""Session plumbing that operators share: the shared folder and written tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: While a table is written: its shuffle files go at the end.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
_BATCH, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where the setting is absent, a local session gets a temporary folder; a
    cluster session is refused, since no folder of one machine would survive the
    loss of that machine.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if sc.getCheckpointDir():
        return sc.getCheckpointDir().rstrip("/")
    if not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillmill-"))
    return sc.getCheckpointDir().rstrip("/")


#: Folders written within ``temporary``, by nesting.
_WRITTEN: list[list[str]] = []


def drop(spark: SparkSession, path: str) -> None:
    """Delete a written table."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at its end what ``materialize`` wrote meanwhile, but for the folders that are taken out of the list."""
    made: list[str] = []
    _WRITTEN.append(made)
    try:
        yield made
    finally:
        _WRITTEN.remove(made)
        for path in made:
            drop(spark, path)


def keep(path: str) -> None:
    """Leave a folder that was taken out of a nested ``temporary`` to the one around it, if there is one."""
    if _WRITTEN:
        _WRITTEN[-1].append(path)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage and lets a frame be read several times without computing it
    again; survives the loss of any executor. The folder goes with the session, or at the
    end of ``temporary``; the shuffle files of the write go when it is done.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillmill-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in _WRITING}
    for k, v in _WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if _WRITTEN:
        _WRITTEN[-1].append(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def _width(name: Column, kind: T.DataType) -> Column:
    """Bytes that a value takes in memory."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.lit(16) + F.coalesce(F.octet_length(name), F.lit(0))
    if isinstance(kind, T.StructType):
        return sum((_width(name[f.name], f.dataType) for f in kind.fields), F.lit(16))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType)):
            return F.lit(24) + F.coalesce(F.aggregate(F.transform(name, lambda x: _width(x, kind.elementType).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0))
        each = 16 + 8 * len(kind.elementType.fields) if isinstance(kind.elementType, T.StructType) else 8
        return F.lit(24) + F.coalesce(F.size(name), F.lit(0)) * each
    return F.lit(8)


def size_in_memory(df: DataFrame) -> tuple[int, int]:
    """Bytes and rows of a written table as rows in memory: one pass over the lengths of its values."""
    row = sum((_width(df[f.name], f.dataType) for f in df.schema.fields), F.lit(16)).cast("long")
    found = df.agg(F.coalesce(F.sum(row), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    return found["b"], found["n"]


def broadcast_if_small(df: DataFrame, most_bytes: int = 16 << 20, most_rows: int = 1_000_000) -> DataFrame:
    """A written table, marked for broadcast if its rows in memory are within the limits; else left to a shuffled join.

    The limits hold at every size of the corpus, so what is broadcast doesn't grow
    with it; the rows of the join are the same either way.
    """
    size, rows = size_in_memory(df)
    return F.broadcast(df) if size <= most_bytes and rows <= most_rows else df


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 4 MB: a batch is held several times, by the JVM, the socket and Python, in each task. A lower setting stays."""
    now = spark.conf.get(_BATCH, None)
    if now is None or not 0 < spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) <= _BATCH_BYTES:
        spark.conf.set(_BATCH, str(_BATCH_BYTES))


def spread(df: DataFrame) -> DataFrame:
    """Few partitions (a small file of one row group is a single one) over all cores; others are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
