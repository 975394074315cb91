"""Where intermediate results live.

Both ways of keeping a table write it to the folder the cluster names in
``spark.checkpoint.dir`` and read it back, so the lineage ends there, and a lost
executor costs a re-read and never a re-computation. ``stage`` writes a file for
each task. ``compacted`` is for what is made by joins and aggregates: a task
takes several partitions where little is read. Hadoop's local file system starts
a process or two for each file and folder that it makes, and small tables of
hundreds of files are slow to list and read.
"""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_BYTES, LEAST_BYTES, BROADCAST_BYTES, BUCKET_BYTES = 16 << 20, 4 << 20, 4 << 20, 256 << 10
_SILENT = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}  # the caller waits for the job: a marker file tells nothing


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; one of our own only where the session names none and the driver is the only machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="maskweave-"))
    return sc.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Paths staged since each open scope of this thread began, innermost last.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there,
    so a lost executor costs a re-read and never a re-computation."""
    path = fresh_path(df.sparkSession, name)
    for scope in _scopes.get()[-1:]:
        scope.append(path)
    spark = df.sparkSession
    if path.startswith("file:"):  # java.io makes the writer's folders without a process for each
        spark._jvm.java.io.File(path.removeprefix("file:") + "/_temporary/0").mkdirs()
    df.write.mode("append").options(**_SILENT).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def size_of(df: DataFrame) -> int:
    """Bytes of a stored table, as its files have them; Catalyst's estimate for others."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def bytes_read(df: DataFrame) -> int:
    """Bytes of all that ``df`` reads, by Catalyst's statistics of the leaves of its plan."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


def in_few_files(df: DataFrame) -> DataFrame:
    """``df`` in as many tasks as what it reads fills files, and no more than it has:
    one for little, then as many as there are cores, then one for each FILE_BYTES."""
    n = bytes_read(df)
    cores = df.sparkSession.sparkContext.defaultParallelism
    n = max(1, min(-(-n // LEAST_BYTES), max(cores, -(-n // FILE_BYTES))))
    return df.coalesce(n) if n < 1 << 20 else df


def compacted(df: DataFrame, name: str) -> DataFrame:
    """``stage`` with a bounded number of files: what is written must not be far more than what is read."""
    return stage(in_few_files(df), name)


def few(df: DataFrame, width: int | None = None) -> DataFrame:
    """A side of a join, which has been stored: broadcast if it is small, else as it is.
    Small is by the bytes of its files, or for keys by their number and ``width``."""
    n = size_of(df) if width is None else df.count() * (width + 32) // 4
    return F.broadcast(df) if n <= BROADCAST_BYTES else df


def beside(df: DataFrame) -> DataFrame:
    """The small side of a join with texts, which has been stored: it is hashed, so the texts are not sorted."""
    return F.broadcast(df) if size_of(df) <= BROADCAST_BYTES else df.hint("shuffle_hash")


def bucketed(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``stage`` for what is grouped by ``keys``: joins on them shuffle their other side only.

    Spark takes buckets as they are if there are as many as it would shuffle into. Little is stored as by ``stage``."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or spark.conf.get("spark.sql.shuffle.partitions"))
    if bytes_read(df) < n * BUCKET_BYTES:
        return stage(df, name)
    path = fresh_path(spark, name)
    for scope in _scopes.get()[-1:]:
        scope.append(path)
    entry = f"{name}-{uuid.uuid4().hex}".replace("-", "_")
    df.write.options(**_SILENT).bucketBy(n, *keys).saveAsTable(entry, format="parquet", path=path)
    out = spark.table(entry)
    spark.sql(f"DROP TABLE {entry}")  # only its name: files at a path of their own stay
    return out


def delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def collected() -> Iterator[list[str]]:
    """The paths that are staged meanwhile, in a list for whoever deletes them."""
    paths: list[str] = []
    token = _scopes.set((*_scopes.get(), paths))
    try:
        yield paths
    finally:
        _scopes.reset(token)


def handed_on(paths: list[str]) -> None:
    """Paths that ``collected`` found become the scope's around."""
    for scope in _scopes.get()[-1:]:
        scope.extend(paths)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """What is staged meanwhile is deleted at the end: nothing that outlives it may read it."""
    with collected() as paths:
        yield
    delete(spark, paths)
