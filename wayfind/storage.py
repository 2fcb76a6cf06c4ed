"""Intermediate tables that survive lost executors.

Iterative and multi-pass operators cut their lineage by writing a Parquet table into
the folder that the cluster names in ``spark.checkpoint.dir`` and reading it again.
Unlike a checkpointed RDD the table is columnar, so later passes read only the columns
they use, and it needs no executor to stay alive.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local session gets one made."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="wayfind-"))
    return sc._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame, label: str, compact: bool = False, codec: str | None = None) -> DataFrame:
    """Write ``df`` once and return the table read back, with the same schema.

    ``compact`` is for the small tables of iterations: they are written by two tasks for each
    core at most, as every round would else begin with many tiny files. ``codec`` is a Parquet
    codec for tables of texts, where the session's own is not close enough.
    """
    spark = df.sparkSession
    if compact:
        df = df.coalesce(2 * spark.sparkContext.defaultParallelism)
    path = f"{shared_dir(spark)}/wayfind-tables/{label}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path, compression=codec)
    _written[path] = spark
    made = spark.read.schema(df.schema).parquet(path)
    made._wayfind_path = path
    return made


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs run inside go when each ends: its table replaces them."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


@contextlib.contextmanager
def bucketed(df: DataFrame, key: str, parts: int, label: str) -> Iterator[DataFrame]:
    """``df`` as a table in so many buckets of ``key``, for joins of many rounds; removed at the end.

    A join on the key reads it bucket by bucket and deals only its other side out.
    """
    spark, name = df.sparkSession, f"wayfind_{label}_{uuid.uuid4().hex}"
    path = scratch_path(spark, label)
    with shuffles_removed(spark):
        df.repartition(parts, key).write.format("parquet").bucketBy(parts, key).option("path", path).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"drop table {name}")
        discard(spark, path)


def release(df: DataFrame | None) -> None:
    """Remove the table that ``materialize`` returned, once nothing will read it again."""
    path = getattr(df, "_wayfind_path", None)
    if path in _written:
        discard(df.sparkSession, path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` begins so."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name = f"_{name}"
    return name


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder that is removed when the driver ends."""
    path = f"{shared_dir(spark)}/wayfind-tables/{label}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table through Hadoop's file system, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _written.pop(path, None)


@atexit.register
def _discard_all() -> None:
    for path, spark in list(_written.items()):
        try:
            discard(spark, path)
        except Exception:  # the JVM may be gone; the cluster cleans its own folder
            return
