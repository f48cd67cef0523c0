"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The folders made inside the innermost swept block of this thread; None outside of one.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def scratch_path(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir. Where that is unset, a session on one machine (tests) gets a
    local folder; on a cluster this raises."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="siftmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    own = _made.get()
    if own is not None:
        own.append(path)
    return path


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes folders; those that aren't there do no harm."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving, by an exception too, what this thread stored inside. Only for work whose results
    are written elsewhere. Blocks may stand in each other and in several threads: each owns its folders."""
    own: list[str] = []
    outer = _made.set(own)
    try:
        yield
    finally:
        _made.reset(outer)
        discard(spark, *own)


def kept(df: DataFrame) -> DataFrame:
    """df written there as Parquet and read again."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], rows: int = 0) -> DataFrame:
    """What make returns, kept; all that was kept on the way is deleted. rows: the most rows of a file (0: any
    number). Tasks that read are dealt by bytes, of which narrow rows that repeat take few: without it, what a task
    gathers of them grows with the table."""
    path = scratch_path(spark)
    with swept(spark):
        df = make()
        df.write.option("maxRecordsPerFile", rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled_each(spark: SparkSession, make: Callable[[], tuple[DataFrame, ...]], count: int) -> list[DataFrame]:
    """settled for a make that returns `count` frames."""
    paths = [scratch_path(spark) for _ in range(count)]
    with swept(spark):
        frames = make()
        for df, path in zip(frames, paths, strict=True):
            df.write.parquet(path)
    return [spark.read.schema(df.schema).parquet(path) for df, path in zip(frames, paths)]


def collected(spark: SparkSession) -> None:
    """Has the driver collect its garbage: shuffle files stay until it finds that no frame refers to them any more,
    which it may do late. Between steps that shuffle as much as their input."""
    gc.collect()
    spark._jvm.System.gc()
