"""Shared storage and schema helpers of the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Used only where the session names no checkpoint folder and runs in one process (tests, notebooks).
LOCAL_FALLBACK = "file:///tmp/checkpoints/clickloom"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, without which a cluster is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (folder or LOCAL_FALLBACK).rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/clickloom-{uuid.uuid4().hex}/{name}"
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path).getParent()
    top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(top)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a Parquet table in the shared folder and read it.

    A lost executor costs a re-read of the files, never a recomputation, and
    values drawn while writing (row ids) stay what they were.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def discard(df: DataFrame) -> None:
    """Delete a materialised table that nothing reads any more; other frames are left alone."""
    path = getattr(df, "_written_to", None)
    if path:
        p = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def collect_shuffles(df: DataFrame) -> None:
    """Let Spark remove the shuffle files and broadcasts that no plan refers to any more.

    They go when the driver's JVM collects its garbage, which may be long after a job
    with many steps has written them.
    """
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def sized(df: DataFrame, broadcast_keys: int) -> DataFrame:
    """A written table, to be broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.count() <= broadcast_keys else df


#: Bytes of an Arrow batch between the JVM and Python: several copies of one exist at a time in each task.
BATCH_BYTES = 2 << 20


def release_memory() -> None:
    """Give what a Python worker has freed back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` for ``DataFrame.transform``, in batches of bounded bytes, by workers that keep no memory.

    Rows are as wide as texts, so the usual bound of rows alone lets memory follow
    the texts' lengths. The bound is a session option and is read when the plan runs;
    a smaller one that the caller has set stays.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < _bytes(conf.get(key)) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return df.mapInArrow(lean, schema)


def _bytes(size: str) -> int:
    """A size option as bytes: a number, or a number with b, k, m or g."""
    digits = size.lower().rstrip("bkmg")
    unit = size.lower()[len(digits) :].rstrip("b")
    return int(digits) << {"": 0, "k": 10, "m": 20, "g": 30}[unit]


def refuse_clashes(kept: Iterable[str], own: Iterable[str]) -> None:
    """An error if a column that is to be kept has the name of a result."""
    if clash := sorted({c.lower() for c in kept} & {c.lower() for c in own}):
        raise ValueError(f"columns of the result can't be kept: {', '.join(clash)}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(col: str) -> F.Column:
    """crc32 of an id written as text; a null id counts as the empty text (crc 0)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))
