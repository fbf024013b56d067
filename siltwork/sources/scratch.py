"""Written intermediate tables in the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder on a cluster; only a local master, which
has no other machines, may do without it. Tables written here cut lineage and survive
the loss of an executor. ``released`` removes one that is read no more; the rest goes
when the driver ends.
"""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

LOCAL_FALLBACK = "/tmp/checkpoints"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
# neither checksum files nor a success mark beside tables that nothing but this job reads
_PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false", "compression": "zstd"}
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return found or LOCAL_FALLBACK


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for as long as the block runs."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def small_batches(spark: SparkSession):
    """While a job runs: rows go to Python workers in batches of 8 MB, which JVM and worker both hold, instead of 64."""
    return setting(spark, BATCH_BYTES, "8m")


def written(df: DataFrame, name: str, tasks: int | None = None) -> DataFrame:
    """The same rows, written to the shared folder (by at most so many tasks) and read from there.

    Shuffle files that made them go at once; rows go to Python workers in small batches.
    """
    spark = df.sparkSession
    df = df if tasks is None else df.coalesce(tasks)
    path = f"{shared_dir(spark)}/siltwork-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    with setting(spark, SHUFFLE_CLEANUP, "true"), small_batches(spark):
        df.write.options(**_PLAIN).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def released(*tables: DataFrame | None) -> None:
    """Removes tables that ``written`` returned and nothing reads any more."""
    for t in tables:
        path = getattr(t, "scratch_path", None) if t is not None else None
        if path and (t.sparkSession, path) in _written:
            _remove(t.sparkSession, path)
            _written.remove((t.sparkSession, path))


def tasks_for(df: DataFrame, file_bytes: int = 128 << 20) -> int:
    """How many tasks write what is about as large as ``df``: files of some size, but two tasks a core at least."""
    return max(2 * df.sparkSession.sparkContext.defaultParallelism, min(plan_bytes(df, counted=False) // file_bytes, 1 << 24))


def temporary(spark: SparkSession, path: str) -> str:
    """Has the path removed when the driver ends."""
    _written.append((spark, path))
    return path


def plan_bytes(df: DataFrame, counted: bool = True) -> int:
    """Catalyst's size of the input in bytes; where it has none, by counted rows if ``counted``."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().__str__())
    return size if size < 1 << 55 or not counted else df.count() * 4096


@atexit.register
def _clear() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the JVM may be gone already
            return
