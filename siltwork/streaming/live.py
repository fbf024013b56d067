"""Structured Streaming forms of the ingest, chapter and limit operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregates import recent
from ..operators.state import latest
from ..sources.scratch import setting

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def source(spark: SparkSession, folder: str, schema, files_a_trigger: int | None = 8) -> DataFrame:
    """Parquet files as they arrive; without a limit, all that are there in one batch."""
    reader = spark.readStream.schema(schema)
    return (reader if files_a_trigger is None else reader.option("maxFilesPerTrigger", files_a_trigger)).parquet(folder)


def session_windows(events: DataFrame, gap: str = "45 minutes", late: str = "2 hours") -> DataFrame:
    """Each user's spells of activity: a session window closes when the watermark passes its gap."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return e.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id")).select("user_id", F.col("w.start").alias("starts"), F.col("w.end").alias("ends"), "n", "first_id")


def rolling_metrics(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and total of each step by event-time window."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return e.groupBy(F.window("at", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")).select("event_type", F.col("w.start").alias("starts"), "n", "cents")


STEP_LAST, LOG_LAST = 100, 50


def rolling_log(path: str, by: str = "step", value: str = "cents", at: tuple[str, ...] = ("arrives", "event_id")):
    """A foreachBatch sink: after every batch the newest ``STEP_LAST`` samples of each step and the newest ``LOG_LAST`` of all.

    A batch's own newest are found in every partition before they meet (Spark limits a
    ranked window, and sorts with a limit, in each task), then merged with the rings
    of the batch before, so neither a step's nor the whole log's rows meet in one task.
    Rings are written whole under the batch's number: a batch that runs twice writes the
    same again.
    """
    order = [F.desc(c) for c in at]

    def write(batch: DataFrame, number: int) -> None:
        columns = [by, value, *at]
        rows = batch.select(*columns)
        for ring, cut in (("steps", lambda r: recent(r, by, list(at), STEP_LAST)), ("log", lambda r: r.orderBy(*order).limit(LOG_LAST))):
            held = cut(rows)
            before = [n for n in range(number - 1, -1, -1) if exists(batch.sparkSession, f"{path}/{ring}/batch={n}/_SUCCESS")][:1]
            if before:
                held = cut(held.unionByName(batch.sparkSession.read.schema(held.schema).parquet(f"{path}/{ring}/batch={before[0]}")))
            held.coalesce(1).write.mode("overwrite").parquet(f"{path}/{ring}/batch={number}")

    return write


def last_rings(spark: SparkSession, path: str, schema, number: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The rings of the steps and of the log after a batch, by default the last one."""
    n = max(children(spark, f"{path}/steps")) if number is None else number
    return tuple(spark.read.schema(schema).parquet(f"{path}/{ring}/batch={n}") for ring in ("steps", "log"))


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def children(spark: SparkSession, path: str) -> list[int]:
    """The numbers of a folder's batches."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(target)
    return [int(f.getPath().getName().removeprefix("batch=")) for f in found]


def upsert_into(path: str, key: str, at: list[str]):
    """A foreachBatch sink: the batch's newest row of each key into a table of versions; replays change nothing."""

    def write(batch: DataFrame, number: int) -> None:
        latest(batch, key, at).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def current(spark: SparkSession, path: str, key: str, at: list[str]) -> DataFrame:
    """The newest row of each key over all batches."""
    return latest(spark.read.parquet(path), key, at)


def make_folder(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)


def moved(spark: SparkSession, path: str, to: str) -> bool:
    """Moves a folder with its files at once; whether there was one."""
    if not exists(spark, path):
        return False
    a, b = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x) for x in (path, to))
    if not a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(a, b):
        raise OSError(f"cannot move {path}")
    return True


def drained(stream: DataFrame, sink: str, checkpoint: str, come: Sequence[Callable[[], bool]] = (lambda: True,)) -> DataFrame:
    """Runs what is there through a stream into a table and reads the table. Keyed state is kept by RocksDB, in a partition a core.

    Each of ``come`` brings the next files in, before which the stream stops and after
    which it goes on from its checkpoint; False if there were none. What a clock that they
    moved makes due is done with the next files, after the last in a batch of its own.
    """
    spark = stream.sparkSession
    with setting(spark, STATE_STORE, ROCKS_DB), setting(spark, "spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism)):
        for k, bring in enumerate(come, 1):
            if bring():
                with setting(spark, "spark.sql.streaming.noDataMicroBatches.enabled", str(k == len(come)).lower()):
                    _drain(stream, sink, checkpoint)
    return spark.read.schema(stream.schema).parquet(sink)


def _drain(stream: DataFrame, sink: str, checkpoint: str) -> None:
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
