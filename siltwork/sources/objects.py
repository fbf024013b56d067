"""Single objects of a store, through Hadoop's file systems; many are read with ``binaryFile``."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..functions.keys import PLAIN


def _at(spark: SparkSession, base: str, key: str):
    if not PLAIN.fullmatch(key) or ".." in key.split("/"):
        raise ValueError(f"not a storage key: {key!r}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/{key}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def head(spark: SparkSession, base: str, key: str) -> dict | None:
    """Bytes and time of change (seconds) of an object, or None."""
    fs, path = _at(spark, base, key)
    if not fs.exists(path):
        return None
    status = fs.getFileStatus(path)
    return None if status.isDirectory() else {"bytes": status.getLen(), "mtime": status.getModificationTime() / 1000}


def delete(spark: SparkSession, base: str, key: str) -> bool:
    """Whether there was such an object to delete."""
    fs, path = _at(spark, base, key)
    return bool(fs.exists(path) and not fs.getFileStatus(path).isDirectory() and fs.delete(path, False))


def delete_prefix(spark: SparkSession, base: str, prefix: str) -> int:
    """Deletes all objects under a prefix, a whole folder; how many there were."""
    fs, path = _at(spark, base, prefix.rstrip("/"))
    if not fs.exists(path):
        return 0
    n, files = 0, fs.listFiles(path, True)
    while files.hasNext():
        files.next()
        n += 1
    fs.delete(path, True)
    return n
