"""A bounded sample of labelled rows for classifiers, how rows are held out, and names that no column has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def free_name(columns: list[str], wanted: str) -> str:
    """A column name that none of ``columns`` has, in any case."""
    while wanted.lower() in {c.lower() for c in columns}:
        wanted += "_"
    return wanted


def remainder(of: int) -> Column:
    """crc32 of doc_id's text modulo ``of``; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % of


def sample(documents: DataFrame, labels: DataFrame, label: str, learn: Column, most: int) -> DataFrame:
    """(text, label) of about ``most`` labelled rows at most, picked by a hash of doc_id, so alike at every size.

    Null labels and null ids are left out; of several labels for one doc_id the largest holds.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & learn)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    total = known.count()
    share = 1 << 30 if total <= most else (most << 30) // total
    picked = known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < share)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(picked), "doc_id").select("text", "label")  # broadcast: at most about `most` rows of two numbers
