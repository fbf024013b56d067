"""Tables that change: event logs with latest-state views, upserts, retention, eviction, quotas.

Parquet has no update in place. A change is a row of a log; the current state is the
latest row of each key, taken with max_by (partial before the exchange), not a sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, key: str, at: list[str]) -> DataFrame:
    """Each key's newest row."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*at)).alias("r")).select(key, "r.*")


def with_newest(rows: DataFrame, at: str) -> tuple[DataFrame, str]:
    """Rows with the largest ``at`` of all, and that column's name: a one-row aggregate is joined in, no job runs first."""
    name = f"__newest_{at}"
    return rows.crossJoin(F.broadcast(rows.agg(F.max(at).alias(name)))), name  # one row


def upsert_replace(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows take the place of old ones; what they do not list becomes null. One row a key in each."""
    full = new.select(*new.columns, *(F.lit(None).cast(t).alias(c) for c, t in old.dtypes if c not in new.columns)).select(*old.columns)
    return old.join(new.select(key), key, "left_anti").unionByName(full)


def upsert_merge(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows' columns win, columns that they do not list stay."""
    n = new.select(key, F.struct(*(c for c in new.columns if c != key)).alias("n"))
    j = old.withColumn("o", F.struct(*old.columns)).select(key, "o").join(n, key, "full")
    pick = lambda c: F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in new.columns else F.col(f"o.{c}")
    return j.select(key, *(pick(c).alias(c) for c in old.columns if c != key))


def evict(files: DataFrame, by: str, now: Column, ttl: float, budget: int, free: Column | None = None, floor: int = 0) -> DataFrame:
    """What stays in a cache: unexpired files, the newest that together fit the budget and leave ``floor`` bytes of the disk free.

    Dropping the oldest until under a limit keeps the longest suffix that fits, which is a
    running sum. ``free``: the disk's free bytes before anything goes.
    """
    w = Window.partitionBy(by).orderBy(F.desc("mtime"), F.desc("file"))
    room = F.lit(budget) if free is None else F.least(F.lit(budget), F.sum("bytes").over(Window.partitionBy(by)) + free - floor)
    live = files.withColumn("room", room).where(now - F.col("mtime") <= ttl)
    return live.withColumn("newer", F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("newer") <= F.col("room")).drop("newer", "room")


def evolve(df: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """The wanted columns with (type, default) in order: missing ones added, nulls defaulted."""
    return df.select(*((F.coalesce(F.col(c).cast(t), F.lit(v).cast(t)) if c in df.columns else F.lit(v).cast(t)).alias(c) for c, (t, v) in columns.items()))
