"""Aggregations with partial sums before any exchange, except where an order inside a group is asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recent(samples: DataFrame, by: str, at: list[str], last: int) -> DataFrame:
    """Each group's ``last`` newest rows; the limit is on the window's rank, which Spark turns into a group limit before the exchange."""
    newest = Window.partitionBy(by).orderBy(*(F.desc(c) for c in at))
    rank = "__rank"
    return samples.withColumn(rank, F.row_number().over(newest)).where(F.col(rank) <= last).drop(rank)


def recent_summary(samples: DataFrame, by: str, value: str, at: list[str], last: int = 100) -> DataFrame:
    """count, sum, min, max and last value over each group's ``last`` newest samples."""
    rows = recent(samples, by, at, last)
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"), F.max_by(value, F.struct(*at)).alias("last"))


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two arrays of equal length; 0 where one is constant or missing."""
    n = F.size(a)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    times = lambda x, y: total(F.zip_with(x, y, lambda u, v: u * v))
    cov = times(a, b) - total(a) * total(b) / n
    var = lambda x: times(x, x) - total(x) * total(x) / n
    return F.when((n == F.size(b)) & (var(a) * var(b) > 0), cov / F.sqrt(var(a) * var(b))).otherwise(0.0)
