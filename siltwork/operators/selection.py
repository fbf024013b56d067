"""Exact order statistics by selection: histograms narrow every wanted rank to a few rows, only these are sorted.

A pass counts the rows of each open range of values in ``BUCKETS`` buckets, before
any exchange; the bucket that a rank falls into is its next range, with the true least
and largest value in it. The two ends have buckets of their own, so a range always
narrows. No task holds more than counts, or at the end ``FEW`` rows a rank, however
many rows a group has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

BUCKETS = 4096
FEW = 65_536  # rows of a range that are sorted
PASSES = 40


def ranked_values(rows: DataFrame, by: str, value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """``by`` and, a column each, the values at the 0-based ranks that ``ranks`` makes of a group's number of values.

    Null and NaN values are left out; a group without others has no row. A null ``by`` is a
    group. Equal values are told apart by nothing, so ties do not matter.
    """
    rows = rows.select(F.col(by).alias("by"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    base = rows.groupBy("by").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), of(F.col("n")).cast("long").alias("k")) for name, of in ranks.items()))).alias("w")
    targets = written(base.select("by", "n", "lo", "hi", wanted).select("by", "w.name", "w.k", "n", "lo", "hi"), "ranks")
    open_ = (F.col("n") > FEW) & (F.col("lo") < F.col("hi"))
    done = []
    for _ in range(PASSES):
        wide = targets.where(open_)
        if wide.isEmpty():
            break
        done.append(targets.where(~open_))
        side = wide.select(F.col("by").alias("of"), "name", "k", F.col("lo").alias("from"), F.col("hi").alias("to"))
        inside = rows.join(side, F.col("by").eqNullSafe(F.col("of")) & F.col("v").between(F.col("from"), F.col("to")))
        share = F.floor((F.col("v") - F.col("from")) / (F.col("to") - F.col("from")) * BUCKETS)
        bucket = F.when(F.col("v") == F.col("from"), 0).when(F.col("v") == F.col("to"), BUCKETS + 2).otherwise(1 + share)
        counts = inside.groupBy("by", "name", "k", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy("by", "name", "k").orderBy("bucket"))
        found = counts.withColumn("upto", upto).where((F.col("upto") > F.col("k")) & (F.col("upto") - F.col("n") <= F.col("k")))
        targets = written(found.select("by", "name", (F.col("k") - F.col("upto") + F.col("n")).alias("k"), "n", "lo", "hi"), "ranks")
    for t in done:
        targets = targets.unionByName(t)
    one = targets.where("lo = hi").select("by", "name", F.col("lo").alias("v"))
    side = targets.where("lo < hi").select(F.col("by").alias("of"), "name", "k", "lo", "hi")
    left = rows.join(side, F.col("by").eqNullSafe(F.col("of")) & F.col("v").between(F.col("lo"), F.col("hi")))
    at = F.row_number().over(Window.partitionBy("by", "name").orderBy("v")) - 1
    sorted_ = left.withColumn("at", at).where(F.col("at") == F.col("k")).select("by", "name", "v")
    out = one.unionByName(sorted_).groupBy("by").agg(*(F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in ranks))
    return out.withColumnRenamed("by", by)


def nearest_ranks(rows: DataFrame, by: str, value: str, **percents: float) -> DataFrame:
    """By group the values at ranks round(p/100 * (n-1)), half to even."""
    return ranked_values(rows, by, value, {name: (lambda n, p=p: F.rint(F.lit(p / 100.0) * (n - 1))) for name, p in percents.items()})


def medians(rows: DataFrame, by: str, value: str, name: str = "median") -> DataFrame:
    """By group the middle value, or the mean of the two middle ones."""
    both = ranked_values(rows, by, value, {"__low": lambda n: F.floor((n - 1) / 2), "__high": lambda n: F.ceil((n - 1) / 2)})
    return both.select(by, (F.col("__low") + (F.col("__high") - F.col("__low")) * 0.5).alias(name))
