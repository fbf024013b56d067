"""Running values over a key of any size, as prefix scans over ranges.

Rows go to ranges of (key, order), so a key with most rows is many tasks' work. A
window runs inside each range; what a range's keys carry in is made of the totals of
the ranges before it, a small table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.scratch import tasks_for, written

_AGGREGATES = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}
_JOINED = {"sum": lambda a, b: F.coalesce(a + b, a, b), "count": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest, "min": F.least}


def _ranges(rows: DataFrame, by: str, order: list[str], ranges: int | None, inside: Callable[[WindowSpec], dict[str, Column]]) -> DataFrame:
    """Written rows with ``__part``, their range, and columns over the window of their key's rows in it, up to each row."""
    own = rows.withColumn("__uid", F.monotonically_increasing_id()).repartitionByRange(ranges or tasks_for(rows), by, *order, "__uid")
    window = Window.partitionBy(by, "__part").orderBy(*order, "__uid").rowsBetween(Window.unboundedPreceding, 0)
    return written(own.withColumn("__part", F.spark_partition_id()).withColumns(inside(window)), "ranges")


def _before(by: str) -> WindowSpec:
    return Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)


def _carried(local: DataFrame, totals: DataFrame, by: str) -> DataFrame:
    side = totals.withColumnsRenamed({by: "__by", "__part": "__of"})
    return local.join(side, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__part") == F.col("__of")))


def running(rows: DataFrame, by: str, order: list[str], ranges: int | None = None, **values: tuple[str, Column]) -> DataFrame:
    """Rows with, for each name, the aggregate (sum, max, min or count of an expression) over the key's rows up to and with this one.

    Rows of one key and one ``order`` come in any order among themselves, but each has its
    own place. Nulls are passed over, as in Spark's own windows; null keys are one key.
    """
    kinds = {n: kind for n, (kind, _) in values.items()}
    local = _ranges(rows.withColumns({f"__{n}": e for n, (_, e) in values.items()}), by, order, ranges, lambda w: {f"__l_{n}": _AGGREGATES[k](f"__{n}").over(w) for n, k in kinds.items()})
    totals = local.groupBy(by, "__part").agg(*(_AGGREGATES[k](f"__{n}").alias(f"__t_{n}") for n, k in kinds.items()))
    fold = lambda n, k: _AGGREGATES["sum" if k == "count" else k](f"__t_{n}").over(_before(by)).alias(f"__c_{n}")
    carry = totals.select(by, "__part", *(fold(n, k) for n, k in kinds.items()))
    return _carried(local, carry, by).select(*rows.columns, *(_JOINED[k](F.col(f"__l_{n}"), F.col(f"__c_{n}")).alias(n) for n, k in kinds.items()))


def islands(rows: DataFrame, by: str, order: list[str], flag: Column, ranges: int | None = None) -> DataFrame:
    """``streak``: how many rows of the key up to this one the flag has held without a break; an unknown flag does not hold.

    The last break's place is its place in its range after the rows of the ranges before.
    """
    local = _ranges(rows.withColumn("__f", F.coalesce(flag, F.lit(False))), by, order, ranges, lambda w: {"__n": F.row_number().over(w)})
    inside = Window.partitionBy(by, "__part").orderBy("__n").rowsBetween(Window.unboundedPreceding, 0)
    broken = F.max(F.when(~F.col("__f"), F.col("__n")))
    totals = local.groupBy(by, "__part").agg(F.count("*").alias("__rows"), broken.alias("__last"))
    start = F.coalesce(F.sum("__rows").over(_before(by)), F.lit(0))
    placed = totals.select(by, "__part", start.alias("__start"), "__last").select(by, "__part", "__start", F.max(F.col("__start") + F.col("__last")).over(_before(by)).alias("__broken"))
    joined = _carried(local.withColumn("__own", broken.over(inside)), placed, by)
    since = F.coalesce(F.col("__start") + F.col("__own"), F.col("__broken"), F.lit(0))
    return joined.select(*rows.columns, (F.col("__start") + F.col("__n") - since).cast("long").alias("streak"))
