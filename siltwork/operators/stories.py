"""Chapters, heroes, covers: ordered analytics over capture time.

A chapter breaks on a gap that only the adjacent pair decides, or when it is full.
Every break restarts the count, so the chapter of a row is its run of unbroken rows
and its place in the run divided by the capacity: windows, no state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import haversine


def runs(rows: DataFrame, by: list[str], order: list[str], breaks: Column, cap: Column, name: str = "chapter") -> DataFrame:
    """Rows with ``name``, numbered from 1 within ``by``; ``breaks`` sees a row and its lags, ``cap`` is the capacity."""
    w = Window.partitionBy(*by).orderBy(*order)
    r = rows.withColumn("__break", F.coalesce(breaks, F.lit(False)).cast("int"))
    r = r.withColumn("__run", F.sum("__break").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*by, "__run").orderBy(*order)
    r = r.withColumn("__part", F.floor((F.row_number().over(inside) - 1) / cap))
    numbered = Window.partitionBy(*by).orderBy("__run", "__part")
    return r.withColumn(name, F.dense_rank().over(numbered).cast("long")).drop("__break", "__run", "__part")


def capacity(n: Column) -> Column:
    return F.when(n > 200, 24).when(n > 50, 16).otherwise(12)


def gap_reasons(rows: DataFrame, by: list[str], time: str = "epoch", seconds: float = 2700.0, km: float = 5.0) -> DataFrame:
    """``late`` and ``far``: whether a row breaks from the one before it by time (both known) or place."""
    w = Window.partitionBy(*by).orderBy(time, "photo_id")
    before = {c: F.lag(c).over(w) for c in (time, "latitude", "longitude")}
    late = (F.col(time) > 0) & (before[time] > 0) & (F.abs(F.col(time) - before[time]) > seconds)
    far = haversine(before["latitude"], before["longitude"], F.col("latitude"), F.col("longitude")) > km
    return rows.withColumn("late", F.coalesce(late, F.lit(False))).withColumn("far", F.coalesce(far, F.lit(False)))


def macro_chapters(photos: DataFrame, by: tuple[str, ...] = ("session_id",)) -> DataFrame:
    by = list(by)
    r = gap_reasons(photos.withColumn("__n", F.count("*").over(Window.partitionBy(*by))), by)
    return runs(r, by, ["epoch", "photo_id"], F.col("late") | F.col("far"), capacity(F.col("__n"))).drop("__n")


def mini_chapters(photos: DataFrame, by: list[str], least: int = 8, seconds: float = 600.0, cap: int = 18) -> DataFrame:
    """Breaks at a gap, at nightfall, or when full; small groups stay whole."""
    w = Window.partitionBy(*by).orderBy("taken_at", "photo_id")
    hour = F.hour(F.timestamp_seconds("taken_at"))
    r = photos.withColumn("__hour", hour).withColumn("__n", F.count("*").over(Window.partitionBy(*by)))
    gap = F.col("taken_at") - F.lag("taken_at").over(w) > seconds
    night = (F.lag("__hour").over(w) < 18) & (F.col("__hour") >= 18)
    return runs(r, by, ["taken_at", "photo_id"], (gap | night) & (F.col("__n") >= least), F.when(F.col("__n") >= least, cap).otherwise(1 << 30), "mini").drop("__hour", "__n")


def hero_order() -> list[Column]:
    return [*(F.desc(c) for c in ("hero", "major_faces", "face_quality", "blur", "contrast")), F.asc("taken_at"), F.asc("photo_id")]


def hero_of(photos: DataFrame, by: list[str]) -> DataFrame:
    """Rows with ``is_hero`` for each group's best and ``is_alternate`` for those within two points of it."""
    w = Window.partitionBy(*by).orderBy(*hero_order())
    top = F.first("hero").over(w)
    r = photos.withColumn("rank", F.row_number().over(w))
    return r.withColumn("is_alternate", (F.col("rank") > 1) & (F.abs(F.col("hero") - top) <= 2)).withColumn("is_hero", F.col("rank") == 1).drop("rank")


COVER_STYLES = (("SPLIT_BANNER", 2, "LANDSCAPE"), ("HERO_BAND", 1, "LANDSCAPE"), ("COLLAGE_2X2", 4, "ANY"))
BONUS = {"ANY": "8.0D", "LANDSCAPE": "CASE WHEN aspect >= 1.35D THEN 15.0D WHEN aspect >= 1.0D THEN 5.0D ELSE 0.0D END", "PORTRAIT": "CASE WHEN aspect <= 0.8D THEN 15.0D WHEN aspect <= 1.0D THEN 5.0D ELSE 0.0D END"}


def select_covers(photos: DataFrame, by: str = "session_id") -> DataFrame:
    """Per group and cover style the best photos not yet on another cover; a short pool is padded from the overall ranking.

    Only each group's few best rows by each style's order can be chosen (7 are used
    at most), so ranks cut the rows before the styles' choices are made in turn.
    """
    need = sum(n for _, n, _ in COVER_STYLES)
    p = photos.select(by, "photo_id", "hero", "faces", "aspect")
    base = Window.partitionBy(by).orderBy(F.desc("hero"), F.desc("faces"), "photo_id")
    ranked = p.withColumn("overall", F.row_number().over(base)).withColumn("pool", F.count("*").over(Window.partitionBy(by)))
    cuts = [F.col("overall") <= need]
    for k, (_, _, likes) in enumerate(COVER_STYLES):
        w = Window.partitionBy(by).orderBy(F.desc(F.col("hero") + F.expr(BONUS[likes])), F.desc("faces"), "photo_id")
        ranked = ranked.withColumn(f"r{k}", F.row_number().over(w))
        cuts.append(F.col(f"r{k}") <= need)
    keep = cuts[0]
    for c in cuts[1:]:
        keep = keep | c
    left, out = ranked.where(keep), []
    short = ranked.where(F.col("overall") <= need).select(by, "photo_id", F.col("overall").alias("o"), "pool")
    used = 0
    for k, (style, n, _) in enumerate(COVER_STYLES):
        w = Window.partitionBy(by).orderBy(f"r{k}")
        chosen = left.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
        out.append(chosen.select(by, F.lit(style).alias("style"), F.col("rank").cast("long").alias("rank"), "photo_id"))
        had = F.least(F.lit(n), F.greatest(F.lit(0), F.col("pool") - used))
        pad = short.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).where((F.col("slot") < n - had) & (F.col("o") - 1 == F.col("slot") % F.col("pool")))
        out.append(pad.select(by, F.lit(style).alias("style"), (had + F.col("slot") + 1).cast("long").alias("rank"), "photo_id"))
        left = left.join(chosen.select(by, "photo_id"), [by, "photo_id"], "left_anti")
        used += n
    result = out[0]
    for o in out[1:]:
        result = result.unionByName(o)
    return result
