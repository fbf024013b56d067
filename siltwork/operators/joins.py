"""Joins of the curation flow. Range predicates become equi-joins on buckets and their neighbours."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import plan_bytes
from .hashes import near_pairs
from .quality import hamming


def small_side(df: DataFrame, most_bytes: int = 8 << 20) -> DataFrame:
    """A hint to broadcast, given only to a side that the plan's statistics bound; otherwise the plan's own choice stands. No job runs."""
    return F.broadcast(df) if plan_bytes(df, counted=False) <= most_bytes else df


def with_metadata(photos: DataFrame, metadata: DataFrame, key: str = "photo_id") -> DataFrame:
    """Photos with the last metadata record of their key; photos without one are left out."""
    last = metadata.groupBy(key).agg(F.max_by(F.struct(*(c for c in metadata.columns if c != key)), "pos").alias("m")).select(key, "m.*")
    return photos.join(last, key)


def parsed_metadata(texts: DataFrame, text: str, fields: str, key: str = "photo_id") -> DataFrame:
    """Records of JSON arrays (column ``text``, ordered by ``seq``): objects without a key are dropped, the last of a key holds."""
    r = texts.select("seq", F.posexplode(F.from_json(text, f"array<struct<{key}: string, {fields}>>")).alias("at", "r")).select("seq", "at", "r.*")
    r = r.where(F.coalesce(F.col(key), F.lit("")) != "")
    rest = [c for c in r.columns if c not in ("seq", "at", key)]
    return r.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("seq", "at")).alias("r")).select(key, "r.*")


def file_key(name: Column) -> Column:
    """A photo's key from its file's name: the stem without a thumbnail's mark."""
    stem = F.regexp_replace(F.regexp_replace(name, "^.*/", ""), "[.][^.]*$", "")
    return F.regexp_replace(stem, "_thumb$", "")


def unmatched(photos: DataFrame, metadata: DataFrame, key: str = "photo_id") -> DataFrame:
    return photos.join(metadata.select(key), key, "left_anti")


def ordered_lookup(rows: DataFrame, ids: list[int], key: str) -> DataFrame:
    """Rows of the wanted ids in the order they were asked for, unknown ids dropped. The list is the caller's own."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(i, p) for p, i in enumerate(ids)], f"{key} long, pos int")
    return rows.join(F.broadcast(wanted), key).orderBy("pos")


def range_pairs(rows: DataFrame, at: str, width: float, by: list[str], keep: Column, columns: list[str]) -> DataFrame:
    """Pairs a_*, b_* of rows of equal ``by`` whose ``at`` differ by at most ``width`` and for which ``keep`` holds; a's seq is the smaller.

    The left side visits its own bucket and both neighbours; the right side stays put.
    """
    cell = F.floor(F.col(at) / width)
    left = rows.select(*by, *(F.col(c).alias(f"a_{c}") for c in columns), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    right = rows.select(*by, *(F.col(c).alias(f"b_{c}") for c in columns), cell.alias("cell"))
    return left.join(right, [*by, "cell"]).where((F.col("a_seq") < F.col("b_seq")) & (F.abs(F.col(f"a_{at}") - F.col(f"b_{at}")) <= width) & keep).drop("cell")


def duplicate(dt: Column, at: Callable[[str], Column] = F.col) -> Column:
    """The burst rule: close in time and looks, or a group shot within minutes; alike but moving subjects are kept.

    ``at`` gives the pair's values by name.
    """
    shell, core = hamming(at("a_shell"), at("b_shell")), hamming(at("a_core"), at("b_core"))
    # Bits, seconds and faces of the rule.
    alike = (shell <= 7) & (core <= 5)
    group = (at("a_faces") >= 2) & (at("b_faces") >= 2) & (dt <= 180)
    moving = (shell <= 8) & (core >= 5) & (dt <= 45)
    return alike & ((dt <= 5) | group) & ~moving


DUPLICATE_SECONDS, DUPLICATE_CORE = 180, 5  # the widest that the rule above allows


def duplicate_pairs(rows: DataFrame, by: list[str], at: str) -> DataFrame:
    """a_*, b_* of seq, photo_id, ``at``, shell, core, faces of all pairs that the burst rule finds alike; a's seq is the smaller.

    Every such pair's core hashes differ in few bits, so pairs are looked for by their bands.
    """
    pairs = near_pairs(rows, rows, by, at, DUPLICATE_SECONDS, "core", DUPLICATE_CORE, ["seq", "photo_id", at, "shell", "core", "faces"])
    return pairs.where((F.col("a_seq") < F.col("b_seq")) & duplicate(F.abs(F.col(f"a_{at}") - F.col(f"b_{at}"))))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres on a sphere of 6371 km; 0 where a coordinate is unknown."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.coalesce(F.lit(6371.0) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a)), F.lit(0.0))


def space_time(time: str = "epoch", seconds: float = 2700.0, km: float = 5.0) -> Column:
    """Distance of a pair in units of the time and place thresholds."""
    t = (F.col(f"a_{time}") - F.col(f"b_{time}")) / seconds
    g = haversine(F.col("a_latitude"), F.col("a_longitude"), F.col("b_latitude"), F.col("b_longitude")) / km
    return F.sqrt(t * t + g * g)


def iou(at: Callable[[str], Column] = F.col) -> Column:
    """Intersection over union of boxes given as a_x0, a_y0, a_x1, a_y1 and b's; ``at`` gives values by name."""
    side = lambda k: F.greatest(F.lit(0.0), F.least(at(f"a_{k}1"), at(f"b_{k}1")) - F.greatest(at(f"a_{k}0"), at(f"b_{k}0")))
    both = side("x") * side("y")
    area = lambda s: (at(f"{s}_x1") - at(f"{s}_x0")) * (at(f"{s}_y1") - at(f"{s}_y0"))
    return both / (area("a") + area("b") - both)
