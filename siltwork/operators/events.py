"""Events: photos joined through any chain of near ones in time and place, without all pairs.

Two photos are near when the square of their time apart in units of ``seconds`` and the
square of their distance in units of ``km`` sum to at most 1; the distance to an
unknown place is 0. Space and time are cut into cells so small that all of one are
near: a cell is one node of the graph, and only cells that can reach one another are
compared. Boxes around their photos decide most of these comparisons; what they leave
open is decided between halves of the cells, and so on, and between photos where few are
left. A pair of cells that is linked anywhere is looked at no more. Photos of
unknown place form cells by time alone, for which the nearest ends decide.

Places are points of three dimensions on the sphere, so neither poles nor the date
line are special. A straight line between two of them is never longer than the way
over ground, and bounds from boxes are turned into the latter.
"""

from __future__ import annotations

from functools import reduce
from itertools import product
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import released, tasks_for, written
from . import graph
from .joins import haversine

RADIUS = 6371.0
SIDE = 0.45  # of a cell in units of km: sqrt(3) * 0.45 = 0.78
SPAN = 0.6  # of a cell in units of seconds: 0.78^2 + 0.6^2 < 1
STEPS = 2  # cells of times further apart are not near
FEW = 64  # photo pairs of two cells that are compared at once
DEEPEST = 40  # halvings of a cell: far below what coordinates resolve
SAFE = 1e-7  # bounds that are closer to 1 decide nothing
AXES = ("t", "x", "y", "z")


def _points(photos: DataFrame, seconds: float, km: float) -> DataFrame:
    """Positions in units of the thresholds; place is null where a coordinate is."""
    known = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    lat, lon = F.radians("latitude"), F.radians("longitude")
    at = {"x": F.cos(lat) * F.cos(lon), "y": F.cos(lat) * F.sin(lon), "z": F.sin(lat)}
    p = photos.select("photo_id", "session_id", "taken_at", F.when(known, F.col("latitude")).alias("latitude"), F.when(known, F.col("longitude")).alias("longitude"))
    return p.withColumns({"t": F.col("taken_at") / seconds} | {k: F.when(F.col("latitude").isNotNull(), v * (RADIUS / km)) for k, v in at.items()})


def _cell(level: int) -> Column:
    """A point's cell, whose sides halve at each level; the first level's cell is part of the next one's name by halving."""
    side = {k: (SPAN if k == "t" else SIDE) / (1 << level) for k in AXES}
    return F.struct(*(F.floor(F.col(k) / side[k]).alias(k) for k in AXES))


def _cells(points: DataFrame, level: int) -> DataFrame:
    """session_id, cell, n and the box of its points; ``same``: whether all are one point, then its coordinates hold for all."""
    box = [f(c).alias(f"{n}_{c}") for c in AXES for n, f in (("lo", F.min), ("hi", F.max))]
    same = (F.min("taken_at") == F.max("taken_at")) & (F.min("latitude") == F.max("latitude")) & (F.min("longitude") == F.max("longitude"))
    return points.groupBy("session_id", _cell(level).alias("cell")).agg(F.count("*").alias("n"), F.min("photo_id").alias("head"), *box, same.alias("same"), F.min("taken_at").alias("taken_at"), F.min("latitude").alias("latitude"), F.min("longitude").alias("longitude"))


def _bounds(km: float) -> tuple[Column, Column]:
    """The least and the most that two points of the boxes a and b can be apart, squared."""
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"a.lo_{c}") - F.col(f"b.hi_{c}"), F.col(f"b.lo_{c}") - F.col(f"a.hi_{c}"))
    reach = lambda c: F.greatest(F.col(f"a.hi_{c}") - F.col(f"b.lo_{c}"), F.col(f"b.hi_{c}") - F.col(f"a.lo_{c}"))
    r = RADIUS / km

    def ground(f) -> Column:
        chord = F.sqrt(f("x") * f("x") + f("y") * f("y") + f("z") * f("z"))
        return F.asin(F.least(F.lit(1.0), chord / (2 * r))) * (2 * r)

    return tuple(f("t") * f("t") + ground(f) * ground(f) for f in (gap, reach))


def _apart(seconds: float, km: float) -> Column:
    t = (F.col("a.taken_at") - F.col("b.taken_at")) / seconds
    g = haversine(F.col("a.latitude"), F.col("a.longitude"), F.col("b.latitude"), F.col("b.longitude")) / km
    return F.sqrt(t * t + g * g)


def _judged(pairs: DataFrame, seconds: float, km: float) -> DataFrame:
    """Pairs with structs a and b of cells whose boxes are not too far apart: ``near`` is null where they leave it open, only there cells stay.

    Written before it is filtered by, so that it is evaluated once.
    """
    least, most = _bounds(km)
    gaps = [F.col(f"{x}.lo_{c}") - F.col(f"{y}.hi_{c}") <= 1 + SAFE for c in AXES for x, y in ("ab", "ba")]
    pairs = pairs.where(reduce(and_, gaps)).where(least <= 1 + SAFE)
    judged = pairs.withColumn("near", F.when(F.col("a.same") & F.col("b.same"), _apart(seconds, km) <= 1).when(most < 1 - SAFE, True))
    left = [F.when(F.col("near").isNull(), F.struct(f"{x}.cell", f"{x}.n")).alias(x) for x in "ab"]
    return written(judged.select("session_id", "first", "near", *left), "judged")


def _placed_links(points: DataFrame, seconds: float, km: float) -> DataFrame:
    """(a, b): heads of linked cells among photos of known place."""
    points = points.where("x IS NOT NULL")
    cells = written(_cells(points, 0), "cells")
    # cells meet through blocks that are as wide as cells' middles can be apart, so next to one another
    blocks = {f"block_{c}": F.floor((F.col(f"cell.{c}") + 0.5) * w / (1 + w)) for c, w in zip(AXES, (SPAN, SIDE, SIDE, SIDE), strict=True)}
    onward = [o for o in product((-1, 0, 1), repeat=4) if o >= (0, 0, 0, 0)]  # every two blocks once
    # a block is known by a hash; where two share one, the boxes tell their cells apart
    key = lambda o: F.xxhash64("session_id", *(F.col(f"block_{c}") + k for c, k in zip(AXES, o, strict=True)))
    homes = cells.withColumns(blocks).withColumn("home", key((0, 0, 0, 0)))
    there = homes.select(F.col("home").alias("block")).distinct()
    # a small table comes in one task, but each of its rows asks for many blocks
    meets = homes.select("home", "session_id", *blocks).distinct().repartition(tasks_for(cells), "home").select("home", F.explode(F.array(*map(key, onward))).alias("block")).join(there, "block")
    row = F.struct(*(c for c in cells.columns if c != "session_id"))
    a = homes.select("session_id", "home", row.alias("a"))
    b = homes.select(F.col("session_id").alias("of"), F.col("home").alias("block"), row.alias("b"))
    pairs = a.join(meets, "home").join(b, "block").where((F.col("session_id") == F.col("of")) & ((F.col("home") != F.col("block")) | (F.col("a.head") < F.col("b.head")))).select("session_id", "a", "b")
    judged = _judged(pairs.withColumn("first", F.struct(F.col("a.head").alias("a"), F.col("b.head").alias("b"))), seconds, km)
    found = [judged.where("near").select("first.a", "first.b")]
    open_, read = judged.where("near IS NULL"), [cells]
    for level in range(DEEPEST + 1):
        if open_.isEmpty():
            break
        cell = lambda side: open_.select("session_id", F.col(f"{side}.cell").alias("cell"))  # noqa: B023, E731
        own = written(points.withColumn("cell", _cell(level)).join(cell("a").unionByName(cell("b")).distinct(), ["session_id", "cell"], "left_semi"), "points")
        small = (F.col("a.n") * F.col("b.n") <= FEW) if level < DEEPEST else F.lit(True)
        few = open_.where(small).select("session_id", "first", F.col("a.cell").alias("a_cell"), F.col("b.cell").alias("b_cell"))
        at = F.struct("taken_at", "latitude", "longitude")
        side = lambda s, rows: rows.select("session_id", F.col("cell").alias(f"{s}_cell"), at.alias(s))
        by_photo = few.join(side("a", own), ["session_id", "a_cell"]).join(side("b", own), ["session_id", "b_cell"]).where(_apart(seconds, km) <= 1).select("first.a", "first.b").distinct()
        halves = _cells(own.drop("cell"), level + 1)
        up = F.struct(*(F.shiftright(F.col(f"cell.{k}"), 1).alias(k) for k in AXES))
        part = lambda s: halves.select("session_id", up.alias(f"{s}_cell"), F.struct(*(c for c in halves.columns if c != "session_id")).alias(s))  # noqa: B023, E731
        many = open_.where(~small).select("session_id", "first", F.col("a.cell").alias("a_cell"), F.col("b.cell").alias("b_cell"))
        split = many.join(part("a"), ["session_id", "a_cell"]).join(part("b"), ["session_id", "b_cell"]).select("session_id", "first", "a", "b")
        halved = _judged(split, seconds, km)
        sure = written(by_photo.unionByName(halved.where("near").select("first.a", "first.b")).distinct(), "links")
        found.append(sure)
        linked = sure.select(F.struct("a", "b").alias("first"))
        open_ = halved.where("near IS NULL").join(linked, "first", "left_anti")
        read += [own, halved]
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    links = written(links, "links")
    released(*read, judged, *found[1:])
    return links


def _timed_links(points: DataFrame, seconds: float) -> DataFrame:
    """(a, b): heads of cells that a cell of photos of unknown place is linked with; only times count there."""
    placed = F.col("x").isNotNull()
    step = F.floor(F.col("t") / SPAN)
    cells = points.groupBy("session_id", F.when(placed, _cell(0)).alias("cell"), step.alias("step")).agg(F.min("photo_id").alias("head"), F.min("taken_at").alias("lo"), F.max("taken_at").alias("hi"))
    lost = cells.where("cell IS NULL").select("session_id", F.col("step").alias("near"), F.col("head").alias("b"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
    visits = cells.select("session_id", "head", "lo", "hi", F.col("cell").isNull().alias("is_lost"), F.explode(F.sequence(F.lit(-STEPS), F.lit(STEPS))).alias("k"), "step").withColumn("near", F.col("step") + F.col("k")).drop("step")
    # cells of one step span less than the limit; of two steps the nearest ends are the nearest photos
    apart = F.greatest(F.lit(0.0), F.col("lo") - F.col("b_hi"), F.col("b_lo") - F.col("hi")) / seconds
    near = lambda rows, others: rows.join(others, ["session_id", "near"]).where((F.col("head") != F.col("b")) & (apart <= 1))
    # a cell is near all of its step that are lost: what those are linked with needs no link of its own
    chain = written(near(visits.where("is_lost"), lost).select("session_id", "near", "k", "head", "b"), "lost")
    known = chain.groupBy("session_id", "near").agg(F.collect_set("k").alias("known"))
    others = lost.join(known, ["session_id", "near"], "left")
    rest = near(visits.where("NOT is_lost"), others).where("known IS NULL OR NOT array_contains(known, k)").select(F.col("head").alias("a"), "b")
    return rest.unionByName(chain.where("k > 0").select(F.col("head").alias("a"), "b"))


def events(photos: DataFrame, seconds: float = 2700.0, km: float = 5.0) -> DataFrame:
    """photo_id and event, the smallest photo_id that a photo reaches; every photo is in one, alone if near to none.

    ``photos`` has photo_id, session_id, taken_at, latitude, longitude; other columns are
    not looked at. A photo without a time or a session is an event of its own.
    """
    points = written(_points(photos, seconds, km), "points")
    timed = points.where("taken_at IS NOT NULL AND session_id IS NOT NULL")
    links = _placed_links(timed, seconds, km).unionByName(_timed_links(timed, seconds))
    roots = graph.components(links).select(F.col("node").alias("head"), "root")
    cell = F.when(F.col("x").isNotNull(), _cell(0)).otherwise(F.struct(F.floor(F.col("t") / SPAN).alias("t"), *(F.lit(None).cast("long").alias(c) for c in AXES[1:])))
    named = timed.withColumn("cell", cell)
    heads = named.groupBy("session_id", "cell").agg(F.min("photo_id").alias("head"))
    ids = named.join(heads, (named["session_id"] == heads["session_id"]) & named["cell"].eqNullSafe(heads["cell"])).select("photo_id", "head")
    found = ids.join(roots, "head", "left").select("photo_id", F.coalesce("root", "head").alias("event"))
    alone = points.where("taken_at IS NULL OR session_id IS NULL").select("photo_id", F.col("photo_id").alias("event"))
    return found.unionByName(alone)
