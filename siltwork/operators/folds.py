"""Order-dependent greedy operators.

Scopes that are bounded by their rules (an upload chunk of 40, a chapter of at most
24, an image's faces) become one row with an array of their members. Which members go
together is said by the library's pair expressions over that array; the greedy choice
is then an ``aggregate`` over lists of positions, so it stays in the JVM. Scopes without
a bound (a key's hits, a session's uploads) are streamed in order with a state of fixed
size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import pearson
from .joins import duplicate, iou
from .quality import hamming

NO_POSITIONS = "CAST(array() AS ARRAY<INT>)"


def members(rows: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """One row a group: ``by`` and ``ps``, its rows as structs in order; for groups of bounded size."""
    held = F.array_sort(F.collect_list(F.struct(*order, *(c for c in columns if c not in order))))
    return rows.groupBy(*by).agg(held.alias("ps"))


def _positions(first: Column, last: Column) -> Column:
    """Array positions from ``first`` up to, not including, ``last``."""
    return F.when(first < last, F.sequence(first.cast("int"), (last - 1).cast("int"))).otherwise(F.expr(NO_POSITIONS))


def _pair(a: Column, b: Column, **names: str) -> Callable[[str], Column]:
    """How pair expressions see two members: ``a_shell`` is the first one's ``shell``."""
    return lambda name: (a if name.startswith("a_") else b)[names.get(name[2:], name[2:])]


def leaders(ps: Column, rule: Callable[[Callable[[str], Column], Column], Column]) -> Column:
    """For each member the position of the first leader before it that ``rule`` pairs it with, or its own: then it leads."""
    before = F.transform(ps, lambda b, j: F.filter(_positions(F.lit(0), j), lambda i: rule(_pair(ps[i], b), F.abs(ps[i]["moment"] - b["moment"]))))
    first = lambda got, own: F.coalesce(F.get(F.filter(own, lambda i: F.get(got, i) == i), F.lit(0)), F.size(got))
    return F.aggregate(before, F.expr(NO_POSITIONS), lambda got, own: F.concat(got, F.array(first(got, own))))


BURST = ["photo_id", "moment", "shell", "core", "faces", "face_quality", "hero", "blur", "contrast"]


def burst_groups(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, photo_id, leader (a photo_id) and survives: of a burst all stay if it has a good face, else its best photo.

    ``rows`` has by, seq, photo_id, moment, shell, core, faces, face_quality, hero, blur, contrast.
    """
    return bursts_of(members(rows, by, ["seq"], BURST), by)


def _led(groups: DataFrame) -> DataFrame:
    """Groups with, by position in ``ps``, each member's leader, and of each leader its burst's best seq and whether all stay; most lead nobody but themselves."""
    g = groups.withColumn("lead", leaders(F.col("ps"), lambda at, dt: duplicate(dt, at)))
    g = g.withColumn("followed", F.filter("lead", lambda k, i: k != i))
    value = lambda p: p["hero"] * 2 + p["blur"] + p["contrast"] * 1.5
    good = lambda p: (p["faces"] >= 1) & (p["face_quality"] >= 0.75)
    of = lambda k: F.filter("ps", lambda _, i: F.get(F.col("lead"), i) == k)
    one = lambda k: ~F.array_contains("followed", k)
    best = F.transform("ps", lambda p, k: F.when(one(k), -p["seq"]).otherwise(F.array_max(F.transform(of(k), lambda p: F.struct(value(p).alias("v"), (-p["seq"]).alias("s"))))["s"]))
    kept = F.transform("ps", lambda p, k: F.when(one(k), good(p)).otherwise(F.exists(of(k), good)))
    return g.withColumn("best", best).withColumn("kept", kept)


def _survives(i: Column, seq: Column) -> Column:
    lead = F.get("lead", i)
    return F.get("kept", lead) | (F.get("best", lead) == -seq)


def bursts_of(groups: DataFrame, by: list[str]) -> DataFrame:
    """What ``burst_groups`` gives, of groups that are arrays ``ps`` already."""
    out = _led(groups).select(*by, "ps", "lead", "best", "kept", F.posexplode("ps").alias("i", "p"))
    return out.select(*by, "p.photo_id", F.get("ps", F.get("lead", F.col("i")))["photo_id"].alias("leader"), _survives(F.col("i"), F.col("p.seq")).alias("survives"))


def chunk_status(chunks: DataFrame, by: list[str], seconds: int = 30, bits: int = 10, blur: float = 18.0) -> DataFrame:
    """by, photo_id and status of every photo of chunks ``ps``: blurry ones that alone record their moment in the chunk pass, then bursts are cleared.

    Members have ``status``, seq and what ``BURST`` names. One row at a time, so it follows
    a stateful operator in a stream.
    """
    ps = F.col("ps")
    near = lambda p, o: (o["photo_id"] != p["photo_id"]) & (F.abs(o["moment"] - p["moment"]) <= seconds) & (hamming(p["shell"], o["shell"]) <= bits)
    alone = lambda p: (p["status"] == "REJECTED_BLURRY") & (p["blur"] >= blur) & ~F.exists(ps, lambda o: near(p, o))
    every = chunks.withColumn("every", F.transform(ps, lambda p: p.withField("status", F.when(alone(p), "PASSED").otherwise(p["status"]))))
    led = _led(every.withColumn("ps", F.filter("every", lambda p: p["status"] == "PASSED")))
    held = led.select(*by, "lead", "best", "kept", F.transform("ps", lambda p: p["photo_id"]).alias("ids"), "every")
    # an inner explode would first look for empty chunks, and for that work out ``every`` once more
    out = held.select(*by, "lead", "best", "kept", "ids", F.explode_outer("every").alias("p")).where(F.col("p").isNotNull())
    at = (F.array_position("ids", F.col("p.photo_id")) - 1).cast("int")
    status = F.when(F.col("p.status") != "PASSED", F.col("p.status")).when(_survives(at, F.col("p.seq")), "PASSED").otherwise("REJECTED_BURST")
    return out.select(*by, "p.photo_id", status.alias("status"))


# --- layout groups --------------------------------------------------------------

TRIPTYCH = "BURST_TRIPTYCH_GROUP"
KINDS = {2: "COMPANION_PAIR", 3: "THEME_TRIPTYCH_GROUP", 4: "THEME_QUAD_GROUP"}


def _moving(a: Column, b: Column) -> Column:
    """The same place, another pose."""
    # Bits of place and pose.
    at = _pair(a, b)
    return (hamming(at("a_shell"), at("b_shell")) <= 8) & (hamming(at("a_core"), at("b_core")) >= 4)


def triptych_starts(ps: Column) -> Column:
    """Positions at which three consecutive portraits of a moving subject within 45 s begin, left to right, no photo in two."""
    p = lambda i: F.get(ps, i)
    # 45 seconds, an aspect of 0.85.
    hit = lambda i: (p(i + 2)["moment"] - p(i)["moment"] <= 45) & (F.greatest(*(p(i + k)["aspect"] for k in range(3))) < 0.85) & _moving(p(i), p(i + 1)) & _moving(p(i + 1), p(i + 2))
    hits = F.filter(_positions(F.lit(0), F.size(ps) - 2), hit)
    return F.aggregate(hits, F.expr(NO_POSITIONS), lambda got, i: F.when(F.coalesce(F.element_at(F.concat(F.array(F.lit(-3)), got), -1), F.lit(-3)) + 3 <= i, F.concat(got, F.array(i))).otherwise(got))


def _scene(ps: Column, first: Column, last: Column, j: Column) -> Column:
    """Whether a photo goes on with a chain: near its last and first photo's place, or the first's with its colours."""
    # Bits to the first and last photo, and the colours' correlation.
    near = hamming(F.get(ps, first)["shell"], F.get(ps, j)["shell"])
    step = hamming(F.get(ps, last)["shell"], F.get(ps, j)["shell"])
    alike = (near <= 14) & (pearson(F.get(ps, first)["hist"], F.get(ps, j)["hist"]) >= 0.65)
    return ((step <= 10) & (near <= 12)) | alike


def layout_groups(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, group_id, kind, photo_id, pos: triptychs first, then chains of one scene among photos that are in no group yet.

    A chain spans five minutes and holds at most four photos, two if its first has no
    face. ``rows`` has by, seq, photo_id, moment, shell, core, faces, aspect, hist.
    """
    ps = F.col("ps")
    g = members(rows, by, ["seq"], ["photo_id", "moment", "shell", "core", "faces", "aspect", "hist"])
    g = g.withColumn("starts", triptych_starts(ps)).withColumn("used", F.flatten(F.transform("starts", lambda i: F.sequence(i, i + 2))))
    late = lambda i, j: F.get(ps, j)["moment"] - F.get(ps, i)["moment"] > 300

    def grown(used: Column, i: Column) -> Column:
        most = F.when(F.get(ps, i)["faces"] == 0, 2).otherwise(4)
        free = F.filter(_positions(i + 1, F.size(ps)), lambda j: ~F.array_contains(used, j))
        stop = F.coalesce(F.array_min(F.filter(free, lambda j: late(i, j))), F.size(ps))
        one_more = lambda chain, j: F.when((j < stop) & (F.size(chain) < most) & _scene(ps, i, F.element_at(chain, -1), j), F.concat(chain, F.array(j))).otherwise(chain)
        return F.aggregate(free, F.array(i), one_more)

    # the state is one array of chains; what they hold is used
    def step(chains: Column, i: Column) -> Column:
        used = F.flatten(chains)
        chain = grown(used, i)
        return F.when(F.array_contains(used, i), chains).otherwise(F.concat(chains, F.filter(F.array(chain), lambda c: F.size(c) > 1)))

    chains = F.aggregate(_positions(F.lit(0), F.size(ps)), F.array(F.col("used")), step)
    g = g.withColumn("themes", F.slice(chains, 2, F.size(ps)))
    kind = F.element_at(F.create_map(*(F.lit(x) for k in KINDS.items() for x in k)), F.size("c"))
    parts = [
        g.select(*by, "ps", F.explode(F.transform("starts", lambda i: F.sequence(i, i + 2))).alias("c"), F.lit(TRIPTYCH).alias("kind")),
        g.select(*by, "ps", F.explode("themes").alias("c")).withColumn("kind", kind),
    ]
    every = parts[0].unionByName(parts[1])
    named = every.withColumn("group_id", F.get("ps", F.col("c")[0])["photo_id"]).select(*by, "ps", "kind", "group_id", F.posexplode("c").alias("pos", "i"))
    return named.select(*by, "group_id", "kind", F.get("ps", F.col("i"))["photo_id"].alias("photo_id"), "pos")


# --- spreads and boxes ----------------------------------------------------------


def affinity(at: Callable[[str], Column]) -> Column:
    """How well two photos of a chapter go on one spread."""
    # Limits and weights of the score.
    shell, core = hamming(at("a_shell"), at("b_shell")), hamming(at("a_core"), at("b_core"))
    return F.when(shell <= 8, (10 - shell) * 2).otherwise(0) + F.when(core >= 4, 5).otherwise(0) + F.when(F.abs(at("a_aspect") - at("b_aspect")) < 0.25, 6).otherwise(0)


def spread_groups(rows: DataFrame, by: list[str], sizes: tuple[int, ...], carried: list[str]) -> DataFrame:
    """by, size, spread, photos, for each of the sizes: each photo not yet placed takes the most akin of the next eight, until its spread is full.

    A chapter that fits one spread is one; one of at most four photos has smaller
    spreads. ``rows`` has by, seq, photo_id, shell, core, aspect; a spread's photos, structs of
    ``carried`` in order, stay with their chapter, so nothing need be joined to them.
    """
    ps = F.col("ps")
    g = members(rows, by, ["seq"], list(dict.fromkeys(["photo_id", "shell", "core", "aspect", *carried])))
    ranked = F.transform(ps, lambda a, i: F.transform(F.array_sort(F.transform(_positions(i + 1, F.least(F.size(ps), i + 9)), lambda j: F.struct((-affinity(_pair(a, F.get(ps, j)))).alias("less"), j.alias("j")))), lambda x: x["j"]))
    rooms = F.transform(F.array(*map(F.lit, sizes)), lambda n: F.struct(n.alias("size"), F.when(F.size(ps) <= 4, F.greatest(F.lit(2), n - 1)).otherwise(n).alias("room")))
    g = g.withColumn("akin", ranked).withColumn("r", F.explode(rooms)).select(*by, "ps", "akin", "r.size", "r.room")

    def step(spreads: Column, i: Column) -> Column:
        used = F.flatten(spreads)
        more = F.slice(F.filter(F.get("akin", i), lambda j: ~F.array_contains(used, j)), F.lit(1), F.col("room") - 1)
        return F.when(F.array_contains(used, i), spreads).otherwise(F.concat(spreads, F.array(F.concat(F.array(i), more))))

    none = F.expr("CAST(array() AS ARRAY<ARRAY<INT>>)")
    every = _positions(F.lit(0), F.size(ps))
    spreads = F.when(F.size(ps) <= F.col("room"), F.array(every)).otherwise(F.aggregate(every, none, step))
    out = g.withColumn("s", spreads).select(*by, "size", "ps", F.posexplode("s").alias("spread", "c"))
    photo = lambda i: F.struct(*(F.get("ps", i)[c].alias(c) for c in carried))
    return out.select(*by, "size", "spread", F.transform("c", photo).alias("photos"))


def spread_chunks(rows: DataFrame, by: list[str], *sizes: int) -> DataFrame:
    """by, size, spread, pos, photo_id: a row a photo of ``spread_groups``."""
    out = spread_groups(rows, by, sizes, ["photo_id"])
    return out.select(*by, "size", "spread", F.posexplode("photos").alias("pos", "p")).select(*by, "size", "spread", "pos", F.col("p.photo_id").alias("photo_id"))


def without_overlaps(boxes: DataFrame, by: list[str], most: float = 0.35) -> DataFrame:
    """by and box: an image's boxes by confidence times area, without those that overlap a better kept one too much."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    g = members(boxes.withColumn("less", -F.col("conf") * area), by, ["less", "seq", "x0", "y0"], ["x1", "y1"])
    clear = lambda kept, b: F.forall(kept, lambda k: iou(_pair(k, b)) <= most)
    kept = F.aggregate("ps", F.slice("ps", 1, 0), lambda got, b: F.when(clear(got, b), F.concat(got, F.array(b))).otherwise(got))
    return g.select(*by, F.explode(kept).alias("b")).select(*by, F.col("b.seq").alias("box"))


# --- streams --------------------------------------------------------------------


def streamed(rows: DataFrame, by: list[str], order: list[str], start: Callable[[], object], step: Callable[[object, dict], dict], schema: str) -> DataFrame:
    """``step(state, row)``'s row for every row of a group in order; a task holds one group's state and one batch."""
    names = [x.strip().split()[0] for x in schema.split(",")]
    kinds = pa.schema([(n, _TYPES[t]) for n, t in (x.split() for x in schema.split(","))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                own = tuple(row[k] for k in by)
                if own != key:
                    key, state = own, start()
                out.append(step(state, row))
            yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in out], schema=kinds)

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}


def rate_limited(limit: int, seconds: float) -> tuple[Callable, Callable]:
    """At most ``limit`` admitted hits in any trailing window; refused hits do not count. The state is the last admitted times."""

    def step(times: list[float], row: dict) -> dict:
        ok = len(times) < limit or times[0] <= row["at"] - seconds
        if ok:
            times.append(row["at"])
            del times[:-limit]
        return {"key": row["key"], "hit": row["seq"], "allowed": ok}

    return list, step


def within_quota(most: int) -> tuple[Callable, Callable]:
    """Uploads that still fit; refused ones take no room. The state is the room taken."""

    def step(taken: list[int], row: dict) -> dict:
        ok = taken[0] + row["bytes"] <= most
        taken[0] += row["bytes"] if ok else 0
        return {"photo_id": row["photo_id"], "code": 200 if ok else 413}

    return (lambda: [0]), step
