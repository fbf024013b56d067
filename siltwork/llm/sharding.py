"""Shards by a hierarchical weighted hash tree.

Shards hang under racks, racks under regions; a node weighs what its shards weigh
together. A row descends from the root: at each level every child draws
``-ln(u) / weight`` from a hash of (seed, child, doc_id) and the smallest draw wins,
so a child is met with its share of the weight. A draw depends on nothing but its own
child and weight. A weight that rises therefore only draws rows into that child, one
that falls only sends rows out of it, and siblings trade nothing: whatever changes
below a region, rows move into, out of or inside that region alone. A shard that
comes as a region of its own takes rows into itself only.

Where a row goes takes its doc_id and the tree, nothing else: no exchange, no state.
The descent is one expression over the tree's levels as literal arrays, so plans do
not grow with the tree. Slots follow doc_id: rows go to ranges of (shard, doc_id),
ranges are counted, and rows numbered inside these, so no shard meets in one task,
however large, and reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import tasks_for, written
from .labelled import free_name

SEED = 13
SHAPE = (4, 2, 2)  # regions, racks of each, shards of each: 16 shards
FILE_ROWS = 1 << 20


@dataclass(frozen=True)
class Tree:
    """``weights[region][rack][shard]``; shards are numbered in this order, from 0."""

    weights: tuple[tuple[tuple[float, ...], ...], ...]
    seed: int = SEED

    def __post_init__(self) -> None:
        flat = [w for region in self.weights for rack in region for w in rack]
        if not flat or any(not rack for region in self.weights for rack in region) or any(not region for region in self.weights) or any(not w > 0 for w in flat):
            raise ValueError("every region has racks, every rack has shards, every shard weighs more than 0")

    @classmethod
    def even(cls, regions: int = SHAPE[0], racks: int = SHAPE[1], shards: int = SHAPE[2], seed: int = SEED) -> Tree:
        return cls((((1.0,) * shards,) * racks,) * regions, seed)

    def grown(self, weight: float = 1.0) -> Tree:
        """One more shard, in a rack and region of its own: no other subtree's weight changes."""
        return Tree((*self.weights, ((weight,),)), self.seed)

    def reweighted(self, region: int, rack: int, shard: int, weight: float) -> Tree:
        w = [[list(k) for k in r] for r in self.weights]
        w[region][rack][shard] = weight
        return Tree(tuple(tuple(tuple(k) for k in r) for r in w), self.seed)

    def paths(self) -> list[tuple[int, int, int]]:
        """(region, rack, shard of the rack) of every shard, by its number."""
        return [(i, j, k) for i, region in enumerate(self.weights) for j, rack in enumerate(region) for k in range(len(rack))]

    def shard(self, doc_id: str) -> Column:
        """The number of the shard of the row that the column ``doc_id`` names; a null counts as the empty text."""

        def node(path: str, weight: float, at: int) -> str:
            return f"named_struct('path', '{self.seed}/{path}:', 'weight', {weight!r}D, 'at', {at})"

        regions, racks, shards = [], [], []
        for i, region in enumerate(self.weights):
            regions.append(node(f"{i}", sum(map(sum, region)), i))
            racks.append([])
            for j, rack in enumerate(region):
                racks[i].append(node(f"{i}/{j}", sum(rack), len(shards)))
                first = sum(map(len, shards))
                shards.append([node(f"{i}/{j}/{k}", w, first + k) for k, w in enumerate(rack)])
        key = f"coalesce(CAST(`{doc_id}` AS STRING), '')"
        # 52 bits of a hash, strictly between 0 and 1
        draw = f"-ln((CAST(conv(substr(md5(concat(c.path, {key})), 1, 13), 16, 10) AS DOUBLE) + 0.5D) / 4503599627370496D) / c.weight"
        least = lambda children: f"array_min(transform({children}, c -> named_struct('draw', {draw}, 'at', c.at))).at"
        table = lambda rows: "array(" + ", ".join("array(" + ", ".join(r) + ")" for r in rows) + ")"
        region = least(f"array({', '.join(regions)})")
        rack = least(f"{table(racks)}[{region}]")
        return F.expr(least(f"{table(shards)}[{rack}]"))


ORDER = ["doc_id", "size", "text_crc32"]


def _slots(rows: DataFrame) -> DataFrame:
    """``slot`` numbers each shard's rows from 0 in ``ORDER``; equal rows are told apart by where they were read, so they split too."""
    tasks = tasks_for(rows)
    ranges = rows.withColumn("uid", F.monotonically_increasing_id()).repartitionByRange(tasks, "shard", *ORDER, "uid")
    rows = written(ranges.withColumn("part", F.spark_partition_id()), "ranges")
    ahead = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    heads = rows.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("head"))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy(*ORDER)) - 1
    return rows.withColumn("inside", inside).join(heads, ["shard", "part"]).withColumn("slot", (F.col("head") + F.col("inside")).cast("long"))


def assigned(documents: DataFrame, tree: Tree | None = None, grown: Tree | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, region, rack of every row.

    ``size`` is the text's UTF-8 bytes plus 1, ``text_crc32`` that of its bytes; a null
    text counts as empty. Rows with one doc_id, or with none, share a shard (the law is
    ``key``) and get slots of their own. ``grown_shard`` is the shard under ``grown``, one
    more region of one shard unless given. Other columns are not looked at; no rows give
    no rows. Slots are in order of doc_id (null first), size and checksum, rows equal in
    all three in any order.
    """
    tree = tree or Tree.even()
    grown = grown or tree.grown()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    own = written(own.withColumns({"shard": tree.shard("doc_id").cast("int"), "grown_shard": grown.shard("doc_id").cast("int")}), "shards", tasks_for(documents))
    rows = _slots(own)
    paths = tree.paths()
    level = lambda k: F.expr(f"array({', '.join(str(p[k]) for p in paths)})[shard]")
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", level(0).alias("region"), level(1).alias("rack"))


def write(documents: DataFrame, path: str, tree: Tree | None = None) -> None:
    """Writes whole rows under ``path``, a folder for each shard, in files of at most ``FILE_ROWS`` rows.

    Rows go to tasks by (shard, hash of the row's number), so a large shard is written by
    many. A column called ``shard`` of the input, in any case, gives way to the folder's.
    """
    tree = tree or Tree.even()
    kept = [c for c in documents.columns if c.lower() != "shard"]
    rows = documents.select(*kept).withColumn("shard", tree.shard("doc_id").cast("int"))
    salt = free_name(rows.columns, "salt")
    rows = rows.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(tasks_for(documents)))).repartition("shard", salt).drop(salt)
    rows.write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("shard").parquet(path)


def moved(documents: DataFrame, before: Tree, after: Tree) -> DataFrame:
    """from_shard, to_shard, n_rows, n_bytes of the rows that go elsewhere when ``before`` becomes ``after``."""
    pair = documents.select(before.shard("doc_id").alias("from_shard"), after.shard("doc_id").alias("to_shard"), F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).alias("n"))
    return pair.where("from_shard <> to_shard").groupBy("from_shard", "to_shard").agg(F.count("*").alias("n_rows"), F.sum("n").alias("n_bytes"))
