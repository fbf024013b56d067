"""Books as documents: the nested text that a job keeps, and what is asked of it.

A book is one JSON text of spreads, each of two pages of slots. It is read back with its
schema, so a slot's photo or place is a column again; documents of one session's book
are as large as the session's book, never more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOT = "pos int, photo_id long, x double, y double, w double, h double, dpi double, badge string"
_SLOTS = "array<struct<" + ", ".join(f.replace(" ", ": ") for f in SLOT.split(", ")) + ">>"
SCHEMA = f"spreads array<struct<spread_idx: long, chapter: long, caption: string, left: {_SLOTS}, right: {_SLOTS}>>"
BOOK = ["session_id", "variation"]


def documents(slots: DataFrame) -> DataFrame:
    """session_id, variation and ``book``, the JSON text of each, of slot rows as ``spread_pages`` gives them."""
    page = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct(*(F.col(c).cast(t).alias(c) for c, t in (f.split() for f in SLOT.split(", ")))))))
    spreads = slots.groupBy(*BOOK, "spread_idx", "chapter", "caption").agg(page("left").alias("left"), page("right").alias("right"))
    inside = F.array_sort(F.collect_list(F.struct("spread_idx", "chapter", "caption", "left", "right")))
    return spreads.groupBy(*BOOK).agg(F.to_json(F.struct(inside.alias("spreads"))).alias("book"))


def spreads(books: DataFrame) -> DataFrame:
    """session_id, variation, at (from 0), spread_idx, chapter, caption, left, right of every spread of the texts; a text that is no book has none."""
    read = F.from_json("book", SCHEMA)["spreads"]
    return books.select(*BOOK, F.posexplode(read).alias("at", "s")).select(*BOOK, "at", "s.*")


def slots(books: DataFrame) -> DataFrame:
    """session_id, variation, at, side, and each slot's fields: every slot of the texts, in reading order by (at, side, pos)."""
    pages = F.explode(F.array(*(F.struct(F.lit(side).alias("side"), F.col(side).alias("own")) for side in ("left", "right"))))
    p = spreads(books).select(*BOOK, "at", "spread_idx", "chapter", pages.alias("p"))
    return p.select(*BOOK, "at", "spread_idx", "chapter", "p.side", F.explode("p.own").alias("slot")).select(*BOOK, "at", "spread_idx", "chapter", "side", "slot.*")


def placed_ids(books: DataFrame) -> DataFrame:
    """session_id, variation, photo_id, pos: the distinct photos of each book by first appearance, from 0; empty slots count for nothing."""
    first = F.min(F.struct("at", "side", "pos")).alias("first")
    ids = slots(books).where(F.col("photo_id").isNotNull()).groupBy(*BOOK, "photo_id").agg(first)
    return ids.select(*BOOK, "photo_id", (F.row_number().over(Window.partitionBy(*BOOK).orderBy("first")) - 1).cast("long").alias("pos"))


def export_gate(books: DataFrame, photos: DataFrame, preview: bool = False) -> DataFrame:
    """session_id, variation, total, pending, code: 409 while a placed photo's original is missing or unknown, 200 otherwise and for previews.

    ``photos``: photo_id, synced. A book without photos may be exported.
    """
    read = F.from_json("book", SCHEMA)["spreads"]
    ids = F.array_distinct(F.flatten(F.transform(read, lambda s: F.transform(F.concat(F.coalesce(s["left"], F.array()), F.coalesce(s["right"], F.array())), lambda x: x["photo_id"]))))
    # each text is made and read once; a book without photos keeps a row
    placed = books.select(*BOOK, ids.alias("ids")).select(*BOOK, F.explode_outer(F.filter("ids", lambda x: x.isNotNull())).alias("photo_id"))
    known = placed.join(photos.select("photo_id", "synced"), "photo_id", "left")
    pending = F.count_if(F.col("photo_id").isNotNull() & ~F.coalesce("synced", F.lit(False)))
    every = known.groupBy(*BOOK).agg(F.count("photo_id").alias("total"), pending.alias("pending"))
    return every.withColumn("code", F.when((F.col("pending") > 0) & ~F.lit(preview), 409).otherwise(200))


def page_text(page: str) -> Column:
    """A page's slots as text, places in millionths."""
    whole = lambda s: [F.round(F.round(s[c], 9) * 1_000_000).cast("long").cast("string") for c in "xywh"]
    return F.array_join(F.transform(page, lambda s: F.concat_ws(":", s["photo_id"].cast("string"), *whole(s), s["badge"])), ",")
