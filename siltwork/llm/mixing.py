"""Mixing sources to target weights over fixed-length blocks.

All words of a source, its documents in a pseudorandom but fixed order, form a
stream that is cut into blocks of ``BLOCK`` words. The mix has as many block slots
as the targets ask for. Each output shard draws its slots' sources from a
multinomial; a source's slots over all shards are numbered, and slot k takes block
``perm(k mod blocks)`` by a keyed permutation of the source's block numbers (one
key a pass, so a block returns only after all others). Draws above a source's
exact number of slots give way to sources with too few, in a last shard. Blocks
are joined to slots by (source, block number).

Offsets into the streams come from two-level sums over hashed buckets, so no
source, however large, meets in one task. Only sums by source reach the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textscan
from ..sources.scratch import tasks_for, written
from .labelled import free_name

BLOCK = 64
MOST = 3  # a document is taken at most so often
WEIGHTS = (5.0, 2.0, 1.0)
PLAN_ROWS = 1_000_000
SHARDS = 4096
DOCS_A_BUCKET = 4096
WORD = re.compile("[^\x20\x09-\x0d]+")


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns uid, doc_id, source, text: the number of words of each row."""
    for batch in batches:
        offsets, data = textscan.string_bytes(batch.column(3))
        size = np.zeros(batch.num_rows, dtype=np.int64)
        for i, j in textscan.slices(offsets):
            base = offsets[i]
            inside = ~textscan.IS_SEP[data[base : offsets[j]]]
            begins = inside.copy()
            begins[1:] &= ~inside[:-1]
            edge = offsets[i : j + 1] - base
            heads = edge[:-1][edge[:-1] < edge[1:]]
            begins[heads] = inside[heads]
            size[i:j] = np.diff(np.concatenate(([0], np.cumsum(begins)))[edge])
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(size)], ["uid", "doc_id", "source", "size"])


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> dict[str | None, float]:
    """Words wanted of each source: shares by weight (repeating over sources by code point, null last), none above ``most`` times its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, out, open_ = float(sum(sizes.values())), {}, list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return out


def _permuted(k: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of 0..n-1: a Feistel network over the next even power of two, walked until below n."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    x = k.astype(np.uint64)
    open_ = np.arange(len(x))
    while len(open_):
        h, m, y, salt = half[open_], low[open_], x[open_], key[open_]
        a, b = y >> h, y & m
        for r in range(4):
            a, b = b, a ^ (textscan.mix(b + salt * np.uint64(2 * r + 3)) & m)
        x[open_] = a << h | b
        open_ = open_[x[open_] >= n[open_].astype(np.uint64)]
    return x.astype(np.int64)


def _slots(seed: int):
    """Columns shard, s, blocks, first, n: the block and the pass of each drawn slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, s, blocks, first, n in zip(*(np.asarray(c) for c in batch.columns), strict=True):
                for at in range(first, first + n, 100_000):
                    k = np.arange(at, min(at + 100_000, first + n), dtype=np.int64)
                    turn = k // blocks
                    key = textscan.mix((turn * 1_000_003 + s * 7919 + seed).astype(np.uint64))
                    block = _permuted(k % blocks, np.full(len(k), blocks), key)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), x)) for x in (shard, s)] + [pa.array(k), pa.array(turn), pa.array(block)], ["shard", "s", "slot", "turn", "block"])

    return run


def _draws(want: np.ndarray, seed: int) -> pd.DataFrame:
    """How many slots each shard draws of each source, and which: at most ``want`` a source, the missing ones in a last shard."""
    total = int(want.sum())
    if not total:
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("shard", "s", "first", "n")})
    shards = max(1, min(SHARDS, PLAN_ROWS // max(1, len(want)), -(-total // SHARDS)))
    sizes = np.diff(np.linspace(0, total, shards + 1).astype(np.int64))
    share = want / total
    drawn = np.array([np.random.default_rng((seed, j)).multinomial(n, share) for j, n in enumerate(sizes)] + [np.zeros(len(want), np.int64)])
    upto = np.minimum(np.cumsum(drawn, axis=0), want)
    upto[-1] = want
    first = np.vstack((np.zeros(len(want), np.int64), upto[:-1]))
    j, s = np.nonzero(upto > first)
    return pd.DataFrame({"shard": j, "s": s, "first": first[j, s], "n": (upto - first)[j, s]})


class Mix:
    """A mix of documents (doc_id, source, text); null texts are empty, a null source is a source of its own, last in order.

    Texts of any length are read whole, rows with one doc_id or none are documents of
    their own, other columns are not looked at; no rows give an empty mix.

    ``sized``: uid, doc_id, source, size of every row. ``want``: source, source_size,
    target. ``pieces``: uid, block, begin, words, takes; the parts of documents that
    the mix takes ``takes`` times, ``begin`` counted in words of the document.
    ``slots``: shard, source number, slot, turn, block in output order.
    """

    def __init__(self, documents: DataFrame, seed: int = 17, weights: tuple[float, ...] = WEIGHTS):
        spark = documents.sparkSession
        docs = documents.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
        self.sized = written(docs.mapInArrow(_sizes, "uid long, doc_id long, source string, size long"), "sized", tasks_for(docs))
        # one row a source: a configuration-sized list, as its weights are
        sums = {r.source: (r.total, r.rows) for r in self.sized.groupBy("source").agg(F.sum("size").alias("total"), F.count("*").alias("rows")).collect()}
        order = sorted(sums, key=lambda s: (s is None, s or ""))
        goal = targets({s: t for s, (t, _) in sums.items()}, weights)
        size = np.array([sums[s][0] for s in order], dtype=np.int64)
        blocks = -(-size // BLOCK)
        wanted = np.array([goal[s] for s in order])
        want = np.where(size > 0, np.rint(wanted * blocks / np.maximum(size, 1)), 0).astype(np.int64)
        want = np.minimum(want, MOST * blocks)
        rows = [(s, k, int(size[k]), float(wanted[k])) for k, s in enumerate(order)]
        self.want = spark.createDataFrame(rows, "source string, s int, source_size long, target double")
        plan = _draws(want, seed)
        plan["blocks"] = blocks[plan["s"].to_numpy(int)]
        plan = spark.createDataFrame(plan[["shard", "s", "blocks", "first", "n"]].astype("int64"), "shard long, s long, blocks long, first long, n long")
        tasks = max(spark.sparkContext.defaultParallelism, int(want.sum()) >> 20)
        self.slots = plan.repartition(tasks).mapInArrow(_slots(seed), "shard long, s long, slot long, turn long, block long")

        parts = max(256, -(-sum(r for _, r in sums.values()) // DOCS_A_BUCKET))
        keyed = self.sized.where("size > 0").join(F.broadcast(self.want.select(F.col("source").alias("src"), "s")), F.col("source").eqNullSafe(F.col("src"))).select("uid", F.col("s").cast("long").alias("s"), "doc_id", "size", F.pmod(F.xxhash64("doc_id", "size", F.when(F.col("doc_id").isNull(), F.col("uid")), F.lit(seed)), F.lit(parts)).alias("bucket"))
        ahead = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        heads = keyed.groupBy("s", "bucket").agg(F.sum("size").alias("sum")).select("s", "bucket", F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("head"))
        inner = Window.partitionBy("s", "bucket").orderBy("doc_id", "size", "uid").rowsBetween(Window.unboundedPreceding, -1)
        placed = keyed.withColumn("inside", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(heads, ["s", "bucket"]).select("uid", "s", "size", (F.col("head") + F.col("inside")).alias("at"))
        cut = placed.select("uid", "s", "size", "at", F.explode(F.sequence(F.expr(f"at div {BLOCK}"), F.expr(f"(at + size - 1) div {BLOCK}"))).alias("block"))
        begin = F.greatest(F.lit(0), F.col("block") * BLOCK - F.col("at"))
        stop = F.least("size", (F.col("block") + 1) * BLOCK - F.col("at"))
        cut = cut.select("s", "block", "uid", begin.alias("begin"), (stop - begin).alias("words"))
        takes = self.slots.groupBy("s", "block").agg(F.count("*").alias("takes"))
        # the plan's few rows hide how many slots they expand to, so no estimate may choose a broadcast here
        self.pieces = cut.join(takes.hint("merge"), ["s", "block"]).select("uid", "block", "begin", "words", "takes")

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken of every row."""
        got = self.pieces.groupBy("uid").agg(F.sum(F.col("words") * F.col("takes")).alias("taken"))
        want = self.want.select(F.col("source").alias("src"), "source_size", "target")
        rows = self.sized.join(got.hint("merge"), "uid", "left").join(F.broadcast(want), F.col("source").eqNullSafe(F.col("src")))
        return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _texts(columns: list[str]):
    at, kept = columns.index("text"), len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                some = batch.slice(first, 256)
                rows, texts = [], []
                for k, (text, parts) in enumerate(zip(some.column(at).to_pylist(), some.column(kept).to_pylist(), strict=True)):
                    spans = [m.span() for m in WORD.finditer(text)]
                    parts.sort(key=lambda p: p["begin"])
                    for turn in range(1, MOST + 1):
                        runs: list[list[int]] = []
                        for p in parts:
                            if p["takes"] >= turn:
                                if runs and runs[-1][1] == p["begin"]:
                                    runs[-1][1] += p["words"]
                                else:
                                    runs.append([p["begin"], p["begin"] + p["words"]])
                        if runs:
                            rows.append(k)
                            texts.append("\n".join(text[spans[x][0] : spans[y - 1][1]] for x, y in runs))
                out = [c.take(pa.array(rows, pa.int64())) for c in some.columns[:kept]]
                out[at] = pa.array(texts, some.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(out, columns)

    return run


def mixed_documents(documents: DataFrame, seed: int = 17) -> DataFrame:
    """The mix as documents: a row for each pass over a document's taken blocks, its text those words, n_chars its length.

    ``documents`` must read the same rows in the same order each time, as written tables do.
    Other columns stay as they are. A text without words is not taken.
    """
    columns = documents.columns
    uid, taken = free_name(columns, "uid"), free_name([*columns, "uid"], "parts")
    mix = Mix(documents, seed)
    rows = documents.withColumn(uid, F.monotonically_increasing_id())
    parts = mix.pieces.groupBy(F.col("uid").alias(uid)).agg(F.collect_list(F.struct("begin", "words", "takes")).alias(taken))
    out = written(rows.join(parts.hint("merge"), uid).select(*columns, taken).mapInArrow(_texts(columns), documents.schema), "mixed", tasks_for(documents))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*columns) if "n_chars" in columns else out
