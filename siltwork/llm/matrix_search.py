"""Ranked lexical search as a blocked product of sparse matrices.

One matrix has the items' terms with their multiplicity, the other the documents'
terms with their 64-bit integer impacts. Documents come in blocks of bounded size, a
task's own; a block's matrix is stored by rows of terms. Each item's row of the
product is formed after Gustavson: the rows of its terms are scaled and merged into
one accumulator over the block. Of each block only an item's k best stay; blocks,
tasks and salted groups of tasks are merged the same way, so nothing that grows with
the documents meets in one place.

Items come in blocks of at most ``ITEM_TERMS`` terms, each block's terms and weights
are broadcast alone. Global statistics (documents, terms, document frequencies of the
block's terms) are exact sums over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textscan
from .terms import ALPHANUMERIC, profiles, scan
from ..sources.scratch import released, small_batches, tasks_for, written

ITEM_TERMS = 1 << 20  # of one block of items; one item with more is a block of its own
DOCS, POSTINGS = 8192, 1 << 20  # of one block of documents
IMPACT, SCALE, BASE, SPREAD = 1_000_000_000, 1000, 75, 25


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns item_id, text: (item_id, term, times) of the distinct terms of each row."""
    for batch in batches:
        ids = np.asarray(batch.column(0))
        offsets, data = textscan.string_bytes(batch.column(1))
        for i, j in textscan.slices(offsets):
            row, term, times, _ = profiles(scan(offsets, data, i, j, ALPHANUMERIC))
            yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][row]), pa.array(term.view(np.int64)), pa.array(times.astype(np.int64))], ["item_id", "term", "times"])


def _statistics(vocabulary):
    """Column text: (term number, its documents), (-1, documents with a term), (-2, terms) of a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        df = np.zeros(len(known), dtype=np.int64)
        documents = terms = 0
        for batch in batches:
            offsets, data = textscan.string_bytes(batch.column(0))
            for i, j in textscan.slices(offsets):
                w = scan(offsets, data, i, j, ALPHANUMERIC)
                documents += int((w.per_row > 0).sum())
                terms += len(w.hash)
                _, at, _ = _numbered(w, known)
                df += np.bincount(at, minlength=len(known))
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-1, -2], hit))), pa.array(np.concatenate(([documents, terms], df[hit])))], ["at", "n"])

    return run


def _numbered(w: textscan.Words, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, number, times) of the distinct terms of each row that the sorted hashes ``known`` have."""
    if not len(known) or not len(w.hash):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    at = np.minimum(np.searchsorted(known, w.hash), len(known) - 1)
    hit = known[at] == w.hash
    key, times = np.unique(w.row[hit] * len(known) + at[hit], return_counts=True)
    return key // len(known), key % len(known), times


def _lengths(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """m by a document's terms; the product may leave 64 bits, then in Python's integers."""
    if len(n) and int(n.max()) * SPREAD * documents >= 1 << 62:
        return np.array([100 - SPREAD + SPREAD * int(x) * documents // terms for x in n], dtype=np.int64)
    return 100 - SPREAD + SPREAD * n * documents // max(terms, 1)


class Block:
    """Term-document impacts of some documents, by rows of terms."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, terms: int):
        order = np.argsort(term, kind="stable")
        self.ids, self.doc, self.impact = ids, doc[order], impact[order]
        self.edge = np.searchsorted(term[order], np.arange(terms + 1))

    def product(self, terms: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """One item's row: its terms' rows, each times its weight, merged; a row has no document twice."""
        out = np.zeros(len(self.ids), dtype=np.int64)
        for t, w in zip(terms.tolist(), weight.tolist(), strict=True):
            i, j = self.edge[t], self.edge[t + 1]
            if i < j:
                out[self.doc[i:j]] += w * self.impact[i:j]
        return out

    def top(self, terms: np.ndarray, weight: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best with scores of at least ``least`` and above 0."""
        score = self.product(terms, weight)
        found = np.flatnonzero(score >= max(least, 1))
        if len(found) > k:  # all ties of the k-th best stay for their ids to decide
            found = found[score[found] >= np.partition(score[found], -k)[-k]]
        return best(self.ids[found], score[found], k)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _searched(sent, k: int):
    """Columns doc_id, text: the k best of a task's rows for every item of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, edge, number, weight, known, documents, terms = sent.value
        top = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(items)
        held: list[tuple[np.ndarray, ...]] = []
        docs = postings = 0

        def answer() -> None:
            start = np.cumsum([0, *(len(x[0]) for x in held)])
            doc = np.concatenate([x[1] + s for x, s in zip(held, start, strict=False)])
            block = Block(np.concatenate([x[0] for x in held]), doc, *(np.concatenate([x[c] for x in held]) for c in (2, 3)), len(known))
            held.clear()
            for q in range(len(items)):
                least = int(top[q][1][-1]) if len(top[q][1]) == k else 1
                found, scores = block.top(number[edge[q] : edge[q + 1]], weight[edge[q] : edge[q + 1]], least, k)
                if len(found):
                    top[q] = best(np.concatenate((top[q][0], found)), np.concatenate((top[q][1], scores)), k)

        for batch in batches:
            ids = np.asarray(batch.column(0))
            offsets, data = textscan.string_bytes(batch.column(1))
            for i, j in textscan.slices(offsets):
                w = scan(offsets, data, i, j, ALPHANUMERIC)
                row, at, tf = _numbered(w, known)
                m = _lengths(w.per_row, documents, terms)
                held.append((ids[i:j], row, at, IMPACT * tf // (SCALE * tf + 12 * m[row])))
                docs, postings = docs + j - i, postings + len(at)
                if docs >= DOCS or postings >= POSTINGS:
                    answer()
                    docs = postings = 0
        if held:
            answer()
        for q in range(0, len(items), 1000):
            some = top[q : q + 1000]
            name = np.repeat(items[q : q + 1000], [len(x) for x, _ in some])
            yield pa.RecordBatch.from_arrays([pa.array(name), *(pa.array(np.concatenate([x[c] for x in some])) for c in (0, 1))], ["item_id", "doc_id", "score"])

    return run


def _merged(rows: DataFrame, k: int, groups: int) -> DataFrame:
    """The k best of each item: first of salted groups of tasks, then of these."""
    order = [F.desc("score"), F.col("doc_id")]
    rows = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(groups)))
    some = rows.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def top_k(documents: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents with a score above 0 of every item.

    Terms are runs of ASCII letters and digits and of non-ASCII characters, A-Z
    lower-cased. Rows of one item_id are one item with the terms of all; items without
    an id or without terms have no results. Rows with a null doc_id and null or empty
    texts count in the statistics as the texts that they are, but a row without an id is
    no result. Of rows with one doc_id each is a result of its own; equal scores go by
    doc_id. Texts of any length count whole; other columns are not looked at.
    """
    spark = documents.sparkSession
    sc = spark.sparkContext
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL")
    asked = rows.mapInArrow(_asked, "item_id long, term long, times long").groupBy("item_id", "term").agg(F.sum("times").alias("times"))
    asked = written(asked, "items")
    blocks = max(1, -(-asked.count() // ITEM_TERMS))
    groups = max(1, int(tasks_for(documents) ** 0.5))
    out = None
    for b in range(blocks):
        # one block's items: about ITEM_TERMS rows of three numbers
        own = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toArrow()
        item, term, times = (np.asarray(own[c]) for c in ("item_id", "term", "times"))
        order = np.argsort(item, kind="stable")
        names, first = np.unique(item[order], return_index=True)
        known, number = np.unique(term[order].view(np.uint64), return_inverse=True)
        sent = sc.broadcast(known)
        with small_batches(spark):
            seen = docs.select("text").mapInArrow(_statistics(sent), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        sent.destroy()
        at, n = np.asarray(seen["at"]), np.asarray(seen["n"])
        total, terms = (int(n[at == x].sum()) for x in (-1, -2))
        df = np.zeros(len(known), dtype=np.int64)
        df[at[at >= 0]] = n[at >= 0]
        weight = np.floor(1000 * np.log((2 * total + 2) / (2 * df + 1))).astype(np.int64)
        sent = sc.broadcast((names, np.append(first, len(item)), number, weight[number] * times[order], known, total, terms))
        found = docs.where("doc_id IS NOT NULL").mapInArrow(_searched(sent, k), "item_id long, doc_id long, score long")
        found = written(_merged(found, k, groups), "found", sc.defaultParallelism)
        sent.destroy()
        out = found if out is None else out.unionByName(found)
    released(asked)
    return out
