"""Connected components of a distributed list of links.

Every round, each node that is not a local minimum hooks onto its smallest
neighbour, pointers are jumped until all nodes know their root, and links between
roots form the next, at least halved, graph. Every round's tables are written to
the shared folder, nothing is collected but row counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import released, written


def _jumped(parents: DataFrame) -> DataFrame:
    """(node, root) of (node, parent) rows in which roots do not occur as nodes."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        step = parents.select("node", "parent").join(up, "parent", "left")
        before, parents = parents, written(step.select("node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")), "jump")
        released(before)
        if parents.where("moved").isEmpty():
            return parents


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each linked node reaches. Nodes without links to others do not appear."""
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    labels, read = None, []
    while True:
        edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        released(*read)
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")).where("parent < node")
        roots = _jumped(written(parents, "hook"))
        found = roots.select("node", F.col("parent").alias("root"))
        if labels is None:
            labels = written(found, "labels")
        else:
            up = roots.select(F.col("node").alias("root"), F.col("parent").alias("above"))
            known = labels.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
            new = written(known.unionByName(found.join(labels.select("node"), "node", "left_anti")), "labels")
            released(labels)
            labels = new
        ra = roots.select(F.col("node").alias("a"), F.col("parent").alias("ra"))
        rb = roots.select(F.col("node").alias("b"), F.col("parent").alias("rb"))
        read = [edges, roots]
        edges = edges.join(ra, "a", "left").join(rb, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a <> b")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels.unionByName(labels.select(F.col("root").alias("node"), "root").distinct())
