"""Exact cosine links among embeddings by dual traversal of cover trees.

Unit vectors at distance d have cosine ``1 - d * d / 2``, so a cosine threshold is
a distance. Equal vectors of a label first become one with a count. A label's vectors
are dealt to blocks of at most about ``BLOCK``; each pair of blocks is one task's work.
The largest labels have a net of pivots, of a bounded sample, as their top level: a
vector's cell is its nearest pivot's, neighbouring cells form a block, and a vector is
sent to another block only if the triangle inequality lets it link in one of its cells
(covering radius and hyperplane bounds). Labels beyond that number, and small ones, are
split by hash alone. Both blocks' cover trees (nested levels, halving radii) are then
traversed together, node pairs are dropped when their covering radii keep them apart
and taken whole when they keep them together; only the rest is compared, leaves with
leaves as products of matrices in single precision, rounded up, and what these find
likely in double precision. A task gives link counts and a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..sources.scratch import released, written

BLOCK = 8192
CHUNK, STRIP, PAIRS = 512, 1 << 21, 1 << 16  # rows of a distance matrix, products of leaf members, and pairs that they find likely, that are held at once
LEAF = 64
MOST_SPACES, MOST_PIVOTS = 256, 8192  # labels that have pivots, the largest ones, and pivots of all together: what is broadcast is at most so many vectors
CELL = 64  # vectors of a cell, where pivots last
SAMPLE_A_PIVOT = 4
SLACK = 1e-7  # room for rounding in bounds; links themselves are decided by their cosine


# --- cover trees ----------------------------------------------------------------


@dataclass
class Node:
    point: int
    cover: float  # the farthest member's distance
    members: np.ndarray
    children: list[Node] = field(default_factory=list)


def _distances(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x[i] @ y[j].T)))


def build(x: np.ndarray) -> Node | None:
    """A cover tree of the rows of x, unit vectors: a level's nodes are a net of half its parents' radius."""
    if not len(x):
        return None

    def grow(point: int, members: np.ndarray, d: np.ndarray, radius: float) -> Node:
        node = Node(point, float(d.max()), members)
        if len(members) <= LEAF or node.cover < 1e-9:
            return node
        while radius / 2 >= node.cover:
            radius /= 2
        half = radius / 2
        centres, near, to = [point], d.copy(), np.zeros(len(members), dtype=np.int64)
        while True:
            far = np.flatnonzero(near > half)
            if not len(far):
                break
            if len(far) == len(members) - 1 and len(centres) == 1 or len(far) > 64:
                # a batch of uncovered points, thinned to a net among themselves
                batch = far[:256]
                own = _distances(x, members[batch], x, members[batch])
                pick: list[int] = []
                for k in range(len(batch)):
                    if not pick or own[k, pick].min() > half:
                        pick.append(k)
                new = batch[pick]
            else:
                new = far[:1]
            dist = _distances(x, members, x, members[new])
            best = dist.argmin(axis=1)
            least = dist[np.arange(len(members)), best]
            better = least < near
            near[better] = least[better]
            to[better] = len(centres) + best[better]
            centres.extend(members[new].tolist())
        for k, c in enumerate(centres):
            own = to == k
            if own.any():
                node.children.append(grow(c, members[own], near[own], half))
        return node

    first = _distances(x, np.arange(len(x)), x, np.zeros(1, dtype=np.int64))[:, 0]
    return grow(0, np.arange(len(x)), first, 2.0)


class Forest:
    """Components over local numbers, named by their least; links come in arrays."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.late: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_late = 0

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        self.late.append((a, b))
        self.n_late += len(a)
        if self.n_late > 1 << 20:
            self.roots()

    def roots(self) -> np.ndarray:
        """The least member of each one's component, by hooking and pointer jumping."""
        if self.late:
            a, b = (np.concatenate([x[k] for x in self.late]) for k in (0, 1))
            self.late, self.n_late = [], 0
            while True:
                x, y = self.up[a], self.up[b]
                apart = x != y
                if not apart.any():
                    break
                a, b, x, y = a[apart], b[apart], x[apart], y[apart]
                np.minimum.at(self.up, np.maximum(x, y), np.minimum(x, y))
                while (self.up[self.up] != self.up).any():
                    self.up = self.up[self.up]
        return self.up


def links(x: np.ndarray, wx: np.ndarray, y: np.ndarray | None, wy: np.ndarray | None, cosine: float) -> tuple[np.ndarray, np.ndarray, Forest]:
    """(weighted links of each x, of each y, forest over x then y) of all linked pairs between x and y, or within x if y is None."""
    same = y is None
    if same:
        y, wy = x, wx
    reach = float(np.sqrt(2.0 - 2.0 * cosine))
    shift = 0 if same else len(x)
    forest = Forest(len(x) + (0 if same else len(y)))
    nx, ny = np.zeros(len(x)), np.zeros(len(y))
    a, b = build(x), build(y) if not same else None
    if a is None or (b is None and not same):
        return nx, ny, forest
    stack: list[tuple[list[Node], list[Node], bool]] = []  # all nodes of one list meet all of the other, or one another

    def whole(p: Node, q: Node) -> None:
        nx[p.members] += wy[q.members].sum()
        forest.join(p.members, np.full(len(p.members), q.point + shift))
        if p is not q or not same:
            ny[q.members] += wx[p.members].sum()
            forest.join(np.full(len(q.members), p.point), q.members + shift)
        else:
            nx[p.members] -= wx[p.members]

    def compare(p: Node, q: Node) -> None:
        hit = x[p.members] @ y[q.members].T >= cosine
        if p is q and same:
            np.fill_diagonal(hit, False)
            hit_y = None
        else:
            hit_y = hit.T
        nx[p.members] += hit @ wy[q.members]
        if hit_y is not None:
            ny[q.members] += hit_y @ wx[p.members]
        i, j = np.nonzero(hit)
        forest.join(p.members[i], q.members[j] + shift)

    x32, y32 = x.astype(np.float32), y.astype(np.float32)
    likely = np.float32(cosine - (x.shape[1] + 8) * 2.0**-22)  # a product in single precision, rounded, is below it for no link

    def compare_leaves(ps: list[Node], qs: list[Node], ask: np.ndarray) -> None:
        """Many pairs of different leaves at once, those that ``ask`` marks: as products of matrices, a strip at a time; what they find likely is decided in double precision."""
        rows, columns = np.flatnonzero(ask.any(axis=1)), np.flatnonzero(ask.any(axis=0))
        if not len(rows):
            return
        mp, mq = (np.concatenate([side[c].members for c in some]) for side, some in ((ps, rows), (qs, columns)))
        op, oq = (np.repeat(some, [len(side[c].members) for c in some]) for side, some in ((ps, rows), (qs, columns)))
        wide = y32[mq].T
        high = max(1, STRIP // len(mq))
        for at in range(0, len(mp), high):
            i, j = np.nonzero(x32[mp[at : at + high]] @ wide >= likely)
            i += at
            asked = ask[op[i], oq[j]]
            a, b = mp[i[asked]], mq[j[asked]]
            for k in range(0, len(a), PAIRS):
                u, v = a[k : k + PAIRS], b[k : k + PAIRS]
                hit = np.einsum("ij,ij->i", x[u], y[v]) >= cosine
                u, v = u[hit], v[hit]
                np.add.at(nx, u, wy[v])
                np.add.at(ny, v, wx[u])
                forest.join(u, v + shift)

    def meet(p: Node, q: Node) -> None:
        twin = same and p is q
        if twin and 2 * p.cover <= reach - SLACK:
            whole(p, q)
        elif not p.children and not q.children or len(p.members) * len(q.members) <= LEAF * LEAF:
            compare(p, q)
        elif twin:
            stack.append((p.children, p.children, True))
        else:
            # nodes of about one size are opened together
            ps = p.children if p.children and (2 * p.cover >= q.cover or not q.children) else [p]
            qs = q.children if q.children and (2 * q.cover >= p.cover or not p.children) else [q]
            stack.append((ps, qs, False))

    meet(a, a if same else b)
    while stack:
        ps, qs, twin = stack.pop()
        pp, pc, leaf_p = np.array([c.point for c in ps]), np.array([c.cover for c in ps]), np.array([not c.children for c in ps])
        qp, qc, leaf_q = np.array([c.point for c in qs]), np.array([c.cover for c in qs]), np.array([not c.children for c in qs])
        for at in range(0, len(ps), CHUNK):
            d = _distances(x, pp[at : at + CHUNK], y, qp)
            cover, leaf = pc[at : at + CHUNK, None], leaf_p[at : at + CHUNK]
            near = d - cover - qc[None, :] <= reach + SLACK
            together = d + cover + qc[None, :] <= reach - SLACK
            own = np.zeros(1, dtype=bool)
            if twin:
                before = np.arange(at, at + len(leaf))[:, None] - np.arange(len(qs))[None, :]
                own = before == 0
                near &= before <= 0
                together &= before < 0
            small = near & ~together & ~own & leaf[:, None] & leaf_q[None, :]
            compare_leaves(ps[at : at + CHUNK], qs, small)
            for i, j in zip(*(k.tolist() for k in np.nonzero(together)), strict=True):
                whole(ps[at + i], qs[j])
            rest = near & ~small & ~together
            # leaves meet what is below a node all at once
            for j in np.flatnonzero(~leaf_q).tolist():
                some = np.flatnonzero(rest[:, j] & leaf).tolist()
                if some:
                    stack.append(([ps[at + i] for i in some], qs[j].children, False))
            for i in np.flatnonzero(~leaf).tolist():
                some = np.flatnonzero(rest[i] & leaf_q).tolist()
                if some:
                    stack.append((ps[at + i].children, [qs[j] for j in some], False))
            for i, j in zip(*(k.tolist() for k in np.nonzero(rest & (own | ~leaf[:, None] & ~leaf_q[None, :]))), strict=True):
                if len(ps[at + i].members) > 1 or ps[at + i] is not qs[j]:
                    meet(ps[at + i], qs[j])
    if same:
        nx, ny = nx + ny, nx
    return nx, ny, forest


# --- cells ----------------------------------------------------------------------


def _net(x: np.ndarray, k: int) -> np.ndarray:
    """k rows of x, each farthest from those before it."""
    pick, d = [0], np.linalg.norm(x - x[0], axis=1)
    while len(pick) < min(k, len(x)) and d.max() > 0:
        pick.append(int(d.argmax()))
        d = np.minimum(d, np.linalg.norm(x - x[pick[-1]], axis=1))
    return x[pick]


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_space(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(space, rows, unit vectors) of a batch with columns rid, space, m, vec, at most a strip's distances at once."""
    space = np.asarray(batch.column(1))
    for s in np.unique(space):
        every = np.flatnonzero(space == s)
        for i in range(0, len(every), 2048):
            rows = every[i : i + 2048]
            yield int(s), rows, _unit(_matrix(batch.column(3).take(pa.array(rows))))


def _from(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (x @ c.T)))


def _housed(pivots):
    """The cell of each vector and its distance from the cell's pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for space, _, x in _by_space(batch):
                d = _from(x, pivots.value[space])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), space)), pa.array(d.argmin(axis=1)), pa.array(d.min(axis=1))], ["space", "cell", "d"])

    return run


@dataclass
class Cells:
    """A space's top level: pivots with their cells' covering radii, each cell's group, and each group's blocks."""

    pivots: np.ndarray
    radius: np.ndarray
    group: np.ndarray
    blocks: np.ndarray
    first: np.ndarray

    def can(self, d: np.ndarray, reach: float) -> np.ndarray:
        """Which groups (columns) may hold a link of vectors with distances ``d`` from the pivots."""
        near = d.min(axis=1, keepdims=True)
        cell = (d <= self.radius + reach + SLACK) & (d <= near + 2 * reach + SLACK) & (self.radius >= 0)
        order = np.argsort(self.group, kind="stable")
        return np.logical_or.reduceat(cell[:, order], np.searchsorted(self.group[order], np.arange(len(self.blocks))), axis=1)


def _cells(pivots: np.ndarray, n: np.ndarray, radius: np.ndarray) -> Cells:
    """Cells of ``n`` vectors in groups: each goes to the nearest of the net's first pivots, about one for each half a block."""
    heads = pivots[: max(1, min(len(pivots), int(2 * n.sum()) // BLOCK))]
    _, group = np.unique(_from(pivots, heads).argmin(axis=1), return_inverse=True)
    size = np.bincount(group, n)
    blocks = np.maximum(1, -(-size.astype(np.int64) // BLOCK))
    return Cells(pivots, np.where(n > 0, radius, -1.0), group, blocks, np.cumsum(blocks) - blocks)


def _sent(cells, reach: float):
    """Each vector to every pair of blocks in which it can have a link; ``side`` 0 is the lesser block's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for space, rows, x in _by_space(batch):
                c = cells.value[space]
                rid = np.asarray(batch.column(0))[rows]
                d = _from(x, c.pivots)
                home = c.group[d.argmin(axis=1)]
                can = c.can(d, reach)
                can[np.arange(len(rows)), home] = True
                own = c.first[home] + (rid * 2654435761 % 4294967291) % c.blocks[home]
                at, group = np.nonzero(can)
                size = c.blocks[group]
                other = np.repeat(c.first[group] - np.cumsum(size) + size, size) + np.arange(size.sum())
                at = np.repeat(at, size)
                low, high = np.minimum(own[at], other), np.maximum(own[at], other)
                take = pa.array(rows[at])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), space)), pa.array(low), pa.array(high), pa.array((own[at] > other).astype(np.int32)), *(batch.column(k).take(take) for k in (0, 2, 3))], ["space", "low", "high", "side", "rid", "m", "vec"])

    return run


def _compared(cosine: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x = _unit(np.array(frame["vec"].tolist(), dtype=np.float64))
        rid, m, side = (frame[k].to_numpy() for k in ("rid", "m", "side"))
        order = np.argsort(rid, kind="stable")
        x, rid, m, side = x[order], rid[order], m[order].astype(float), side[order]
        if frame["low"].iloc[0] == frame["high"].iloc[0]:
            n, _, forest = links(x, m, None, None, cosine)
        else:
            a, b = side == 0, side == 1
            na, nb, forest = links(x[a], m[a], x[b], m[b], cosine)
            n, rid = np.concatenate((na, nb)), np.concatenate((rid[a], rid[b]))
        root = rid[forest.roots()] if len(rid) else rid
        use = n > 0
        return pd.DataFrame({"rid": rid[use], "n": n[use].astype(np.int64), "root": root[use]})

    return run


def _routed(reps: DataFrame, reach: float) -> DataFrame:
    """space, low, high, side, rid, m, vec: every vector for each pair of blocks in which it can have a link. A space is a label and a length."""
    spark = reps.sparkSession
    counts = reps.groupBy("label", F.size("vec").alias("dim")).count()
    spaces = written(counts.withColumn("space", F.monotonically_increasing_id()), "spaces")
    sized = reps.withColumn("dim", F.size("vec")).join(spaces, ["label", "dim"]).select("rid", "space", "m", "vec", "count")
    large = spaces.where(F.col("count") > BLOCK).orderBy(F.desc("count"), "space").limit(MOST_SPACES).select("space", "dim", "count").collect()
    known = [r.space for r in large]

    # without pivots: blocks by hash, one where that is enough
    blocks = F.ceil(F.col("count") / BLOCK).cast("long")
    own = F.pmod(F.xxhash64("rid"), blocks)
    plain = sized.where(~F.col("space").isin(known)) if known else sized
    plain = plain.select("space", "rid", "m", "vec", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
    plain = plain.select("space", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).cast("int").alias("side"), "rid", "m", "vec")
    if not known:
        return plain

    total = sum(r["count"] for r in large)
    wanted = {r.space: max(1, min(r["count"] // CELL, MOST_PIVOTS * r["count"] // total)) for r in large}
    chance = spark.createDataFrame([(r.space, min(1 << 30, (SAMPLE_A_PIVOT * wanted[r.space] << 30) // r["count"]) + 1) for r in large], "space long, below long")
    flat = sized.where(F.col("space").isin(known)).select("rid", "space", "m", "vec")
    sampled = flat.join(F.broadcast(chance), "space").where(F.pmod(F.xxhash64("vec"), F.lit(1 << 30)) < F.col("below")).select("space", "vec").toPandas()  # about SAMPLE_A_PIVOT * MOST_PIVOTS vectors
    pivots = {}
    for r in large:
        some = sampled.loc[sampled["space"] == r.space, "vec"].tolist()
        pivots[r.space] = _net(_unit(np.array(sorted(map(tuple, some)))), wanted[r.space]) if some else np.eye(1, r.dim)
    housed = flat.mapInArrow(_housed(spark.sparkContext.broadcast(pivots)), "space long, cell long, d double").groupBy("space", "cell").agg(F.count("*").alias("n"), F.max("d").alias("r")).toPandas()  # at most a row a pivot
    cells = {}
    for space, c in pivots.items():
        mine = housed[housed["space"] == space]
        n, radius = np.zeros(len(c), dtype=np.int64), np.zeros(len(c))
        n[mine["cell"]], radius[mine["cell"]] = mine["n"], mine["r"]
        cells[space] = _cells(c, n, radius)
    sent = flat.mapInArrow(_sent(spark.sparkContext.broadcast(cells), reach), "space long, low long, high long, side int, rid long, m long, vec array<double>")
    return plain.unionByName(sent)


def embedding_links(embeddings: DataFrame, cosine: float = 0.93) -> DataFrame:
    """Per row of embeddings (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Compared are vectors of equal, non-null label and equal length. A vector that
    is null, empty, zero or holds null or non-finite components links with nothing,
    as does one without a label. Equal vectors link with each other, rows with equal
    vec_ids stay rows. A null vec_id counts as a link but never names a component.
    Other columns are not looked at.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").alias("label"))
    sound = "label IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0 AND forall(vec, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('Infinity')) AND exists(vec, v -> v <> 0)"
    rows = rows.withColumn("sound", F.coalesce(F.expr(sound), F.lit(False)))
    same = rows.where("sound").groupBy("label", "vec").agg(F.count("*").alias("m"), F.min("vec_id").alias("least"))
    reps = written(same.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    reach = float(np.sqrt(2 - 2 * cosine))
    found = written(_routed(reps, reach).groupBy("space", "low", "high").applyInPandas(_compared(cosine), "rid long, n long, root long"), "links")

    roots = components(found.select(F.col("rid").alias("a"), F.col("root").alias("b")))
    n = found.groupBy("rid").agg(F.sum("n").alias("n"))
    full = reps.join(n, "rid", "left").join(roots.select(F.col("node").alias("rid"), "root"), "rid", "left").select("label", "vec", "m", "least", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "rid").alias("root"))
    full = written(full, "full")
    released(reps, found)
    names = full.groupBy("root").agg(F.min("least").alias("component_id"))
    known = full.join(names, "root").select("label", "vec", (F.col("n") + F.col("m") - 1).alias("n_links"), "component_id")
    out = rows.where("sound").join(known, ["label", "vec"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
