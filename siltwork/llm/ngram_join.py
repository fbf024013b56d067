"""N-gram Jaccard join: texts whose sets of word n-grams overlap enough.

The method is rare-first prefix filtering. A first exchange deals packed blocks
of n-gram hashes to ranges, where each n-gram's document frequency is counted
exactly; only n-grams that two documents share travel back. Document-frequency
one sorts first in the global order, so a document with too many n-grams of its
own leaves at once. What remains is joined on prefix n-grams with length,
positional and suffix filters, and each candidate pair is verified once.

Copies (equal sets) meet in one representative. In each prefix n-gram's group,
all members are first tried against the group's smallest member; only members
that this does not connect are tried against the others, so a large group of
near copies costs about its size and no link between components is lost.

N-grams are known by 64-bit hashes of which ``40 + log2(ranges)`` bits are kept,
ranges growing with the input, so that the share of confused n-grams is constant
(about 1 in 10 million).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textscan
from ..operators.graph import components
from ..sources.scratch import plan_bytes, released, tasks_for, written
from .labelled import free_name

LOW_BITS = 40
FLUSH_SHINGLES = 1 << 20
FLUSH_ROWS = 60_000
SALTS = 16
SIGNATURE = 32  # counts of a set's shared n-grams by hash class, an upper bound of any overlap

_BLOCKS = "part int, base long, keys binary, docs binary, dfs binary, ids binary, nulls binary, sizes binary, h1 binary, h2 binary"
_BLOCK_NAMES = [x.split()[0] for x in _BLOCKS.split(", ")]
_ARROW = pa.schema([("part", pa.int32()), ("base", pa.int64()), *((n, pa.binary()) for n in _BLOCK_NAMES[2:])])
_SETS = "uid long, doc_id long, n_shingles long, h1 long, h2 long, keys array<long>, sig array<int>"
_SETS_ARROW = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("keys", pa.list_(pa.int64())), ("sig", pa.list_(pa.int32()))])


def _low(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : LOW_BITS // 8]).tobytes()


def _unlow(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) * 8 // LOW_BITS, 8), dtype=np.uint8)
    out[:, : LOW_BITS // 8] = np.frombuffer(data, dtype=np.uint8).reshape(-1, LOW_BITS // 8)
    return out.view("<u8").ravel()


def _table(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in _ARROW], schema=_ARROW)


def _split(bits: int, width: int):
    """Packed, sorted n-gram hashes by range, and one row with each flush's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = 0
        ids: list[np.ndarray] = []
        nulls: list[np.ndarray] = []
        rows: list[np.ndarray] = []
        hashes: list[np.ndarray] = []
        n_docs = n_hashes = 0

        def flush() -> pa.RecordBatch:
            nonlocal n_docs, n_hashes
            row, h = np.concatenate(rows or [np.zeros(0, np.int64)]), np.concatenate(hashes or [np.zeros(0, np.uint64)])
            order = np.argsort(h, kind="stable")
            hs, rs = h[order], row[order]
            new = np.ones(len(hs), dtype=bool)
            new[1:] = (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])
            hs, rs = hs[new], rs[new]
            sizes = np.bincount(rs, minlength=n_docs).astype(np.int64)
            by_row = np.argsort(rs, kind="stable")
            first = np.concatenate(([0], np.cumsum(sizes)))[:-1]
            some = sizes > 0
            sums = []
            for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
                total = np.zeros(n_docs, dtype=np.uint64)
                if some.any():
                    total[some] = np.add.reduceat(textscan.mix(hs ^ np.uint64(salt))[by_row], first[some])
                sums.append(total.view(np.int64))
            key = hs >> np.uint64(64 - bits - LOW_BITS)
            part = (key >> np.uint64(LOW_BITS)).astype(np.int64)
            low = np.frombuffer(_low(key), dtype=np.uint8).reshape(-1, LOW_BITS // 8)
            docs = rs.astype("<u2")
            parts, edge = np.unique(part, return_index=True)
            edge = np.append(edge, len(part))
            out = [{"part": base % 1000003 % (1 << bits), "base": base, "ids": np.concatenate(ids).tobytes(), "nulls": np.concatenate(nulls).tobytes(), "sizes": sizes.tobytes(), "h1": sums[0].tobytes(), "h2": sums[1].tobytes()}]
            out += [{"part": p, "base": base, "keys": low[i:j].tobytes(), "docs": docs[i:j].tobytes()} for p, i, j in zip(parts.tolist(), edge[:-1], edge[1:], strict=True)]
            n_docs = n_hashes = 0
            for x in (ids, nulls, rows, hashes):
                x.clear()
            return _table(out)

        for batch in batches:
            uid = np.asarray(batch.column(0))
            offsets, data = textscan.string_bytes(batch.column(2))
            doc = batch.column(1)
            known = np.asarray(doc.is_valid())
            value = np.asarray(doc.fill_null(0)).astype(np.int64)
            for i, j in textscan.slices(offsets):
                j0 = i
                while j0 < j:
                    if n_docs and uid[j0] != base + n_docs:  # a flush's numbers are consecutive
                        yield flush()
                    base = base if n_docs else int(uid[j0])
                    j1 = min(j, j0 + FLUSH_ROWS - n_docs)
                    row, h = textscan.shingles(textscan.words(offsets, data, j0, j1), width)
                    ids.append(value[j0:j1])
                    nulls.append(~known[j0:j1])
                    rows.append(row + n_docs)
                    hashes.append(h)
                    n_docs += j1 - j0
                    n_hashes += len(h)
                    j0 = j1
                    if n_hashes >= FLUSH_SHINGLES or n_docs >= FLUSH_ROWS:
                        yield flush()
        if n_docs:
            yield flush()

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by range: a range's document frequencies, back to the flushes that share an n-gram with another document."""
    part, held = None, []

    def finish() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        keys = np.concatenate([_unlow(r[1]) for r in held])
        count = [len(r[2]) // 2 for r in held]
        order = np.argsort(keys, kind="stable")
        ks = keys[order]
        head = np.flatnonzero(np.concatenate(([True], ks[1:] != ks[:-1])))
        times = np.diff(head, append=len(ks))
        df = np.empty(len(ks), dtype=np.int64)
        df[order] = np.repeat(times, times)
        out, at = [], 0
        for (base, low, docs), n in zip(held, count, strict=True):
            own = df[at : at + n]
            pick = own > 1
            at += n
            if pick.any():
                out.append({"part": part, "base": base, "keys": np.frombuffer(low, np.uint8).reshape(-1, LOW_BITS // 8)[pick].tobytes(), "docs": np.frombuffer(docs, "<u2")[pick].tobytes(), "dfs": np.minimum(own[pick], 65535).astype("<u2").tobytes()})
        if out:
            yield _table(out)

    for batch in batches:
        through = []
        for r in batch.to_pylist():
            if r["keys"] is None:
                through.append(r)
                continue
            if r["part"] != part:
                yield from finish()
                part, held = r["part"], []
            held.append((r["base"], r["keys"], r["docs"]))
        if through:
            yield _table(through)
    yield from finish()


def _needed(n: np.ndarray, percent: int) -> np.ndarray:
    """The fewest common n-grams that a set of n must have with any set it links to."""
    return -(-n * percent // 100)


def _gathered(percent: int):
    """Rows come sorted by flush: every document, with its shared n-grams rare-first if it has enough of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, info, held = None, None, []

        def finish() -> Iterator[pa.RecordBatch]:
            if info is None:
                return
            ids, nulls, n, h1, h2 = info
            keys = np.concatenate([_unlow(k) | np.uint64(p << LOW_BITS) for p, k, _, _ in held] or [np.zeros(0, np.uint64)]).view(np.int64)
            docs = np.concatenate([np.frombuffer(d, "<u2") for _, _, d, _ in held] or [np.zeros(0, np.uint16)]).astype(np.int64)
            dfs = np.concatenate([np.frombuffer(d, "<u2") for _, _, _, d in held] or [np.zeros(0, np.uint16)])
            shared = np.bincount(docs, minlength=len(ids))
            stays = (n > 0) & (shared >= _needed(n, percent))
            pick = stays[docs]
            keys, docs, dfs = keys[pick], docs[pick], dfs[pick]
            order = np.lexsort((keys, dfs, docs))
            keys, docs = keys[order], docs[order]
            size = np.where(stays, shared, 0)
            sig = np.bincount(docs * SIGNATURE + (textscan.mix(keys.view(np.uint64)) % np.uint64(SIGNATURE)).astype(np.int64), minlength=len(ids) * SIGNATURE)
            edge = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(edge), pa.array(keys), mask=pa.array(~stays))
            sigs = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * SIGNATURE), pa.array(sig.astype(np.int32)), mask=pa.array(~stays))
            doc = pa.array(ids, mask=nulls)
            yield pa.RecordBatch.from_arrays([pa.array(base + np.arange(len(ids))), doc, pa.array(n), pa.array(h1), pa.array(h2), lists, sigs], schema=_SETS_ARROW)

        for batch in batches:
            for r in batch.to_pylist():
                if r["base"] != base:
                    yield from finish()
                    base, info, held = r["base"], None, []
                if r["keys"] is None:
                    info = (*(np.frombuffer(r[k], np.int64 if k != "nulls" else bool) for k in ("ids", "nulls", "sizes", "h1", "h2")),)
                else:
                    held.append((r["part"], r["keys"], r["docs"], r["dfs"]))
        yield from finish()

    return run


def shared_sets(documents: DataFrame, width: int, percent: int) -> DataFrame:
    """Per row: its set's size and sum hashes, and, where it can link at all, its shared n-grams rare-first."""
    docs = documents.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bits = min(24, max(4, (max(1, plan_bytes(docs)) >> 20).bit_length()))
    blocks = docs.mapInArrow(_split(bits, width), _BLOCKS).repartition("part").sortWithinPartitions("part")
    back = blocks.mapInArrow(_counted, _BLOCKS).repartition("base").sortWithinPartitions("base")
    return written(back.mapInArrow(_gathered(percent), _SETS), "sets", tasks_for(docs))


def _possible(a: str, b: str, percent: int) -> Column:
    """The length and positional filters for two members of a prefix n-gram's group.

    ``own`` n-grams of no other document come first in a set's order, ``at`` counts
    its shared ones before this one: the sets have at most the lesser ``at`` in
    common before it, it, and the lesser rest after it.
    """
    n = [F.col(f"{x}n") for x in (a, b)]
    at = [F.col(f"{x}at") for x in (a, b)]
    rest = [F.col(f"{x}n") - F.col(f"{x}own") - F.col(f"{x}at") - 1 for x in (a, b)]
    most = F.least(*at) + 1 + F.least(*rest)
    return (100 * F.least(*n) >= percent * F.greatest(*n)) & ((100 + percent) * most >= percent * (n[0] + n[1]))


def _alike(a: str, b: str, total: Column, percent: int) -> Column:
    """The suffix filter: class by class, sets cannot share more n-grams than the lesser has."""
    most = F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    return (100 + percent) * most >= percent * total


def _first() -> Column:
    """What sorts the row that names a class first: known doc_ids by value, then row numbers."""
    return F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "uid")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The linked ones of the distinct candidate pairs (a, b)."""
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("keys").alias("ka"), F.col("sig").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("keys").alias("kb"), F.col("sig").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    total = F.col("na") + F.col("nb")
    both = both.where(_alike("sa", "sb", total, percent))
    common = F.size(F.array_intersect("ka", "kb"))
    return both.where(100 * common >= percent * (total - common)).select("a", "b")


def jaccard_classes(documents: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """Per row of documents (doc_id, text): doc_id, n_shingles, component_id, uid (the row's ``monotonically_increasing_id``), keep (one row of a class).

    Two rows link when ``100 * |A and B| >= percent * |A or B|`` for their sets of
    word n-grams; component_id is the smallest doc_id reachable. A null or empty
    text has an empty set and links with nothing; fewer than ``width`` words make
    one n-gram. Equal sets always link. Rows with equal doc_ids stay apart rows.
    A null doc_id links like any other but never names a component (null if alone).
    Texts of any length are read whole, other columns are not looked at; no rows give none.
    """
    every, tasks = shared_sets(documents, width, percent), tasks_for(documents)
    copies = every.where("keys IS NOT NULL").groupBy("n_shingles", "h1", "h2").agg(F.min(_first()).alias("first"), F.min("uid").alias("id"))
    copies = written(copies, "copies", tasks)
    sets = written(copies.select("id").join(every.select(F.col("uid").alias("id"), F.col("n_shingles").alias("n"), "keys", "sig"), "id"), "reps", tasks)

    own = F.col("n") - F.size("keys")
    need = F.ceil(F.col("n") * percent / 100).cast("long")
    prefix = (F.col("n") - need + 1 - own).cast("int")
    pref = sets.select("id", "n", "sig", own.alias("own"), F.posexplode(F.slice("keys", F.lit(1), prefix)).alias("at", "key"))
    # the member with the fewest n-grams of its own is the likeliest original of a group of copies
    centres = pref.groupBy("key").agg(F.min(F.struct("own", "n", "id", "at")).alias("c"), F.count("*").alias("m")).where("m > 1").select("key", F.col("c.id").alias("centre"), *(F.col(f"c.{k}").alias(f"c_{k}") for k in ("n", "own", "at")))
    pref = star = written(pref.join(centres, "key"), "prefix", tasks)

    tries = pref.where((F.col("id") != F.col("centre")) & _possible("", "c_", percent)).select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
    tries = written(tries, "tries", tasks)
    first = written(_verified(tries, sets, percent), "stars", tasks)
    roots = components(first)
    known = roots.select(F.col("node").alias("id"), F.col("root").alias("comp"))
    centre_of = roots.select(F.col("node").alias("centre"), F.col("root").alias("ccomp"))
    pref = pref.join(known, "id", "left").join(centre_of, "centre", "left").select("key", "id", "n", "own", "at", "sig", F.coalesce("comp", "id").alias("comp"), (F.coalesce("comp", "id") != F.coalesce("ccomp", "centre")).alias("apart"))
    pref = written(pref, "labelled", tasks)
    released(star)
    x = pref.where("apart").select("key", *(F.col(c).alias(f"x_{c}") for c in ("id", "n", "own", "at", "sig", "comp")))
    y = pref.select("key", *(F.col(c).alias(f"y_{c}") for c in ("id", "n", "own", "at", "sig", "comp", "apart")))
    once = (~F.col("y_apart")) | (F.col("x_id") < F.col("y_id"))
    near = x.join(y, "key").where((F.col("x_comp") != F.col("y_comp")) & once & _possible("x_", "y_", percent) & _alike("x_sig", "y_sig", F.col("x_n") + F.col("y_n"), percent))
    swap = F.col("x_id") > F.col("y_id")
    pairs = near.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct().join(tries, ["a", "b"], "left_anti")
    second = written(_verified(pairs, sets, percent), "rest", tasks)
    if not second.isEmpty():
        roots = components(first.unionByName(second))
    released(pref, tries, sets)

    classes = copies.join(roots.select(F.col("node").alias("id"), "root"), "id", "left")
    # a component of very many classes is dealt over several tasks
    linked = classes.where("root IS NOT NULL").withColumn("salt", F.pmod("id", F.lit(SALTS)).cast("int"))
    names = linked.groupBy("root").agg(F.min("first").alias("component")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = linked.join(names, ["root", "salt"]).select("n_shingles", "h1", "h2", "component")
    named = written(named.unionByName(classes.where("root IS NULL").select("n_shingles", "h1", "h2", F.col("first").alias("component"))), "classes", tasks)
    alone = every.where("keys IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "uid", F.lit(True).alias("keep"))
    linked = every.where("keys IS NOT NULL").select("doc_id", "n_shingles", "h1", "h2", "uid").join(named, ["n_shingles", "h1", "h2"]).select("doc_id", "n_shingles", F.col("component.doc_id").alias("component_id"), "uid", (F.col("component.uid") == F.col("uid")).alias("keep"))
    return alone.unionByName(linked)


def one_of_each(documents: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """The rows of documents of which each class of near copies keeps one, that of the smallest doc_id.

    ``documents`` must read the same rows in the same order each time, as written tables do.
    Its columns stay as they are; classes are as ``jaccard_classes`` has them.
    """
    uid = free_name(documents.columns, "uid")
    gone = jaccard_classes(documents, width, percent).where("NOT keep").select(F.col("uid").alias(uid))
    rows = documents.withColumn(uid, F.monotonically_increasing_id())
    return rows.join(gone, uid, "left_anti").select(*documents.columns).coalesce(tasks_for(documents))
