"""LM scoring by a probabilistic suffix tree over words.

Tokens are words and one end per text. The root's distribution is the smoothed
unigram ``(c + 0.1) / (N + 0.1 * (V + 1))``, in which all unknown words are one
symbol. Contexts are all runs of 1 to ``DEPTH`` words before a token, the text's
start among them, and every symbol is counted in each.

A context is retained when its next-symbol distribution diverges from its suffix's:
the leave-one-out log likelihood that it gains over the state of its own suffix (the
longest retained one) on its training tokens must exceed ``log(count + 1)``; no
context of one training token can. Its distribution is interpolated with that state's
by Witten-Bell weights, so each sums to one, and a token is scored in its longest
retained suffix.

Everything is counted over all training texts. The texts are read twice, for the
vocabulary and to be written as numbers; all later passes read those. An occurrence
travels once, packed in about 13 bytes, to the range of its shortest context that is
not hot; all longer ones meet there too, so its chain is judged in place, and a sum
for each text and range travels back. Ranges are worked off in ``ROUNDS`` rounds, which
bounds the disk that is taken at once. A context with more occurrences than one task
should hold (``hot_share`` of all tokens, at most ``hot_most``, but never less than one
in ten million, so there are at most 10^7 a level) is hot: its (context, symbol) counts
are added up before they are exchanged and judged level by level. The likeliest ``head_words`` symbols of the root and pairs of each hot level
are looked up where tokens are read, all others by a join; no result depends on
these limits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan
from .labelled import remainder
from ..sources.scratch import plan_bytes, released, tasks_for, written

DEPTH = 3
ROUNDS = 2
MERGE_WORDS = 1 << 19
FLUSH_TOKENS, FLUSH_ROWS = 1 << 18, 30_000
START, END = np.uint64(0x7A3D5F1C9B24E861), np.uint64(0x2C9E7B5A41D8F36D)
_ORDER = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
NONE = 0xFFFFFF  # of three bytes: a number that names nothing


# --- words ----------------------------------------------------------------------


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns held_out, text: (h, train, every) of distinct words, merged over many rows."""
    held: list[tuple] = []

    def merge() -> pa.RecordBatch:
        h, to = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
        train, every = (np.bincount(to, np.concatenate([x[k] for x in held])).astype(np.int64) for k in (1, 2))
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(train), pa.array(every)], ["h", "train", "every"])

    for batch in batches:
        learn = ~np.asarray(batch.column(0))
        offsets, data = textscan.string_bytes(batch.column(1))
        for i, j in textscan.slices(offsets):
            w = textscan.words(offsets, data, i, j)
            if len(w.hash):
                h, to = np.unique(w.hash, return_inverse=True)
                held.append((h, np.bincount(to, learn[i:j][w.row]), np.bincount(to)))
            if sum(len(x[0]) for x in held) > MERGE_WORDS:
                yield merge()
                held.clear()
    if held:
        yield merge()


class Head:
    """Looks hashes up: a direct table of the leading bits, then a short walk."""

    BITS = 20

    def __init__(self, h: np.ndarray):
        self.h = h
        self.first = np.searchsorted(h >> np.uint64(64 - self.BITS), np.arange((1 << self.BITS) + 1, dtype=np.uint64))

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        out = np.full(len(x), -1)
        lead = (x >> np.uint64(64 - self.BITS)).astype(np.int64)
        open_ = np.flatnonzero(self.first[lead] < self.first[lead + 1])
        at, stop = self.first[lead[open_]], self.first[lead[open_] + 1]
        while len(open_):
            hit = self.h[at] == x[open_]
            out[open_[hit]] = at[hit]
            on = ~hit & (at + 1 < stop)
            open_, at, stop = open_[on], at[on] + 1, stop[on]
        return out


# --- texts as numbers -----------------------------------------------------------


def _narrow(x: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of numbers, plane by plane."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _wide(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


_TOKENS = "base long, ids binary, nulls binary, held binary, sizes binary, codes binary, rare binary"


def _record(schema: str, rows: list[dict]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds[t]) for n, t in fields], [n for n, _ in fields])


def _tokenised(head):
    """Columns doc_id, held_out, text: a row for each flush of texts; frequent words by number, the others by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Head(head.value)
        base = TaskContext.get().partitionId() << 40
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal base
            ids, nulls, out, sizes, codes, rare = (np.concatenate([x[k] for x in held]) for k in range(6))
            held.clear()
            row = {"base": base, "ids": ids.tobytes(), "nulls": nulls.tobytes(), "held": out.tobytes(), "sizes": sizes.astype("<u4").tobytes(), "codes": _narrow(codes, 3), "rare": rare.tobytes()}
            base += len(ids)
            return _record(_TOKENS, [row])

        n_docs = n_tokens = 0
        for batch in batches:
            known = np.asarray(batch.column(0).is_valid())
            ids, out = np.asarray(batch.column(0).fill_null(0)).astype(np.int64), np.asarray(batch.column(1))
            offsets, data = textscan.string_bytes(batch.column(2))
            for i, j in textscan.slices(offsets):
                while i < j:
                    k = min(j, i + FLUSH_ROWS - n_docs)
                    w = textscan.words(offsets, data, i, k)
                    at = find.find(w.hash)
                    held.append((ids[i:k], ~known[i:k], out[i:k], w.per_row, np.where(at < 0, NONE, at), w.hash[at < 0]))
                    n_docs, n_tokens, i = n_docs + k - i, n_tokens + len(at), k
                    if n_docs >= FLUSH_ROWS or n_tokens >= FLUSH_TOKENS:
                        yield flush()
                        n_docs = n_tokens = 0
        if held:
            yield flush()

    return run


def extended(key, word, k: int):
    """The key of the context of ``k`` words that has one more word before the context ``key``."""
    return textscan.mix((key ^ word) * _ORDER[k - 1] + np.uint64(k))


def pair_key(ctx: np.ndarray, s: np.ndarray) -> np.ndarray:
    return textscan.mix(ctx ^ textscan.mix(s))


class Flush:
    """The tokens of a flush, ends among them: text, symbol, keys of the contexts of 1 to DEPTH words and how many of them exist.

    ``often`` tells which words occur twice in training; a context ends before one that does not.
    """

    def __init__(self, row: dict, head: np.ndarray, start_often: bool = True, often=None):
        self.sizes = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
        self.learn = ~np.frombuffer(row["held"], bool)
        self.code = _wide(row["codes"], 3).astype(np.int64)
        self.rare = self.code == NONE
        self.word = head[np.where(self.rare, 0, self.code)] if len(head) else np.zeros(len(self.code), np.uint64)
        self.word[self.rare] = np.frombuffer(row["rare"], np.uint64)
        size = self.sizes + 2
        first = np.cumsum(size) - size
        n = int(size.sum())
        inner = np.ones(n, dtype=bool)
        inner[first] = inner[first + size - 1] = False
        h = np.full(n, START, dtype=np.uint64)
        h[inner], h[first + size - 1] = self.word, END
        good = np.full(n, start_often)
        good[inner] = True if often is None else often(self)
        use = np.ones(n, dtype=bool)
        use[first] = False
        self.doc = np.repeat(np.arange(len(size)), self.sizes + 1)
        self.inner = inner[use]  # tokens that are words
        use = np.flatnonzero(use)
        self.s = h[use]
        left = np.arange(n)[use] - np.repeat(first, self.sizes + 1)
        self.keys, self.m = np.zeros((DEPTH, len(use)), dtype=np.uint64), np.zeros(len(use), dtype=np.int64)
        live = np.arange(len(use))
        for k in range(1, DEPTH + 1):
            live = live[left[live] >= k]
            live = live[good[use[live] - k]]
            self.keys[k - 1, live] = extended(self.keys[k - 2, live] if k > 1 else np.zeros(len(live), np.uint64), h[use[live] - k], k)
            self.m[live] = k

    def state(self, finds: list[Head]) -> tuple[np.ndarray, np.ndarray]:
        """(words, key) of each token's longest hot context; every suffix of a hot context is hot."""
        d, live = np.zeros(len(self.m), dtype=np.int64), np.arange(len(self.m))
        ctx = np.zeros(len(self.m), dtype=np.uint64)
        for k, find in enumerate(finds):
            live = live[self.m[live] > k]
            live = live[find.find(self.keys[k, live]) >= 0]
            d[live], ctx[live] = k + 1, self.keys[k, live]
        return d, ctx


class Shared:
    """What is broadcast, ready for look-ups: frequent words, hot contexts and the likeliest (state, symbol) pairs with their probabilities."""

    def __init__(self, value: tuple):
        self.head, hot, self.pairs, self.known, self.floor, self.start_often = value
        self.hot, self.find = [Head(h) for h in hot], Head(self.pairs)
        self.root = self.find.find(pair_key(np.zeros(len(self.head), np.uint64), self.head))
        self.end = self.find.find(pair_key(np.zeros(1, np.uint64), np.array([END])))[0]

    def flush(self, row: dict) -> Flush:
        """The tokens with ``low`` (their state's probability of them), ``place`` (its pair, or -1), ``root`` and ``counted`` of words."""
        rest = np.frombuffer(row["keys"] or b"", np.uint64), np.frombuffer(row["lows"] or b"", np.float64)
        look = lambda key: rest[1][np.searchsorted(rest[0], key)]

        def often(f: Flush) -> np.ndarray:
            f.root = np.empty(len(f.word))
            f.root[~f.rare] = self.known[self.root[f.code[~f.rare]]]
            f.root[f.rare] = look(pair_key(np.zeros(f.rare.sum(), np.uint64), f.word[f.rare]))
            return f.root > self.floor * 15  # (2 + 0.1) / 0.1 is 21, (1 + 0.1) / 0.1 is 11

        f = Flush(row, self.head, self.start_often, often)
        self._place(f)
        f.low = self.known[f.place]
        miss = f.place < 0
        f.low[miss] = look(pair_key(f.ctx[miss], f.s[miss]))
        return f

    def _place(self, f: Flush) -> None:
        f.d, f.ctx = f.state(self.hot)
        f.place = np.full(len(f.s), self.end)
        f.place[f.inner] = np.where(f.rare, -1, self.root[np.where(f.rare, 0, f.code)]) if len(self.head) else -1
        deep = np.flatnonzero(f.d)
        f.place[deep] = self.find.find(pair_key(f.ctx[deep], f.s[deep]))

    def missing(self, row: dict) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (state, symbol) whose probabilities must be joined: all that ``flush`` may look up."""
        f = Flush(row, self.head)
        self._place(f)
        miss = f.place < 0
        ctx, s = np.concatenate((f.ctx[miss], np.zeros(f.rare.sum(), np.uint64))), np.concatenate((f.s[miss], f.word[f.rare]))
        _, pick = np.unique(pair_key(ctx, s), return_index=True)
        return ctx[pick], s[pick]


def _hot_pairs(shared, level: int):
    """Counts of (hot context of ``level`` words, symbol), added up over many tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, hot = shared.value
        finds = [Head(h) for h in hot]
        held: list[tuple] = []

        def merge() -> pa.RecordBatch:
            ctx, s, t, e = (np.concatenate([x[k] for x in held]) for k in range(4))
            held.clear()
            order = np.lexsort((s, ctx))
            ctx, s = ctx[order], s[order]
            new = np.flatnonzero(np.concatenate(([True], (ctx[1:] != ctx[:-1]) | (s[1:] != s[:-1]))))
            t, e = (np.add.reduceat(x[order], new) for x in (t, e))
            return pa.RecordBatch.from_arrays([pa.array(ctx[new].view(np.int64)), pa.array(s[new].view(np.int64)), pa.array(t), pa.array(e)], ["ctx", "s", "train", "every"])

        for batch in batches:
            for row in batch.to_pylist():
                f = Flush(row, head)
                d, ctx = f.state(finds)
                own = np.flatnonzero(d == level)
                if len(own):
                    held.append((ctx[own], f.s[own], f.learn[f.doc[own]].astype(np.int64), np.ones(len(own), dtype=np.int64)))
                if sum(len(x[0]) for x in held) > FLUSH_TOKENS:
                    yield merge()
        if held:
            yield merge()

    return run


def _missing(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Shared(shared.value)
        for batch in batches:
            for row in batch.to_pylist():
                ctx, s = look.missing(row)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), row["base"])), pa.array(ctx.view(np.int64)), pa.array(s.view(np.int64))], ["base", "ctx", "s"])

    return run


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by flush: its (state, symbol) pairs' keys, ascending, and probabilities."""
    last, held = None, []

    def emit() -> pa.RecordBatch:
        ctx, s, low = (np.concatenate([x[k] for x in held]) for k in range(3))
        key = pair_key(ctx.view(np.uint64), s.view(np.uint64))
        order = np.argsort(key)
        held.clear()
        return _record("base long, keys binary, lows binary", [{"base": last, "keys": key[order].tobytes(), "lows": low[order].tobytes()}])

    for batch in batches:
        base, *rest = (np.array(c) for c in batch.columns)
        for part in np.split(np.arange(len(base)), np.flatnonzero(base[1:] != base[:-1]) + 1):
            if not len(part):
                continue
            if held and base[part[0]] != last:
                yield emit()
            last = int(base[part[0]])
            held.append([x[part] for x in rest])
    if held:
        yield emit()


# --- contexts -------------------------------------------------------------------

_SUMS = "base long, ids binary, nulls binary, held binary, sizes binary, known binary, root binary, docs binary, sums binary"
_BLOCKS = "part int, a0 binary, a1 binary, a2 binary, said binary, extra binary, lows binary, learn binary, " + _SUMS


def _occurrences(shared, bits: int, turn: int):
    """Packed occurrences of each flush by range of contexts, of this round's ranges; in the first round also what its texts score in their hot states, and the root's sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Shared(shared.value)
        end = look.known[look.end]

        def summed(row: dict, f: Flush) -> dict:
            n, doc = len(f.sizes), f.doc[f.inner]
            root = np.bincount(doc, np.log10(f.root), minlength=n) + np.log10(end)
            known = np.bincount(doc, f.root > look.floor * 5, minlength=n) + (end > look.floor * 5)
            sums = np.bincount(f.doc, np.log10(f.low), minlength=n)
            part = int(textscan.mix(np.array([row["base"]], np.uint64))[0] >> np.uint64(64 - bits))
            return {"part": part, **{c: row[c] for c in ("base", "ids", "nulls", "held", "sizes")}, "known": known.astype(np.int64).tobytes(), "root": root.tobytes(), "docs": np.arange(n).astype("<u2").tobytes(), "sums": sums.tobytes()}

        for batch in batches:
            for row in batch.to_pylist():
                f = look.flush(row)
                use = np.flatnonzero(f.m > f.d)
                a0 = f.keys[f.d[use], use]
                part = (a0 >> np.uint64(64 - bits)).astype(np.int64)
                own = np.flatnonzero(part % ROUNDS == turn)
                own = own[np.argsort(part[own].astype(np.uint32), kind="stable")]
                use, part = use[own], part[own]
                a = [a0[own] << np.uint64(bits) >> np.uint64(32)]
                for x in range(1, DEPTH):
                    at = f.d[use] + x
                    a.append(np.where(at < f.m[use], f.keys[np.minimum(at, DEPTH - 1), use] % np.uint64(NONE) + np.uint64(1), np.uint64(0)))
                said, doc, learn = f.place[use], f.doc[use], f.learn[f.doc[use]]
                some, edge = np.unique(part, return_index=True)
                out = []
                for p, i, j in zip(some.tolist(), edge, np.append(edge[1:], len(use)), strict=True):
                    far = use[i:j][said[i:j] < 0]
                    packed = {"said": _narrow(np.where(said[i:j] < 0, NONE, said[i:j]), 3), "extra": f.s[far].astype("<u4").tobytes(), "lows": f.low[far].astype("<f4").tobytes(), "learn": np.packbits(learn[i:j]).tobytes(), "docs": doc[i:j].astype("<u2").tobytes()}
                    out.append({"part": p, "base": row["base"], **{f"a{x}": _narrow(a[x][i:j], 4 if x == 0 else 3) for x in range(DEPTH)}, **packed})
                if not turn:
                    out.append(summed(row, f))
                if out:
                    yield _record(_BLOCKS, out)

    return run


def _in_state(ctx: np.ndarray, said: np.ndarray, learn: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The probability of each occurrence in the state of its context (numbered) where that is retained, else ``low``, that of its suffix's state."""
    key = ctx.astype(np.uint64) << np.uint64(32) | said
    order = np.argsort(key)
    key, t = key[order], learn[order].astype(float)
    new = np.concatenate(([True], key[1:] != key[:-1]))
    pair, of = np.cumsum(new) - 1, ctx[order][new]
    c = np.bincount(pair, t)
    n, kinds = np.bincount(of, c), np.bincount(of, c > 0)
    p0, a = low[order][new], np.maximum(kinds[of], 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        one_out = c * (np.log((np.maximum(c - 1, 0) + a * p0) / np.maximum(n[of] - 1 + a, 1e-9)) - np.log(p0))
    stay = np.bincount(of, np.where(c > 0, one_out, 0.0)) > np.log(n + 1)
    out = np.empty(len(key))
    out[order] = np.where(stay[of], (c + a * p0) / (n[of] + a), p0)[pair]
    return out


def climb(a: list[np.ndarray], said: np.ndarray, learn: np.ndarray, low: np.ndarray) -> np.ndarray:
    """What the contexts ``a[0]``, ``a[1]``, ... of each occurrence (0: none from here on) add to log10 ``low``, each judged against its own suffix's state.

    A longer context is known within its suffix; one with fewer than two training occurrences cannot be retained, nor can those that it is the suffix of.
    """
    p, live, key = low.copy(), np.arange(len(said)), a[0]
    for x in range(DEPTH):
        if not len(live):
            break
        order = np.argsort(key)
        ctx = np.cumsum(np.concatenate(([False], np.diff(key[order]) != 0)))
        twice = (np.bincount(ctx, learn[live[order]]) >= 2)[ctx]
        live, ctx = live[order][twice], ctx[twice]
        if not len(live):
            break
        p[live] = _in_state(ctx, said[live], learn[live], p[live])
        if x + 1 < DEPTH:
            on = a[x + 1][live] > 0
            live, key = live[on], ctx[on].astype(np.uint64) << np.uint64(24) | a[x + 1][live[on]]
    return np.log10(p) - np.log10(low)


def _judged(shared):
    """Rows come sorted by range: what the range's occurrences add to each text of each flush."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value[3]
        part, held = None, []

        def finish() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            a = [np.concatenate([_wide(r[f"a{x}"], 4 if x == 0 else 3) for r in held]) for x in range(DEPTH)]
            said = np.concatenate([_wide(r["said"], 3) for r in held])
            count = [len(r["docs"]) // 2 for r in held]
            learn = np.concatenate([np.unpackbits(np.frombuffer(r["learn"], np.uint8), count=n) for r, n in zip(held, count, strict=True)]) > 0
            far = said == NONE
            low = known[np.where(far, 0, said).astype(np.int64)]
            low[far] = np.frombuffer(b"".join(r["lows"] for r in held), "<f4")
            said[far] = np.frombuffer(b"".join(r["extra"] for r in held), "<u4") | np.uint64(1 << 31)
            add = climb(a, said, learn, low)
            out, at = [], 0
            for r, n in zip(held, count, strict=True):
                docs, own = np.frombuffer(r["docs"], "<u2"), add[at : at + n]
                at += n
                some = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))  # a block's texts ascend
                out.append({"base": r["base"], "docs": docs[some].tobytes(), "sums": np.add.reduceat(own, some).tobytes()})
            yield _record(_SUMS, out)

        for batch in batches:
            for r in batch.to_pylist():
                if r["a0"] is None:
                    yield _record(_SUMS, [r])
                    continue
                if r["part"] != part:
                    yield from finish()
                    part, held = r["part"], []
                held.append(r)
        yield from finish()

    return run


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _added(total: int):
    """Rows come sorted by flush: its texts with their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, info, sums = None, None, np.zeros(FLUSH_ROWS)

        def finish() -> Iterator[pa.RecordBatch]:
            if info is not None:
                ids, known, root = (np.frombuffer(info[c], t) for c, t in (("ids", np.int64), ("known", np.int64), ("root", np.float64)))
                held, nulls = (np.frombuffer(info[c], bool) for c in ("held", "nulls"))
                n = np.frombuffer(info["sizes"], "<u4").astype(np.int64) + 1
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=nulls), pa.array(held), pa.array(n), pa.array(known), pa.array(np.full(len(ids), total)), pa.array(root), pa.array(sums[: len(ids)])], [x.split()[0] for x in _SCORES.split(", ")])

        for batch in batches:
            for r in batch.to_pylist():
                if r["base"] != base:
                    yield from finish()
                    base, info, sums = r["base"], None, np.zeros(FLUSH_ROWS)
                if r["ids"] is not None:
                    info = r
                sums[np.frombuffer(r["docs"], "<u2")] += np.frombuffer(r["sums"], np.float64)
        yield from finish()

    return run


def _most(rows: DataFrame, by: str, limit: int) -> DataFrame:
    """Whole levels of the largest counts, at most ``limit`` rows: counts by level are a small table at any size."""
    level = F.floor(F.log2(F.col(by) + 1) * 8).cast("int")
    left, least = limit, None
    for r in sorted(rows.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        left -= r["count"]
        if left < 0:
            break
        least = r["level"]
    return rows.where(level >= least if least is not None else F.lit(False))


def _key(name: tuple) -> list[np.uint64]:
    """Keys of the suffixes of a context given by its words' hashes, oldest first."""
    out, key = [], np.zeros(1, dtype=np.uint64)
    for k, word in enumerate(reversed(name), 1):
        key = extended(key, np.uint64(word), k)
        out.append(key[0])
    return out


def score_texts(documents: DataFrame, held_out_of: int = 10, head_words: int = 1 << 18, hot_share: float = 1 / 256, hot_least: int = 1 << 14, hot_most: int = 1 << 20) -> DataFrame:
    """Per row of documents (doc_id, text): held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows whose ``crc32(doc_id as text) % held_out_of`` is not 0; a null
    doc_id counts as the empty text, so it is held out. A null text is empty and has
    one token, its end. ``base_score`` is the root's log10 probability of the text,
    ``score`` the tree's. Without training texts both are 0 tokens' worth of counts
    (every token is unknown). Rows with equal doc_ids stay rows of their own; other
    columns are not looked at. Texts of any length are scored whole.
    """
    spark = documents.sparkSession
    sc = spark.sparkContext
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(held_out_of) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    words = docs.select("held_out", "text").mapInArrow(_counted_words, "h long, train long, every long").groupBy("h").agg(F.sum("train").alias("train"), F.sum("every").alias("every"))
    tasks = tasks_for(docs)
    vocabulary = written(words, "vocabulary", tasks)
    sums = vocabulary.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("train", "every")), F.count_if(F.col("train") > 0).alias("kinds")).first()
    texts = docs.agg(F.count_if(~F.col("held_out")).alias("ends"), F.count("*").alias("every")).first()
    ends = texts.ends
    total, kinds = sums.train + ends, sums.kinds + (ends > 0)

    top = _most(vocabulary, "train", head_words).toPandas()
    h = top["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    h, train = h[order], top["train"].to_numpy(np.int64)[order]
    tokens = written(docs.coalesce(tasks).mapInArrow(_tokenised(sc.broadcast(h)), _TOKENS), "tokens")  # the broadcast: at most head_words numbers

    floor, scale = 0.1, total + 0.1 * (kinds + 1)
    lower = vocabulary.select(F.lit(0).cast("long").alias("ctx"), F.col("h").alias("s"), ((F.col("train") + floor) / scale).alias("low"))
    end = spark.createDataFrame([(0, int(END.view(np.int64)), float((ends + floor) / scale))], "ctx long, s long, low double")
    lower = least = lower.unionByName(end)
    hot_over = max(min(hot_most, max(hot_least, hot_share * sums.every)), 1e-7 * sums.every)
    hot: list[np.ndarray] = []
    pairs, known = [pair_key(np.zeros(len(h) + 1, dtype=np.uint64), np.append(h, END))], [(np.append(train, ends) + floor) / scale]
    tables = [vocabulary]
    names = {(int(np.int64(r.h).view(np.uint64)),): None for r in vocabulary.where(F.col("every") > hot_over).select("h").collect()}  # at most 10^7 rows
    names |= {(int(START),): None} if texts.every > hot_over else {}
    for level in range(1, DEPTH + 1):
        keyed = {int(_key(name)[-1]): name for name in names}
        if not keyed:
            break
        hot.append(np.sort(np.array(list(keyed), dtype=np.uint64)))
        counts = tokens.mapInArrow(_hot_pairs(sc.broadcast((h, hot)), level), "ctx long, s long, train long, every long").groupBy("ctx", "s").agg(F.sum("train").alias("train"), F.sum("every").alias("every"))
        counts = written(counts, f"hot{level}")
        signed = lambda x: int(np.uint64(x).view(np.int64))
        suffix = spark.createDataFrame([(signed(k), signed(_key(n)[-2]) if level > 1 else 0) for k, n in keyed.items()], "ctx long, suffix long")
        seen_of = counts.groupBy("ctx").agg(F.sum("train").alias("n"), F.greatest(F.count_if(F.col("train") > 0), F.lit(1)).alias("a"))
        judged = counts.join(F.broadcast(suffix), "ctx").join(least.select(F.col("ctx").alias("suffix"), "s", F.col("low").alias("p")), ["suffix", "s"]).join(F.broadcast(seen_of), "ctx")
        judged = written(judged, f"judged{level}")
        one_out = F.col("train") * (F.log((F.greatest(F.col("train") - 1, F.lit(0)) + F.col("a") * F.col("p")) / F.greatest(F.col("n") - 1 + F.col("a"), F.lit(1e-9))) - F.log("p"))
        stay = judged.groupBy("ctx", "n").agg(F.sum(F.when(F.col("train") > 0, one_out).otherwise(0.0)).alias("gain")).select("ctx", (F.col("gain") > F.log(F.col("n") + 1)).alias("stay"))
        least = written(judged.join(F.broadcast(stay), "ctx").select("ctx", "s", "every", F.when(F.col("stay"), (F.col("train") + F.col("a") * F.col("p")) / (F.col("n") + F.col("a"))).otherwise(F.col("p")).alias("low")), f"lower{level}")
        tables.append(least)
        lower = lower.unionByName(least.select("ctx", "s", "low"))
        often = _most(least, "every", head_words).toPandas()
        pairs.append(pair_key(*(often[c].to_numpy(np.int64).view(np.uint64) for c in ("ctx", "s"))))
        known.append(often["low"].to_numpy(float))
        longer = counts.where((F.col("every") > hot_over) & (F.col("s") != signed(END))).select("ctx", "s").collect()
        names = {(*keyed[int(np.int64(r.ctx).view(np.uint64))], int(np.int64(r.s).view(np.uint64))): None for r in longer}
        released(judged, counts)
    pairs, known = np.concatenate(pairs), np.concatenate(known)
    order = np.argsort(pairs)
    shared = sc.broadcast((h, hot, pairs[order], known[order], floor / scale, ends >= 2))

    missing = tokens.mapInArrow(_missing(shared), "base long, ctx long, s long").join(lower, ["ctx", "s"]).select("base", "ctx", "s", "low")
    found = missing.repartition("base").sortWithinPartitions("base").mapInArrow(_looked_up, "base long, keys binary, lows binary")
    numbers = written(tokens.join(found, "base", "left"), "numbers")
    released(tokens, *tables)

    bits = min(20, max(6, (max(1, plan_bytes(docs)) >> 19).bit_length()))  # about half a megabyte of input a range
    sums = None
    for turn in range(ROUNDS):
        blocks = numbers.mapInArrow(_occurrences(shared, bits, turn), _BLOCKS).repartition("part").sortWithinPartitions("part")
        part = written(blocks.mapInArrow(_judged(shared), _SUMS), f"sums{turn}")
        sums = part if sums is None else sums.unionByName(part)
    released(numbers)
    return sums.repartition("base").sortWithinPartitions("base").mapInArrow(_added(total), _SCORES)
