"""How far a language's sources are from one another, by systolic rotation.

Every (language, source) group has a vector of counts over the language's kept terms.
Vectors are cut into ranges of about ``RANGE`` terms, so a part of one is small
however large the group, and stored compressed. A language's sources sit in teams of
``TEAM``; a written table, bucketed by (language, range, seat of the team), holds
them. In each round of a round-robin tournament every team meets another: one stays
in its partition, the other's compressed parts travel to it, and the meeting
evaluates all pairs of the two teams in both directions. After as many rounds as
there are other teams all pairs have met once; a round is a job of its own and leaves
only sums by pair. Pairs inside a team meet at home. There the language's own vector
comes by too, and heaps keep each source's leading terms of the range.

All arithmetic is in 64-bit integers and exact while a count is below 2^48.
"""

from __future__ import annotations

import heapq
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textscan
from .terms import LETTERS, profiles, scan
from ..sources.scratch import _PLAIN, SHUFFLE_CLEANUP, released, setting, shared_dir, small_batches, tasks_for, temporary, written

LEAST_DOCS = 3
UNIT = 1_000_000_000
RANGE, TEAM = 2048, 8
HELD = 1 << 19  # (group, term) counts that a task holds before it passes them on

_COUNTS = "lang string, source string, term binary, n long, docs long"
_PAIR = "lang string, source string, item string, value long"
_TERM = "lang string, source string, item string, value long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns lang, source, text: occurrences and documents by group and term; a row without a term names each group met."""
    groups: dict[tuple[str, str], int] = {}
    words: dict[int, bytes] = {}
    held: list[tuple[np.ndarray, ...]] = []

    def merge() -> tuple[np.ndarray, ...]:
        g, h, n, d = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((h, g))
        g, h = g[order], h[order]
        new = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (h[1:] != h[:-1]))))
        held[:] = [(g[new], h[new], np.add.reduceat(n[order], new), np.add.reduceat(d[order], new))]
        return held[0]

    def emit() -> Iterator[pa.RecordBatch]:
        names = list(groups)
        langs, sources = (pa.array([x[c] for x in names], pa.string()) for c in (0, 1))
        none = np.zeros(len(names), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([langs, sources, pa.array([None] * len(names), pa.binary()), pa.array(none), pa.array(none)], ["lang", "source", "term", "n", "docs"])
        if held:
            g, h, n, d = merge()
            for i in range(0, len(g), 1 << 16):
                part = slice(i, i + (1 << 16))
                term = pa.array([words[x] for x in h[part].tolist()], pa.binary())
                at = pa.array(g[part])
                yield pa.RecordBatch.from_arrays([langs.take(at), sources.take(at), term, pa.array(n[part]), pa.array(d[part])], ["lang", "source", "term", "n", "docs"])
        groups.clear(), words.clear(), held.clear()

    for batch in batches:
        langs, sources = (batch.column(c).to_pylist() for c in (0, 1))
        of = np.array([groups.setdefault(x, len(groups)) for x in zip(langs, sources, strict=True)], dtype=np.int64)
        offsets, data = textscan.string_bytes(batch.column(2))
        for i, j in textscan.slices(offsets):
            w = scan(offsets, data, i, j, LETTERS)
            if not len(w.hash):
                continue
            row, h, n, at = profiles(w)
            raw = w.data.tobytes()
            distinct, first = np.unique(h, return_index=True)
            for x, s, e in zip(distinct.tolist(), w.start[at[first]].tolist(), w.end[at[first]].tolist(), strict=True):
                if x not in words:
                    words[x] = raw[s:e]
            held.append((of[i:j][row], h, n.astype(np.int64), np.ones(len(h), dtype=np.int64)))
            if sum(len(x[0]) for x in held) > HELD:
                if len(merge()[0]) > HELD // 2 or len(words) > HELD // 2:
                    yield from emit()
                    of = np.array([groups.setdefault(x, len(groups)) for x in zip(langs, sources, strict=True)], dtype=np.int64)
    if groups:
        yield from emit()


def shares(n: np.ndarray, whole) -> np.ndarray:
    """1 + floor(UNIT * (n + 1) / whole), in two steps of 64 bits."""
    a, b = UNIT // 32_000, 32_000
    high = (n + 1) * a
    return 1 + high // whole * b + high % whole * b // whole


def excess(p, q):
    return (p - q) * (p - q) // q


def packed(ids: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending term numbers and their counts, as differences in the narrowest types."""
    step, kind = np.diff(ids, prepend=-1), np.min_scalar_type(n.max(initial=0))
    return zlib.compress(np.int32(len(ids)).tobytes() + np.dtype(kind).char.encode() + step.astype(np.uint16 if step.max(initial=0) < 1 << 16 else np.int64).tobytes() + n.astype(kind).tobytes(), 1)


def unpacked(blob: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    if blob is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = zlib.decompress(blob)
    size, kind = int(np.frombuffer(raw, np.int32, 1)[0]), np.dtype(chr(raw[4]))
    wide = len(raw) - 5 - size * kind.itemsize
    step = np.frombuffer(raw, np.int64 if size and wide == 8 * size else np.uint16, size, 5)
    return np.cumsum(step.astype(np.int64)) - 1, np.frombuffer(raw, kind, size, 5 + wide).astype(np.int64)


def _pack(key, rows):
    """One range of a language (source, term, n, total): a row for each source's vector, and one with the range's terms and the language's own."""
    rows = rows.sort_by([("term", "ascending"), ("source", "ascending")])
    term = rows["term"].combine_chunks()
    offsets, data = textscan.string_bytes(term)
    flat = term.to_pylist()
    new = np.array([True, *(x != y for x, y in zip(flat, flat[1:], strict=False))])
    ids, n = np.cumsum(new) - 1, np.asarray(rows["n"])
    first = np.flatnonzero(new)
    out = [(None, packed(ids[first], np.asarray(rows["total"])[first]), b"\n".join(flat[x] for x in first.tolist()))]
    source = np.array(rows["source"].to_pylist(), dtype=object)
    by = np.argsort(source, kind="stable")
    for part in np.split(by, np.flatnonzero(source[by][1:] != source[by][:-1]) + 1):
        out.append((source[part[0]], packed(ids[part], n[part]), None))
    names, blobs, terms = zip(*out, strict=True)
    size = len(out)
    return pa.table([pa.array([key[0].as_py()] * size, pa.string()), pa.array([key[1].as_py()] * size, pa.int32()), pa.array(names, pa.string()), pa.array([len(first)] * size, pa.int64()), pa.array(blobs, pa.binary()), pa.array([None if t is None else zlib.compress(t, 1) for t in terms], pa.binary())], ["lang", "range", "source", "terms", "counts", "names"])


class _Member:
    """A source's part of a range: its terms' shares, and the share of all others."""

    def __init__(self, source: str, whole: int, counts: bytes | None):
        self.source = source
        self.ids, self.n = unpacked(counts)
        whole = max(whole, 1)
        self.p, self.rest = shares(self.n, whole), int(shares(np.zeros(1, np.int64), whole)[0])


def _members(rows: pa.Table) -> list[_Member]:
    return [_Member(*x) for x in zip(rows["source"].to_pylist(), rows["whole"].to_pylist(), rows["counts"].to_pylist(), strict=True)]


def _divergence(a: _Member, pa_: np.ndarray, b: _Member, pb: np.ndarray, at: np.ndarray, alone_a: int, terms: int) -> int:
    """Sum over the range's terms of excess(a's share, b's share).

    ``pa_``, ``pb``: shares of both at b's terms where a has them too (``at``: which of a's).
    """
    both = len(at)
    only_b = int(excess(np.int64(a.rest), b.p).sum()) - int(excess(np.int64(a.rest), pb).sum())
    only_a = alone_a - int(excess(pa_, np.int64(b.rest)).sum())
    neither = terms - len(a.ids) - len(b.ids) + both
    return int(excess(pa_, pb).sum()) + only_a + only_b + neither * int(excess(a.rest, b.rest))


def _meet(one: list[_Member], other: list[_Member], terms: int, same: bool) -> list[tuple[str, str, int]]:
    """(source, item, sum) of all pairs of the two teams, in both directions."""
    out = []
    place = np.full(terms, -1, dtype=np.int64)
    for x, a in enumerate(one):
        place[a.ids] = np.arange(len(a.ids))
        for b in other[x + 1 :] if same else other:
            found = place[b.ids]
            in_b = np.flatnonzero(found >= 0)
            in_a = found[in_b]
            p, q = a.p[in_a], b.p[in_b]
            out.append((a.source, b.source, _divergence(a, p, b, q, in_a, int(excess(a.p, np.int64(b.rest)).sum()), terms)))
            out.append((b.source, a.source, _divergence(b, q, a, p, in_b, int(excess(b.p, np.int64(a.rest)).sum()), terms)))
        place[a.ids] = -1
    return out


def _table(lang, rows: list[tuple], fields: int) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * fields
    kinds = [pa.string(), pa.string(), pa.int64()]
    return pa.table([pa.array([lang] * len(rows), pa.string()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["lang", "source", "item", "value"])


def _meeting(key, residents, guests):
    rows = []
    if residents.num_rows and guests.num_rows:
        rows = _meet(_members(residents), _members(guests), residents["terms"][0].as_py(), False)
    return _table(key[0].as_py(), rows, 3)


def _home(key, residents):
    team = _members(residents)
    return _table(key[0].as_py(), _meet(team, team, residents["terms"][0].as_py(), True) if team else [], 3)


def _leading(most: int):
    """A team's sources against the language's own vector: each source's leading terms of the range, by heaps."""

    def run(key, residents, own):
        rows = []
        if residents.num_rows and own.num_rows:
            names = zlib.decompress(own["names"][0].as_py()).split(b"\n")
            lang = _Member("", own["whole"][0].as_py(), own["counts"][0].as_py())
            for a in _members(residents):
                q = lang.p[a.ids]  # the language has all of the range's terms, in order
                over = np.flatnonzero(a.p > q)
                value = excess(a.p[over], q[over])
                # terms are numbered in the order of their bytes
                for v, t in heapq.nsmallest(most, zip((-value).tolist(), a.ids[over].tolist(), strict=True)):
                    rows.append((a.source, names[t].decode("utf-8", "replace"), -v))
        return _table(key[0].as_py(), rows, 3)

    return run


def rounds(teams: int) -> list[dict[int, int]]:
    """A round-robin of an even number of teams: in each round {travelling team: its host}; every two teams meet once."""
    out = []
    for r in range(teams - 1):
        met = [(r, teams - 1)] + [((r + k) % (teams - 1), (r - k) % (teams - 1)) for k in range(1, teams // 2)]
        out.append(dict((min(x), max(x)) if (sum(x) + r) % 2 else (max(x), min(x)) for x in met))
    return out


def _seated(df: DataFrame, parts: int) -> DataFrame:
    """The table written in buckets by (lang, range, seat), so that those who stay need no exchange."""
    spark = df.sparkSession
    name = f"siltwork_seats_{uuid.uuid4().hex}"
    path = temporary(spark, f"{shared_dir(spark)}/{name}")
    with setting(spark, SHUFFLE_CLEANUP, "true"), small_batches(spark):
        df.repartition(parts, "lang", "range", "seat").write.options(**_PLAIN).bucketBy(parts, "lang", "range", "seat").option("path", path).saveAsTable(name)
    seated = spark.table(name)
    seated.scratch_path, seated.table_name = path, name
    return seated


def audit(documents: DataFrame, most_terms: int = 200, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, part, item, value, rank for every (lang, source) of the documents.

    Terms are runs of ASCII letters and of non-ASCII characters, A-Z lower-cased; a
    language keeps those that at least ``least_docs`` of its documents hold. A group's
    share of a kept term is 1 + floor(10^9 * (count + 1) / (N + V)), N its count of kept
    terms, V how many are kept; the excess of shares p over q is floor((p - q)^2 / q).
    Part ``pair``: for every other source of the language the sum of the excess over its
    shares, all ranks. Part ``term``: the ``most_terms`` kept terms, among those that the
    group holds and of which it has a larger share than the language, with the largest
    excess. Equal values go by item, by bytes.

    Null text, lang and source count as empty. A group without terms, or in a language
    that keeps none (values are 0 there), still is compared. Repeated rows and rows of
    one doc_id are documents of their own; texts of any length count whole; other columns
    are not looked at; no rows give no rows.
    """
    spark = documents.sparkSession
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    seen = documents.select(empty("lang"), empty("source"), empty("text")).mapInArrow(_counted, _COUNTS)
    counts = seen.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    nth = F.row_number().over(of_term.orderBy("source"))
    counts = counts.select("lang", "source", "term", "n", F.sum("n").over(of_term).alias("total"), F.sum("docs").over(of_term).alias("df"), nth.alias("nth"))
    kept = counts.where(F.col("term").isNull() | (F.col("df") >= least_docs)).drop("df")
    kept = written(kept, "kept", tasks_for(documents))

    one = F.when(F.col("term").isNotNull() & (F.col("nth") == 1), 1).otherwise(0)
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum(one).alias("firsts"))
    by_lang = Window.partitionBy("lang")
    whole = F.sum("firsts").over(by_lang)
    seat = ((F.row_number().over(by_lang.orderBy("source")) - 1) / TEAM).cast("int")
    groups = written(sums.select("lang", "source", (F.col("n") + whole).alias("whole"), (F.sum("n").over(by_lang) + whole).alias("lang_whole"), F.greatest(F.lit(1), F.ceil(whole / RANGE)).cast("int").alias("ranges"), seat.alias("seat")), "groups", 1)
    last = groups.agg(F.max("seat").alias("seat")).first().seat

    langs = groups.groupBy("lang").agg(F.max("ranges").alias("ranges"), F.max("lang_whole").alias("whole"), F.max("seat").alias("last"))
    ranged = kept.where("term IS NOT NULL").join(langs.select("lang", "ranges"), "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("ranges")).cast("int").alias("range"), "source", "term", "n", "total")
    vectors = written(ranged.groupBy("lang", "range").applyInArrow(_pack, "lang string, range int, source string, terms long, counts binary, names binary"), "vectors")
    released(kept)

    own = vectors.where("source IS NULL")
    places = groups.select("lang", "source", "whole", "seat", F.explode(F.sequence(F.lit(0), F.col("ranges") - 1)).alias("range"))
    parts = places.join(vectors.where("source IS NOT NULL").select("lang", "range", "source", "counts"), ["lang", "range", "source"], "left")
    parts = parts.join(own.select("lang", "range", "terms"), ["lang", "range"], "left").withColumn("terms", F.coalesce("terms", F.lit(0)))
    buckets = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    residents = _seated(parts, buckets)

    key = ["lang", "range", "seat"]
    visits = own.join(langs, "lang").select("lang", "range", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("seat"), "whole", "counts", "names")
    terms = residents.groupBy(*key).cogroup(visits.groupBy(*key)).applyInArrow(_leading(most_terms), _TERM)
    pairs = [written(residents.groupBy(*key).applyInArrow(_home, _PAIR).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "home")]
    for meet in rounds(last + 1 + (last + 1) % 2) if last else []:
        to = F.create_map(*(F.lit(x) for pair in meet.items() for x in pair))
        hosts = residents.where(F.col("seat").isin(list(meet.values())))
        guests = residents.where(F.col("seat").isin(list(meet))).withColumn("seat", to[F.col("seat")])
        met = hosts.groupBy(*key).cogroup(guests.groupBy(*key)).applyInArrow(_meeting, _PAIR)
        pairs.append(written(met.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "round"))
    between = pairs[0]
    for met in pairs[1:]:
        between = between.unionByName(met)

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(best).alias("rank"))
    leading = written(ranked(terms, "term").where(F.col("rank") <= most_terms), "terms")
    spark.sql(f"DROP TABLE {residents.table_name}")
    released(residents, vectors, groups)
    return ranked(between, "pair").unionByName(leading)
