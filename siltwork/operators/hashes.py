"""Hamming joins of 64-bit hashes at any density, by multi-index hashing.

A hash is cut into bands. Of two hashes that differ in few bits, some band differs in
at most ``flips`` (if all bands differed in more, the hashes would differ in more), so
one side visits, for every band, the values that its own reaches by so many flips, and
the other side waits under its own. Bands take every n-th bit, so hashes that use only
some of the 64 bits fill all of them alike. A pair counts in its first such band only,
so it is verified once and no distinct is needed.

Pairs are looked for among rows of equal ``by`` whose positions ``at`` differ by at most
``width``: rows wait in cells of that width and visit three. Where a cell holds at most
``LIGHT`` rows its visitors meet them as they are, which bounds what a row meets;
bands are used where it holds more.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIGHT = 2048  # rows of a cell that a visitor meets without bands: looking so many over costs less than some 70 probes
HASH_BITS = 64


def bands(bits: int, flips: int) -> list[list[int]]:
    """The bit numbers of each band, as few bands as keep the promise for ``bits`` differing bits."""
    n = bits // (flips + 1) + 1
    return [list(range(b, HASH_BITS, n)) for b in range(n)]


def _long(bits: tuple[int, ...] | list[int]) -> int:
    """The signed 64-bit number with these bits set."""
    n = sum(1 << b for b in bits)
    return n - (1 << 64) if n >> 63 else n


def _keys(value: str, bits: int, flips: int) -> Column:
    """(band, key) of every band, and with ``flips`` of every value that so many flips of it reach."""
    parts = []
    for k, band in enumerate(bands(bits, flips)):
        own = f"({value} & CAST('{_long(band)}' AS BIGINT))"
        reach = [_long(c) for n in range(flips + 1) for c in combinations(band, n)]
        parts.append((k, own, reach))
    sql = ", ".join(f"transform(array({', '.join(f"CAST('{x}' AS BIGINT)" for x in reach)}), f -> named_struct('band', {k}, 'key', {own} ^ f))" for k, own, reach in parts)
    return F.expr(f"flatten(array({sql}))")


def _first_band(a: str, b: str, bits: int, flips: int) -> Column:
    """The first band in which two hashes differ in at most ``flips`` bits; none if there is none."""
    out = F.lit(None).cast("int")
    for k, band in reversed(list(enumerate(bands(bits, flips)))):
        out = F.when(F.expr(f"bit_count(({a} ^ {b}) & CAST('{_long(band)}' AS BIGINT))") <= flips, k).otherwise(out)
    return out


def near_pairs(left: DataFrame, right: DataFrame, by: list[str], at: str, width: float, value: str, bits: int, columns: list[str], flips: int = 1) -> DataFrame:
    """a_*, b_* of the candidate pairs: every left and right row of equal ``by``, at most ``width`` apart, whose hashes differ in at most ``bits`` bits; each pair once.

    Candidates meet the time condition but need not meet the one on hashes: the caller's
    own condition decides. Rows without a hash, a position or a ``by`` are in no pair.
    """
    known = lambda df: df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*by, at, value]))
    cell = F.floor(F.col(at) / width)
    right = known(right).select(*by, cell.alias("cell"), F.col(value).alias("b_key"), *(F.col(c).alias(f"b_{c}") for c in columns))
    left = known(left).select(*by, F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"), F.col(value).alias("a_key"), *(F.col(c).alias(f"a_{c}") for c in columns))
    sizes = right.groupBy(*by, "cell").agg((F.count("*") > LIGHT).alias("dense"))
    bare = F.array(F.struct(F.lit(-1).alias("band"), F.lit(0).cast("long").alias("key")))
    at_home = F.expr(f"array({', '.join(f"named_struct('band', {k}, 'key', b_key & CAST('{_long(band)}' AS BIGINT))" for k, band in enumerate(bands(bits, flips)))})")
    probes = F.when(F.col("dense"), _keys("a_key", bits, flips)).otherwise(bare)
    homes = F.when(F.col("dense"), at_home).otherwise(bare)
    # a visitor of a cell that nobody waits in drops out here
    visits = left.join(sizes, [*by, "cell"]).withColumn("k", F.explode(probes)).select(*by, "cell", "k.band", "k.key", *(c for c in left.columns if c.startswith("a_")))
    waits = right.join(sizes, [*by, "cell"]).withColumn("k", F.explode(homes)).select(*by, "cell", "k.band", "k.key", *(c for c in right.columns if c.startswith("b_")))
    once = (F.col("band") == -1) | (F.col("band") == _first_band("a_key", "b_key", bits, flips))
    near = F.abs(F.col(f"a_{at}") - F.col(f"b_{at}")) <= width
    return visits.join(waits, [*by, "cell", "band", "key"]).where(once & near).drop("cell", "band", "key", "a_key", "b_key")
