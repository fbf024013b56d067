"""Hamming joins against all pairs, sparse and crowded."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from siltwork.operators import hashes, joins, quality


def test_bands_cover_every_difference():
    rng = random.Random(1)
    for bits, flips in ((5, 1), (7, 1), (10, 2), (3, 0)):
        parts = hashes.bands(bits, flips)
        assert sorted(b for p in parts for b in p) == list(range(64))
        for _ in range(300):
            differ = set(rng.sample(range(64), bits))
            assert min(len(differ & set(p)) for p in parts) <= flips


def rows_of(spark, n, seconds, seed, span=64):
    rng = random.Random(seed)
    rows, kin = [], rng.getrandbits(span)
    for i in range(n):
        if i % 4 == 0:
            kin = rng.getrandbits(span)
        shell = kin
        for _ in range(rng.randrange(9)):
            shell ^= 1 << rng.randrange(span)
        signed = lambda v: v - (1 << 64) if v >> 63 else v
        core = kin ^ rng.choice([0, 3, 1 << (span - 1), 127])
        rows.append((i, "ab"[i % 3 == 0], rng.uniform(0, seconds), None if i % 101 == 0 else signed(shell), None if i % 103 == 0 else signed(core), i % 4))
    return rows, spark.createDataFrame(rows, "photo_id long, session_id string, moment double, shell long, core long, faces long").withColumn("seq", F.col("photo_id"))


def far(a, b):
    return 99 if a is None or b is None else bin((a ^ b) & (1 << 64) - 1).count("1")


def duplicates(rows):
    out = set()
    for i, x in enumerate(rows):
        for y in rows[i + 1 :]:
            dt, sh, co = abs(x[2] - y[2]), far(x[3], y[3]), far(x[4], y[4])
            if x[1] == y[1] and dt <= 180 and sh <= 7 and co <= 5 and (dt <= 5 or (x[5] >= 2 and y[5] >= 2)) and not (sh <= 8 and co >= 5 and dt <= 45):
                out.add((x[0], y[0]))
    return out


@pytest.mark.parametrize(("seconds", "span"), [(60, 64), (60, 31), (20_000, 64), (900, 12)])
def test_duplicate_pairs_equal_all_pairs(spark, monkeypatch, seconds, span):
    monkeypatch.setattr(hashes, "LIGHT", 40)
    rows, df = rows_of(spark, 700, seconds, 3, span)
    got = [(r.a, r.b) for r in joins.duplicate_pairs(df, ["session_id"], "moment").select(F.col("a_photo_id").alias("a"), F.col("b_photo_id").alias("b")).collect()]
    assert len(got) == len(set(got)) and set(got) == duplicates(rows)
    assert got


def test_solo_anchors_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(hashes, "LIGHT", 40)
    rows, df = rows_of(spark, 900, 60, 4)
    df = df.withColumn("status", F.when(F.col("photo_id") % 5 == 0, "REJECTED_BLURRY").otherwise("PASSED")).withColumn("blur", F.lit(20.0))
    want = {x[0] for x in rows if x[0] % 5 == 0 and not any(y[0] != x[0] and y[1] == x[1] and abs(x[2] - y[2]) <= 30 and far(x[3], y[3]) <= 10 for y in rows)}
    got = [r.photo_id for r in quality.solo_anchors(df).collect()]
    assert sorted(got) == sorted(want) and got


def test_candidates_follow_the_pairs_of_a_crowded_minute(spark):
    """20,000 photos of one minute: 200 million pairs, of which candidates are a few for each photo."""
    n = 20_000
    h = lambda salt: F.xxhash64(F.expr("id div 4"), F.lit(salt))
    df = spark.range(n).select(F.col("id").alias("photo_id"), F.lit("s").alias("session_id"), (F.col("id") % 60).cast("double").alias("moment"), h(1).bitwiseXOR(F.col("id") % 4).alias("shell"), h(2).bitwiseXOR((F.col("id") % 4) * 2).alias("core"), F.lit(2).alias("faces")).withColumn("seq", F.col("photo_id"))
    found = hashes.near_pairs(df, df, ["session_id"], "moment", 180, "core", 5, ["photo_id", "moment", "core"]).where("a_photo_id < b_photo_id")
    true = found.where(quality.hamming("a_core", "b_core") <= 5).count()
    assert true == n // 4 * 6 and found.count() < 5 * true
    wide = hashes.near_pairs(df, df, ["session_id"], "moment", 30, "shell", 10, ["photo_id", "moment", "shell"], flips=2)
    assert wide.count() < n * n / 40
