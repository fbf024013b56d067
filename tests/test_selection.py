"""Order statistics and running values against sorting and loops."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from siltwork.operators import scans, selection


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(6)
    rows = [("hot", rng.choice([rng.lognormvariate(0, 6), -rng.random(), 5.0, 1e300, -1e-300])) for _ in range(4000)]
    rows += [("ends", x) for x in (math.inf, -math.inf, 1.0, 2.0, 2.0)] + [("same", 3.0)] * 50 + [("one", -2.5), ("none", None), ("none", math.nan), (None, 1.0), (None, 4.0)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "g string, v double").repartition(5)


@pytest.mark.parametrize(("buckets", "few"), [(4, 3), (64, 100), (4096, 65_536)])
def test_ranks_equal_a_sort(skewed, monkeypatch, buckets, few):
    monkeypatch.setattr(selection, "BUCKETS", buckets)
    monkeypatch.setattr(selection, "FEW", few)
    rows, df = skewed
    held = defaultdict(list)
    for g, v in rows:
        if v is not None and not math.isnan(v):
            held[g].append(v)
    got = {r.g: (r.low, r.p95, r.top) for r in selection.nearest_ranks(df, "g", "v", low=0.0, p95=95.0, top=100.0).collect()}
    assert got == {g: tuple(sorted(v)[round(p / 100 * (len(v) - 1))] for p in (0, 95, 100)) for g, v in held.items()}


def test_medians(skewed):
    rows, df = skewed
    got = {r.g: r.median for r in selection.medians(df.where("g <> 'ends'"), "g", "v").collect()}
    for g in ("hot", "same", "one"):
        own = sorted(v for k, v in rows if k == g)
        assert got[g] == own[(len(own) - 1) // 2] + (own[len(own) // 2] - own[(len(own) - 1) // 2]) * 0.5


def test_one_key_is_narrowed_before_it_is_sorted(spark, monkeypatch):
    """One group of 300,000 rows: what is sorted in the end is a few of them."""
    monkeypatch.setattr(selection, "FEW", 2000)
    df = spark.range(300_000).select(F.lit("k").alias("g"), F.sqrt(F.xxhash64("id").bitwiseAND((1 << 40) - 1).cast("double")).alias("v"))
    seen = []
    written = selection.written
    monkeypatch.setattr(selection, "written", lambda t, n: seen.append(out := written(t, n)) or out)
    got = selection.nearest_ranks(df, "g", "v", p50=50.0).first().p50
    assert len(seen) <= 3 and seen[-1].agg(F.max("n")).first()[0] <= 2000
    assert got == sorted(r.v for r in df.select("v").collect())[round(0.5 * 299_999)]


@pytest.mark.parametrize("ranges", [1, 2, 7, 40])
def test_scans_equal_a_loop(spark, ranges):
    rng = random.Random(ranges)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([None, 1, 2, 5]), rng.choice([True, True, True, False, None])) for i in range(400)] + [("lone", 1000, 3, False)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "k string, i long, v long, f boolean")
    got = {r.i: (r.total, r.most, r.n) for r in scans.running(df, "k", ["i"], ranges, total=("sum", F.col("v")), most=("max", F.col("v")), n=("count", F.lit(1))).collect()}
    streaks = {r.i: r.streak for r in scans.islands(df, "k", ["i"], F.col("f"), ranges).collect()}
    state = defaultdict(lambda: [None, None, 0, 0])
    for k, i, v, f in rows:
        s = state[k]
        if v is not None:
            s[0], s[1] = (s[0] or 0) + v, max(s[1] or 0, v)
        s[2], s[3] = s[2] + 1, s[3] + 1 if f else 0
        assert got[i] == tuple(s[:3]) and streaks[i] == s[3]
    assert len(got) == len(rows)


def test_one_key_is_many_tasks(spark):
    df = spark.range(20_000).select(F.lit("k").alias("k"), "id", (F.col("id") % 3).alias("v"))
    out = scans.running(df, "k", ["id"], 8, total=("sum", F.col("v")))
    assert out.agg(F.max("total")).first()[0] == sum(i % 3 for i in range(20_000))
    assert all(x["total"] == sum(i % 3 for i in range(x["id"] + 1)) for x in out.where("id % 3999 = 0").collect())
    parts = scans._ranges(df, "k", ["id"], 8, lambda w: {"n": F.row_number().over(w)}).groupBy("__part").count().collect()
    assert len(parts) == 8 and max(r["count"] for r in parts) < 5000
