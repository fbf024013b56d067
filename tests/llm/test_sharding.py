"""The hash tree: its laws of movement, against a descent in Python."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from siltwork.llm.sharding import Tree, assigned, moved, write


def descend(tree, doc_id):
    """(region, rack, shard of the rack) by draws at each level."""
    key, path, below = "" if doc_id is None else str(doc_id), [], tree.weights
    weigh = lambda x: sum(map(weigh, x)) if isinstance(x, tuple) else x
    while isinstance(below, tuple):
        draws = []
        for k, child in enumerate(below):
            name = f"{tree.seed}/{'/'.join(map(str, [*path, k]))}:{key}"
            u = (int(hashlib.md5(name.encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            draws.append((-math.log(u) / weigh(child), k))
        path.append(min(draws)[1])
        below = below[path[-1]]
    return tuple(path)


@pytest.fixture(scope="module")
def many(spark):
    return spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).cache()


def places(many, tree):
    paths = tree.paths()
    return {r.doc_id: paths[r.s] for r in many.select("doc_id", tree.shard("doc_id").alias("s")).collect()}


def test_rows(documents, corpus):
    got = assigned(documents).collect()
    tree = Tree.even()
    grown = tree.grown()
    want = Counter()
    for r in corpus:
        raw = (r[1] or "").encode()
        want[r[0], len(raw) + 1, zlib.crc32(raw), "key", tree.paths().index(descend(tree, r[0])), grown.paths().index(descend(grown, r[0]))] += 1
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == want
    for s in range(16):
        own = sorted((r.slot, -1 if r.doc_id is None else r.doc_id, r["size"]) for r in got if r.shard == s)
        assert [x[0] for x in own] == list(range(len(own)))
        assert [x[1:] for x in own] == sorted(x[1:] for x in own)
    assert all((r.region, r.rack) == tree.paths()[r.shard][:2] for r in got)


def test_reruns_agree_and_no_rows(documents, nothing):
    key = lambda df: sorted(map(str, df.collect()))
    assert key(assigned(documents)) == key(assigned(documents.repartition(3, "n_chars")))
    assert assigned(nothing).collect() == []


def test_one_key_with_most_rows(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text"))
    got = assigned(rows)
    assert got.groupBy("shard").agg((F.max("slot") + 1 - F.count("*")).alias("gap"), (F.countDistinct("slot") - F.count("*")).alias("twice")).where("gap <> 0 OR twice <> 0").count() == 0
    assert got.where("doc_id = 7").select("shard").distinct().count() == 1


def test_shares_follow_weights(many):
    tree = Tree((((1.0, 3.0), (2.0,)), ((4.0,), (1.0, 1.0, 4.0))))
    found = Counter(places(many, tree).values())
    for (i, j, k), n in found.items():
        assert abs(n / 20_000 - tree.weights[i][j][k] / 16) < 0.012


def test_growth_takes_rows_into_the_new_shard_only(many):
    tree = Tree.even()
    before, after = places(many, tree), places(many, tree.grown())
    gone = {d for d in before if before[d] != after[d]}
    assert {after[d] for d in gone} == {(4, 0, 0)} and abs(len(gone) / 20_000 - 1 / 17) < 0.01
    more = places(many, tree.grown().grown())
    assert {more[d] for d in before if more[d] != after[d]} == {(5, 0, 0)}


def test_movement_stays_in_the_subtree_that_changed(many):
    tree = Tree.even(3, 3, 2)
    before = places(many, tree)
    for weight in (3.0, 0.25):
        after = places(many, tree.reweighted(1, 2, 0, weight))
        moves = [(before[d], after[d]) for d in before if before[d] != after[d]]
        for a, b in moves:
            if weight > 1:
                assert b[0] == 1 and (a[0] != 1 or b[1] == 2) and (a[:2] != (1, 2) or b[2] == 0)
            else:
                assert a[0] == 1 and (b[0] != 1 or a[1] == 2) and (b[:2] != (1, 2) or a[2] == 0)
        assert any(a[0] != b[0] for a, b in moves) and any(a[0] == b[0] == 1 for a, b in moves)
        table = moved(many, tree, tree.reweighted(1, 2, 0, weight)).collect()
        assert sum(r.n_rows for r in table) == len(moves) == sum(r.n_bytes for r in table)


def test_written_folders(spark, documents, corpus, tmp_path):
    rows = documents.withColumn("Shard", F.lit("other"))
    write(rows, f"file://{tmp_path}/out")
    got = spark.read.parquet(f"file://{tmp_path}/out")
    assert set(got.columns) == {*documents.columns, "shard"} and got.count() == len(corpus)
    assert got.where(F.col("shard") != Tree.even().shard("doc_id")).count() == 0


def test_bad_trees():
    for weights in ((), (((),),), (((0.0,),),), ((),)):
        with pytest.raises(ValueError):
            Tree(weights)
