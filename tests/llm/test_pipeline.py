"""The pipeline's stages against brute force on their own input."""

from __future__ import annotations

import re
from collections import Counter
from pathlib import Path

import pytest
from siltwork.sources.scratch import written

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")


def grams(text, words):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_stages(spark, words):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["toxicity", "near copies", "personal data", "source mix", "packing"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in cp.STAGES:
        docs = written(stage(spark, docs, DATA), "stage")
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    start = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    toxic = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").where("toxic = 0").collect()}
    assert toxic <= {r.doc_id for r in seen["toxicity"]}
    sets = [grams(r.text, words) for r in seen["near copies"]]
    assert not any(a and b and 100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    lost = {r.doc_id for r in seen["toxicity"]} - {r.doc_id for r in seen["near copies"]}
    by = {r.doc_id: grams(r.text, words) for r in seen["toxicity"]}
    assert all(any(100 * len(by[d] & s) >= 80 * len(by[d] | s) for e, s in by.items() if e != d) for d in lost)
    assert len(seen["personal data"]) == len(seen["near copies"])
    assert not any(re.search(r"[a-z0-9]@[a-z0-9]+\.[a-z]", r.text) for r in seen["personal data"])
    assert all(r.text == start[r.doc_id] or "<" in r.text for r in seen["personal data"])
    size, mixed = {r.doc_id: len(words(r.text)) for r in seen["personal data"]}, Counter()
    for r in seen["source mix"]:
        mixed[r.doc_id] += len(words(r.text))
    assert all(n <= 3 * size[d] for d, n in mixed.items()) and abs(sum(mixed.values()) - sum(size.values())) < 0.05 * sum(size.values())
    assert Counter(r.doc_id for r in seen["packing"] if r.start == 0) == Counter(r.doc_id for r in seen["source mix"])
    assert cp.run(spark, DATA).count() == len(seen["packing"])


@pytest.mark.parametrize("empty", [False, True])
def test_awkward_rows_go_through(spark, tmp_path, empty):
    """Nulls in any column, empty, long and repeated texts, extra columns with clashing names, and an empty table."""
    import corpus_pipeline as cp

    prose = lambda k: " ".join(f"word{i * k % 97} of{k} the {i % 13}" for i in range(200))
    rows = [(i, prose(i + 1), "en", f"s{i % 2}", 5, 1.0, "x") for i in range(30)]
    rows += [(100, None, None, None, None, None, None), (None, None, "en", "s0", 0, 1.0, "x"), (101, "", "en", None, 0, 1.0, "x"), (102, " \n ", "en", "s1", 3, 1.0, "x"), (103, "mail a@b.cc now", "en", "s1", 15, 1.0, "x")]
    rows += [(104, "x" * 300_000, "en", "s1", 1, 1.0, "x"), (105, prose(200) * 60, "en", "s1", 1, 1.0, "x"), (None, prose(300), "en", "s0", 1, 1.0, "x"), (7, rows[7][1], "en", "s1", 5, 1.0, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, size string"
    docs = spark.createDataFrame([] if empty else rows, schema)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 1), (2, 0, 0), (None, 1, None), (100, None, 1)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        now = written(stage(spark, now, str(tmp_path)), "stage")
        assert now.columns == docs.columns
        if name == "near copies" and not empty:
            kept = Counter(r.doc_id for r in now.collect())
            assert kept[7] == 1 and {100, 101, 102, 103, 104, 105} <= set(kept) and kept[None] == 2
        if name == "personal data" and not empty:
            assert {r.text for r in now.where("doc_id = 103").collect()} == {"mail <email> now"}
            assert now.where("text IS NULL").count() == 2
    out = cp.run(spark, str(tmp_path)).collect()
    assert (not out) if empty else {r.doc_id for r in out} >= {0, 103, 105}
