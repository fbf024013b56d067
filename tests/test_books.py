"""Books as documents, and the gate over them."""

from __future__ import annotations

from pathlib import Path

import pytest

from siltwork.operators import books
from siltwork.plans import catalog
from siltwork.sources.scratch import setting

SLOT = "session_id string, variation int, chapter long, spread_idx long, caption string, side string, pos int, photo_id long, x double, y double, w double, h double, dpi double, badge string"
ROWS = [
    ("s", 1, 1, 0, "A \"quoted\" é", "left", 1, 7, 0.1, 0.05, 1 / 3, 0.2, 301.5, "excellent"),
    ("s", 1, 1, 0, "A \"quoted\" é", "left", 0, 9, 0.025, 0.05, 0.3, 0.2, 120.0, "alert"),
    ("s", 1, 1, 1, None, "right", 0, 7, 0.5, 0.5, 0.25, 0.2, 200.0, "warning"),
    ("s", 1, 1, 1, None, "left", 0, None, 0.5, 0.5, 0.25, 0.2, 200.0, "warning"),
    ("s", 1, 2, 10, "B", "left", 0, 4, 0.5, 0.5, 0.25, 0.2, 200.0, "warning"),
    ("s", 2, 1, 0, "C", "right", 0, 4, 0.5, 0.5, 0.25, 0.2, 200.0, "warning"),
    ("t", 1, 1, 0, "D", "right", 0, None, 0.5, 0.5, 0.25, 0.2, None, "warning"),
]


def test_round_trip(spark):
    rows = spark.createDataFrame(ROWS, SLOT)
    docs = books.documents(rows)
    assert docs.count() == 3 and docs.dtypes[2] == ("book", "string")
    names = ["session_id", "variation", "chapter", "spread_idx", "side", "pos", "photo_id", "x", "y", "w", "h", "dpi", "badge"]
    key = lambda df: sorted(map(str, df.select(*names).collect()))
    assert key(books.slots(docs)) == key(rows)
    assert [(r.at, r.spread_idx, r.caption) for r in books.spreads(docs.where("session_id = 's' AND variation = 1")).collect()] == [(0, 0, 'A "quoted" é'), (1, 1, None), (2, 10, "B")]


def test_placed_ids_by_first_appearance(spark):
    got = {(r.session_id, r.variation, r.pos): r.photo_id for r in books.placed_ids(books.documents(spark.createDataFrame(ROWS, SLOT))).collect()}
    assert got == {("s", 1, 0): 9, ("s", 1, 1): 7, ("s", 1, 2): 4, ("s", 2, 0): 4}


def test_gate(spark):
    docs = books.documents(spark.createDataFrame(ROWS, SLOT))
    photos = spark.createDataFrame([(4, True), (7, None), (1, False)], "photo_id long, synced boolean")
    found = lambda **k: sorted((r.session_id, r.variation, r.total, r.pending, r.code) for r in books.export_gate(docs, photos, **k).collect())
    assert found() == [("s", 1, 3, 2, 409), ("s", 2, 1, 0, 200), ("t", 1, 0, 0, 200)]
    assert [x[4] for x in found(preview=True)] == [200, 200, 200]


def test_texts_that_are_no_books(spark):
    docs = spark.createDataFrame([("s", 1, None), ("s", 2, "not json"), ("s", 3, "{}"), ("s", 4, '{"spreads": []}')], "session_id string, variation int, book string")
    assert books.slots(docs).count() == 0 and books.placed_ids(docs).count() == 0
    assert [r.code for r in books.export_gate(docs, spark.createDataFrame([], "photo_id long, synced boolean")).collect()] == [200] * 4


def test_books_travel_once(spark):
    """From photos to books a session's rows stay together: one exchange by session, then the gate's join by photo."""
    data = "/root/testdata/sf0.001"
    if not Path(data).exists():
        pytest.skip("needs the test tables")
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"), setting(spark, "spark.sql.adaptive.enabled", "false"):
        plan = lambda q: catalog.queries()[q](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert [plan(q).count("Exchange hashpartitioning") for q in ("q_book_placed", "q_variations", "q_book_gate")] == [1, 1, 4]
