"""Streams give what their batch twins give, once flushed; tests/test_queries.py holds each against its SQL."""

from __future__ import annotations

import json
import random
import re
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from siltwork.operators.state import latest
from siltwork.plans import catalog
from siltwork.streaming import live, sessions

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")


@pytest.fixture
def events(spark):
    return spark.read.parquet(f"{DATA}/events.parquet")


@needs_data
def test_rate_limit(spark):
    q = catalog.queries()
    assert sorted(map(tuple, q["q_stream_rate_limit"](spark, DATA).collect())) == sorted(map(tuple, q["q_rate_limit"](spark, DATA).collect()))


@needs_data
def test_replayed_batches_change_nothing(spark, events, tmp_path):
    e = events.select("user_id", "event_id", "event_type")
    write = live.upsert_into(f"file://{tmp_path}/t", "user_id", ["event_id"])
    for number, batch in ((0, e.where("event_id < 500")), (1, e.where("event_id >= 500")), (1, e.where("event_id >= 500"))):
        write(batch, number)
    got = live.current(spark, f"file://{tmp_path}/t", "user_id", ["event_id"]).select("user_id", "event_id").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, latest(e, "user_id", ["event_id"]).select("user_id", "event_id").collect()))


@needs_data
def test_rings_after_every_batch(spark, events, tmp_path):
    """The rings of steps and log equal SQL over all rows so far after each batch, also when a batch runs twice or is empty."""
    rows = events.selectExpr("event_type AS step", "event_id", "CAST(event_id * 31 % 4 AS INT) AS arrives", "CAST(round(value * 100) AS BIGINT) AS cents")
    write = live.rolling_log(f"file://{tmp_path}/out")
    schema = rows.select("step", "cents", "arrives", "event_id").schema
    for number in (0, 1, 1, 2, 3, 4):
        write(rows.where(rows["arrives"] == number), number)
        steps, log = (sorted(map(tuple, t.collect())) for t in live.last_rings(spark, f"file://{tmp_path}/out", schema))
        s = f"(SELECT event_type AS step, CAST(round(value * 100) AS BIGINT) AS cents, CAST(event_id * 31 % 4 AS INTEGER) AS arrives, event_id FROM '{DATA}/events.parquet' WHERE event_id * 31 % 4 <= {number})"
        assert steps == sorted(duckdb.sql(f"SELECT * FROM {s} QUALIFY row_number() OVER (PARTITION BY step ORDER BY arrives DESC, event_id DESC) <= 100").fetchall())
        assert log == sorted(duckdb.sql(f"SELECT * FROM {s} ORDER BY arrives DESC, event_id DESC LIMIT 50").fetchall())


# --- ordered machines, against replay in order -----------------------------------


class Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


class Map(dict):
    def containsKey(self, k):
        return k in self

    def getValue(self, k):
        return self[k]

    def updateValue(self, k, v):
        self[k] = v


class Handle:
    """State variables and timers of one key."""

    def __init__(self):
        self.timers = set()

    def getValueState(self, name, schema):
        return Value()

    def getMapState(self, name, key, value):
        return Map()

    def registerTimer(self, at):
        self.timers.add(at)


class Clock:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


def run(machine, batches, late):
    """What a key's machine says over batches of (at, id, row): Spark drops rows behind the watermark and fires timers that it has passed."""
    handle, out, newest, mark = Handle(), [], 0, 0
    machine.init(handle)
    for batch in batches:
        batch = [x for x in batch if x[0] > mark * 1000]
        if batch:
            frame = pd.DataFrame([(a, i, json.dumps(r)) for a, i, r in batch], columns=["at", "id", "row"])
            out += [x for f in machine.handleInputRows(("k",), iter([frame]), Clock(mark)) for x in f.itertuples(index=False, name=None)]
            newest = max(newest, *(x[0] for x in batch))
        mark = max(mark, newest // 1000 - late)
        while due := sorted(t for t in handle.timers if t <= mark):
            handle.timers.discard(due[0])
            out += [x for f in machine.handleExpiredTimer(("k",), Clock(mark), None) for x in f.itertuples(index=False, name=None)]
    return out


CLOCK = (10**15, -1, {})
MACHINES = {
    "chapters": (sessions.Chapters, lambda rng: {"latitude": rng.choice([None, 10.0, 10.01, 10.2]), "longitude": rng.choice([20.0, 20.02]), "expected": 80}),
    "ledger": (lambda: sessions.Ledger(40, 900), lambda rng: {"kind": rng.choice(["presign", "confirm"]), "photo": rng.randrange(6), "bytes": rng.randrange(4) * 50}),
    "cache": (lambda: sessions.Cache(3, 4000.0), lambda rng: {"item": rng.randrange(6), "put": rng.random() < 0.4}),
    "jobs": (sessions.Jobs, lambda rng: {"code": rng.choice([200, 404, 429, 500, 503])}),
    "limit": (lambda: sessions.Limit(3, 3000.0), lambda rng: {"event_id": 0}),
}


@pytest.mark.parametrize("name", MACHINES)
def test_arrival_does_not_matter(name):
    """Out of order, in batches, in part twice: the same as in order at once."""
    make, row = MACHINES[name]
    rng = random.Random(name)
    at, rows = 0, []
    for i in range(200):
        at += rng.choice([0, 10**5, 10**6, 3 * 10**6, 400 * 10**6, 2700 * 10**6, 2700 * 10**6 + 1])
        rows.append((at, i, row(rng)))
    want = run(make(), [rows, [CLOCK], []], 0)
    late = 6 * 3600 * 1000
    for _ in range(3):
        arrives = sorted((a + rng.uniform(0, 0.9 * late * 1000), a, i, k) for k, (a, i, _) in enumerate(rows) for _ in range(1 + (rng.random() < 0.2)))
        shuffled = [rows[k] for *_, k in arrives]
        cuts = [0, *sorted(rng.sample(range(len(shuffled)), 12)), len(shuffled)]
        got = run(make(), [*(shuffled[x:y] for x, y in zip(cuts, cuts[1:], strict=False)), [CLOCK], []], late)
        assert sorted(map(str, got)) == sorted(map(str, want))
    assert len(want) > 20


def test_job_wakes_after_its_delays_and_fails_in_the_end():
    s = 10**6
    rows = [(10 * s, 1, {"code": 503}), (20 * s, 2, {"code": 429}), (30 * s, 3, {"code": 500}), (40 * s, 4, {"code": 500}), (50 * s, 5, {"code": 200}), (60 * s, 6, {"code": 404}), (70 * s, 7, {"code": 503}), (70 * s + s // 2, 8, {"code": 200})]
    got = [(x[1:4], x[4] / s) for x in run(sessions.Jobs(), [rows, [CLOCK], []], 0)]
    assert got == [((1, "waiting", 2), 10), ((1, "processing", 2), 11), ((1, "waiting", 3), 20), ((1, "processing", 3), 22), ((1, "waiting", 4), 30), ((1, "processing", 4), 34), ((1, "failed", 4), 40), ((2, "completed", 1), 50), ((3, "failed", 1), 60), ((4, "waiting", 2), 70), ((4, "completed", 2), 70.5)]


def test_ledger_counts_differences_and_promises():
    ask, have = (lambda p, n: {"kind": "presign", "photo": p, "bytes": n}), (lambda p, n: {"kind": "confirm", "photo": p, "bytes": n})
    steps = [(ask(1, 60), 200, 0, 60), (ask(2, 50), 413, 0, 60), (ask(1, 0), 200, 0, 60), (have(1, 40), 200, 40, 0), (have(1, 40), 200, 40, 0), (have(1, 45), 200, 45, 0), (ask(1, 20), 200, 45, 0), (ask(2, 50), 200, 45, 50), (ask(3, 1), 429, 45, 50), (have(3, 7), 200, 52, 50)]
    got = run(sessions.Ledger(5, 100), [[(i + 1, i, r) for i, (r, *_) in enumerate(steps)], [CLOCK], []], 0)
    assert [x[2:5] for x in got] == [tuple(s[1:]) for s in steps]


def test_cache_drops_the_expired_then_the_unused():
    put, get = (lambda k: {"item": k, "put": True}), (lambda k: {"item": k, "put": False})
    steps = [(0, put(1)), (1, put(2)), (2, get(1)), (3, put(3)), (4, get(2)), (5, get(1)), (11, get(1)), (12, get(3)), (13, get(3))]
    got = run(sessions.Cache(2, 10.0), [[(1 + t * 10**6, i, r) for i, (t, r) in enumerate(steps)], [CLOCK], []], 0)
    assert [x[2] for x in got] == [False, False, True, False, False, True, False, True, False]


def test_chunks_pass_once():
    machine, handle = sessions.Chunks(), Handle()
    machine.init(handle)
    row = lambda chunk, photo: (chunk, 2, 2, photo, f"r{photo}")
    batches = [[row(0, 1), row(1, 3), row(0, 1)], [row(0, 1), row(1, 4)], [row(1, 3), row(1, 4)], [row(0, 2), row(0, 1)], [row(0, 1), row(0, 2)]]
    out = []
    for b in batches:
        frame = pd.DataFrame(b, columns=["chunk", "chunk_size", "chunk_count", "photo_id", "row"])
        out += [x for f in machine.handleInputRows(("s",), iter([frame]), None) for x in f.itertuples(index=False, name=None)]
    assert out == [("s", 1, ["r3", "r4"], False), ("s", 0, ["r1", "r2"], True)]


def test_chunks_are_one_value_of_their_session():
    """One value in and one out for every call, however many chunks it brings; a session is ready once, with its last chunk."""

    class Counted(Value):
        gets = updates = 0

        def get(self):
            self.gets += 1
            return super().get()

        def update(self, value):
            self.updates += 1
            super().update(value)

    made = []

    class Watched(Handle):
        def getValueState(self, name, schema):
            made.append(Counted())
            return made[-1]

        def getMapState(self, name, key, value):
            raise AssertionError("calls to the JVM for every chunk")

    machine, out, of = sessions.Chunks(), [], 50
    machine.init(Watched())
    photos = [(chunk, 4, of, 4 * chunk + i, f"r{4 * chunk + i}") for chunk in range(of) for i in range(4)]
    for k in (2, 0, 3, 0, 1, 1, 2):
        frame = pd.DataFrame([x for x in photos if x[3] % 4 == k], columns=["chunk", "chunk_size", "chunk_count", "photo_id", "row"])
        out += [x for f in machine.handleInputRows(("s",), iter([frame[:70], frame[70:]]), None) for x in f.itertuples(index=False, name=None)]
    assert [(c, r, ready) for _, c, r, ready in out] == [(c, [f"r{4 * c + i}" for i in (2, 0, 3, 1)], c == of - 1) for c in range(of)]
    assert [(v.gets, v.updates) for v in made] == [(7, 7)]
    assert made[0].held[:3] == ([], [], []) and sorted(made[0].held[3]) == list(range(of))


@needs_data
def test_arrivals_of_many_files_lose_no_row(spark):
    """Each arrival written as several files, each over all of its times: every event has its answer, in its place."""
    from siltwork.plans import streams
    from siltwork.plans.registry import ORACLES

    rows = spark.read.parquet(f"{DATA}/events.parquet").selectExpr("concat(event_type, '-', user_id % 20) AS key", "event_id", "ts").repartition(5, "event_id")
    got = streams._machine(spark, rows, "key", sessions.Limit(3, 7200.0))
    sql = duckdb.connect()
    sql.execute(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    cursor = sql.execute(ORACLES["q_stream_rate_limit"])
    names = [c[0] for c in cursor.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(cursor.fetchall())


def test_state_is_left_alone_until_a_row_is_due():
    """Rows that only wait cost the machine no access to its state; the photos of a ledger come and go at once."""
    made = []

    class Counted(Value):
        n = 0

        def get(self):
            self.n += 1
            return super().get()

    class Watched(Handle):
        def getValueState(self, name, schema):
            made.append((name, Counted()))
            return made[-1][1]

        def getMapState(self, name, key, value):
            raise AssertionError("a call to the JVM for every photo")

    machine = sessions.Ledger(40, 900)
    machine.init(Watched())
    sums = dict(made)["sums"]
    rows = lambda ids: iter([pd.DataFrame([(i * 10**6, i, json.dumps({"kind": "confirm", "photo": i, "bytes": 1})) for i in ids], columns=["at", "id", "row"])])
    assert not list(machine.handleInputRows(("k",), rows(range(1, 6)), Clock(0))) and sums.n == 0
    (frame,) = machine.handleInputRows(("k",), rows(range(6, 9)), Clock(5000))
    assert frame["total"].tolist() == [1, 2, 3, 4, 5] and sums.n == 1


def test_a_key_comes_and_goes_with_all_of_its_state():
    """One value in and one out for every key at hand, whatever the machine keeps; its timer lies ahead of the watermark; keys do not mix."""
    from siltwork.streaming import ordered

    class State:
        def __init__(self):
            self.value, self.mark, self.hasTimedOut, self.wake, self.updates = None, 0, False, None, 0

        exists = property(lambda self: self.value is not None)
        get = property(lambda self: self.value)

        def getCurrentWatermarkMs(self):
            return self.mark

        def update(self, value):
            self.value, self.updates = value, self.updates + 1

        def setTimeoutTimestamp(self, at):
            assert at > self.mark
            self.wake = at

    run, states, out = ordered._advanced(sessions.Jobs()), {k: State() for k in "ab"}, []
    frame = lambda *rows: iter([pd.DataFrame([(a, i, json.dumps({"code": c})) for a, i, c in rows], columns=["at", "id", "row"])])
    s = 10**6
    for k, rows in (("a", [(10 * s, 1, 503), (11 * s + 1000, 2, 200)]), ("b", [(10 * s, 1, 404)])):
        assert not list(run((k,), frame(*rows), states[k])) and states[k].updates == 1 and states[k].wake == 9_999
    for mark in (10_000, 11_000, 20_000):
        for k, state in states.items():
            state.mark, state.hasTimedOut = mark, True
            out += [tuple(x) for f in run((k,), iter([]), state) for x in f.itertuples(index=False, name=None)]
    assert out == [("a", 1, "waiting", 2, 10 * s), ("b", 1, "failed", 1, 10 * s), ("a", 1, "processing", 2, 11 * s), ("a", 1, "completed", 2, 11 * s + 1000)]


def test_status_of_a_chunk_works_its_photos_out_once(spark):
    """No filter goes through a chunk's photos before its status does; chunks without photos give no row; of a burst the best stays, the first of equals."""
    from siltwork.operators import folds

    photo = lambda i, shell, blur, status="PASSED", face=0.0: (i, i, 10.0, shell, 0, 1, face, 50.0, blur, 1.0, status)
    far = 0x0F0F0F0F
    rows = [("s", 0, [photo(1, 0, 20.0), photo(2, 1, 30.0), photo(3, 0, 30.0), photo(4, far, 5.0), photo(5, 0, 40.0, "REJECTED_JUNK"), photo(6, far << 4, 18.0, "REJECTED_BLURRY")])]
    rows += [("s", 1, []), ("s", 2, [photo(7, 0, 20.0, face=0.75), photo(8, 1, 30.0)]), ("s", 3, [photo(9, 0, 1.0)])]
    kinds = "seq: long, photo_id: long, moment: double, shell: long, core: long, faces: long, face_quality: double, hero: double, blur: double, contrast: double, status: string"
    got = folds.chunk_status(spark.createDataFrame(rows, f"session_id string, chunk long, ps array<struct<{kinds}>>"), ["session_id", "chunk"])
    burst = {1, 3}
    want = [(("s", c, p[1]), "REJECTED_BURST" if p[1] in burst else "PASSED" if p[1] == 6 else p[-1]) for _, c, ps in rows for p in ps]
    assert sorted((tuple(r[:3]), r[3]) for r in got.collect()) == sorted(want)
    assert not re.search(r"Filter \(+size\(", got._jdf.queryExecution().optimizedPlan().toString())
