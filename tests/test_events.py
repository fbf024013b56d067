"""Event clusters against all pairs."""

from __future__ import annotations

import random

import numpy as np
from siltwork.operators import events as ev

SCHEMA = "photo_id long, session_id string, taken_at double, latitude double, longitude double"


def brute(rows, seconds=2700.0, km=5.0):
    """photo_id: smallest photo_id reached."""
    rows = [r for r in rows if r[1] is not None and r[2] is not None]
    of = np.array([hash(r[1]) for r in rows])
    t = np.array([r[2] for r in rows])
    unknown = np.array([r[3] is None or r[4] is None for r in rows])
    lat, lon = (np.radians([0.0 if u else r[k] for r, u in zip(rows, unknown, strict=True)]) for k in (3, 4))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        h = np.sin((lat - lat[i]) / 2) ** 2 + np.cos(lat[i]) * np.cos(lat) * np.sin((lon - lon[i]) / 2) ** 2
        g = np.where(unknown | unknown[i], 0.0, 6371.0 * 2 * np.arctan2(np.sqrt(h), np.sqrt(1 - h))) / km
        for j in np.flatnonzero((of == of[i]) & (np.sqrt(((t - t[i]) / seconds) ** 2 + g * g) <= 1)):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return {r[0]: least[find(i)] for i, r in enumerate(rows)}


def got(spark, rows):
    out = {r.photo_id: r.event for r in ev.events(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(out) == len(rows)
    return out


def crowd(n, lat, lon, spread, hours, seed, lost=0.0, rng=None):
    rng = rng or random.Random(seed)
    return [(i, "ab"[i % 2], rng.uniform(0, hours * 3600), None if rng.random() < lost else lat + rng.gauss(0, spread), None if rng.random() < lost / 2 else lon + rng.gauss(0, spread)) for i in range(n)]


CASES = [
    crowd(600, 48.0, 11.0, 0.2, 30, 1),
    crowd(900, 12.0, 77.0, 0.05, 5, 2),
    crowd(500, 12.0, 77.0, 0.3, 60, 3, lost=0.05),
    [(i, s, t, lat, (lon + 540) % 360 - 180) for i, s, t, lat, lon in crowd(500, -17.0, 180.0, 0.2, 20, 4)],
    [(i, s, t, min(lat, 90.0), random.Random(i).uniform(-180, 180)) for i, s, t, lat, lon in crowd(400, 89.9, 0.0, 0.05, 10, 5)],
    [(i, "a", 900.0 * (i % 40), 10.0, 20.0 + (i // 40) * 0.04) for i in range(400)],  # steps that meet the limits exactly
    [(1, "a", 0.0, 1.0, 1.0), (2, "a", 2700.0, None, 1.0), (3, "a", 5400.0, 1.0, 1.0), (4, "a", 8100.001, 1.0, 1.0), (5, None, 0.0, 1.0, 1.0), (6, "a", None, 1.0, 1.0)],
]


def test_equal_all_pairs(spark):
    """Scattered and crowded photos, unknown places, the date line, a pole, distances at the limits, missing times and sessions."""
    rows = [(1000 * k + i, None if s is None else f"{s}{k}", t, lat, lon) for k, case in enumerate(CASES) for i, s, t, lat, lon in case]
    assert got(spark, rows) == brute(rows) | {r[0]: r[0] for r in rows if r[1] is None or r[2] is None}


def test_a_dense_evening_has_few_links(spark, monkeypatch):
    """20,000 photos of one evening at places some kilometres apart, taken in turn: links between cells, not photos."""
    rng = random.Random(9)
    places = [(48.1 + 0.035 * (k % 4), 11.5 + 0.05 * (k // 4)) for k in range(12)]
    rows = []
    for i in range(20_000):
        lat, lon = places[i % 12]
        rows.append((i, "s", i * 0.4, lat + rng.gauss(0, 0.0005), lon + rng.gauss(0, 0.0005)))
    counts = []
    links = ev._placed_links
    monkeypatch.setattr(ev, "_placed_links", lambda *a: counts.append((out := links(*a)).count()) or out)
    found = got(spark, rows)
    assert counts[0] < 2000
    sample = rows[::16]  # the same places and times, thinner: chains stay
    assert len(set(found.values())) == len(set(brute(sample).values()))


def test_no_rows(spark):
    assert ev.events(spark.createDataFrame([], SCHEMA)).collect() == []


def test_cells_are_linked_with_unknown_places_once(spark):
    """Where photos of unknown place follow one another, a cell has one link with them, not one for each step in reach."""
    rows = [(i, "s", 300.0 * i, None, None) for i in range(60)]
    rows += [(1000 + 100 * k + i, "s", 300.0 * i + 7.0, 10.0 + k, 20.0) for k in range(8) for i in range(60)]
    points = ev._points(spark.createDataFrame(rows, SCHEMA), 2700.0, 5.0)
    cells = points.groupBy("session_id", ev.F.col("x").isNull(), ev._cell(0)).count().count()
    links = ev._timed_links(points, 2700.0)
    assert links.count() < 1.5 * cells
    assert got(spark, rows) == brute(rows)
