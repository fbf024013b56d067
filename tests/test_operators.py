"""Operators against folds over plain lists, boundary cases and invariants."""

from __future__ import annotations

import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltwork.functions import scalar as fn
from siltwork.operators import aggregates, folds, graph, layouts, quality, selection, state, stories
from siltwork.operators import joins as jn


def test_chapters_equal_a_fold(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for s in range(6):
        n, t, seen = rng.choice([3, 40, 60, 210]), 0.0, []
        for i in range(n):
            t += rng.choice([10, 600, 2700, 2701, 5000])
            seen.append((0.0 if rng.random() < 0.1 else t, i))
        rows += [(f"s{s}", i, e, None, None) for e, i in seen]
        cap = 24 if n > 200 else 16 if n > 50 else 12
        chapter, size, before = 1, 0, None
        for e, i in sorted(seen):
            late = before is not None and before > 0 and e > 0 and abs(e - before) > 2700
            if before is not None and (late or size >= cap):
                chapter, size = chapter + 1, 0
            want[f"s{s}", i], size, before = chapter, size + 1, e
    df = spark.createDataFrame(rows, "session_id string, photo_id long, epoch double, latitude double, longitude double")
    got = {(r.session_id, r.photo_id): r.chapter for r in stories.macro_chapters(df).collect()}
    assert got == want


def test_gap_at_the_threshold_does_not_split(spark):
    df = spark.createDataFrame([("s", 1, 100.0, None, None), ("s", 2, 2800.0, None, None), ("s", 3, 5501.0, None, None)], "session_id string, photo_id long, epoch double, latitude double, longitude double")
    assert {r.photo_id: r.chapter for r in stories.macro_chapters(df).collect()} == {1: 1, 2: 1, 3: 2}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(400 + i, 401 + i) for i in range(60)]
    up = list(range(500))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: find(n) for n in nodes}


def test_components_of_nothing(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


PHOTO = "session_id string, chunk long, seq long, photo_id long, moment double, shell long, core long, faces int, face_quality double, hero double, blur double, contrast double, aspect double, hist array<double>"


def photo(i, **k):
    own = {"session_id": "s", "chunk": 0, "seq": i, "photo_id": i, "moment": float(i), "shell": 0, "core": 0, "faces": 0, "face_quality": 0.0, "hero": 50.0, "blur": 10.0, "contrast": 5.0, "aspect": 0.7, "hist": None} | k
    return tuple(own[x.split()[0]] for x in PHOTO.split(", "))


@pytest.fixture
def bursts(spark):
    def run(*photos):
        rows = folds.burst_groups(spark.createDataFrame(list(photos), PHOTO), ["session_id", "chunk"]).collect()
        return sorted((r.photo_id, r.leader, r.survives) for r in rows)

    return run


def test_burst_keeps_the_best_or_all_with_a_good_face(bursts):
    assert bursts(photo(0), photo(1, hero=60.0), photo(2, shell=255)) == [(0, 0, False), (1, 0, True), (2, 2, True)]
    assert all(r[2] for r in bursts(photo(0), photo(1, faces=1, face_quality=0.75)))


def test_moving_subject_is_no_duplicate(bursts):
    assert all(r[2] for r in bursts(photo(0), photo(1, core=31)))


def test_group_portrait_within_three_minutes(bursts):
    assert [r[1] for r in bursts(photo(0, faces=2), photo(1, faces=2, moment=180.0))] == [0, 0]
    assert [r[1] for r in bursts(photo(0, faces=2), photo(1, faces=2, moment=181.0))] == [0, 1]


@pytest.fixture
def groups(spark):
    def run(*photos):
        rows = folds.layout_groups(spark.createDataFrame(list(photos), PHOTO), ["session_id", "chunk"]).collect()
        return sorted((r.group_id, r.pos, r.photo_id, r.kind) for r in rows)

    return run


def test_triptychs_do_not_overlap(groups):
    got = groups(*(photo(i, core=(0xF << (4 * i)), moment=float(i), shell=0xFFFF * (i == 6)) for i in range(7)))
    assert [r[2] for r in got] == [0, 1, 2, 3, 4, 5] and {r[3] for r in got} == {folds.TRIPTYCH}


def test_theme_groups_use_a_photo_once(groups):
    got = groups(*(photo(i, faces=1) for i in range(9)))
    ids = [r[2] for r in got]
    assert len(ids) == len(set(ids)) and {r[3] for r in got} == {"THEME_QUAD_GROUP"}
    assert {r[3] for r in groups(*(photo(i) for i in range(4)))} == {"COMPANION_PAIR"}


def test_a_triptychs_photos_are_in_no_theme(groups):
    moving = [photo(i, core=(0xF << (4 * i)), faces=1) for i in range(3)]
    got = groups(*moving, photo(3, core=0xF << 8, faces=1), photo(4, core=0xF << 8, faces=1))
    assert {(r[3], r[2]) for r in got} == {(folds.TRIPTYCH, 0), (folds.TRIPTYCH, 1), (folds.TRIPTYCH, 2), ("COMPANION_PAIR", 3), ("COMPANION_PAIR", 4)}


def test_theme_chains_by_time_and_colours(groups):
    apart = [0, 0x1FFF]  # 13 bits from each other
    colours = {"hist": [1.0, 2.0, 3.0]}
    assert not groups(photo(0, faces=1, shell=apart[0]), photo(1, faces=1, shell=apart[1]))
    assert len(groups(photo(0, faces=1, shell=apart[0], **colours), photo(1, faces=1, shell=apart[1], **colours))) == 2
    assert not groups(photo(0, faces=1), photo(1, faces=1, moment=301.0))


@pytest.mark.parametrize("size", [2, 3, 4])
def test_spread_chunks_partition_a_chapter(spark, size):
    rng = random.Random(size)
    rows = [(f"c{c}", i, 100 * c + i, rng.getrandbits(20) & rng.getrandbits(20), rng.getrandbits(20) & rng.getrandbits(20), rng.uniform(0.4, 2.5)) for c in range(40) for i in range(rng.randint(1, 24))]
    df = spark.createDataFrame(rows, "chapter string, seq long, photo_id long, shell long, core long, aspect double")
    out = folds.spread_chunks(df, ["chapter"], size).collect()
    assert {r.size for r in out} == {size}
    assert sorted(r.photo_id for r in out) == sorted(r[2] for r in rows)
    members = {}
    for r in sorted(out, key=lambda r: r.pos):
        members.setdefault((r.chapter, r.spread), []).append(r.photo_id)
    assert max(map(len, members.values())) <= size
    assert all(p[0] == min(p) and max(p) - p[0] <= 8 for p in members.values())


def test_nms_keeps_no_heavy_overlap(spark):
    rng = random.Random(1)
    rows = [(1, i, x := rng.random() * 50, y := rng.random() * 50, x + 20, y + 20, rng.random()) for i in range(40)]
    df = spark.createDataFrame(rows, "img long, seq int, x0 double, y0 double, x1 double, y1 double, conf double")
    kept = {r.box for r in folds.without_overlaps(df, ["img"]).collect()}

    def over(a, b):
        i = max(0, min(a[4], b[4]) - max(a[2], b[2])) * max(0, min(a[5], b[5]) - max(a[3], b[3]))
        return i / (800 - i) > 0.35

    for a, b in combinations([r for r in rows if r[1] in kept], 2):
        assert not over(a, b)
    for a in rows:  # what is gone overlaps a better kept one
        assert a[1] in kept or any(over(a, b) and b[6] >= a[6] for b in rows if b[1] in kept)


def test_refused_hits_do_not_count():
    start, admit = folds.rate_limited(3, 60.0)
    times = start()
    assert [admit(times, {"key": "k", "seq": i, "at": float(t)})["allowed"] for i, t in enumerate([0, 1, 2, 30, 61, 62])] == [True, True, True, False, True, True]


def test_refused_uploads_take_no_room():
    start, admit = folds.within_quota(10)
    taken = start()
    assert [admit(taken, {"photo_id": i, "bytes": b})["code"] for i, b in enumerate([6, 5, 4, 1])] == [200, 413, 200, 413]


def test_folds_do_not_depend_on_partitions(spark):
    rows = [photo(i, shell=i * 7 % 64, session_id=f"s{i % 3}") for i in range(90)]
    df = spark.createDataFrame(rows, PHOTO)
    want = None
    for n in (1, 4, 16):
        got = sorted(map(tuple, folds.burst_groups(df.repartition(n), ["session_id", "chunk"]).collect()))
        assert want is None or got == want
        want = got


def test_covers_pad_a_short_pool(spark):
    rows = [("a", i, 90.0 - i, 1, 1.5) for i in range(3)] + [("b", 10 + i, 90.0 - i, 1, 1.5) for i in range(9)]
    got = {}
    for r in stories.select_covers(spark.createDataFrame(rows, "session_id string, photo_id long, hero double, faces long, aspect double")).collect():
        got.setdefault((r.session_id, r.style), []).append((r.rank, r.photo_id))
    for key, n in ((("a", "SPLIT_BANNER"), 2), (("a", "HERO_BAND"), 1), (("a", "COLLAGE_2X2"), 4), (("b", "COLLAGE_2X2"), 4)):
        assert [k for k, _ in sorted(got[key])] == list(range(1, n + 1))
    assert [p for _, p in sorted(got["a", "COLLAGE_2X2"])] == [0, 1, 2, 0]
    ids = [p for (s, _), v in got.items() if s == "b" for _, p in v]
    assert len(set(ids)) == 7


def test_covers_of_all_books(spark, monkeypatch):
    from siltwork.plans import catalog
    from siltwork.plans import stories as plan

    data, view = "/root/testdata/sf0.001", plan.photos
    photos = lambda spark, d: view(spark, d).where("photo_id % 200 < 20 OR photo_id < 200")
    monkeypatch.setattr(plan, "photos", photos)
    books, got = {}, {}
    for r in quality.with_hero(photos(spark, data)).collect():
        books.setdefault(f"{r.session_id}{r.photo_id // 200}", []).append(r)
    for r in catalog.queries()["q_cover_select_all"](spark, data).collect():
        got.setdefault((r.grp, r.style), []).append((r["rank"], r.photo_id))
    for grp, rows in books.items():
        overall, used = sorted(rows, key=lambda r: (-r.hero, -r.faces, r.photo_id)), set()
        for style, n, likes in stories.COVER_STYLES:
            bonus = {r.photo_id: 8.0 if likes == "ANY" else 15.0 if r.aspect >= 1.35 else 5.0 if r.aspect >= 1.0 else 0.0 for r in rows}
            want = sorted((r for r in overall if r.photo_id not in used), key=lambda r: (-(r.hero + bonus[r.photo_id]), -r.faces, r.photo_id))[:n]
            want = [r.photo_id for r in want]
            want += [overall[k % len(overall)].photo_id for k in range(n - len(want))]
            used |= set(want)
            assert sorted(got.pop((grp, style))) == list(enumerate(want, 1))
    assert not got and any(len(rows) < 7 for rows in books.values())


def boxes_overlap(a, b):
    return min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]) > 1e-3 and min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]) > 1e-3


def flat(spark, rows):
    """One row a spread of up to four aspects, with its flags."""
    return spark.createDataFrame(rows, "i int, ars array<double>, text boolean, left boolean, right boolean")


@pytest.fixture(scope="module")
def spreads():
    rng = random.Random(9)
    return [(i, [rng.uniform(0.4, 2.6) for _ in range(rng.randint(1, 4))], rng.random() < 0.5, rng.random() < 0.5, rng.random() < 0.5) for i in range(250)]


def test_spreads_stay_on_the_page(spark, spreads):
    top = layouts.laid_out(F.col("ars"), F.col("text"), F.col("left"), F.col("right"))
    for r in flat(spark, spreads).select("ars", top.alias("t")).collect():
        out = [("left", k, tuple(b)) for k, b in zip(r.t.left, r.t.lefts, strict=True)] + [("right", k, tuple(b)) for k, b in zip(r.t.right, r.t.rights, strict=True)]
        assert sorted(k for _, k, _ in out) == list(range(len(r.ars)))
        for _, k, (x, y, w, h) in out:
            assert -1e-9 <= x and x + w <= 1 + 1e-9 and -1e-9 <= y and y + h <= 1 + 1e-9
            assert math.isclose(2 * w / h, r.ars[k], rel_tol=1e-9)
        for side in ("left", "right"):
            own = [b for s, _, b in out if s == side]
            assert not any(boxes_overlap(a, b) for a, b in combinations(own, 2)) or len(own) == 2
            assert all(x >= 0.5 if side == "right" else x + w <= 0.5 for x, _, w, _ in own)


def test_the_best_split_covers_most(spark, spreads):
    """Every split laid out page by page, against the one chosen."""
    options = [(i, k, [a[x] for x in le], [a[x] for x in ri], t, bl, br) for i, a, t, bl, br in spreads for k, (le, ri) in enumerate(layouts.splits(len(a)))]
    df = spark.createDataFrame(options, "i int, k int, le array<double>, ri array<double>, text boolean, bl boolean, br boolean")
    area = lambda p: F.aggregate(p, F.lit(0.0), lambda s, b: s + b["w"] * b["h"])
    pages = layouts.page(F.col("le"), layouts.area_of(True, F.col("text"), F.col("bl"))), layouts.page(F.col("ri"), layouts.area_of(False, False, F.col("br")))
    best = {}
    for r in df.select("i", "k", "le", "ri", (area(pages[0]) + area(pages[1])).alias("v")).collect():
        calm = len(r.le) == len(r.ri) == 1 and min(r.le[0], r.ri[0]) <= 0.95 and max(r.le[0], r.ri[0]) >= 1.1
        best.setdefault(r.i, []).append((r.v + 0.25 * calm, -r.k))
    got = {r.i: (r.score, -r.best) for r in layouts.best_split(flat(spark, spreads), F.col("text"), F.col("left"), F.col("right")).collect()}
    assert all(math.isclose(got[i][0], max(v)[0]) and math.isclose(dict((b, a) for a, b in v)[got[i][1]], max(v)[0]) for i, v in best.items())


def test_dominant_photos_get_more_room(spark):
    df = flat(spark, [(0, [1.5, 1.5, 1.5], False, True, False), (1, [1.5, 1.5, 1.5], False, False, False)])
    got = {r.i: r.p for r in df.select("i", layouts.page(F.col("ars"), layouts.area_of(True, F.col("text"), F.col("left"))).alias("p")).collect()}
    assert got[0][0].w > got[0][1].w and got[0][1].y == got[0][2].y and math.isclose(got[1][0].w, got[1][2].w)


def test_more_than_three_photos_on_a_page(spark):
    with pytest.raises(Exception, match="at most three"):
        flat(spark, [(0, [1.0] * 4, False, False, False)]).select(layouts.page(F.col("ars"), layouts.area_of(True, True, False))).collect()


def test_dpi_badges(spark):
    one = spark.range(1)
    low = one.select(layouts.badge(layouts.dpi(F.lit(300), F.lit(200), F.lit(0.436), F.lit(0.4)))).first()[0]
    edge = [r[0] for r in spark.createDataFrame([(250.0,), (249.9,), (150.0,), (149.9,)], "v double").select(layouts.badge(F.col("v"))).collect()]
    assert low == "alert" and edge == ["excellent", "warning", "warning", "alert"]


def test_file_names(spark):
    names = {"IMG_20240229_235959.jpg": "2024-02-29 23:59:59", "IMG-20240301-WA1.jpg": "2024-03-01 12:00:00", "20230230.jpg": None, "x.jpg": None, "2024-01-02 10.jpg": "2024-01-02 12:00:00"}
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", F.date_format(fn.filename_time(F.col("n")), "yyyy-MM-dd HH:mm:ss").alias("t"))
    assert {r.n: r.t for r in df.collect()} == names


def test_keys(spark):
    ok = ["a/b/c.jpg", "original/s1/px_1.webp"]
    bad = ["/a", "a/../b", "..", "C:/x", "a\\b", "", "a//b"]
    got = {r.k: r.ok for r in spark.createDataFrame([(k,) for k in ok + bad], "k string").select("k", fn.valid_key(F.col("k")).alias("ok")).collect()}
    assert got == {k: True for k in ok} | {k: False for k in bad}


def test_hamming_and_sql_functions(spark):
    df = spark.createDataFrame([(1, -1, 0), (2, None, 5), (3, 7, 4)], "i int, a long, b long")
    assert [r[0] for r in df.orderBy("i").select(quality.hamming("a", "b")).collect()] == [64, 99, 2]
    assert spark.sql("SELECT hamming64(7, 4), round(haversine_km(12D, 77D, 12D, 77D), 3), haversine_km(NULL, 1D, 2D, 3D)").first()[0:3] == (2, 0.0, 0.0)


def test_range_pairs_equal_a_loop(spark):
    rng = random.Random(4)
    rows = [(i, "s", float(rng.randrange(2000))) for i in range(120)]
    df = spark.createDataFrame(rows, "seq long, session_id string, at double")
    got = {(r.a_seq, r.b_seq) for r in jn.range_pairs(df, "at", 30, ["session_id"], F.lit(True), ["seq", "at"]).collect()}
    assert got == {(a[0], b[0]) for a, b in combinations(rows, 2) if abs(a[2] - b[2]) <= 30}


def test_eviction_keeps_the_newest_that_fit(spark):
    files = spark.createDataFrame([("c", i, float(i), 1000) for i in range(3)] + [("c", 9, -10.0, 1)], "cache string, file long, mtime double, bytes long")
    assert sorted(r.file for r in state.evict(files, "cache", F.lit(2.0), 5.0, 2500).collect()) == [1, 2]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, s string, c int")
    new = spark.createDataFrame([(2, "x"), (3, "y")], "k int, s string")
    assert sorted(map(tuple, state.upsert_merge(old, new, "k").collect())) == [(1, "a", 5), (2, "x", 6), (3, "y", None)]
    assert sorted(state.upsert_replace(old, new, "k").collect(), key=lambda r: r.k) == [(1, "a", 5), (2, "x", None), (3, "y", None)]
    once = state.upsert_merge(old, new, "k")
    assert sorted(map(tuple, state.upsert_merge(once, new, "k").collect())) == sorted(map(tuple, once.collect()))


def test_nearest_rank_rounds_half_to_even(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(6)] + [("b", 1.0)] * 9 + [("b", 5.0), ("b", None)], "g string, v double")
    got = {r.g: (r.half, r.top) for r in selection.nearest_ranks(df, "g", "v", half=50.0, top=100.0).collect()}
    assert got == {"a": (2.0, 5.0), "b": (1.0, 5.0)}


def test_gate_thresholds(spark):
    cols = "black_share double, white_share double, std_light double, mean_light double, laplacian double, tenengrad double"
    rows = [(0.93, 0.0, 11.0, 9.0, 50.0, 200.0), (0.92, 0.0, 11.0, 9.0, 50.0, 200.0), (0.0, 0.0, 30.0, 60.0, 17.0, 119.0), (0.0, 0.0, 30.0, 60.0, 18.0, 119.0), (0.0, 0.0, 20.0, 60.0, 29.0, 119.0), (0.0, 0.0, 20.0, 60.0, 29.0, 120.0)]
    df = spark.createDataFrame(rows, cols).select(F.expr(quality.double_literals(quality.BAD_EXPOSURE)).alias("e"), F.expr(quality.BLURRY).alias("b"))
    assert [tuple(r) for r in df.collect()] == [(True, False), (False, False), (False, True), (False, False), (False, True), (False, False)]
