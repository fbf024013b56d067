"""Queries of clustering and of the greedy folds. Their DuckDB twins are recursions over positions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import folds, quality
from ..operators import joins as jn
from ..operators import stories as st
from ..operators.events import events
from ..sources.scratch import written
from .aggregates import _CHUNK, chunked
from .joins import _AFFINITY, _BOXES, EDGES, boxes
from .registry import query
from .stories import HERO, MACRO
from .views import WITH, photos, table

D = quality.double_literals
RECURSIVE = WITH.replace("WITH ", "WITH RECURSIVE ")


@query(
    f"""{RECURSIVE}, {EDGES}, both_ways AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges),
    reach AS (SELECT a AS x, a AS y FROM both_ways UNION SELECT r.x, e.b FROM reach r JOIN both_ways e ON r.y = e.a), named AS (SELECT x AS photo_id, min(y) AS event FROM reach GROUP BY x)
    SELECT p.photo_id, coalesce(n.event, p.photo_id) AS event FROM photos p LEFT JOIN named n USING (photo_id)"""
)
def q_event_clusters(spark, d):
    """Events: components of the space-time distance graph, named by their first photo."""
    return events(photos(spark, d))


# --- bursts ---------------------------------------------------------------------

CHUNK = ["session_id", "chunk"]


def passed(p):
    """Photos that pass the gate, in the upload chunks that all photos were numbered into."""
    p = quality.with_hero(quality.with_status(chunked(p))).where("status = 'PASSED'")
    return p.withColumn("moment", F.col("burst_epoch").cast("double")).withColumn("seq", F.col("photo_id"))


def bursts_sql(rows: str) -> str:
    """CTEs from ``rows`` (photos with hero and chunk) to ``bursts``: n, leader, survives."""
    return f"""g AS (SELECT *, row_number() OVER (PARTITION BY session_id, chunk ORDER BY photo_id) AS n FROM {rows}),
    h AS (SELECT b.session_id, b.chunk, b.n, a.n AS m, abs(a.burst_epoch - b.burst_epoch) AS dt, bit_count(xor(a.shell, b.shell)) AS sh, bit_count(xor(a.core, b.core)) AS co, least(a.faces, b.faces) AS f
      FROM g a JOIN g b ON a.session_id = b.session_id AND a.chunk = b.chunk AND a.n < b.n),
    adjacent AS (SELECT session_id, chunk, n, list(m ORDER BY m) AS ms FROM h WHERE sh <= 7 AND co <= 5 AND (dt <= 5 OR f >= 2 AND dt <= 180) AND NOT (sh <= 8 AND co >= 5 AND dt <= 45) GROUP BY ALL),
    s AS (SELECT g.session_id, g.chunk, g.n, coalesce(ms, []) AS ms FROM g LEFT JOIN adjacent USING (session_id, chunk, n)),
    led AS (SELECT session_id, chunk, n, [n] AS l FROM s WHERE n = 1 UNION ALL
      SELECT s.session_id, s.chunk, s.n, list_append(l, coalesce(list_min(list_filter(s.ms, lambda x: l[x] = x)), s.n)) FROM led JOIN s ON s.session_id = led.session_id AND s.chunk = led.chunk AND s.n = led.n + 1),
    ends AS (SELECT session_id, chunk, arg_max(l, n) AS l FROM led GROUP BY ALL),
    f AS (SELECT g.*, l[g.n] AS lead FROM g JOIN ends USING (session_id, chunk)),
    bursts AS (SELECT *, first_value(photo_id) OVER (PARTITION BY session_id, chunk, lead ORDER BY n) AS leader, bool_or(faces >= 1 AND face_quality >= 0.75::DOUBLE) OVER (PARTITION BY session_id, chunk, lead)
      OR row_number() OVER (PARTITION BY session_id, chunk, lead ORDER BY hero * 2 + blur + contrast * 1.5::DOUBLE DESC, photo_id) = 1 AS survives FROM f)"""


_PASSED = f"c AS (SELECT *, CAST({_CHUNK} AS BIGINT) AS chunk, {HERO} AS hero, {D(quality.STATUS)} AS status FROM photos), passed AS (SELECT * FROM c WHERE status = 'PASSED')"
_BURSTS = f"{RECURSIVE}, {_PASSED}, {bursts_sql('passed')}"


@query(f"{_BURSTS} SELECT session_id, photo_id, leader, survives FROM bursts")
def q_burst_dedup(spark, d):
    return folds.burst_groups(passed(photos(spark, d)), CHUNK).select("session_id", "photo_id", "leader", "survives")


# --- layout groups --------------------------------------------------------------


def survivors(spark, d, p=None):
    """Photos (of the library, or ``p``) that stay after burst dedup, with 32 colour counts where the library has them."""
    p = passed(photos(spark, d) if p is None else p)
    stay = folds.burst_groups(p, CHUNK).where("survives").select("photo_id")
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("photo_id"), F.transform(F.slice("embedding", 1, 32), lambda x: x.cast("double")).alias("hist"))
    return p.join(stay, "photo_id", "left_semi").join(e, "photo_id", "left")


_TRIPTYCHS = f"""{_BURSTS}, v AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY session_id, chunk) AS cnt, lead(shell) OVER w AS shell2, lead(shell, 2) OVER w AS shell3, lead(core) OVER w AS core2, lead(core, 2) OVER w AS core3,
      lead(aspect) OVER w AS aspect2, lead(aspect, 2) OVER w AS aspect3, lead(burst_epoch, 2) OVER w AS moment3 FROM bursts WHERE survives WINDOW w AS (PARTITION BY session_id, chunk ORDER BY photo_id)),
    hits AS (SELECT *, coalesce(moment3 - burst_epoch <= 45 AND greatest(aspect, aspect2, aspect3) < 0.85::DOUBLE AND bit_count(xor(shell, shell2)) <= 8 AND bit_count(xor(shell2, shell3)) <= 8
      AND bit_count(xor(core, core2)) >= 4 AND bit_count(xor(core2, core3)) >= 4, false) AND i + 2 <= cnt AS hit FROM v),
    walk AS (SELECT session_id, chunk, i, CASE WHEN hit THEN i ELSE -9 END AS last FROM hits WHERE i = 1 UNION ALL
      SELECT h.session_id, h.chunk, h.i, CASE WHEN h.hit AND h.i >= last + 3 THEN h.i ELSE last END FROM walk w JOIN hits h ON h.session_id = w.session_id AND h.chunk = w.chunk AND h.i = w.i + 1),
    triptychs AS (SELECT v.session_id, v.chunk, v.i, v.photo_id, a.photo_id AS group_id, CAST(v.i - w.i AS INTEGER) AS pos FROM walk w JOIN v ON v.session_id = w.session_id AND v.chunk = w.chunk AND v.i BETWEEN w.i AND w.i + 2
      JOIN v a ON a.session_id = w.session_id AND a.chunk = w.chunk AND a.i = w.i WHERE w.last = w.i)"""

# a step looks at one candidate j of the chain that photo i began; what a group holds is used
_GROUPS = f"""{_TRIPTYCHS}, colours AS (SELECT vec_id AS photo_id, list_transform(embedding[1:32], lambda x: CAST(x AS DOUBLE)) AS hist FROM embeddings),
    p AS (SELECT a.session_id, a.chunk, a.i AS x, b.i AS y, bit_count(xor(a.shell, b.shell)) AS sh, b.burst_epoch - a.burst_epoch > 300 AS late, ca.hist AS ha, cb.hist AS hb FROM v a JOIN v b ON a.session_id = b.session_id AND a.chunk = b.chunk AND a.i < b.i
      LEFT JOIN colours ca ON ca.photo_id = a.photo_id LEFT JOIN colours cb ON cb.photo_id = b.photo_id),
    m AS (SELECT *, list_sum(ha) / 32 AS ma, list_sum(hb) / 32 AS mb FROM p),
    k AS (SELECT session_id, chunk, x * 100 + y AS code, sh, late, CASE WHEN sh <= 14 AND ha IS NOT NULL AND hb IS NOT NULL THEN
      coalesce(list_sum(list_transform(list_zip(ha, hb), lambda z: (z[1] - ma) * (z[2] - mb))) / sqrt(nullif(list_sum(list_transform(ha, lambda z: (z - ma) * (z - ma))) * list_sum(list_transform(hb, lambda z: (z - mb) * (z - mb))), 0)), 0) >= 0.65::DOUBLE ELSE false END AS alike FROM m),
    facts AS (SELECT session_id, chunk, coalesce(list(code) FILTER (WHERE late), []) AS late, coalesce(list(code) FILTER (WHERE sh <= 10), []) AS step, coalesce(list(code) FILTER (WHERE sh <= 12), []) AS near, coalesce(list(code) FILTER (WHERE alike), []) AS alike FROM k GROUP BY ALL),
    taken AS (SELECT session_id, chunk, list(i) AS used FROM triptychs GROUP BY ALL),
    chunks AS (SELECT session_id, chunk, max(cnt) AS cnt, list(CASE WHEN faces = 0 THEN 2 ELSE 4 END ORDER BY i) AS most, any_value(f.late) AS late, any_value(f.step) AS step, any_value(f.near) AS near, any_value(f.alike) AS alike, coalesce(any_value(t.used), []) AS used
      FROM v JOIN facts f USING (session_id, chunk) LEFT JOIN taken t USING (session_id, chunk) GROUP BY ALL),
    chain AS (SELECT session_id, chunk, 1::BIGINT AS i, 2::BIGINT AS j, [1::BIGINT] AS c, used, NULL::BIGINT[] AS done FROM chunks UNION ALL
      SELECT session_id, chunk, CASE WHEN over THEN i + 1 ELSE i END, CASE WHEN over THEN i + 2 ELSE j + 1 END, CASE WHEN over THEN [i + 1] WHEN goes THEN list_append(c, j) ELSE c END,
        CASE WHEN over AND len(c) > 1 AND NOT skip THEN list_concat(used, c) ELSE used END, CASE WHEN over AND len(c) > 1 AND NOT skip THEN c END
      FROM (SELECT q.*, list_contains(q.used, i) AS skip, list_contains(q.used, i) OR j > cnt OR len(c) = most[i] OR NOT list_contains(q.used, j) AND list_contains(late, i * 100 + j) AS over,
          NOT list_contains(q.used, j) AND (list_contains(step, c[-1] * 100 + j) AND list_contains(near, i * 100 + j) OR list_contains(alike, i * 100 + j)) AS goes
        FROM chain q JOIN chunks USING (session_id, chunk) WHERE i <= cnt)),
    themes AS (SELECT session_id, chunk, CASE len(done) WHEN 2 THEN 'COMPANION_PAIR' WHEN 3 THEN 'THEME_TRIPTYCH_GROUP' ELSE 'THEME_QUAD_GROUP' END AS kind, done[1] AS first, unnest(done) AS i, unnest(range(len(done))) AS pos FROM chain WHERE done IS NOT NULL),
    groups AS (SELECT t.session_id, a.photo_id AS group_id, kind, v.photo_id, CAST(pos AS INTEGER) AS pos FROM themes t JOIN v a ON a.session_id = t.session_id AND a.chunk = t.chunk AND a.i = t.first JOIN v ON v.session_id = t.session_id AND v.chunk = t.chunk AND v.i = t.i
      UNION ALL SELECT session_id, group_id, 'BURST_TRIPTYCH_GROUP', photo_id, pos FROM triptychs)"""


# portraits of one place whose subjects move, so that triptychs occur: (column, Spark expression, DuckDB expression)
_POSED = [
    ("shell", "((burst_epoch div 512) * 2654435761 % 2147483648) ^ (photo_id % 4)", "xor(burst_epoch // 512 * 2654435761 % 2147483648, photo_id % 4)"),
    ("core", "((burst_epoch div 512) * 2246822519 % 2147483648) ^ (63 * (photo_id % 3) * (1 + 31 * (photo_id % 3)))", "xor(burst_epoch // 512 * 2246822519 % 2147483648, 63 * (photo_id % 3) * (1 + 31 * (photo_id % 3)))"),
    ("aspect", "CASE WHEN photo_id % 7 = 0 THEN 1.5D ELSE 0.7D END", "CASE WHEN photo_id % 7 = 0 THEN 1.5::DOUBLE ELSE 0.7::DOUBLE END"),
]
_POSED_TRIPTYCHS = _TRIPTYCHS.replace("AS status FROM photos)", f"AS status FROM (SELECT * REPLACE ({', '.join(f'{sql} AS {name}' for name, _, sql in _POSED)}) FROM photos))")


@query(f"{_POSED_TRIPTYCHS} SELECT session_id, group_id, photo_id, pos FROM triptychs")
def q_triptych(spark, d):
    posed = photos(spark, d).withColumns({name: F.expr(e) for name, e, _ in _POSED})
    groups = folds.layout_groups(survivors(spark, d, posed), CHUNK).where(F.col("kind") == folds.TRIPTYCH)
    return groups.select("session_id", "group_id", "photo_id", "pos")


@query(f"{_GROUPS} SELECT session_id, group_id, kind, photo_id, pos FROM groups")
def q_theme_groups(spark, d):
    """Triptychs, then chains of one scene among the other photos."""
    return folds.layout_groups(survivors(spark, d), CHUNK).select("session_id", "group_id", "kind", "photo_id", "pos")


@query(f"{_GROUPS} SELECT session_id, group_id, kind, max(photo_id) FILTER (WHERE pos = 0) AS photo_id, max(photo_id) FILTER (WHERE pos = 1) AS paired_photo_id, 95.0::DOUBLE AS pairing_score FROM groups GROUP BY ALL")
def q_pairing(spark, d):
    """The first two photos of each group, triptychs among them, suggest each other."""
    g = q_theme_groups(spark, d).groupBy("session_id", "group_id", "kind").agg(F.max(F.when(F.col("pos") == 0, F.col("photo_id"))).alias("photo_id"), F.max(F.when(F.col("pos") == 1, F.col("photo_id"))).alias("paired_photo_id"))
    return g.withColumn("pairing_score", F.lit(95.0))


# --- spreads, boxes, limits -----------------------------------------------------


def chapter_rows(spark, d, *more: str):
    """The photos of each chapter, numbered in order."""
    m = st.macro_chapters(photos(spark, d))
    seq = F.row_number().over(Window.partitionBy("session_id", "chapter").orderBy("epoch", "photo_id"))
    return m.select("session_id", "chapter", seq.alias("seq"), "photo_id", "shell", "core", "aspect", *more)


def spread_rows(spark, d, *sizes: int):
    return folds.spread_chunks(chapter_rows(spark, d), ["session_id", "chapter"], *sizes)


_AKIN = _AFFINITY.format(q="0.25::DOUBLE")


def spreads_sql(*sizes: int) -> str:
    """CTEs up to ``placed``: session_id, chapter, size, spread, pos and i, a photo's place in its chapter (``gg``)."""
    pairs = "SELECT x.session_id, x.chapter, x.i, y.i AS j, x.aspect AS a_aspect, y.aspect AS b_aspect, bit_count(xor(x.shell, y.shell)) AS sh, bit_count(xor(x.core, y.core)) AS co FROM gg x JOIN gg y ON x.session_id = y.session_id AND x.chapter = y.chapter AND y.i BETWEEN x.i + 1 AND x.i + 8"
    return f"""{MACRO}, gg AS (SELECT *, row_number() OVER (PARTITION BY session_id, chapter ORDER BY epoch, photo_id) AS i FROM macro),
    near AS (SELECT session_id, chapter, i, list(j ORDER BY affinity DESC, j) AS js FROM (SELECT session_id, chapter, i, j, {_AKIN} AS affinity FROM ({pairs})) GROUP BY ALL),
    sizes AS (SELECT session_id, chapter, size, cnt, CASE WHEN cnt <= 4 THEN greatest(2, size - 1) ELSE size END AS room FROM (SELECT session_id, chapter, count(*) AS cnt FROM gg GROUP BY ALL), (SELECT unnest({list(sizes)}) AS size)),
    rr AS (SELECT gg.session_id, gg.chapter, size, gg.i, cnt, room, CASE WHEN cnt <= room THEN range(2, cnt + 1) ELSE coalesce(js, []) END AS js FROM gg JOIN sizes USING (session_id, chapter) LEFT JOIN near USING (session_id, chapter, i)),
    steps AS (SELECT session_id, chapter, size, 0::BIGINT AS i, []::BIGINT[] AS used, []::BIGINT[] AS own, -1::BIGINT AS spread FROM sizes UNION ALL
      SELECT r.session_id, r.chapter, r.size, r.i, CASE WHEN list_contains(used, r.i) THEN used ELSE list_concat(used, list_concat([r.i], list_filter(js, lambda j: NOT list_contains(used, j))[1:room - 1])) END,
        CASE WHEN list_contains(used, r.i) THEN [] ELSE list_concat([r.i], list_filter(js, lambda j: NOT list_contains(used, j))[1:room - 1]) END, CASE WHEN list_contains(used, r.i) THEN spread ELSE spread + 1 END
      FROM steps w JOIN rr r ON r.session_id = w.session_id AND r.chapter = w.chapter AND r.size = w.size AND r.i = w.i + 1),
    placed AS (SELECT session_id, chapter, size, spread, unnest(own) AS i, unnest(range(len(own))) AS pos FROM steps)"""


@query(f"{RECURSIVE}, {spreads_sql(3)} SELECT session_id, chapter, CAST(spread AS INTEGER) AS spread, CAST(pos AS INTEGER) AS pos, photo_id FROM placed JOIN gg USING (session_id, chapter, i)")
def q_spread_chunks(spark, d):
    return spread_rows(spark, d, 3).drop("size")


@query(
    f"""WITH RECURSIVE {_BOXES}, b AS (SELECT *, (x1 - x0) * (y1 - y0) AS area, ((img * 7 + box * 13) % 100) / 100.0::DOUBLE AS conf FROM boxes),
    o AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY conf * area DESC, box, x0, y0) AS i FROM b),
    h AS (SELECT img, b, list(a) AS hit FROM (SELECT x.img, x.i AS a, y.i AS b, greatest(0.0::DOUBLE, least(x.x1, y.x1) - greatest(x.x0, y.x0)) * greatest(0.0::DOUBLE, least(x.y1, y.y1) - greatest(x.y0, y.y0)) AS common, x.area AS aa, y.area AS ba FROM o x JOIN o y ON x.img = y.img AND x.i < y.i)
      WHERE common / (aa + ba - common) > 0.35::DOUBLE GROUP BY ALL),
    s AS (SELECT o.img, o.i, coalesce(hit, []) AS hit FROM o LEFT JOIN h ON h.img = o.img AND h.b = o.i),
    walk AS (SELECT img, 1::BIGINT AS i, [1::BIGINT] AS kept FROM s WHERE i = 1 UNION ALL SELECT s.img, s.i, CASE WHEN list_has_any(s.hit, kept) THEN kept ELSE list_append(kept, s.i) END FROM walk w JOIN s ON s.img = w.img AND s.i = w.i + 1),
    ends AS (SELECT img, unnest(arg_max(kept, i)) AS i FROM walk GROUP BY img) SELECT img, CAST(box AS INTEGER) AS box FROM ends JOIN o USING (img, i)"""
)
def q_nms(spark, d):
    rows = boxes(spark, d).withColumnRenamed("box", "seq").withColumn("conf", (F.col("img") * 7 + F.col("seq") * 13) % 100 / 100)
    return folds.without_overlaps(rows, ["img"]).select("img", F.col("box").cast("int").alias("box"))


@query(
    """WITH RECURSIVE e AS (SELECT concat(event_type, '-', user_id % 20) AS key, event_id AS hit, epoch_us(ts) / 1000000.0::DOUBLE AS tm FROM events),
    n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY tm, hit) AS i FROM e),
    walk AS (SELECT key, i, hit, true AS allowed, [tm] AS times FROM n WHERE i = 1 UNION ALL
      SELECT n.key, n.i, n.hit, len(list_filter(times, lambda t: t > n.tm - 7200)) < 3, CASE WHEN len(list_filter(times, lambda t: t > n.tm - 7200)) < 3 THEN list_append(list_filter(times, lambda t: t > n.tm - 7200), n.tm) ELSE times END
      FROM walk w JOIN n ON n.key = w.key AND n.i = w.i + 1) SELECT key, hit, allowed FROM walk"""
)
def q_rate_limit(spark, d):
    """Admitted hits of each key in any trailing window; refused ones leave no trace."""
    rows = table(spark, d, "events").selectExpr("concat(event_type, '-', user_id % 20) AS key", "event_id AS seq", "unix_micros(CAST(ts AS TIMESTAMP)) / 1000000D AS at")
    return folds.streamed(rows, ["key"], ["at", "seq"], *folds.rate_limited(3, 7200.0), "key string, hit long, allowed boolean")


@query(
    f"""{RECURSIVE}, n AS (SELECT session_id, photo_id, bytes, row_number() OVER (PARTITION BY session_id ORDER BY photo_id) AS i FROM photos),
    walk AS (SELECT session_id, i, photo_id, CASE WHEN bytes <= 100000000 THEN bytes ELSE 0 END AS taken, bytes <= 100000000 AS ok FROM n WHERE i = 1 UNION ALL
      SELECT n.session_id, n.i, n.photo_id, CASE WHEN taken + n.bytes <= 100000000 THEN taken + n.bytes ELSE taken END, taken + n.bytes <= 100000000 FROM walk w JOIN n ON n.session_id = w.session_id AND n.i = w.i + 1)
    SELECT photo_id, CASE WHEN ok THEN 200 ELSE 413 END AS code FROM walk"""
)
def q_quota_admission(spark, d):
    """Uploads that still fit a session's room; refused ones take none."""
    rows = photos(spark, d).select("session_id", "photo_id", "bytes")
    return folds.streamed(rows, ["session_id"], ["photo_id"], *folds.within_quota(100_000_000), "photo_id long, code int")


_SAVED = f"""q AS (SELECT *, CAST({_CHUNK} AS BIGINT) AS chunk, {HERO} AS hero, {D(quality.STATUS)} AS status0 FROM photos),
    solo AS (SELECT x.photo_id FROM q x WHERE x.status0 = 'REJECTED_BLURRY' AND x.blur >= 18 AND NOT EXISTS (SELECT 1 FROM q y WHERE y.session_id = x.session_id AND y.photo_id <> x.photo_id AND abs(y.burst_epoch - x.burst_epoch) <= 30 AND bit_count(xor(x.shell, y.shell)) <= 10)),
    c AS (SELECT q.*, CASE WHEN solo.photo_id IS NULL THEN status0 ELSE 'PASSED' END AS status FROM q LEFT JOIN solo USING (photo_id)), live AS (SELECT * FROM c WHERE status = 'PASSED')"""


@query(f"{RECURSIVE}, {_SAVED}, {bursts_sql('live')} SELECT c.session_id, c.photo_id, CASE WHEN NOT coalesce(b.survives, true) THEN 'REJECTED_BURST' ELSE c.status END AS status FROM c LEFT JOIN bursts b USING (photo_id)")
def q_phase1(spark, d):
    """Every photo's status after the gate, the rescue of solo anchors and burst dedup in its upload chunk."""
    p = quality.with_hero(quality.with_status(chunked(photos(spark, d)))).withColumn("moment", F.col("burst_epoch").cast("double")).withColumn("seq", F.col("photo_id"))
    saved = quality.solo_anchors(p).withColumn("saved", F.lit(True))
    p = p.join(saved, "photo_id", "left").withColumn("status", F.when(F.col("saved"), "PASSED").otherwise(F.col("status")))
    kept = folds.burst_groups(p.where("status = 'PASSED'"), CHUNK)
    done = p.select("session_id", "photo_id", "status").join(kept.select("photo_id", "survives"), "photo_id", "left")
    return done.select("session_id", "photo_id", F.when(~F.col("survives"), "REJECTED_BURST").otherwise(F.col("status")).alias("status"))


@query(
    f"""{RECURSIVE}, {_SAVED}, {bursts_sql('live')}, alive AS (SELECT * FROM live WHERE photo_id NOT IN (SELECT photo_id FROM bursts WHERE NOT survives)), {EDGES.replace('FROM photos a JOIN photos b', 'FROM alive a JOIN alive b')},
    both_ways AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges), reach AS (SELECT a AS x, a AS y FROM both_ways UNION SELECT r.x, e.b FROM reach r JOIN both_ways e ON r.y = e.a),
    named AS (SELECT x AS photo_id, min(y) AS event FROM reach GROUP BY x), e AS (SELECT a.photo_id, coalesce(n.event, a.photo_id) AS event, hero FROM alive a LEFT JOIN named n USING (photo_id))
    SELECT event, count(*) AS photos, arg_max(photo_id, struct_pack(h := hero, p := -photo_id)) AS hero_id FROM e GROUP BY event"""
)
def q_phase1_events(spark, d):
    """Events of the photos that phase 1 keeps: how many photos, and the best of them."""
    p = photos(spark, d).join(q_phase1(spark, d).where("status = 'PASSED'").select("photo_id"), "photo_id", "left_semi")
    p = written(quality.with_hero(p), "alive")
    e = events(p).join(p.select("photo_id", "hero"), "photo_id")
    return e.groupBy("event").agg(F.count("*").alias("photos"), F.max_by("photo_id", F.struct(F.col("hero"), -F.col("photo_id"))).alias("hero_id"))
