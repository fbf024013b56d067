"""Queries that join."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins as op
from .registry import query
from .views import WITH, photos, table

_STEM = "regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^.*/', ''), '_(thumb|orig)$', '')"


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def q_point_lookup(spark, d):
    return table(spark, d, "orders").where("o_orderkey = 7").select("o_orderkey", "o_totalprice")


_WANTED = [42, 7, 999999999, 1, 640, 3]


@query(f"SELECT w.pos, e.event_id, e.event_type FROM (SELECT unnest({_WANTED}) AS event_id, unnest([0, 1, 2, 3, 4, 5]) AS pos) w JOIN events e USING (event_id)")
def q_ordered_in_lookup(spark, d):
    return op.ordered_lookup(table(spark, d, "events").select("event_id", "event_type"), _WANTED, "event_id").select("pos", "event_id", "event_type")


@query(f"{WITH} SELECT photo_id, row_number() OVER (ORDER BY epoch > 0 DESC, epoch, taken_at, photo_id) AS pos FROM photos WHERE session_id = 'signup-0'")
def q_session_scan(spark, d):
    """One session in capture order, unknown times last; its rows alone are read and sorted."""
    w = Window.partitionBy("session_id").orderBy((F.col("epoch") > 0).desc(), "epoch", "taken_at", "photo_id")
    return photos(spark, d).where("session_id = 'signup-0'").select("photo_id", F.row_number().over(w).cast("long").alias("pos"))


@query("SELECT (SELECT count(*) FROM events) AS n_photos, (SELECT count(*) FROM orders) AS n_jobs")
def q_counts(spark, d):
    n = table(spark, d, "events").agg(F.count("*").alias("n_photos"))
    return n.crossJoin(table(spark, d, "orders").agg(F.count("*").alias("n_jobs")))  # one row each


@query("SELECT o.o_orderkey, c.c_name, c.c_mktsegment FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
def q_meta_join(spark, d):
    meta = table(spark, d, "customer").selectExpr("c_custkey AS photo_id", "c_name", "c_mktsegment", "0 AS pos")
    orders = table(spark, d, "orders").selectExpr("o_orderkey", "o_custkey AS photo_id")
    return op.with_metadata(orders, meta).select("o_orderkey", "c_name", "c_mktsegment")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def q_unmatched(spark, d):
    c = table(spark, d, "customer").selectExpr("c_custkey AS photo_id")
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").selectExpr("o_custkey AS photo_id")
    return op.unmatched(c, o).select(F.col("photo_id").alias("c_custkey"))


@query(
    f"""{WITH}, placed AS (SELECT session_id, photo_id * 3 AS photo_id FROM photos)
    SELECT l.session_id, count(*) AS total, count(*) FILTER (WHERE p.photo_id IS NULL OR NOT p.synced) AS pending,
    CASE WHEN count(*) FILTER (WHERE p.photo_id IS NULL OR NOT p.synced) > 0 THEN 409 ELSE 200 END AS code FROM placed l LEFT JOIN photos p USING (photo_id) GROUP BY l.session_id"""
)
def q_export_gate(spark, d):
    """Placed photos whose original has not arrived block an export."""
    p = photos(spark, d)
    placed = p.select("session_id", (F.col("photo_id") * 3).alias("photo_id"))
    g = placed.join(p.select("photo_id", "synced"), "photo_id", "left").groupBy("session_id").agg(F.count("*").alias("total"), F.count_if(~F.coalesce("synced", F.lit(False))).alias("pending"))
    return g.withColumn("code", F.when(F.col("pending") > 0, 409).otherwise(200))


_DUP = """WITH {photos}, r AS (SELECT photo_id, session_id, burst_epoch, shell, core, faces FROM photos),
    h AS (SELECT x.photo_id AS a, y.photo_id AS b, abs(x.burst_epoch - y.burst_epoch) AS dt, bit_count(xor(x.shell, y.shell)) AS sh, bit_count(xor(x.core, y.core)) AS co, x.faces AS fa, y.faces AS fb
      FROM r x JOIN r y ON x.session_id = y.session_id AND x.photo_id < y.photo_id AND abs(x.burst_epoch - y.burst_epoch) <= 180)
    SELECT a, b FROM h WHERE sh <= 7 AND co <= 5 AND (dt <= 5 OR fa >= 2 AND fb >= 2 AND dt <= 180) AND NOT (sh <= 8 AND co >= 5 AND dt <= 45)"""


@query(_DUP.replace("WITH {photos}", WITH.strip()))
def q_dup_pairs(spark, d):
    pairs = op.duplicate_pairs(photos(spark, d).withColumn("seq", F.col("photo_id")), ["session_id"], "burst_epoch")
    return pairs.select(F.col("a_photo_id").alias("a"), F.col("b_photo_id").alias("b"))


HAVERSINE = """coalesce(6371.0::DOUBLE * 2 * atan2(sqrt(pow(sin((radians({b}.latitude) - radians({a}.latitude)) / 2), 2) + cos(radians({a}.latitude)) * cos(radians({b}.latitude)) * pow(sin(radians({b}.longitude - {a}.longitude) / 2), 2)),
  sqrt(1 - (pow(sin((radians({b}.latitude) - radians({a}.latitude)) / 2), 2) + cos(radians({a}.latitude)) * cos(radians({b}.latitude)) * pow(sin(radians({b}.longitude - {a}.longitude) / 2), 2)))), 0.0::DOUBLE)"""
EDGES = f"""edges AS (SELECT a.photo_id AS a, b.photo_id AS b FROM photos a JOIN photos b ON a.session_id = b.session_id AND a.photo_id < b.photo_id AND a.taken_at BETWEEN b.taken_at - 2700 AND b.taken_at + 2700
  WHERE sqrt(pow((a.taken_at - b.taken_at) / 2700, 2) + pow({HAVERSINE.format(a='a', b='b')} / 5, 2)) <= 1)"""


@query(f"{WITH}, {EDGES} SELECT a, b FROM edges")
def q_event_edges(spark, d):
    """All near pairs; what is dense has many, so clusters are found without them."""
    r = photos(spark, d).withColumn("seq", F.col("photo_id"))
    e = op.range_pairs(r, "taken_at", 2700, ["session_id"], op.space_time("taken_at") <= 1, ["seq", "photo_id", "taken_at", "latitude", "longitude"])
    return e.select(F.col("a_photo_id").alias("a"), F.col("b_photo_id").alias("b"))


@query(f"{WITH} SELECT a.photo_id AS a, b.photo_id AS b, round({HAVERSINE.format(a='a', b='b')}, 4) AS km FROM photos a JOIN photos b ON b.photo_id = a.photo_id + 1")
def q_haversine(spark, d):
    p = photos(spark, d).select("photo_id", "latitude", "longitude")
    a, b = p.alias("a"), p.alias("b")
    km = op.haversine(F.col("a.latitude"), F.col("a.longitude"), F.col("b.latitude"), F.col("b.longitude"))
    return a.join(b, F.col("b.photo_id") == F.col("a.photo_id") + 1).select(F.col("a.photo_id").alias("a"), F.col("b.photo_id").alias("b"), F.round(km, 4).alias("km"))


_AFFINITY = "CASE WHEN sh <= 8 THEN (10.0 - sh) * 2.0 ELSE 0.0 END + CASE WHEN co >= 4 THEN 5.0 ELSE 0.0 END + CASE WHEN abs(a_aspect - b_aspect) < {q} THEN 6.0 ELSE 0.0 END"


@query(
    f"""{WITH}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id, burst_epoch // 720 ORDER BY photo_id) AS pos FROM photos)
    SELECT a, b, CAST({_AFFINITY.format(q='0.25::DOUBLE')} AS DOUBLE) AS affinity FROM (SELECT x.photo_id AS a, y.photo_id AS b, x.aspect AS a_aspect, y.aspect AS b_aspect, bit_count(xor(x.shell, y.shell)) AS sh, bit_count(xor(x.core, y.core)) AS co
    FROM n x JOIN n y ON x.session_id = y.session_id AND x.burst_epoch // 720 = y.burst_epoch // 720 AND y.pos BETWEEN x.pos + 1 AND x.pos + 8)"""
)
def q_affinity(spark, d):
    """Each photo against the next eight of its chapter: window leads instead of a self-join, so one exchange."""
    w = Window.partitionBy("session_id", F.expr("burst_epoch div 720")).orderBy("photo_id")
    ahead = F.collect_list(F.struct("photo_id", "shell", "core", "aspect")).over(w.rowsBetween(1, 8))
    p = photos(spark, d).select("photo_id", "shell", "core", F.col("aspect").alias("a_aspect"), ahead.alias("ahead")).select("photo_id", "shell", "core", "a_aspect", F.explode("ahead").alias("o"))
    p = p.selectExpr("photo_id AS a", "o.photo_id AS b", "a_aspect", "o.aspect AS b_aspect", "bit_count(shell ^ o.shell) AS sh", "bit_count(core ^ o.core) AS co")
    return p.select("a", "b", F.expr(_AFFINITY.format(q="0.25D")).cast("double").alias("affinity"))


@query(
    "SELECT p_partkey, arg_min(s.name, struct_pack(d := pow(p_size * 5 - s.r, 2) + pow(p_partkey % 256 - s.g, 2) + pow(p_partkey * 7 % 256 - s.b, 2), n := s.name)) AS swatch FROM part, (VALUES ('accent', 200, 80, 40), ('background', 250, 245, 235)) s(name, r, g, b) GROUP BY p_partkey"
)
def q_nearest_swatch(spark, d):
    """The nearer of a theme's two swatches: both distances in one expression, no cross join."""
    dist = lambda r, g, b: F.expr(f"pow(p_size * 5 - {r}, 2) + pow(p_partkey % 256 - {g}, 2) + pow(p_partkey * 7 % 256 - {b}, 2)")
    options = F.array(F.struct(dist(200, 80, 40).alias("d"), F.lit("accent").alias("n")), F.struct(dist(250, 245, 235).alias("d"), F.lit("background").alias("n")))
    return table(spark, d, "part").select("p_partkey", F.array_min(options)["n"].alias("swatch"))


@query("SELECT p.p_partkey, coalesce(n.n_name, 'Warm') AS theme, coalesce(r.r_name, 'Classic') AS family FROM part p LEFT JOIN nation n ON n.n_nationkey = p.p_size LEFT JOIN region r ON r.r_regionkey = n.n_regionkey")
def q_theme_dim(spark, d):
    """Fixed-size dimensions with a default for unknown keys."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    p = table(spark, d, "part").join(op.small_side(n), F.col("n_nationkey") == F.col("p_size"), "left")
    return p.select("p_partkey", F.coalesce("n_name", F.lit("Warm")).alias("theme"), F.coalesce("r_name", F.lit("Classic")).alias("family"))


@query(f"{WITH}, c AS (SELECT photo_id + 5 AS photo_id, session_id AS claimed FROM photos) SELECT c.photo_id, CASE WHEN p.photo_id IS NULL THEN 404 WHEN p.session_id <> c.claimed THEN 403 ELSE 200 END AS code FROM c LEFT JOIN photos p USING (photo_id)")
def q_ownership(spark, d):
    p = photos(spark, d).select("photo_id", "session_id")
    c = p.select((F.col("photo_id") + 5).alias("photo_id"), F.col("session_id").alias("claimed"))
    code = F.when(F.col("session_id").isNull(), 404).when(F.col("session_id") != F.col("claimed"), 403).otherwise(200)
    return c.join(p, "photo_id", "left").select("photo_id", code.alias("code"))


@query("SELECT coalesce(c.k, s.k) AS k, coalesce(c.v, s.v) AS v, c.k IS NOT NULL AS hit FROM (SELECT o_orderkey AS k, o_totalprice + 1 AS v FROM orders WHERE o_orderkey % 3 = 0) c FULL JOIN (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 2 = 0) s ON c.k = s.k")
def q_cache_fallback(spark, d):
    o = table(spark, d, "orders")
    c = o.where("o_orderkey % 3 = 0").selectExpr("o_orderkey AS k", "o_totalprice + 1 AS cv", "true AS hit")
    s = o.where("o_orderkey % 2 = 0").selectExpr("o_orderkey AS k", "o_totalprice AS sv")
    return c.join(s, "k", "full").select("k", F.coalesce("cv", "sv").alias("v"), F.coalesce("hit", F.lit(False)).alias("hit"))


_BOXES = "boxes AS (SELECT l_orderkey AS img, l_linenumber AS box, CAST(l_quantity AS DOUBLE) AS x0, CAST(l_partkey % 40 AS DOUBLE) AS y0, CAST(l_quantity + 20 AS DOUBLE) AS x1, CAST(l_partkey % 40 + 25 AS DOUBLE) AS y1 FROM lineitem)"


def boxes(spark, d):
    return table(spark, d, "lineitem").selectExpr("l_orderkey AS img", "l_linenumber AS box", "CAST(l_quantity AS DOUBLE) AS x0", "CAST(l_partkey % 40 AS DOUBLE) AS y0", "CAST(l_quantity + 20 AS DOUBLE) AS x1", "CAST(l_partkey % 40 + 25 AS DOUBLE) AS y1")


@query(
    f"""WITH {_BOXES}, o AS (SELECT a.img, a.box AS a, b.box AS b, greatest(0.0::DOUBLE, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0.0::DOUBLE, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS i,
    (a.x1 - a.x0) * (a.y1 - a.y0) AS aa, (b.x1 - b.x0) * (b.y1 - b.y0) AS ba FROM boxes a JOIN boxes b ON a.img = b.img AND a.box < b.box) SELECT img, a, b, round(i / (aa + ba - i), 6) AS iou FROM o WHERE i / (aa + ba - i) > 0.35::DOUBLE"""
)
def q_iou_pairs(spark, d):
    b = boxes(spark, d)
    a, c = (b.select("img", *(F.col(k).alias(f"{s}_{k}") for k in ("box", "x0", "y0", "x1", "y1"))) for s in ("a", "b"))
    p = a.join(c, "img").where("a_box < b_box").withColumn("iou", op.iou()).where("iou > 0.35D")
    return p.select("img", F.col("a_box").alias("a"), F.col("b_box").alias("b"), F.round("iou", 6).alias("iou"))


@query(
    """WITH r AS (SELECT e.event_id, 'px_' || (e.event_id % 4000) AS photo_id, e.event_id AS pos, CAST(json_extract(e.props, '$.k') AS BIGINT) AS k FROM events e)
    SELECT photo_id, arg_max(k, pos) AS k FROM r GROUP BY photo_id"""
)
def q_parse_metadata(spark, d):
    """JSON records, the last of a key holding; broken ones are dropped."""
    r = table(spark, d, "events").select(F.concat(F.lit("px_"), F.col("event_id") % 4000).alias("photo_id"), F.col("event_id").alias("pos"), F.from_json("props", "k long").alias("j"))
    return r.where("j IS NOT NULL").groupBy("photo_id").agg(F.max_by("j.k", "pos").alias("k"))


@query(
    f"""{WITH} SELECT 'thumb/' || session_id || '/px_' || photo_id || '_thumb.jpg' AS file, 'px_' || photo_id AS photo_id, CAST((photo_id * 7) % 100 AS DOUBLE) / 100 AS score, CAST(CASE WHEN photo_id % 4 = 0 THEN 0 ELSE photo_id % 4 END AS INTEGER) AS faces, photo_id % 3 = 0 AS blinks FROM photos WHERE photo_id % 5 <> 0"""
)
def q_upload_metadata(spark, d):
    """Thumbnails with what their chunk's JSON array says of them: keyed by file name, the last record of a photo holds, defaults where it says nothing."""
    p = photos(spark, d).select("session_id", "photo_id", (F.col("photo_id") / 40).cast("long").alias("chunk"))
    key = F.when(F.col("photo_id") % 5 != 0, F.concat(F.lit("px_"), "photo_id"))
    hero = F.when(F.col("photo_id") % 2 == 0, F.col("photo_id") * 7 % 100)
    first = F.struct(key.alias("photo_id"), F.lit(1).cast("double").alias("hero"), F.lit(9).alias("faces"), F.lit(True).alias("blinks"))
    last = F.struct(key.alias("photo_id"), F.coalesce(hero, F.col("photo_id") * 7 % 100).cast("double").alias("hero"), F.nullif(F.col("photo_id") % 4, F.lit(0)).cast("int").alias("faces"), F.when(F.col("photo_id") % 3 == 0, True).alias("blinks"))
    sent = p.groupBy("session_id", F.col("chunk").alias("seq")).agg(F.to_json(F.concat(F.collect_list(first), F.collect_list(last))).alias("metadata"))
    said = op.parsed_metadata(sent, "metadata", "hero: double, faces: int, blinks: boolean")
    files = p.select(F.concat(F.lit("thumb/"), "session_id", F.lit("/px_"), "photo_id", F.lit("_thumb.jpg")).alias("file"))
    j = files.withColumn("photo_id", op.file_key(F.col("file"))).join(said, "photo_id")
    return j.select("file", "photo_id", (F.coalesce("hero", F.lit(0.0)) / 100).alias("score"), F.coalesce("faces", F.lit(0)).alias("faces"), F.coalesce("blinks", F.lit(False)).alias("blinks"))


@query(
    f"""SELECT page_id, regexp_replace(url, '^https?://[^/]*/', '') AS key, {_STEM.replace("'[?#].*$', '')", "'[?#].*$', '')").replace("'^.*/', '')", "'^.*/', '')")} AS stem FROM pages"""
)
def q_stem(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^https?://[^/]*/", "").alias("key"), F.expr(_STEM).alias("stem"))
