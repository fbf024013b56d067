"""Queries of the quality gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as op
from .registry import query
from .views import WITH, photos, table

D = op.double_literals


@query(f"{WITH} SELECT photo_id, {D(op.BAD_EXPOSURE)} AS bad_exposure FROM photos")
def q_exposure(spark, d):
    return photos(spark, d).select("photo_id", F.expr(D(op.BAD_EXPOSURE)).alias("bad_exposure"))


@query("SELECT vec_id, round(-sum(CASE WHEN n > 0 THEN n / t * log2(n / t) ELSE 0 END), 6) AS entropy FROM (SELECT vec_id, v.n, sum(v.n) OVER (PARTITION BY vec_id) AS t FROM (SELECT vec_id, unnest([struct_pack(n := abs(CAST(x AS DOUBLE)), i := i) FOR x, i IN embedding[1:16]]) AS v FROM embeddings)) GROUP BY vec_id")
def q_entropy(spark, d):
    h = F.transform(F.slice("embedding", 1, 16), lambda x: F.abs(x.cast("double")))
    return table(spark, d, "embeddings").select("vec_id", F.round(op.entropy(h), 6).alias("entropy"))


@query(f"{WITH} SELECT photo_id, {D(op.JUNK)} AS junk FROM photos")
def q_junk_gate(spark, d):
    return photos(spark, d).select("photo_id", F.expr(D(op.JUNK)).alias("junk"))


@query(f"{WITH} SELECT photo_id, {D(op.BLURRY)} AS blurry FROM photos")
def q_blur(spark, d):
    return photos(spark, d).select("photo_id", F.expr(D(op.BLURRY)).alias("blurry"))


@query(f"{WITH} SELECT photo_id, {D(op.STATUS)} AS status FROM photos")
def q_status(spark, d):
    return op.with_status(photos(spark, d)).select("photo_id", "status")


@query(f"{WITH} SELECT session_id, {D(op.STATUS)} AS status, count(*) AS n FROM photos GROUP BY ALL")
def q_status_counts(spark, d):
    return op.with_status(photos(spark, d)).groupBy("session_id", "status").agg(F.count("*").alias("n"))


@query(
    f"""{WITH}, s AS (SELECT photo_id, session_id, burst_epoch AS moment, shell, blur, {D(op.STATUS)} AS status FROM photos)
    SELECT photo_id FROM s x WHERE status = 'REJECTED_BLURRY' AND blur >= 18 AND NOT EXISTS (SELECT 1 FROM s y
    WHERE y.session_id = x.session_id AND y.photo_id <> x.photo_id AND abs(y.moment - x.moment) <= 30 AND bit_count(xor(x.shell, y.shell)) <= 10)"""
)
def q_solo_anchor(spark, d):
    return op.solo_anchors(op.with_status(photos(spark, d)).withColumn("moment", F.col("burst_epoch")))


@query(f"{WITH} SELECT photo_id, {D(op.ORIENTATION)} AS orientation, {D(op.CLIENT_ORIENTATION)} AS client_orientation FROM photos")
def q_orientation(spark, d):
    return photos(spark, d).select("photo_id", F.expr(D(op.ORIENTATION)).alias("orientation"), F.expr(D(op.CLIENT_ORIENTATION)).alias("client_orientation"))


@query(f"{WITH} SELECT photo_id, CAST({D(op.HERO)} AS DOUBLE) AS hero, hero / 100 AS score FROM photos")
def q_hero_score(spark, d):
    return op.with_hero(photos(spark, d)).select("photo_id", "hero", (F.col("hero") / 100).alias("score"))


@query(f"{WITH} SELECT photo_id, {op.ROLE} AS layout_role FROM (SELECT *, CAST({D(op.HERO)} AS DOUBLE) AS hero FROM photos)")
def q_layout_role(spark, d):
    return op.with_role(op.with_hero(photos(spark, d))).select("photo_id", "layout_role")


_FACES = """faces_of AS (SELECT photo_id, CAST(i AS BIGINT) AS face, CAST(10 + (photo_id * 7 + i * 31) % 90 AS DOUBLE) AS size,
  CAST((photo_id * 3 + i * 17) % 100 / CAST(100 AS DOUBLE) AS DOUBLE) AS conf, CAST((photo_id * 5 + i * 29) % 100 / CAST(100 AS DOUBLE) AS DOUBLE) AS cx,
  CAST((photo_id * 11 + i * 41) % 100 / CAST(100 AS DOUBLE) AS DOUBLE) AS cy, CAST((photo_id * 13 + i * 7) % 40 / CAST(100 AS DOUBLE) - CAST(0.2 AS DOUBLE) AS DOUBLE) AS nose
  FROM (SELECT photo_id, unnest(range(faces)) AS i FROM photos))"""


def face_rows(spark, d):
    """Detected faces as rows: what a detector would emit for each photo."""
    i = photos(spark, d).where("faces > 0").select("photo_id", F.explode(F.expr("sequence(0L, faces - 1)")).alias("face"))
    return i.selectExpr(
        "photo_id", "face", "CAST(10 + (photo_id * 7 + face * 31) % 90 AS DOUBLE) AS size", "(photo_id * 3 + face * 17) % 100 / 100D AS conf",
        "(photo_id * 5 + face * 29) % 100 / 100D AS cx", "(photo_id * 11 + face * 41) % 100 / 100D AS cy", "(photo_id * 13 + face * 7) % 40 / 100D - 0.2D AS nose",
    )


@query(
    f"""{WITH}, {_FACES}, a AS (SELECT *, size * size / 1000000 AS area FROM faces_of), m AS (SELECT *, max(area) OVER (PARTITION BY photo_id) AS top FROM a),
    k AS (SELECT *, NOT (size < 24 OR area < 0.15::DOUBLE * top AND top > 0.0005::DOUBLE AND conf < 0.88::DOUBLE) AS good FROM m),
    w AS (SELECT *, bool_or(good) OVER (PARTITION BY photo_id) AS any_good FROM k)
    SELECT photo_id, list(face ORDER BY face) AS kept FROM w WHERE good OR NOT any_good GROUP BY photo_id"""
)
def q_face_filter(spark, d):
    """Tiny or faint faces go, unless none would be left."""
    f = face_rows(spark, d).groupBy("photo_id").agg(F.array_sort(F.collect_list(F.struct("face", "size", "conf", (F.col("size") * F.col("size") / 1000000).alias("area")))).alias("fs"))
    top = F.array_max(F.transform("fs", lambda x: x["area"]))
    good = F.filter("fs", lambda x: ~((x["size"] < 24) | ((x["area"] < F.lit(0.15) * top) & (top > 0.0005) & (x["conf"] < 0.88))))
    return f.select("photo_id", F.transform(F.when(F.size(good) > 0, good).otherwise(F.col("fs")), lambda x: x["face"]).alias("kept"))


_GRID = "concat(CASE WHEN cy < {a} THEN 'top' WHEN cy > {b} THEN 'bottom' ELSE 'middle' END, '_', CASE WHEN cx < {a} THEN 'left' WHEN cx > {b} THEN 'right' ELSE 'center' END)"
_POSE = "CASE WHEN nose < {m} THEN 'LEFT' WHEN nose > {p} THEN 'RIGHT' ELSE 'FRONT' END"


@query(f"{WITH}, {_FACES} SELECT photo_id, face, {_GRID.format(a='0.33::DOUBLE', b='0.66::DOUBLE')} AS cell, {_POSE.format(m='-0.15::DOUBLE', p='0.15::DOUBLE')} AS pose FROM faces_of")
def q_face_grid(spark, d):
    return face_rows(spark, d).select("photo_id", "face", F.expr(_GRID.format(a="0.33D", b="0.66D")).alias("cell"), F.expr(_POSE.format(m="-0.15D", p="0.15D")).alias("pose"))


_COMPOSITION = "CASE WHEN n = 1 THEN 'SOLO' WHEN n = 2 THEN 'COUPLE' WHEN n <= 4 THEN 'SMALL_GROUP' ELSE 'GROUP' END"


@query(
    f"""{WITH}, {_FACES}, a AS (SELECT *, size * size / 1000000 AS area FROM faces_of), t AS (SELECT *, max(area) OVER (PARTITION BY photo_id) AS top FROM a)
    SELECT photo_id, n, n_major, {_COMPOSITION} AS composition FROM (SELECT photo_id, count(*) AS n, count(*) FILTER (WHERE area >= 0.35::DOUBLE * top OR area >= 0.0015::DOUBLE) AS n_major FROM t GROUP BY photo_id)"""
)
def q_composition(spark, d):
    f = face_rows(spark, d).groupBy("photo_id").agg(F.collect_list(F.col("size") * F.col("size") / 1000000).alias("areas"))
    top = F.array_max("areas")
    g = f.select("photo_id", F.size("areas").cast("long").alias("n"), F.size(F.filter("areas", lambda a: (a >= F.lit(0.35) * top) | (a >= 0.0015))).cast("long").alias("n_major"))
    return g.withColumn("composition", F.expr(_COMPOSITION))


@query(
    f"""{WITH}, {_FACES}, a AS (SELECT *, size * size / 1000000 AS area FROM faces_of)
    SELECT photo_id, count(*) AS n_faces, arg_max(face, struct_pack(a := area, f := -face)) AS main_face, CAST(sum(CAST(round(conf * 100) AS BIGINT)) AS BIGINT) AS conf_points FROM a GROUP BY photo_id"""
)
def q_face_agg(spark, d):
    area = F.col("size") * F.col("size") / 1000000
    return face_rows(spark, d).groupBy("photo_id").agg(F.count("*").alias("n_faces"), F.max_by("face", F.struct(area, -F.col("face"))).alias("main_face"), F.sum(F.round(F.col("conf") * 100).cast("long")).alias("conf_points"))


_DPI = "least(width / greatest(0.1, 0.45 * 420.0 / 25.4), height / greatest(0.1, 0.40 * 210.0 / 25.4))"


@query(f"{WITH} SELECT photo_id, dpi, CASE WHEN dpi >= 250 THEN 'excellent' WHEN dpi >= 150 THEN 'warning' ELSE 'alert' END AS badge FROM (SELECT photo_id, {D(_DPI)} AS dpi FROM photos)")
def q_dpi(spark, d):
    p = photos(spark, d).select("photo_id", F.expr(D(_DPI)).alias("dpi"))
    return p.withColumn("badge", F.when(F.col("dpi") >= 250, "excellent").when(F.col("dpi") >= 150, "warning").otherwise("alert"))


@query(f"{WITH} SELECT photo_id, least(greatest(aspect, 0.33::DOUBLE), 3.0::DOUBLE) AS clamped FROM photos")
def q_aspect_clamp(spark, d):
    return photos(spark, d).select("photo_id", F.least(F.greatest("aspect", F.lit(0.33)), F.lit(3.0)).alias("clamped"))


_MIMES = ["image/jpeg; charset=x", "IMAGE/JPG", "image/png", "image/webp", "text/html", "image/heic", "image/gif", ""]
_KINDS = {"image/jpeg": "jpg", "image/png": "png", "image/webp": "webp", "image/heic": "heic"}


@query(
    f"""{WITH}, u AS (SELECT photo_id, {_MIMES!r}[CAST(photo_id % 8 AS INT) + 1] AS mime, CASE WHEN photo_id % 9 = 0 THEN 'bad id!' ELSE concat('px_', photo_id) END AS name FROM photos),
    n AS (SELECT *, replace(lower(trim(split_part(mime, ';', 1))), 'image/jpg', 'image/jpeg') AS kind FROM u)
    SELECT photo_id, MAP {{'image/jpeg': 'jpg', 'image/png': 'png', 'image/webp': 'webp', 'image/heic': 'heic'}}[kind] AS extension, regexp_full_match(name, '[A-Za-z0-9_-]{{1,64}}') AS name_ok FROM n"""
)
def q_upload_policy(spark, d):
    mime = F.element_at(F.array(*map(F.lit, _MIMES)), (F.col("photo_id") % 8 + 1).cast("int"))
    kind = F.replace(F.lower(F.trim(F.substring_index(mime, ";", 1))), F.lit("image/jpg"), F.lit("image/jpeg"))
    name = F.when(F.col("photo_id") % 9 == 0, "bad id!").otherwise(F.concat(F.lit("px_"), "photo_id"))
    known = F.create_map(*(F.lit(x) for kv in _KINDS.items() for x in kv))
    return photos(spark, d).select("photo_id", F.try_element_at(known, kind).alias("extension"), name.rlike("^[A-Za-z0-9_-]{1,64}$").alias("name_ok"))


@query(f"{WITH} SELECT session_id, photo_id, status FROM (SELECT session_id, photo_id, {D(op.STATUS)} AS status FROM photos) WHERE status <> 'PASSED'")
def q_rejected_union(spark, d):
    """The rejected classes, one after another."""
    p = op.with_status(photos(spark, d)).select("session_id", "photo_id", "status")
    parts = [p.where(F.col("status") == s) for s in ("REJECTED_EXPOSURE", "REJECTED_JUNK", "REJECTED_BLURRY")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
