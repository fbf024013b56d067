"""Queries over chapters, heroes and covers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import quality, scans
from ..operators import stories as op
from .joins import HAVERSINE
from .registry import query
from .views import WITH, photos, table

D = quality.double_literals

MACRO = f"""o AS (SELECT *, lag(epoch) OVER w AS t0, lag(photo_id) OVER w AS p0, count(*) OVER (PARTITION BY session_id) AS n FROM photos WINDOW w AS (PARTITION BY session_id ORDER BY epoch, photo_id)),
  g AS (SELECT b.*, coalesce(b.epoch > 0 AND b.t0 > 0 AND abs(b.epoch - b.t0) > 2700, false) AS late, coalesce({HAVERSINE.format(a='a', b='b')} > 5, false) AS far FROM o b LEFT JOIN photos a ON a.photo_id = b.p0),
  r AS (SELECT *, sum(CAST(late OR far AS INTEGER)) OVER (PARTITION BY session_id ORDER BY epoch, photo_id ROWS UNBOUNDED PRECEDING) AS run FROM g),
  k AS (SELECT *, (row_number() OVER (PARTITION BY session_id, run ORDER BY epoch, photo_id) - 1) // CASE WHEN n > 200 THEN 24 WHEN n > 50 THEN 16 ELSE 12 END AS part FROM r),
  macro AS (SELECT *, dense_rank() OVER (PARTITION BY session_id ORDER BY run, part) AS chapter FROM k)"""
HERO = f"CAST({D(quality.HERO)} AS DOUBLE)"


@query(f"{WITH}, {MACRO} SELECT photo_id, session_id, chapter FROM macro")
def q_macro_chapters(spark, d):
    return op.macro_chapters(photos(spark, d)).select("photo_id", "session_id", "chapter")


@query(
    f"""{WITH}, {MACRO}, h AS (SELECT *, {HERO} AS hero, {D(quality.STATUS)} AS status FROM macro),
    t AS (SELECT *, row_number() OVER (PARTITION BY session_id, chapter ORDER BY hero DESC, major_faces DESC, face_quality DESC, blur DESC, contrast DESC, taken_at, photo_id) AS rn FROM h WHERE status = 'PASSED')
    SELECT session_id, chapter, photo_id, hero FROM t WHERE rn = 1"""
)
def q_chapter_covers(spark, d):
    """Which photo is the cover of each story chapter: the gate, chapters over all photos, each chapter's best survivor."""
    p = quality.with_hero(quality.with_status(op.macro_chapters(photos(spark, d)))).where("status = 'PASSED'")
    return op.hero_of(p, ["session_id", "chapter"]).where("is_hero").select("session_id", "chapter", "photo_id", "hero")


@query(
    f"""{WITH}, c AS (SELECT *, epoch_us(to_timestamp(taken_at)) AS us, hour(make_timestamp(CAST(floor(taken_at) AS BIGINT) * 1000000)) AS h, burst_epoch // 720 AS grp FROM photos),
    o AS (SELECT *, lag(taken_at) OVER w AS t0, lag(h) OVER w AS h0, count(*) OVER (PARTITION BY session_id, grp) AS n FROM c WINDOW w AS (PARTITION BY session_id, grp ORDER BY taken_at, photo_id)),
    r AS (SELECT *, sum(CAST(coalesce((taken_at - t0 > 600 OR h0 < 18 AND h >= 18) AND n >= 8, false) AS INTEGER)) OVER (PARTITION BY session_id, grp ORDER BY taken_at, photo_id ROWS UNBOUNDED PRECEDING) AS run FROM o),
    k AS (SELECT *, (row_number() OVER (PARTITION BY session_id, grp, run ORDER BY taken_at, photo_id) - 1) // CASE WHEN n >= 8 THEN 18 ELSE 1073741824 END AS part FROM r)
    SELECT photo_id, session_id, grp, dense_rank() OVER (PARTITION BY session_id, grp ORDER BY run, part) AS mini FROM k"""
)
def q_mini_chapters(spark, d):
    p = photos(spark, d).withColumn("grp", F.expr("burst_epoch div 720"))
    return op.mini_chapters(p, ["session_id", "grp"]).select("photo_id", "session_id", "grp", "mini")


@query(
    f"""{WITH}, {MACRO}, a AS (SELECT session_id, chapter, arg_min(taken_at, struct_pack(e := epoch, p := photo_id)) AS first_at, bool_or(faces = 0) AS bare FROM macro GROUP BY ALL),
    l AS (SELECT *, lead(chapter) OVER (PARTITION BY session_id ORDER BY chapter) IS NULL AS last, hour(make_timestamp(CAST(floor(first_at) AS BIGINT) * 1000000)) AS h FROM a)
    SELECT session_id, chapter, concat('Chapter ', chapter, CASE WHEN last THEN ': Highlights' ELSE ': Story Sequence' END) AS title,
    CASE WHEN h >= 18 OR h < 5 THEN 'Evening & Illuminated Views' WHEN bare THEN 'Candids & Details' ELSE 'Portraits & Pathway' END AS mood FROM l"""
)
def q_chapter_titles(spark, d):
    a = op.macro_chapters(photos(spark, d)).groupBy("session_id", "chapter").agg(F.min_by("taken_at", F.struct("epoch", "photo_id")).alias("first_at"), F.bool_or(F.col("faces") == 0).alias("bare"))
    last = F.lead("chapter").over(Window.partitionBy("session_id").orderBy("chapter")).isNull()
    h = F.hour(F.timestamp_seconds("first_at"))
    mood = F.when((h >= 18) | (h < 5), "Evening & Illuminated Views").when(F.col("bare"), "Candids & Details").otherwise("Portraits & Pathway")
    return a.select("session_id", "chapter", F.concat(F.lit("Chapter "), "chapter", F.when(last, ": Highlights").otherwise(": Story Sequence")).alias("title"), mood.alias("mood"))


_EVENT = f"e AS (SELECT *, {HERO} AS hero, burst_epoch // 720 AS event FROM photos), f AS (SELECT *, row_number() OVER w AS rn, first(hero) OVER w AS top FROM e WINDOW w AS (PARTITION BY session_id, event ORDER BY hero DESC, major_faces DESC, face_quality DESC, blur DESC, contrast DESC, taken_at, photo_id))"


def _events(spark, d):
    p = quality.with_hero(photos(spark, d)).withColumn("event", F.expr("burst_epoch div 720"))
    return op.hero_of(p, ["session_id", "event"])


@query(f"{WITH}, {_EVENT} SELECT session_id, event, photo_id FROM f WHERE rn = 1")
def q_event_hero(spark, d):
    return _events(spark, d).where("is_hero").select("session_id", "event", "photo_id")


@query(f"{WITH}, {_EVENT} SELECT session_id, event, photo_id FROM f WHERE rn > 1 AND abs(hero - top) <= 2")
def q_event_alternates(spark, d):
    return _events(spark, d).where("is_alternate").select("session_id", "event", "photo_id")


@query(f"{WITH}, {_EVENT} SELECT session_id, event, min(taken_at) AS starts, count(*) AS n, max(photo_id) FILTER (WHERE rn = 1) AS cover FROM f GROUP BY session_id, event")
def q_event_rollup(spark, d):
    return _events(spark, d).groupBy("session_id", "event").agg(F.min("taken_at").alias("starts"), F.count("*").alias("n"), F.max(F.when(F.col("is_hero"), F.col("photo_id"))).alias("cover"))


@query(f"{WITH}, {MACRO} SELECT session_id, CAST(count(*) FILTER (WHERE late) AS BIGINT) AS by_time, count(*) FILTER (WHERE NOT late AND far) AS by_place, count(*) FILTER (WHERE NOT late AND NOT far AND part > 0 AND pos = 1) AS by_size FROM (SELECT *, row_number() OVER (PARTITION BY session_id, chapter ORDER BY epoch, photo_id) AS pos FROM macro) GROUP BY session_id")
def q_split_reasons(spark, d):
    """Why chapters ended: the first reason that holds."""
    m = op.macro_chapters(photos(spark, d))
    w = Window.partitionBy("session_id").orderBy("epoch", "photo_id")
    m = m.withColumn("new", F.col("chapter") != F.lag("chapter").over(w))
    late, far = F.col("late"), F.col("far")
    return m.groupBy("session_id").agg(F.count_if(late).alias("by_time"), F.count_if(~late & far).alias("by_place"), F.count_if(F.col("new") & ~late & ~far).alias("by_size"))


@query(f"{WITH} SELECT photo_id, session_id, CAST((row_number() OVER (PARTITION BY session_id ORDER BY photo_id) - 1) // 40 AS BIGINT) AS chunk, CAST((row_number() OVER (PARTITION BY session_id ORDER BY photo_id) - 1) % 40 AS BIGINT) AS pos FROM photos")
def q_chunking(spark, d):
    """Upload chunks of 40, numbered by a prefix scan: a session may be any size."""
    p = scans.running(photos(spark, d).select("photo_id", "session_id"), "session_id", ["photo_id"], n=("count", F.lit(1)))
    return p.select("photo_id", "session_id", F.floor((F.col("n") - 1) / 40).alias("chunk"), ((F.col("n") - 1) % 40).cast("long").alias("pos"))


@query(f"{WITH} SELECT photo_id, pos FROM (SELECT photo_id, row_number() OVER (PARTITION BY session_id ORDER BY photo_id) - 1 AS pos FROM photos WHERE session_id = 'view-0') WHERE pos BETWEEN 18 AND 33")
def q_viewport_slice(spark, d):
    """Rows 20 to 31 of a session with two rows of margin."""
    rn = (F.row_number().over(Window.partitionBy("session_id").orderBy("photo_id")) - 1).cast("long")
    return photos(spark, d).where("session_id = 'view-0'").select("photo_id", rn.alias("pos")).where("pos BETWEEN 18 AND 33")


_CAPTIONS = ["FIRST LIGHT", "BLUE SKIES", "TOGETHER", "FOREVER"]


@query(f"{WITH}, {MACRO}, s AS (SELECT DISTINCT session_id, chapter, part, run FROM macro) SELECT session_id, chapter, {_CAPTIONS!r}[CAST((chapter - 1) % 4 AS INTEGER) + 1] AS caption FROM s")
def q_caption_cycle(spark, d):
    s = op.macro_chapters(photos(spark, d)).select("session_id", "chapter").distinct()
    return s.select("session_id", "chapter", F.element_at(F.array(*map(F.lit, _CAPTIONS)), (F.pmod(F.col("chapter") - 1, F.lit(4)) + 1).cast("int")).alias("caption"))


def covers_sql(grp: str) -> str:
    """SQL: covers of every book ``grp``; where fewer photos are left than a style needs, the overall ranking goes round."""
    wide = D("CASE WHEN aspect >= 1.35 THEN 15.0 WHEN aspect >= 1.0 THEN 5.0 ELSE 0.0 END")
    top = lambda rest, bonus: f"SELECT grp, photo_id, row_number() OVER (PARTITION BY grp ORDER BY hero + {bonus} DESC, faces DESC, photo_id) AS rank FROM b{rest}"
    return f"""{WITH}, b AS (SELECT {grp} AS grp, photo_id, faces, aspect, {HERO} AS hero FROM photos),
    c1 AS (SELECT * FROM ({top('', wide)}) WHERE rank <= 2),
    c2 AS (SELECT * FROM ({top(' WHERE photo_id NOT IN (SELECT photo_id FROM c1)', wide)}) WHERE rank <= 1),
    c3 AS (SELECT * FROM ({top(' WHERE photo_id NOT IN (SELECT photo_id FROM c1 UNION ALL SELECT photo_id FROM c2)', D('8.0'))}) WHERE rank <= 4),
    overall AS (SELECT grp, photo_id, row_number() OVER (PARTITION BY grp ORDER BY hero DESC, faces DESC, photo_id) AS o, count(*) OVER (PARTITION BY grp) AS pool FROM b),
    short AS (SELECT grp, style, least(n, greatest(0, pool - used)) AS had, n, pool FROM (SELECT DISTINCT grp, pool FROM overall), (VALUES ('SPLIT_BANNER', 2, 0), ('HERO_BAND', 1, 2), ('COLLAGE_2X2', 4, 3)) t(style, n, used)),
    slots AS (SELECT grp, style, had, pool, unnest(range(n - had)) AS slot FROM short)
    SELECT grp, 'SPLIT_BANNER' AS style, rank, photo_id FROM c1 UNION ALL SELECT grp, 'HERO_BAND', rank, photo_id FROM c2 UNION ALL SELECT grp, 'COLLAGE_2X2', rank, photo_id FROM c3
    UNION ALL SELECT s.grp, style, had + slot + 1, photo_id FROM slots s JOIN overall o ON o.grp = s.grp AND o.o = slot % s.pool + 1"""


@query(covers_sql("session_id || (photo_id // 200)"))
def q_cover_select_all(spark, d):
    """Covers of all books; those of fewer than 7 photos are padded."""
    p = quality.with_hero(photos(spark, d)).withColumn("grp", F.concat("session_id", F.expr("CAST(photo_id div 200 AS STRING)")))
    return op.select_covers(p, "grp")


@query(f"{WITH}, h AS (SELECT *, {HERO} AS hero FROM photos) SELECT session_id, burst_epoch // 5 AS burst, arg_max(photo_id, struct_pack(s := hero * 2 + blur + contrast * 1.5::DOUBLE, p := -photo_id)) AS best FROM h GROUP BY ALL")
def q_burst_best(spark, d):
    score = F.col("hero") * 2 + F.col("blur") + F.col("contrast") * 1.5
    return quality.with_hero(photos(spark, d)).groupBy("session_id", F.expr("burst_epoch div 5").alias("burst")).agg(F.max_by("photo_id", F.struct(score, -F.col("photo_id"))).alias("best"))


@query(f"{WITH} SELECT photo_id, row_number() OVER (PARTITION BY session_id ORDER BY CASE WHEN photo_id % 7 = 0 THEN 0 ELSE 1 END, photo_id) AS pos FROM photos WHERE NOT synced")
def q_priority_queue(spark, d):
    w = Window.partitionBy("session_id").orderBy(F.when(F.col("photo_id") % 7 == 0, 0).otherwise(1), "photo_id")
    return photos(spark, d).where("NOT synced").select("photo_id", F.row_number().over(w).cast("long").alias("pos"))


@query("SELECT l_partkey AS photo_id, min(l_orderkey * 10 + l_linenumber) AS first_pos FROM lineitem GROUP BY l_partkey")
def q_placed_ids(spark, d):
    """Distinct placed ids by first appearance."""
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("photo_id")).agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first_pos"))


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40)")
def q_unused(spark, d):
    used = table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").select("p_partkey").join(used, "p_partkey", "left_anti")
