"""Queries of scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..operators import quality
from .registry import query
from .views import WITH, photos, table


@query(f"{WITH} SELECT a.photo_id, CASE WHEN b.photo_id IS NULL THEN 99 ELSE CAST(bit_count(xor(a.shell, b.shell)) AS INTEGER) END AS bits FROM photos a LEFT JOIN photos b ON b.photo_id = a.photo_id + 1")
def q_hamming(spark, d):
    p = photos(spark, d).select("photo_id", "shell")
    n = p.select((F.col("photo_id") - 1).alias("photo_id"), F.col("shell").alias("next"))
    return p.join(n, "photo_id", "left").select("photo_id", quality.hamming("shell", "next").alias("bits"))


@query("SELECT event_id, CASE WHEN event_id % 4 IN (2, 3) THEN -(event_id % 90 + event_id % 60 / 60.0::DOUBLE + event_id % 59 / 3600.0::DOUBLE) ELSE event_id % 90 + event_id % 60 / 60.0::DOUBLE + event_id % 59 / 3600.0::DOUBLE END AS degrees FROM events")
def q_dms(spark, d):
    i = F.col("event_id")
    ref = F.element_at(F.array(*map(F.lit, "NESW")), (i % 4 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", fn.degrees(i % 90, i % 60, i % 59, ref).alias("degrees"))


_NAMES = "CASE event_id % 5 WHEN 0 THEN 'IMG_' || {t} WHEN 1 THEN 'VID-' || {day} || '-WA0001.jpg' WHEN 2 THEN 'photo.jpg' WHEN 3 THEN '20231945_101010.jpg' ELSE 'PXL_' || {t} || '.jpg' END"


@query(
    f"""WITH n AS (SELECT event_id, {_NAMES.format(t="strftime(ts, '%Y%m%d_%H%M%S')", day="strftime(ts, '%Y%m%d')")} AS name FROM events),
    m AS (SELECT event_id, regexp_extract(name, '{fn.FILE_DATE}', ['y', 'm', 'd', 'h', 'i', 's']) AS g FROM n)
    SELECT event_id, epoch(try_strptime(g.y || g.m || g.d || CASE WHEN g.h = '' THEN '120000' ELSE g.h || coalesce(nullif(g.i, ''), '00') || coalesce(nullif(g.s, ''), '00') END, '%Y%m%d%H%M%S'))::BIGINT AS at FROM m"""
)
def q_filename_date(spark, d):
    name = F.expr(_NAMES.format(t="date_format(ts, 'yyyyMMdd_HHmmss')", day="date_format(ts, 'yyyyMMdd')"))
    return table(spark, d, "events").select("event_id", F.unix_seconds(fn.filename_time(name)).alias("at"))


@query(
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN epoch_us(ts) // 1000000 WHEN event_id % 3 = 1 AND event_id % 4 <> 0 THEN 1700000000 + event_id WHEN event_id % 5 <> 0 THEN 1600000000 + event_id ELSE 0 END AS at,
    CASE WHEN event_id % 3 = 0 THEN 'exif' WHEN event_id % 3 = 1 AND event_id % 4 <> 0 THEN 'client' WHEN event_id % 5 <> 0 THEN 'mtime' ELSE 'unknown' END AS date_source FROM events"""
)
def q_capture_time(spark, d):
    """Trusted camera time, else the client's, else the file's, else 0."""
    i = F.col("event_id")
    exif = F.when(i % 3 == 0, F.unix_seconds(F.col("ts").cast("timestamp")))
    client = F.when(i % 3 == 1, F.nullif(F.when(i % 4 != 0, 1700000000 + i).otherwise(0), F.lit(0)))
    mtime = F.when(i % 5 != 0, 1600000000 + i)
    source = F.when(exif.isNotNull(), "exif").when(client.isNotNull(), "client").when(mtime.isNotNull(), "mtime").otherwise("unknown")
    return table(spark, d, "events").select("event_id", F.coalesce(exif, client, mtime, F.lit(0)).alias("at"), source.alias("date_source"))


@query("SELECT event_id, epoch_us(ts) // 1000000 AS at FROM events WHERE event_id % 7 <> 0 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 7 = 0")
def q_iso_time(spark, d):
    """Seconds of ISO texts as clients send them, null where a text is none."""
    text = F.when(F.col("event_id") % 7 == 0, "yesterday").otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    return table(spark, d, "events").select("event_id", F.unix_seconds(F.try_to_timestamp(text)).alias("at"))


@query("SELECT event_id, strftime(ts, '%b %d, %Y %I:%M %p') AS label FROM events")
def q_date_fmt(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format("ts", "MMM dd, yyyy hh:mm a").alias("label"))


_RGB = "SELECT p_partkey, CAST(p_partkey * 7 % 256 AS INTEGER) AS r, CAST(p_partkey * 13 % 256 AS INTEGER) AS g, CAST(p_size * 5 AS INTEGER) AS b FROM part"


@query(f"SELECT p_partkey, lower(format('#{{:02x}}{{:02x}}{{:02x}}', r, g, b)) AS colour, r, g, b FROM ({_RGB})")
def q_hex_rgb(spark, d):
    """To hex and back."""
    c = table(spark, d, "part").select("p_partkey", fn.rgb_hex(F.col("p_partkey") * 7 % 256, F.col("p_partkey") * 13 % 256, F.col("p_size") * 5).alias("colour"))
    return c.select("p_partkey", "colour", *(fn.hex_channel(F.col("colour"), k).alias(n) for k, n in enumerate("rgb")))


@query(f"SELECT p_partkey, CASE WHEN (r * 299 + g * 587 + b * 114) / 1000 >= 128 THEN '#121212' ELSE '#FFFFFF' END AS ink FROM ({_RGB})")
def q_yiq(spark, d):
    return table(spark, d, "part").select("p_partkey", fn.text_colour(F.col("p_partkey") * 7 % 256, F.col("p_partkey") * 13 % 256, F.col("p_size") * 5).alias("ink"))


_CATEGORY = "CASE " + " ".join(f"WHEN {' OR '.join(f'''contains(lower(prompt), '{w}')''' for w in ws)} THEN '{c}'" for c, ws in fn.CATEGORIES) + " ELSE 'Family' END"
_PROMPTS = ["Temple Visit", "our WEDDING day", "Beach trip", "selfie", "College days", "Grandma", "Birthday portrait"]
_PROMPT = "SELECT c_custkey, [" + ", ".join(f"'{p}'" for p in _PROMPTS) + "][CAST(c_custkey % 7 AS INTEGER) + 1] AS prompt FROM customer"


def prompts(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.element_at(F.array(*map(F.lit, _PROMPTS)), (F.col("c_custkey") % 7 + 1).cast("int")).alias("prompt"))


@query(f"SELECT c_custkey, {_CATEGORY} AS category FROM ({_PROMPT})")
def q_category(spark, d):
    return prompts(spark, d).select("c_custkey", fn.category(F.col("prompt")).alias("category"))


@query(f"SELECT c_custkey, coalesce(nullif(upper(prompt), ''), 'CHERISHED MOMENTS') AS title, 'CHRONICLES OF ' || upper(prompt) AS second FROM ({_PROMPT})")
def q_title(spark, d):
    up = F.upper("prompt")
    return prompts(spark, d).select("c_custkey", F.coalesce(F.nullif(up, F.lit("")), F.lit("CHERISHED MOMENTS")).alias("title"), F.concat(F.lit("CHRONICLES OF "), up).alias("second"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]*/', '') AS key, regexp_extract(url, '^(https?://[^/]*)/', 1) AS origin, starts_with(url, 'https://') AS secure FROM pages")
def q_url_key(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_replace(u, "[?#].*$", ""), "^https?://[^/]*/", "").alias("key"), F.regexp_extract(u, "^(https?://[^/]*)/", 1).alias("origin"), u.startswith("https://").alias("secure"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '[\"' || event_type || '\",\"' || user_id || '\"]' AS colours FROM events")
def q_json_roundtrip(spark, d):
    """Arrays and records through JSON text and back."""
    e = table(spark, d, "events").withColumn("colours", F.to_json(F.array("event_type", F.col("user_id").cast("string"))))
    back = F.from_json("colours", "array<string>")
    return e.select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.to_json(back).alias("colours"))


@query("SELECT o_orderkey, left(sha256('{\"k\":' || o_orderkey || ',\"s\":\"' || o_orderstatus || '\"}'), 16) AS digest FROM orders")
def q_sha_slot(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.substring(F.sha2(F.to_json(F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))), 256), 1, 16).alias("digest"))


def fit_sql(a: str, x: str, y: str, w: str, h: str) -> str:
    """DuckDB: the struct of a box fitted in another."""
    wide = f"({w} * 2.0 / {h}) > {a}"
    bw, bh = f"(CASE WHEN {wide} THEN {h} * {a} / 2.0 ELSE {w} END)", f"(CASE WHEN {wide} THEN {h} ELSE {w} * 2.0 / {a} END)"
    return f"struct_pack(x := {x} + ({w} - {bw}) / 2.0, y := {y} + ({h} - {bh}) / 2.0, w := {bw}, h := {bh})"


@query(f"{WITH} SELECT photo_id, f.x, f.y, f.w, f.h FROM (SELECT photo_id, {fit_sql('aspect', '0.025::DOUBLE', '0.05::DOUBLE', '0.436::DOUBLE', '0.89::DOUBLE')} AS f FROM photos)")
def q_fit_box(spark, d):
    box = fn.fit_box(F.col("aspect"), 0.025, 0.05, 0.436, 0.89)
    return photos(spark, d).select("photo_id", *(c.alias(n) for c, n in zip(box, "xywh", strict=True)))


@query("SELECT side, has_text, CASE WHEN side = 'left' THEN 0.025::DOUBLE ELSE 0.539::DOUBLE END AS x, 0.05::DOUBLE AS y, 0.436::DOUBLE AS w, CASE WHEN has_text THEN 0.81::DOUBLE ELSE 0.89::DOUBLE END AS h FROM (VALUES ('left', true), ('left', false), ('right', true), ('right', false)) t(side, has_text)")
def q_safe_bounds(spark, d):
    rows = [(s, t, *(round(v, 6) for v in fn.safe_bounds(s == "left", t))) for s in ("left", "right") for t in (True, False)]
    return spark.createDataFrame(rows, "side string, has_text boolean, x double, y double, w double, h double")


@query("SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN '  ' WHEN c_custkey % 3 = 1 THEN c_mktsegment END), ''), 'default') AS setting FROM customer")
def q_env_default(spark, d):
    raw = F.when(F.col("c_custkey") % 3 == 0, "  ").when(F.col("c_custkey") % 3 == 1, F.col("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", F.coalesce(F.nullif(F.trim(raw), F.lit("")), F.lit("default")).alias("setting"))


_KEYS = "CASE p_partkey % 7 WHEN 0 THEN 'original/s1/' || p_name || '.jpg' WHEN 1 THEN '/abs/x' WHEN 2 THEN 'a/../b' WHEN 3 THEN 'C:/x' WHEN 4 THEN 'a\\\\b' WHEN 5 THEN '' ELSE 'thumb/s1/px_1.webp' END"


@query(f"SELECT p_partkey, regexp_full_match(key, '[A-Za-z0-9._-]+(/[A-Za-z0-9._-]+)*') AND NOT regexp_matches(key, '(^|/)\\.\\.(/|$)') AND NOT regexp_matches(key, '^[A-Za-z]:') AS ok FROM (SELECT p_partkey, {_KEYS.replace('a' + chr(92) * 2 + 'b', 'a' + chr(92) + 'b')} AS key FROM part)")
def q_key_validate(spark, d):
    return table(spark, d, "part").select("p_partkey", fn.valid_key(F.expr(_KEYS)).alias("ok"))
