"""Queries that aggregate."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates as op
from ..operators import quality, scans, selection
from .registry import query
from .views import WITH, photos, table

D = quality.double_literals
_CHUNK = "(row_number() OVER (PARTITION BY session_id ORDER BY photo_id) - 1) // 40"


def chunked(p):
    w = Window.partitionBy("session_id").orderBy("photo_id")
    return p.withColumn("chunk", F.expr("(rn - 1) div 40") if "rn" in p.columns else F.floor((F.row_number().over(w) - 1) / 40))


@query(
    f"""{WITH}, s AS (SELECT session_id, CAST({_CHUNK} AS BIGINT) AS chunk, {D(quality.STATUS)} AS status FROM photos)
    SELECT session_id, chunk, count(*) AS total, count(*) FILTER (WHERE status = 'PASSED') AS survived, count(*) FILTER (WHERE status = 'REJECTED_BLURRY') AS blurry,
    count(*) FILTER (WHERE status = 'REJECTED_EXPOSURE') AS exposure, count(*) FILTER (WHERE status = 'REJECTED_JUNK') AS junk, count(*) FILTER (WHERE status <> 'PASSED') AS rejected FROM s GROUP BY ALL"""
)
def q_filter_summary(spark, d):
    s = quality.with_status(chunked(photos(spark, d)))
    n = lambda x: F.count_if(F.col("status") == x)
    return s.groupBy("session_id", "chunk").agg(F.count("*").alias("total"), n("PASSED").alias("survived"), n("REJECTED_BLURRY").alias("blurry"), n("REJECTED_EXPOSURE").alias("exposure"), n("REJECTED_JUNK").alias("junk"), F.count_if(F.col("status") != "PASSED").alias("rejected"))


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS survived FROM customer")
def q_session_recount(spark, d):
    n = table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("survived"))


@query(f"{WITH} SELECT CAST(coalesce(sum(bytes), 0) AS BIGINT) AS total_bytes FROM photos")
def q_total_bytes(spark, d):
    return photos(spark, d).agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"))


@query(f"{WITH} SELECT session_id, CAST(coalesce(sum(bytes) FILTER (WHERE NOT synced AND upload_status = 1), 0) AS BIGINT) AS reserved FROM photos GROUP BY session_id")
def q_reserved_bytes(spark, d):
    return photos(spark, d).groupBy("session_id").agg(F.coalesce(F.sum(F.when(~F.col("synced") & (F.col("upload_status") == 1), F.col("bytes"))), F.lit(0)).alias("reserved"))


@query(f"{WITH} SELECT photo_id, CAST(sum(bytes) OVER (PARTITION BY session_id ORDER BY photo_id) AS BIGINT) AS used FROM photos")
def q_running_bytes(spark, d):
    return scans.running(photos(spark, d).select("session_id", "photo_id", "bytes"), "session_id", ["photo_id"], used=("sum", F.col("bytes"))).select("photo_id", "used")


@query(
    """WITH s AS (SELECT event_type AS step, CAST(round(value * 100) AS BIGINT) AS cents, ts, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events)
    SELECT step, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total, min(cents) AS least, max(cents) AS most, arg_max(cents, struct_pack(t := ts, e := event_id)) AS last FROM s WHERE r <= 100 GROUP BY step"""
)
def q_metrics_summary(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("step"), F.round(F.col("value") * 100).cast("long").alias("cents"), "ts", "event_id")
    return op.recent_summary(e, "step", "cents", ["ts", "event_id"])


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def q_recent_events(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "event_type")


@query(
    f"""{WITH} SELECT session_id, count(*) AS n, count(*) FILTER (WHERE epoch > 0) AS dated, count(*) FILTER (WHERE latitude IS NOT NULL) AS placed, max(faces) AS most_faces,
    count(DISTINCT [photo_id % 5, photo_id % 3]) AS palettes FROM photos GROUP BY session_id"""
)
def q_data_contract(spark, d):
    return photos(spark, d).groupBy("session_id").agg(F.count("*").alias("n"), F.count_if(F.col("epoch") > 0).alias("dated"), F.count("latitude").alias("placed"), F.max("faces").alias("most_faces"), F.count_distinct(F.array(F.col("photo_id") % 5, F.col("photo_id") % 3)).alias("palettes"))


@query("SELECT event_type, s[CAST(round_even(0.95::DOUBLE * (len(s) - 1), 0) AS INTEGER) + 1] AS p95, s[CAST(round_even(0.5::DOUBLE * (len(s) - 1), 0) AS INTEGER) + 1] AS p50 FROM (SELECT event_type, list_sort(list(value)) AS s FROM events GROUP BY event_type)")
def q_percentile(spark, d):
    return selection.nearest_ranks(table(spark, d, "events").select("event_type", "value"), "event_type", "value", p95=95.0, p50=50.0)


@query("SELECT event_type, median(value) AS middle, count(*) / (epoch_us(max(ts)) - epoch_us(min(ts))) AS per_us FROM events GROUP BY event_type")
def q_throughput(spark, d):
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    e = table(spark, d, "events").select("event_type", "value", "ts")
    rate = e.groupBy("event_type").agg((F.count("*") / (us(F.max("ts")) - us(F.min("ts")))).alias("per_us"))
    return selection.medians(e, "event_type", "value", "middle").join(rate, "event_type")


@query("SELECT p_brand, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS total, max(p_size) AS most, sum(p_size) / count(*) AS mean FROM part GROUP BY p_brand")
def q_corpus_stats(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("p_size").cast("long").alias("total"), F.max("p_size").alias("most"), (F.sum("p_size") / F.count("*")).alias("mean"))


@query(f"{WITH} SELECT photo_id % 8 AS kind, count(*) AS total, count(*) FILTER (WHERE {D(quality.STATUS)} = 'PASSED') AS survived, count(*) FILTER (WHERE {D(quality.STATUS)} = 'PASSED') / count(*) AS rate FROM photos GROUP BY photo_id % 8")
def q_survival_rate(spark, d):
    s = quality.with_status(photos(spark, d)).groupBy((F.col("photo_id") % 8).alias("kind")).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "PASSED").alias("survived"))
    return s.withColumn("rate", F.col("survived") / F.col("total"))


_NORM = "[(CAST(x AS DOUBLE) - list_min(h)) / (list_max(h) - list_min(h)) FOR x IN h]"


@query(
    """WITH e AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding[1:32]] AS h, [CAST(x AS DOUBLE) FOR x IN embedding[33:64]] AS g FROM embeddings), u AS (SELECT vec_id, unnest(h) AS x, unnest(g) AS y FROM e)
    SELECT vec_id, round(corr(x, y), 6) AS corr FROM u GROUP BY vec_id"""
)
def q_hist_corr(spark, d):
    half = lambda i: F.transform(F.slice("embedding", i, 32), lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.round(op.pearson(half(1), half(33)), 6).alias("corr"))


@query(f"{WITH} SELECT CASE WHEN photo_id % 2 = 0 THEN 'original' ELSE 'thumb' END || '/' || session_id || '/' AS prefix, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM photos GROUP BY 1")
def q_prefix_bytes(spark, d):
    kind = F.when(F.col("photo_id") % 2 == 0, "original").otherwise("thumb")
    return photos(spark, d).groupBy(F.concat(kind, F.lit("/"), "session_id", F.lit("/")).alias("prefix")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
