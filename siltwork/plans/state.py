"""Queries over logs and changing tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import scans
from ..operators import state as op
from .registry import query
from .views import WITH, photos, table

_OLD = "SELECT o_orderkey AS k, o_orderstatus AS s, o_custkey AS c FROM orders WHERE o_orderkey % 2 = 0"
_NEW = "SELECT o_orderkey AS k, 'X' AS s FROM orders WHERE o_orderkey % 3 = 0"


def _old_new(spark, d):
    o = table(spark, d, "orders")
    return o.where("o_orderkey % 2 = 0").selectExpr("o_orderkey AS k", "o_orderstatus AS s", "o_custkey AS c"), o.where("o_orderkey % 3 = 0").selectExpr("o_orderkey AS k", "'X' AS s")


@query(f"SELECT coalesce(n.k, o.k) AS k, CASE WHEN n.k IS NOT NULL THEN n.s ELSE o.s END AS s, CASE WHEN n.k IS NULL THEN o.c END AS c FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.k = n.k")
def q_upsert_replace(spark, d):
    return op.upsert_replace(*_old_new(spark, d), "k")


@query(f"SELECT coalesce(n.k, o.k) AS k, CASE WHEN n.k IS NOT NULL THEN n.s ELSE o.s END AS s, o.c AS c FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.k = n.k")
def q_upsert_merge(spark, d):
    return op.upsert_merge(*_old_new(spark, d), "k")


@query(f"SELECT coalesce(n.k, o.k) AS k, CASE WHEN n.k IS NOT NULL THEN n.s ELSE o.s END AS s, o.c AS c FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.k = n.k")
def q_replay_idempotent(spark, d):
    """The same batch twice gives what it gives once."""
    old, new = _old_new(spark, d)
    return op.upsert_merge(op.upsert_merge(old, new, "k"), new, "k")


@query("SELECT user_id, arg_max(event_type, struct_pack(t := ts, e := event_id)) AS status, max(ts) AS last_seen, min(ts) AS created FROM events GROUP BY user_id")
def q_latest_state(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    now = op.latest(e, "user_id", ["ts", "event_id"]).select("user_id", F.col("event_type").alias("status"), F.col("ts").alias("last_seen"))
    return now.join(e.groupBy("user_id").agg(F.min("ts").alias("created")), "user_id")


@query(
    """WITH l AS (SELECT user_id, event_id, event_id % 7 * 100 AS bytes, lag(event_id % 7 * 100) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
    SELECT user_id, count(*) FILTER (WHERE before IS DISTINCT FROM bytes) AS changes, CAST(sum(CASE WHEN before IS DISTINCT FROM bytes THEN bytes - coalesce(before, 0) ELSE 0 END) AS BIGINT) AS counted FROM l GROUP BY user_id"""
)
def q_sync_delta(spark, d):
    """Only a confirmation that changes the size counts, by its difference."""
    b = (F.col("event_id") % 7 * 100).alias("bytes")
    l = table(spark, d, "events").select("user_id", "event_id", b).withColumn("before", F.lag("bytes").over(Window.partitionBy("user_id").orderBy("event_id")))  # noqa: E741
    new = ~F.col("before").eqNullSafe(F.col("bytes"))
    return l.groupBy("user_id").agg(F.count_if(new).alias("changes"), F.sum(F.when(new, F.col("bytes") - F.coalesce("before", F.lit(0))).otherwise(0)).alias("counted"))


@query("SELECT user_id, coalesce(arg_max(v, event_id) FILTER (WHERE v > 0), 0) AS declared FROM (SELECT user_id, event_id, event_id % 5 * 10 AS v FROM events) GROUP BY user_id")
def q_last_positive(spark, d):
    v = F.col("event_id") % 5 * 10
    return table(spark, d, "events").groupBy("user_id").agg(F.coalesce(F.max_by(F.when(v > 0, v), F.when(v > 0, F.col("event_id"))), F.lit(0)).alias("declared"))


@query("SELECT user_id, arg_max(CAST(json_extract(props, '$.k') AS BIGINT), event_id) AS k, CASE WHEN arg_max(event_type, event_id) = 'error' THEN 'failed' WHEN arg_max(event_type, event_id) = 'purchase' THEN 'completed' ELSE 'processing' END AS status FROM events GROUP BY user_id")
def q_job_state(spark, d):
    s = op.latest(table(spark, d, "events").select("user_id", "event_type", "props", "event_id"), "user_id", ["event_id"])
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").otherwise("processing")
    return s.select("user_id", F.from_json("props", "k long")["k"].alias("k"), status.alias("status"))


@query("SELECT c_custkey, c_name, CAST(0 AS BIGINT) AS presign_count, 'active' AS status, c_mktsegment FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_name, c_nationkey, 'active', 'none' FROM customer WHERE c_custkey % 2 = 1")
def q_schema_evolve(spark, d):
    """An old and a new layout of one table read together, missing columns defaulted."""
    want = {"c_custkey": ("long", None), "c_name": ("string", ""), "presign_count": ("long", 0), "status": ("string", "active"), "c_mktsegment": ("string", "none")}
    c = table(spark, d, "customer")
    old = op.evolve(c.where("c_custkey % 2 = 0").select("c_custkey", "c_name", "c_mktsegment"), want)
    return old.unionByName(op.evolve(c.where("c_custkey % 2 = 1").select("c_custkey", "c_name", F.col("c_nationkey").alias("presign_count")), want))


@query(
    f"""{WITH}, l AS (SELECT session_id, photo_id, bytes, taken_at, sum(bytes) OVER (PARTITION BY session_id ORDER BY taken_at DESC, photo_id DESC ROWS UNBOUNDED PRECEDING) AS newer FROM photos
    WHERE (SELECT max(taken_at) FROM photos) - taken_at <= 500000) SELECT session_id, photo_id FROM l WHERE newer <= 20000000"""
)
def q_lru_evict(spark, d):
    files, now = op.with_newest(photos(spark, d), "taken_at")
    files = files.select("session_id", F.col("photo_id").alias("file"), F.col("taken_at").alias("mtime"), "bytes", now)
    return op.evict(files, "session_id", F.col(now), 500000.0, 20_000_000).select("session_id", F.col("file").alias("photo_id"))


@query(
    f"""{WITH}, r AS (SELECT session_id, photo_id, bytes, taken_at, (SELECT max(taken_at) FROM photos) AS now, least(40000000, sum(bytes) OVER (PARTITION BY session_id) + 30000000 - 200000000) AS room FROM photos),
    l AS (SELECT *, sum(bytes) OVER (PARTITION BY session_id ORDER BY taken_at DESC, photo_id DESC ROWS UNBOUNDED PRECEDING) AS newer FROM r WHERE now - taken_at <= 2000000) SELECT session_id, photo_id FROM l WHERE newer <= room"""
)
def q_lru_floor(spark, d):
    """Eviction that also keeps 200 MB of the disk free, of which 30 MB are."""
    files, now = op.with_newest(photos(spark, d), "taken_at")
    files = files.select("session_id", F.col("photo_id").alias("file"), F.col("taken_at").alias("mtime"), "bytes", now)
    return op.evict(files, "session_id", F.col(now), 2000000.0, 40_000_000, F.lit(30_000_000), 200_000_000).select("session_id", F.col("file").alias("photo_id"))


@query("SELECT count(*) AS rows, count(*) > 0 AS alive FROM events")
def q_alive(spark, d):
    """Whether the session answers and the store can be read: the row counts of the files' footers."""
    return table(spark, d, "events").agg(F.count("*").alias("rows")).withColumn("alive", F.col("rows") > 0)


@query("SELECT e.event_id FROM events e WHERE e.ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAY AND e.user_id NOT IN (SELECT user_id FROM events GROUP BY user_id HAVING max(ts) < (SELECT max(ts) FROM events) - INTERVAL 2 DAY)")
def q_retention(spark, d):
    """Rows young enough, of sessions that are not expired."""
    e, now = op.with_newest(table(spark, d, "events").select("event_id", "user_id", "ts"), "ts")
    gone = e.groupBy("user_id").agg(F.max("ts").alias("last"), F.max(now).alias(now)).where(F.col("last") < F.col(now) - F.expr("INTERVAL 2 DAYS")).select("user_id")
    return e.where(F.col("ts") >= F.col(now) - F.expr("INTERVAL 30 DAYS")).join(gone, "user_id", "left_anti").select("event_id")


@query("SELECT event_id, CASE WHEN code BETWEEN 400 AND 499 AND code <> 429 THEN 'permanent' WHEN code >= 400 THEN 'retry' ELSE 'ok' END AS kind, CASE WHEN code >= 500 OR code = 429 THEN CAST(pow(2, event_id % 3) AS INTEGER) END AS delay FROM (SELECT event_id, [200, 404, 429, 500, 503][CAST(event_id % 5 AS INTEGER) + 1] AS code FROM events)")
def q_retry_class(spark, d):
    code = F.element_at(F.array(*map(F.lit, (200, 404, 429, 500, 503))), (F.col("event_id") % 5 + 1).cast("int"))
    e = table(spark, d, "events").select("event_id", code.alias("code"))
    kind = F.when(F.col("code").between(400, 499) & (F.col("code") != 429), "permanent").when(F.col("code") >= 400, "retry").otherwise("ok")
    return e.select("event_id", kind.alias("kind"), F.when((F.col("code") >= 500) | (F.col("code") == 429), F.pow(F.lit(2), F.col("event_id") % 3).cast("int")).alias("delay"))


@query(
    """WITH n AS (SELECT user_id, event_id, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    s AS (SELECT *, max(CASE WHEN bad THEN 0 ELSE n END) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS since FROM n) SELECT event_id, n - since AS streak, n - since >= 2 AS open FROM s"""
)
def q_circuit_breaker(spark, d):
    s = scans.islands(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", ["event_id"], F.col("event_type") == "error")
    return s.select("event_id", "streak", (F.col("streak") >= 2).alias("open"))


@query("SELECT user_id, count(*) AS presigned, count(*) > 70 AS over_ceiling FROM events GROUP BY user_id")
def q_presign_ceiling(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("presigned")).withColumn("over_ceiling", F.col("presigned") > 70)


@query("SELECT user_id, CASE WHEN n >= 60 THEN 100 WHEN n >= 50 THEN 70 WHEN n >= 40 THEN 45 WHEN n >= 20 THEN 20 ELSE 10 END AS progress FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)")
def q_job_progress(spark, d):
    n = F.count("*")
    return table(spark, d, "events").groupBy("user_id").agg(F.when(n >= 60, 100).when(n >= 50, 70).when(n >= 40, 45).when(n >= 20, 20).otherwise(10).alias("progress"))


@query("SELECT event_type, user_id, max(event_id) AS event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY event_type, user_id")
def q_ttl_cache(spark, d):
    """What a cache still holds: the newest entry of each key within its time to live."""
    e, now = op.with_newest(table(spark, d, "events"), "ts")
    fresh = e.where(F.col("ts") > F.col(now) - F.expr("INTERVAL 1 HOUR"))
    return fresh.groupBy("event_type", "user_id").agg(F.max("event_id").alias("event_id"))


@query("SELECT user_id, count(DISTINCT event_id // 40) AS chunks, max(event_id // 40) = (SELECT max(event_id // 40) FROM events) AS final FROM events GROUP BY user_id")
def q_chunk_status(spark, d):
    """A session is complete when the last chunk of all has come; replays of a chunk change nothing."""
    e, last = op.with_newest(table(spark, d, "events").withColumn("chunk", F.floor(F.col("event_id") / 40)), "chunk")
    return e.groupBy("user_id").agg(F.count_distinct("chunk").alias("chunks"), (F.max("chunk") == F.max(last)).alias("final"))
