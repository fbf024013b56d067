"""Streaming queries, run over what is there; batch twins where a result can be compared."""

from __future__ import annotations

import uuid

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators import folds, quality
from ..sources.scratch import setting, shared_dir, temporary
from ..streaming import live, sessions
from ..streaming.ordered import machine
from . import clusters  # noqa: F401  the batch twins
from .aggregates import _CHUNK, chunked
from .clusters import RECURSIVE, _SAVED, bursts_sql
from .registry import ORACLES, query
from .stories import MACRO
from .views import WITH, photos, table


def _run(spark, d, make):
    """A stream over the events as they lie there, all files in one batch: their times may overlap in any way."""
    path = f"{d}/events.parquet"
    base = temporary(spark, f"{shared_dir(spark)}/siltwork-stream-{uuid.uuid4().hex}")
    # a table may be one file; as a stream's path only a pattern may name one
    return live.drained(make(live.source(spark, f"{d}/events.[p]arquet", spark.read.parquet(path).schema, None)), f"{base}/out", f"{base}/checkpoint")


@query(
    """WITH l AS (SELECT *, ts - lag(ts) OVER w >= INTERVAL 45 MINUTE AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, count(*) FILTER (WHERE new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS spell FROM l), w AS (SELECT user_id, spell, min(ts) AS starts, max(ts) + INTERVAL 45 MINUTE AS ends, count(*) AS n, min(event_id) AS first_id FROM s GROUP BY user_id, spell)
    SELECT user_id, starts, ends, n, first_id FROM w WHERE date_trunc('millisecond', ends) < date_trunc('millisecond', (SELECT max(ts) FROM events) - INTERVAL 2 HOUR)"""
)
def q_stream_chapters(spark, d):
    """Session windows that have closed; the last open ones are held back by the watermark."""
    rows = _run(spark, d, live.session_windows)
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("starts", "ends")})


@query(
    """WITH w AS (SELECT event_type, date_trunc('hour', ts) AS starts, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ALL)
    SELECT event_type, starts, n, cents FROM w WHERE starts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR"""
)
def q_stream_metrics(spark, d):
    """Hours that have closed."""
    return _run(spark, d, live.rolling_metrics).withColumn("starts", F.col("starts").cast("timestamp_ntz"))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def q_stream_ingest(spark, d):
    """Micro-batches upserted by key, then the current rows."""
    events = table(spark, d, "events").select("user_id", "event_id", "event_type")
    base = temporary(spark, f"{shared_dir(spark)}/siltwork-stream-{uuid.uuid4().hex}")
    events.repartition(4, "event_id").write.parquet(f"{base}/in")
    stream = live.source(spark, f"{base}/in", events.schema, 1)
    stream.writeStream.foreachBatch(live.upsert_into(f"{base}/out", "user_id", ["event_id"])).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return live.current(spark, f"{base}/out", "user_id", ["event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT event_type, count(*) AS n FROM (SELECT event_type, ts, ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) AS gap FROM events) WHERE gap IS NULL OR gap > INTERVAL 45 MINUTE GROUP BY event_type")
def q_session_windows(spark, d):
    """Chapters by gap alone, in batch."""
    w = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp")).groupBy(F.session_window("at", "45 minutes 1 microsecond"), "event_type").count()
    return w.groupBy("event_type").agg(F.count("*").alias("n"))


# --- arrivals out of order and more than once -----------------------------------

BATCHES = 4
DISORDER, LATE = 6 * 3600, "12 hours"  # how far rows arrive out of order, in seconds; how long the streams wait


def deal(rows: DataFrame, arrives: Column, id: str, folder: str, clock: str | None = None, batches: int = BATCHES) -> int:
    """Writes rows once, in a folder for each arrival (``arrives``, 0 to ``batches`` - 1), one row in ten again in the next; how many arrivals there are.

    ``clock`` names the time column; then a last arrival is a row without an id that comes
    ten days after all others, so that the stream's clock passes them.
    """
    k = arrives.cast("int")
    dealt = rows.withColumn("arrives", F.explode(F.when(F.col(id) % 10 == 3, F.array(k, k + 1)).otherwise(F.array(k))))
    dealt.write.partitionBy("arrives").parquet(folder)
    if clock:
        end = rows.sparkSession.read.schema(rows.schema).parquet(folder).agg((F.max(clock) + F.expr("INTERVAL 10 DAYS")).alias(clock))
        end.select(*(F.col(clock) if c == clock else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes)).write.parquet(f"{folder}/arrives={batches + 1}")
    return batches + 2


def by_time(rows: DataFrame, at: str, id: str, batches: int = BATCHES) -> Column:
    """The arrival of rows that come at their time plus up to ``DISORDER`` seconds."""
    low, high = rows.agg(F.min(at), F.max(at)).first()  # two numbers, of the rows that are dealt
    if low is None:
        return F.lit(0)
    span = (high - low).total_seconds() + DISORDER + 1
    behind = F.unix_seconds(F.col(at).cast("timestamp")) - F.unix_seconds(F.lit(low).cast("timestamp")) + F.pmod(F.col(id) * 7919, F.lit(DISORDER))
    return F.least(F.floor(behind * batches / span), F.lit(batches - 1))


def _streamed(spark: SparkSession, rows: DataFrame, arrives: Column, id: str, make: Callable[[DataFrame], DataFrame], clock: str | None = None) -> DataFrame:
    """The stream over rows as ``deal`` writes them. An arrival may be many files, so the stream takes it as one batch: a clock that its first files moved would make the rest late."""
    base = temporary(spark, f"{shared_dir(spark)}/siltwork-stream-{uuid.uuid4().hex}")
    schema = StructType([*rows.schema.fields, StructField("arrives", IntegerType())])
    arrivals = [f"arrives={k}" for k in range(deal(rows, arrives, id, f"{base}/dealt", clock))]
    live.make_folder(spark, f"{base}/in")
    come = [partial(live.moved, spark, f"{base}/dealt/{a}", f"{base}/in/{a}") for a in arrivals]
    return live.drained(make(live.source(spark, f"{base}/in", schema, None)), f"{base}/out", f"{base}/checkpoint", come)


def _machine(spark: SparkSession, rows: DataFrame, key: str, processor) -> DataFrame:
    """An ordered machine over rows with ts and event_id, dealt out of order and in part twice."""
    return _streamed(spark, rows, by_time(rows, "ts", "event_id"), "event_id", lambda s: machine(s, F.col(key), F.col("ts"), "event_id", processor.columns, processor, LATE), "ts")


_TIMED = f"{WITH}, timed AS (SELECT * REPLACE (taken_at AS epoch) FROM photos), " + MACRO.replace("FROM photos", "FROM timed").replace("JOIN photos", "JOIN timed")


@query(
    f"""{_TIMED} SELECT session_id, chapter, arg_min(photo_id, struct_pack(e := epoch, p := photo_id)) AS first_id, count(*) AS n,
    CAST(round(min(epoch) * 1000000) AS BIGINT) AS starts, CAST(round(max(epoch) * 1000000) AS BIGINT) AS ends FROM macro GROUP BY session_id, chapter"""
)
def q_stream_macro_chapters(spark, d):
    """Story chapters by time, place and capacity as they close, from photos out of order; those of the batch operator over the same times."""
    p = photos(spark, d).join(table(spark, d, "events").select(F.col("event_id").alias("photo_id"), "ts"), "photo_id")
    announced = p.groupBy("session_id").agg(F.count("*").alias("expected"))
    rows = p.join(announced, "session_id").select("session_id", F.col("photo_id").alias("event_id"), "ts", "latitude", "longitude", "expected")
    return _machine(spark, rows, "session_id", sessions.Chapters())


_CHUNK_SAVED = _SAVED.replace("y.session_id = x.session_id AND", "y.session_id = x.session_id AND y.chunk = x.chunk AND")
_MEMBERS = ["seq", *folds.BURST, "status"]


def _chunks(spark, d, make):
    p = quality.with_hero(quality.with_status(chunked(photos(spark, d)))).withColumn("moment", F.col("burst_epoch").cast("double")).withColumn("seq", F.col("photo_id"))
    size = F.count("*").over(Window.partitionBy("session_id", "chunk"))
    count = F.max("chunk").over(Window.partitionBy("session_id")) + 1  # numbered from 0
    rows = p.select("session_id", "chunk", size.alias("chunk_size"), count.alias("chunk_count"), *_MEMBERS)
    # a Python worker keeps the states of as many keys, and gives as many chunks, as a batch has rows before it sends them on
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "500"):
        return _streamed(spark, rows, F.pmod(F.col("photo_id") * 7919, F.lit(BATCHES)), "photo_id", lambda s: make(sessions.complete_chunks(s, _MEMBERS)))


@query(f"{RECURSIVE}, {_CHUNK_SAVED}, {bursts_sql('live')} SELECT c.session_id, c.chunk, c.photo_id, CASE WHEN NOT coalesce(b.survives, true) THEN 'REJECTED_BURST' ELSE c.status END AS status FROM c LEFT JOIN bursts b USING (photo_id)")
def q_stream_phase1(spark, d):
    """Phase 1 of every upload chunk once its photos have all come, in whichever order and however often; anchors are looked for in the chunk."""
    return _chunks(spark, d, lambda chunks: folds.chunk_status(chunks, ["session_id", "chunk"]))


@query(f"{WITH}, c AS (SELECT session_id, {_CHUNK} AS chunk FROM photos) SELECT session_id, count(DISTINCT chunk) AS chunks, CAST(1 AS BIGINT) AS ready FROM c GROUP BY session_id")
def q_stream_session_ready(spark, d):
    """How many chunks each session completed, and how often it became ready: once, with its last chunk."""
    done = _chunks(spark, d, lambda chunks: chunks.select("session_id", "chunk", "ready"))
    return done.groupBy("session_id").agg(F.count("*").alias("chunks"), F.count_if("ready").alias("ready"))


CEILING, ROOM = 12, 1500
_LEDGER = """r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_id % 3 = 0 AS asks, event_id % 8 AS photo, CASE WHEN event_id % 3 = 0 THEN event_id % 5 * 40 ELSE event_id % 7 * 100 END AS n FROM events),
    walk AS (SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, 0 AS code, list_transform(range(8), lambda x: 0::BIGINT) AS declared, list_transform(range(8), lambda x: false) AS asked, list_transform(range(8), lambda x: false) AS synced, list_transform(range(8), lambda x: 0::BIGINT) AS counted, 0::BIGINT AS presigns FROM r
      UNION ALL SELECT user_id, i, event_id, code,
        CASE WHEN asks AND code = 200 AND n > 0 THEN list_transform(range(8), lambda x: CASE WHEN x = photo THEN n ELSE declared[x + 1] END) ELSE declared END,
        CASE WHEN asks AND code = 200 THEN list_transform(range(8), lambda x: x = photo OR asked[x + 1]) ELSE asked END,
        CASE WHEN NOT asks THEN list_transform(range(8), lambda x: x = photo OR synced[x + 1]) ELSE synced END,
        CASE WHEN NOT asks THEN list_transform(range(8), lambda x: CASE WHEN x = photo THEN n ELSE counted[x + 1] END) ELSE counted END, presigns
      FROM (SELECT r.user_id, r.i, r.event_id, r.asks, r.photo, r.n, w.declared, w.asked, w.synced, w.counted, w.presigns + CAST(r.asks AS BIGINT) AS presigns,
        CASE WHEN NOT r.asks THEN 200 WHEN w.presigns + 1 > {ceiling} THEN 429 WHEN list_sum(w.counted) + list_sum(list_transform(range(8), lambda x: CASE WHEN w.asked[x + 1] AND NOT w.synced[x + 1] THEN w.declared[x + 1] ELSE 0 END)) + r.n > {room} THEN 413 ELSE 200 END AS code
        FROM walk w JOIN r ON r.user_id = w.user_id AND r.i = w.i + 1))
    SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS request, code, CAST(list_sum(counted) AS BIGINT) AS total,
      CAST(list_sum(list_transform(range(8), lambda x: CASE WHEN asked[x + 1] AND NOT synced[x + 1] THEN declared[x + 1] ELSE 0 END)) AS BIGINT) AS reserved, presigns FROM walk WHERE i > 0"""


@query("WITH RECURSIVE " + _LEDGER.replace("{ceiling}", str(CEILING)).replace("{room}", str(ROOM)))
def q_stream_ledger(spark, d):
    """Every presign's and confirmation's outcome and the session's sums after it."""
    e = table(spark, d, "events")
    asks = F.col("event_id") % 3 == 0
    n = F.when(asks, F.col("event_id") % 5 * 40).otherwise(F.col("event_id") % 7 * 100)
    rows = e.select(F.col("user_id").cast("string").alias("session_id"), "event_id", "ts", F.when(asks, "presign").otherwise("confirm").alias("kind"), (F.col("event_id") % 8).alias("photo"), n.alias("bytes"))
    return _machine(spark, rows, "session_id", sessions.Ledger(CEILING, ROOM))


CACHE_LIMIT, CACHE_SECONDS = 6, 86400.0


@query(
    f"""WITH RECURSIVE r AS (SELECT concat(event_type, '-', user_id % 4) AS cache, event_id, epoch_us(ts) AS tm, event_id * 7919 % 41 % 13 AS item, event_id % 3 = 0 AS put, row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY ts, event_id) AS i FROM events),
    walk AS (SELECT DISTINCT cache, 0::BIGINT AS i, NULL::BIGINT AS event_id, false AS hit, []::BIGINT[] AS items, []::BIGINT[] AS ends FROM r
      UNION ALL SELECT cache, i, event_id, NOT put AND p IS NOT NULL,
        CASE WHEN put THEN list_append(CASE WHEN len(rest) >= {CACHE_LIMIT} THEN rest[2:] ELSE rest END, item) WHEN p IS NOT NULL THEN list_append(rest, item) ELSE items END,
        CASE WHEN put THEN list_append(CASE WHEN len(rest) >= {CACHE_LIMIT} THEN left_ends[2:] ELSE left_ends END, tm + {int(CACHE_SECONDS * 1e6)}) WHEN p IS NOT NULL THEN list_append(left_ends, ends[p]) ELSE ends END
      FROM (SELECT *, list_transform(list_filter(list_zip(items, ends), lambda z: z[1] <> item), lambda z: z[1]) AS rest, list_transform(list_filter(list_zip(items, ends), lambda z: z[1] <> item), lambda z: z[2]) AS left_ends, list_position(items, item) AS p
        FROM (SELECT r.cache, r.i, r.event_id, r.tm, r.item, r.put, list_transform(list_filter(list_zip(w.items, w.ends), lambda z: z[2] > r.tm), lambda z: z[1]) AS items, list_filter(w.ends, lambda e: e > r.tm) AS ends FROM walk w JOIN r ON r.cache = w.cache AND r.i = w.i + 1)))
    SELECT cache, event_id AS request, hit, CAST(len(items) AS INTEGER) AS size FROM walk WHERE i > 0"""
)
def q_stream_cache(spark, d):
    """Hits and misses of caches limited in age and in number."""
    item, put = F.col("event_id") * 7919 % 41 % 13, F.col("event_id") % 3 == 0
    rows = table(spark, d, "events").select(F.expr("concat(event_type, '-', user_id % 4)").alias("cache"), "event_id", "ts", item.alias("item"), put.alias("put"))
    return _machine(spark, rows, "cache", sessions.Cache(CACHE_LIMIT, CACHE_SECONDS))


@query(
    """WITH RECURSIVE r AS (SELECT CAST(user_id AS VARCHAR) AS job, epoch_us(ts) AS tm, [200, 404, 429, 500, 503][CAST(event_id % 5 AS INTEGER) + 1] AS code, row_number() OVER w AS i, lead(epoch_us(ts)) OVER w AS following FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    walk AS (SELECT DISTINCT job, 0::BIGINT AS i, 1::BIGINT AS version, 'processing' AS status, 1 AS attempt, 0::BIGINT AS tm, NULL::BIGINT AS wake FROM r
      UNION ALL SELECT job, i, version, status, CASE WHEN status = 'waiting' THEN attempt + 1 ELSE attempt END, tm, CASE WHEN status = 'waiting' AND coalesce(following > tm + 1000000 * (1 << (attempt - 1)), true) THEN tm + 1000000 * (1 << (attempt - 1)) END
      FROM (SELECT *, CASE WHEN code < 400 THEN 'completed' WHEN code <> 429 AND code < 500 OR attempt > 3 THEN 'failed' ELSE 'waiting' END AS status
        FROM (SELECT r.job, r.i, r.tm, r.code, r.following, w.version + CASE WHEN w.status IN ('completed', 'failed') THEN 1 ELSE 0 END AS version, CASE WHEN w.status IN ('completed', 'failed') THEN 1 ELSE w.attempt END AS attempt FROM walk w JOIN r ON r.job = w.job AND r.i = w.i + 1)))
    SELECT job, version, status, attempt, tm AS at_us FROM walk WHERE i > 0 UNION ALL SELECT job, version, 'processing', attempt, wake FROM walk WHERE wake IS NOT NULL"""
)
def q_stream_jobs(spark, d):
    """The log of every job's changes: answers, and waking up for the next attempt."""
    code = F.element_at(F.array(*map(F.lit, (200, 404, 429, 500, 503))), (F.col("event_id") % 5 + 1).cast("int"))
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("job"), "event_id", "ts", code.alias("code"))
    return _machine(spark, rows, "job", sessions.Jobs())


@query(ORACLES["q_rate_limit"])
def q_stream_rate_limit(spark, d):
    """Admitted hits of each key as they come."""
    rows = table(spark, d, "events").select(F.expr("concat(event_type, '-', user_id % 20)").alias("key"), "event_id", "ts")
    return _machine(spark, rows, "key", sessions.Limit(3, 7200.0))


# --- rolling log ----------------------------------------------------------------

_SAMPLES = f"s AS (SELECT event_type AS step, event_id, event_id * 7919 % {BATCHES} AS arrives, CAST(round(value * 100) AS BIGINT) AS cents FROM events)"


def _rings(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("step"), "event_id", (F.col("event_id") * 7919 % BATCHES).cast("int").alias("arrives"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    base = temporary(spark, f"{shared_dir(spark)}/siltwork-stream-{uuid.uuid4().hex}")
    for k in range(BATCHES):
        e.where(F.col("arrives") == k).write.mode("append").parquet(f"{base}/in")
    stream = live.source(spark, f"{base}/in", e.schema, 1)
    stream.writeStream.foreachBatch(live.rolling_log(f"{base}/out")).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return live.last_rings(spark, f"{base}/out", e.select("step", "cents", "arrives", "event_id").schema)


@query(
    f"""WITH {_SAMPLES}, n AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY arrives DESC, event_id DESC) AS r FROM s)
    SELECT step, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total, min(cents) AS least, max(cents) AS most, max(cents) FILTER (WHERE r = 1) AS last FROM n WHERE r <= 100 GROUP BY step"""
)
def q_stream_rolling(spark, d):
    """Each step's summary over its last 100 samples in order of arrival, from the rings that the stream keeps."""
    steps, _ = _rings(spark, d)
    at = F.struct("arrives", "event_id")
    return steps.groupBy("step").agg(F.count("*").alias("n"), F.sum("cents").alias("total"), F.min("cents").alias("least"), F.max("cents").alias("most"), F.max_by("cents", at).alias("last"))


@query(f"WITH {_SAMPLES} SELECT step, event_id, cents, CAST(row_number() OVER (ORDER BY arrives DESC, event_id DESC) AS BIGINT) AS pos FROM s QUALIFY pos <= 50")
def q_stream_recent(spark, d):
    """The last 50 samples of all steps, newest first."""
    _, log = _rings(spark, d)
    newest = log.agg(F.reverse(F.array_sort(F.collect_list(F.struct("arrives", "event_id", "step", "cents")))).alias("rows"))  # 50 rows
    return newest.select(F.posexplode("rows").alias("p", "r")).select("r.step", "r.event_id", "r.cents", (F.col("p") + 1).cast("long").alias("pos"))
