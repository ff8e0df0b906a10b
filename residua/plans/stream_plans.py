"""Streaming plans: the given event table replayed as a file stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.ordered import join_on
from ..session import shared_dir
from ..streaming import monitor as M
from ..streaming import sinks as K
from ..streaming import state as S
from .base import Tables, cents, query, r4
from .ledger_plans import LEDGER_SQL, NOW, latest_side


def event_stream(t: Tables):
    raw = K.file_stream(t.spark, t.folder, "events.parquet")
    return raw.withColumn("event_time", F.col("ts").cast("timestamp")).withColumn("us", F.unix_micros("event_time")).drop("ts")


#: How late an event may come: longer than the table, whose files have no order.
DELAY = "400 days"
#: A task holds one such span of a lane's events.
SPAN = "60 days"


def replayed(t: Tables, stream, build):
    last = t.events.agg(F.max("us")).first()[0]
    return K.run_to_end(t.spark, stream, build, "event_time", F.timestamp_micros(F.lit(last)), DELAY)


@query("stream_progress", "SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) AS window_start, count(*) AS arrived, count(*) FILTER (event_type = 'click') AS completed FROM events GROUP BY 1")
def stream_progress(t: Tables):
    rows = event_stream(t).withColumn("done", F.col("event_type") == "click")
    return K.run_to_table(S.progress_windows(rows, "event_time", "6 hours", "1 hour", "done"), "complete")


@query("stream_change", """SELECT user_id, us, status, event_type AS signature FROM (SELECT user_id, epoch_us(ts) AS us, CASE WHEN value > 60 THEN 'warning' ELSE 'ok' END AS status, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events)
 WHERE event_type IS DISTINCT FROM prev OR status <> 'ok'""")
def stream_change(t: Tables):
    rows = event_stream(t).select("user_id", "us", "event_time", F.when(F.col("value") > 60, "warning").otherwise("ok").alias("status"), F.col("event_type").alias("signature"))
    return replayed(t, rows, lambda df: S.emit_on_change(df, "user_id", "us", "status", "signature", "event_time", DELAY, SPAN))


def lease_events(df):
    kind = (
        F.when(F.col("event_type") == "signup", "claim").when(F.col("event_type") == "click", "heartbeat").when(F.col("event_type") == "purchase", "finish")
        .when(F.col("event_type") == "error", "fail").otherwise("release")
    )
    return df.select(
        F.col("user_id").alias("lane"), "event_time", (F.col("us") / 1e6).alias("ts"), kind.alias("event"), F.concat(F.lit("d"), (F.col("event_id") % 3).cast("string")).alias("device"),
        F.lit(21600).alias("lease_seconds"), cents("value").alias("proof_bytes"), F.lit(65536).cast("bigint").alias("item_count"), (F.col("event_id") % 2 == 0).alias("retryable"),
    )


LEASE_SQL = """WITH RECURSIVE e AS (SELECT user_id AS lane, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn, event_id, epoch_us(ts) / 1e6 AS secs, 'd' || (event_id % 3) AS dev, round(value * 100) AS size,
  CASE event_type WHEN 'signup' THEN 'claim' WHEN 'click' THEN 'heartbeat' WHEN 'purchase' THEN 'finish' WHEN 'error' THEN 'fail' ELSE 'release' END AS event FROM events),
 s AS (SELECT DISTINCT user_id AS lane, CAST(0 AS BIGINT) AS rn, CAST(0 AS DOUBLE) AS ts, '' AS event, false AS accepted, '' AS status, CAST(NULL AS VARCHAR) AS device, CAST(0 AS DOUBLE) AS lease, CAST(0 AS INTEGER) AS attempts FROM events
  UNION ALL SELECT lane, rn, secs, event, ok, CASE WHEN NOT ok THEN os WHEN event = 'claim' THEN 'claimed' WHEN event = 'heartbeat' THEN 'running' WHEN event = 'release' THEN 'released' WHEN event = 'finish' THEN 'done' WHEN event_id % 2 = 0 THEN 'failed' ELSE 'quarantined' END,
   CASE WHEN ok AND event IN ('claim', 'finish', 'fail') THEN dev ELSE od END, CASE WHEN ok AND event IN ('claim', 'heartbeat') THEN secs + 21600 ELSE ol END, CAST(oa + CASE WHEN ok AND event = 'claim' THEN 1 ELSE 0 END AS INTEGER)
  FROM (SELECT e.*, s.status AS os, s.device AS od, s.lease AS ol, s.attempts AS oa, coalesce(CASE WHEN e.event = 'claim' THEN NOT (s.status IN ('done', 'verified', 'quarantined') OR (s.status IN ('claimed', 'running') AND s.lease > secs))
     WHEN e.event IN ('heartbeat', 'release') THEN s.device = dev AND s.status IN ('claimed', 'running') WHEN e.event = 'finish' THEN coalesce(s.device, dev) = dev AND size >= 1024 ELSE coalesce(s.device, dev) = dev END, false) AS ok
    FROM s JOIN e ON e.lane = s.lane AND e.rn = s.rn + 1))"""


@query("stream_lease", LEASE_SQL + " SELECT lane, round(ts, 6) AS ts, event, accepted, status, coalesce(device, '') AS device, attempts FROM s WHERE rn > 0")
def stream_lease(t: Tables):
    """Lease ledger transitions per lane."""
    out = replayed(t, lease_events(event_stream(t)), lambda df: S.ledger_state(df, DELAY, span=SPAN)).filter("event <> 'expire'")
    return out.select("lane", r4("ts", "ts", 6), "event", "accepted", "status", F.coalesce("device", F.lit("")).alias("device"), "attempts")


@query(
    "stream_expired",
    LEASE_SQL
    + """, n AS (SELECT *, lead(ts) OVER (PARTITION BY lane ORDER BY rn) AS next_ts, lead(lease) OVER (PARTITION BY lane ORDER BY rn) AS next_lease FROM s WHERE rn > 0)
    SELECT lane, round(lease, 6) AS lease_until FROM n WHERE status IN ('claimed', 'running') AND lease <= coalesce(next_ts, (SELECT max(epoch_us(ts)) / 1e6 FROM events)) GROUP BY lane, lease""",
)
def stream_expired(t: Tables):
    """Leases that ran out before the lane's next event or the end of the stream."""
    out = replayed(t, lease_events(event_stream(t)), lambda df: S.ledger_state(df, DELAY, span=SPAN)).filter("event = 'expire'")
    return out.select("lane", r4("lease_until", "lease_until", 6))


@query("stream_dedupe", "SELECT DISTINCT lower(event_type) || '-' || user_id AS arrival_key FROM events")
def stream_dedupe(t: Tables):
    k = F.col("event_id") % 2
    name = F.concat(F.when(k == 0, F.upper("event_type")).otherwise(F.col("event_type")), F.lit("-"), F.col("user_id").cast("string"))
    return K.run_to_table(S.dedupe_arrivals(event_stream(t).withColumn("name", name), "name", "event_time", "60 days").select("arrival_key"))


@query(
    "stream_registry",
    f"""WITH h AS (SELECT event_type AS device, epoch_us(ts) / 1e6 AS ts, user_id, event_id % 11 AS side FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1)
    SELECT device, round({NOW} + 2000000 - ts, 3) AS age, CASE WHEN {NOW} - (ts - 604000) BETWEEN 0 AND 300 THEN user_id ELSE greatest(0, user_id - side) END AS workers, NOT {NOW} - (ts - 604000) BETWEEN 0 AND 300 AS sidecar_ignored FROM h""",
)
def stream_registry(t: Tables):
    ts = F.col("us") / 1e6
    beats = event_stream(t).select(
        F.col("event_type").alias("device"), ts.alias("ts"), F.col("event_id").alias("seq"), F.col("user_id").alias("workers"), (ts - 604000 + 2000000).alias("sidecar_ts"),
        (F.col("event_id") % 11).alias("sidecar_workers"), F.lit("0x0001").alias("ranges"),
    )
    out = K.run_to_table(M.device_registry(beats, F.lit(NOW + 2000000)), "complete")
    return out.select("device", r4("age", "age", 3), "workers", "sidecar_ignored")


@query(
    "stream_health",
    """WITH s AS (SELECT user_id, count(*) FILTER (value >= 50) AS slow FROM events WHERE event_type = 'view' GROUP BY 1),
    x AS (SELECT e.event_id, e.user_id, value, value * 10 AS v, coalesce(slow, 0) AS slow, (SELECT count(*) FROM labels l WHERE l.doc_id = e.user_id AND l.toxic = 1) > 0 AS bad FROM events e LEFT JOIN s USING (user_id))
    SELECT event_id, CASE WHEN v >= 600 OR user_id % 9 = 0 OR bad THEN 'critical' WHEN v >= 120 OR value < 1 OR event_id % 50 = 7 OR slow > 0 THEN 'warning' ELSE 'ok' END AS status,
    concat_ws(',', CASE WHEN event_id % 50 = 7 THEN 'bad_name' END, CASE WHEN user_id % 9 = 0 THEN 'idle' END, CASE WHEN v >= 120 THEN 'stale' END, CASE WHEN value < 1 THEN 'tiny' END, CASE WHEN bad THEN 'toxic' END,
      CASE WHEN slow > 0 THEN rtrim(repeat('worker_slow,', slow), ',') END) AS codes FROM x""",
)
def stream_health(t: Tables):
    """Health rules over snapshots joined with static tables: flagged users, and the running slots of each."""
    slots = t.events.filter("event_type = 'view'").groupBy("user_id").agg(F.collect_list(F.struct(F.col("value").alias("seconds"))).alias("slots"))
    toxic = t.labels.filter("toxic = 1").select(F.col("doc_id").alias("user_id"), F.lit(True).alias("toxic")).distinct()
    rows = join_on(join_on(event_stream(t), slots, ["user_id"]), toxic, ["user_id"])
    k, value = F.col("event_id"), F.col("value")
    rules = [
        *M.graded(value * 10, 120, 600, "stale"),
        ("warning", "tiny", value < 1),
        ("warning", "bad_name", k % 50 == 7),
        ("critical", "idle", F.col("user_id") % 9 == 0),
        ("critical", "toxic", F.col("toxic")),
    ]
    slow = F.coalesce(M.slow_slots("slots", "seconds", 50), F.array().cast("array<struct<severity:string,code:string>>"))
    return K.run_to_table(M.health_checks(rows, ["event_id"], rules, [slow]).select("event_id", "status", "codes"))


@query(
    "stream_reconcile",
    f"""WITH {LEDGER_SQL}, l AS (SELECT lane, status FROM latest WHERE side = 0), r AS (SELECT user_id AS lane, max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS is_done FROM events GROUP BY 1)
    SELECT coalesce(l.lane, r.lane) AS lane, CASE WHEN is_done IS NULL OR coalesce(status, '') IN ('done', 'verified') THEN status WHEN is_done = 1 THEN 'done' ELSE 'running' END AS status FROM l FULL JOIN r ON l.lane = r.lane""",
)
def stream_reconcile(t: Tables):
    """Remote reports folded into the ledger, long after every lease has ended."""
    rep = event_stream(t).select(
        F.col("user_id").alias("lane"), F.lit("remote").alias("device"), F.lit(0).cast("bigint").alias("pos"), F.when(F.col("event_type") == "click", "done").otherwise("active").alias("kind")
    )
    return M.reconcile_stream(rep, latest_side(t, 0), F.lit(NOW + 1e8), 21600.0).select("lane", "status")


@query(
    "stream_files",
    f"""WITH {LEDGER_SQL}, l AS (SELECT lane, status, device FROM latest WHERE side = 0), p AS (SELECT user_id AS lane, max(CAST(round(value * 100) AS BIGINT)) AS size FROM events WHERE event_type = 'view' AND round(value * 100) >= 1024 GROUP BY 1)
    SELECT coalesce(l.lane, p.lane) AS lane, CASE WHEN size IS NULL THEN status ELSE 'done' END AS status, coalesce(device, 'folder-reconcile') AS device FROM l FULL JOIN p ON l.lane = p.lane""",
)
def stream_files(t: Tables):
    files = event_stream(t).filter("event_type = 'view'").select(F.col("user_id").alias("lane"), cents("value").alias("size"))
    return M.files_stream(files, latest_side(t, 0), F.lit(NOW)).select("lane", "status", "device")


@query("stream_tail", "SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 20")
def stream_tail(t: Tables):
    rows = event_stream(t).select("event_id", "user_id", "us", "event_type")
    return K.tail_errors(rows, F.col("event_type") == "error", "us", "event_id", 20).select("event_id", "user_id")


@query("stream_log", "SELECT event_id, user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'error'")
def stream_log(t: Tables):
    """Error rows appended to the log and read back from it."""
    rows = event_stream(t).filter("event_type = 'error'").select("event_id", "user_id", "us")
    path = shared_dir(t.spark, "log")
    K.finish(K.append_events(rows, path))
    return K.read_log(t.spark, path, rows.schema).drop("epoch")
