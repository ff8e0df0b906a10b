"""Lease ledger and change detection as keyed streaming state."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ledger import CELLS_PER_LANE, MIN_PROOF_BYTES
from .held import BUCKET, BUCKETS, HeldRows, bucket_of, use_rocks

LEDGER_OUT = "lane bigint, ts double, event string, accepted boolean, status string, device string, lease_until double, attempts int"
LEDGER_COLUMNS = [c.split()[0] for c in LEDGER_OUT.split(", ")]


def lease_step(state: tuple, event: dict) -> tuple[tuple, bool]:
    """One transition of a lane's (status, device, lease_until, attempts); False when rejected.

    claim: unless final or under a live lease. heartbeat and release: owner only, from
    claimed or running. finish and fail: owner or nobody, whatever the status; finish also
    needs the size proof and the full item count. import: takes the longer lease.
    """
    status, device, lease, attempts = state
    kind, ts, who = event["event"], event["ts"], event["device"]
    active = status in ("claimed", "running")
    live = active and lease > ts
    if kind == "claim":
        if status in ("done", "verified", "quarantined") or live:
            return state, False
        return ("claimed", who, ts + event["lease_seconds"], attempts + 1), True
    if kind in ("heartbeat", "release"):
        if device != who or not active:
            return state, False
        if kind == "release":
            return ("released", device, lease, attempts), True
        return ("running", device, ts + event["lease_seconds"], attempts), True
    if kind == "finish":
        size, count = event["proof_bytes"], event["item_count"]
        if device not in (None, who, "folder-reconcile") or pd.isna(size) or size < MIN_PROOF_BYTES or count != CELLS_PER_LANE:
            return state, False
        return ("done", who, lease, attempts), True
    if kind == "fail":
        if device not in (None, who):
            return state, False
        return ("failed" if event["retryable"] else "quarantined", who, lease, attempts), True
    if kind == "import":
        if status in ("done", "verified", "quarantined") or (live and device not in (None, who)):
            return state, False
        return ("running", who, max(lease, ts + event["lease_seconds"]), attempts), True
    return state, False


def _streaming(df: DataFrame) -> DataFrame:
    if not df.isStreaming:
        raise ValueError("replay batch data as a file stream; a batch frame would put a whole key into one task")
    return df


class LaneLedger(HeldRows):
    """Each lane's (status, device, lease_until, attempts) and the lease whose end has been noticed."""

    fields = ("event", "device", "lease_seconds", "proof_bytes", "item_count", "retryable")

    def __init__(self, expire: bool, span_ms: int):
        super().__init__("lane", list(self.fields), list(self.fields), span_ms)
        self.expire = expire

    def _lapsed(self, lane, now: tuple) -> tuple:
        return (lane, now[2], "expire", True, "expired_claims", now[1], now[2], now[3])

    def _open(self, now: tuple) -> bool:
        return self.expire and now[0] in ("claimed", "running") and now[2] != now[4]

    def step(self, now: dict, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        columns = [rows[c].astype(object).where(rows[c].notna(), None).tolist() for c in ("lane", "ts", *self.fields)]
        for lane, *values in zip(*columns, strict=True):
            event = dict(zip(("ts", *self.fields), values, strict=True))
            at = now.get(lane, ("", None, 0.0, 0, -1.0))
            if self._open(at) and at[2] <= event["ts"]:
                out.append(self._lapsed(lane, at))
                at = (*at[:4], at[2])
            state, ok = lease_step(at[:4], event)
            now[lane] = (*state, at[4])
            out.append((lane, event["ts"], event["event"], ok, *state))
        return pd.DataFrame(out, columns=LEDGER_COLUMNS)

    def look(self, now: dict, reached: int) -> tuple[pd.DataFrame, int | None]:
        waiting = [lane for lane, at in now.items() if self._open(at)]
        out = [self._lapsed(lane, now[lane]) for lane in waiting if now[lane][2] * 1000 <= reached]
        again = min((math.ceil(now[lane][2] * 1000) for lane in waiting if now[lane][2] * 1000 > reached), default=None)
        for row in out:
            now[row[0]] = (*now[row[0]][:4], row[1])
        return pd.DataFrame(out, columns=LEDGER_COLUMNS), again


class Changes(HeldRows):
    """The signature of each key's last row."""

    def __init__(self, key: str, stamp: str, status: str, signature: str, span_ms: int):
        super().__init__(key, [stamp, status, signature], [stamp, status, signature], span_ms)
        self.names = (key, stamp, status, signature)

    def step(self, now: dict, rows: pd.DataFrame) -> pd.DataFrame:
        key, stamp, status, signature = self.names
        before = rows.groupby(key, sort=False)[signature].shift().astype(object)
        first = ~rows[key].duplicated()
        before[first] = pd.Series([now.get(k, (None,))[0] for k in rows.loc[first, key].tolist()], index=rows.index[first], dtype=object)
        same = (rows[signature] == before) | (rows[signature].isna() & before.isna())
        last = rows.drop_duplicates(key, keep="last")
        now.update((k, (None if pd.isna(s) else s,)) for k, s in zip(last[key].tolist(), last[signature].tolist(), strict=True))
        return rows.loc[~same | (rows[status] != "ok"), list(self.names)]


def _span_ms(spark: SparkSession, span: str) -> int:
    return spark.range(1).select((F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {span}")) / 1000).cast("bigint")).first()[0]


def ledger_state(events: DataFrame, delay: str = "0 seconds", expire: bool = True, span: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """Every event with the lane state after it; a lapsed lease adds an ``expire`` row.

    Events: lane, event_time (timestamp), ts (its seconds), event, device, lease_seconds,
    proof_bytes, item_count, retryable. A lane's events are held until the watermark, which trails by ``delay``, has
    passed them and are then taken in order of time, where times tie of content, so the rows do not depend on how files fall into
    micro-batches as long as none comes later than the delay. Lanes share ``buckets`` keys of the state, and a task has one ``span``
    of one bucket in memory. A lane without a name only moves the watermark.
    A lapsed lease changes only what may be claimed, so noticing it (by the event-time timer
    or by a later event of the lane) emits one row and leaves the status alone.
    """
    use_rocks(events.sparkSession)
    source = _streaming(events).select(bucket_of("lane", buckets), "lane", "event_time", "ts", *LaneLedger.fields).withWatermark("event_time", delay)
    ledger = LaneLedger(expire, _span_ms(events.sparkSession, span))
    return source.groupBy(BUCKET).transformWithStateInPandas(ledger, LEDGER_OUT, "append", "EventTime")


def emit_on_change(
    df: DataFrame, key: str, stamp: str, status: str, signature: str, event_time: str, delay: str = "0 seconds", span: str = "1 hour",
    buckets: int = BUCKETS,
) -> DataFrame:
    """Rows whose signature differs from the previous one of the key, and all rows not ``ok``.

    Rows are held until the watermark has passed them, like those of :func:`ledger_state`. A null key only moves the watermark.
    """
    schema = f"{key} {df.schema[key].dataType.simpleString()}, {stamp} {df.schema[stamp].dataType.simpleString()}, {status} string, {signature} string"
    use_rocks(df.sparkSession)
    rows = _streaming(df).select(bucket_of(key, buckets), key, stamp, status, signature, F.col(event_time).alias("_time"), (F.unix_micros(event_time) / 1e6).alias("ts"))
    changes = Changes(key, stamp, status, signature, _span_ms(df.sparkSession, span))
    return rows.withWatermark("_time", delay).groupBy(BUCKET).transformWithStateInPandas(changes, schema, "append", "EventTime")


def dedupe_arrivals(df: DataFrame, name: str, event_time: str, delay: str) -> DataFrame:
    """Case-insensitive duplicate names counted once within the watermark delay."""
    rows = df.withColumn("arrival_key", F.lower(F.trim(F.col(name))))
    return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["arrival_key"])


def progress_windows(df: DataFrame, event_time: str, window: str, settle: str, done: str) -> DataFrame:
    """Arrivals and completions per event-time window; the settle time is the watermark delay."""
    return (
        df.withWatermark(event_time, settle)
        .groupBy(F.window(event_time, window))
        .agg(F.count(F.lit(1)).alias("arrived"), F.count_if(F.col(done)).alias("completed"))
        .select(F.unix_micros("window.start").alias("window_start"), "arrived", "completed")
    )
