"""Device registry, health rules, and ledger reconciliation over streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ledger import reconcile_files, reconcile_remote
from ..operators.quality import severity_rank
from ..session import shared_dir
from .sinks import BucketedTable, fold_by_key

STALE_SECONDS = 300.0


def device_registry(heartbeats: DataFrame, now: Column, stale: float = STALE_SECONDS) -> DataFrame:
    """Latest heartbeat per device with its age; a stale sidecar contributes no workers and no ranges.

    Heartbeats: device, ts (seconds), seq, workers, sidecar_ts, sidecar_workers, ranges. An
    aggregate, so it runs on a stream in complete mode and combines hot devices map-side.
    """
    latest = heartbeats.groupBy("device").agg(
        F.max_by(F.struct("ts", "seq", "workers", "sidecar_ts", "sidecar_workers", "ranges"), F.struct("ts", "seq")).alias("_h")
    )
    age = now.cast("double") - F.col("_h.sidecar_ts")
    fresh = F.coalesce((age >= 0) & (age <= stale), F.lit(False))
    return latest.select(
        "device",
        F.col("_h.ts").alias("ts"),
        F.greatest(F.lit(0.0), now.cast("double") - F.col("_h.ts")).alias("age"),
        F.when(fresh, F.col("_h.workers"))
        .otherwise(F.greatest(F.lit(0), F.col("_h.workers") - F.coalesce(F.col("_h.sidecar_workers"), F.lit(0))))
        .alias("workers"),
        F.when(fresh, F.col("_h.ranges")).alias("ranges"),
        (~fresh).alias("sidecar_ignored"),
    )


def surviving_ranges(worker: DataFrame, stale: DataFrame, pool: DataFrame, done: DataFrame, lane: str, device: str) -> DataFrame:
    """Lanes of devices with a stale sidecar that something other than the sidecar explains.

    The pool's own lanes when there are any; else worker lanes that are not done, when some
    worker lane is; else worker lanes the stale sidecar does not list.
    """
    tag = lambda d, n: d.select(device, lane).distinct().withColumn(n, F.lit(1))
    rows = (
        tag(worker, "w").join(tag(stale, "s"), [device, lane], "full_outer")
        .join(tag(pool, "p"), [device, lane], "full_outer").join(tag(done, "d"), [device, lane], "left")
    )
    facts = rows.groupBy(device).agg(F.max("p").alias("_has_pool"), F.max(F.col("w") * F.col("d")).alias("_has_done"), F.max("s").alias("_has_stale"))
    rows = rows.join(facts, device)
    keep = (
        F.when(F.col("_has_stale").isNull(), F.col("w").isNotNull())
        .when(F.col("_has_pool").isNotNull(), F.col("p").isNotNull())
        .when(F.col("_has_done").isNotNull(), F.col("w").isNotNull() & F.col("d").isNull())
        .otherwise(F.col("w").isNotNull() & F.col("s").isNull())
    )
    return rows.filter(keep).select(device, lane)


def graded(value: Column, warning: float, critical: float, code: str, when: Column | None = None) -> list[tuple[str, str, Column]]:
    """Two rules of one code: critical from one limit on, else warning from the other on."""
    gate = F.lit(True) if when is None else when
    return [("critical", code, gate & (value >= critical)), ("warning", code, gate & (value >= warning) & (value < critical))]


def slow_slots(slots: str, seconds: str, limit: float, code: str = "worker_slow") -> Column:
    """A finding for each running slot (an array of structs) that has run for ``limit`` seconds or more."""
    slow = F.filter(slots, lambda s: F.coalesce(s[seconds] >= limit, F.lit(False)))
    return F.transform(slow, lambda s: F.struct(F.lit("warning").alias("severity"), F.lit(code).alias("code")))


def health_checks(snapshots: DataFrame, keep: list[str], rules: Sequence[tuple[str, str, Column]], more: Sequence[Column] = ()) -> DataFrame:
    """Findings per snapshot, overall status, and a signature that changes when they do.

    ``rules`` are (severity, code, condition) over the snapshot's columns, in the order findings are to be listed; a null
    condition does not fire. ``more`` are columns that hold arrays of further findings. Everything is row-local, so it
    applies to a stream (joined with static limits where wanted) or a batch alike.
    """
    finding = lambda severity, code: F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"))
    found = F.array_compact(F.array(*[F.when(condition, finding(severity, code)) for severity, code, condition in rules]))
    out = snapshots.withColumn("checks", F.concat(found, *more) if more else found)
    worst = F.array_max(F.transform("checks", lambda x: severity_rank(x["severity"])))
    status = F.when(worst == 2, "critical").when(worst == 1, "warning").otherwise("ok")
    codes = F.concat_ws(",", F.array_sort(F.transform("checks", lambda x: x["code"])))
    return out.select(*keep, "checks", status.alias("status"), codes.alias("codes"), F.concat(status, F.lit("|"), codes).alias("signature"))


LEDGER_COLUMNS = "lane bigint, status string, device string, lease_until double, finished_at double"


def reconcile_stream(reports: DataFrame, ledger: DataFrame, now: Column, lease_seconds: float, buckets: int = 64) -> DataFrame:
    """Remote reports folded into the ledger micro-batch by micro-batch; a batch rewrites the buckets of its lanes only."""
    spark = ledger.sparkSession
    names = ["lane", "status", "device", "lease_until", "finished_at"]
    fold = lambda old, batch: reconcile_remote(old, batch, "lane", now, lease_seconds)
    nothing = spark.createDataFrame([], reports.schema)
    table = BucketedTable(spark, shared_dir(spark, "ledger"), fold(ledger.select(*names), nothing).select(*names), "lane", buckets)
    return fold_by_key(reports, table, fold)


def files_stream(listing: DataFrame, ledger: DataFrame, now: Column, buckets: int = 64) -> DataFrame:
    """Arriving proven files promote their lanes to done; a batch rewrites the buckets of its lanes only."""
    spark = ledger.sparkSession
    names = ["lane", "status", "device", "finished_at", "proof_bytes"]
    table = BucketedTable(spark, shared_dir(spark, "ledger"), ledger.select(*names), "lane", buckets)
    return fold_by_key(listing, table, lambda old, batch: reconcile_files(old, batch, "lane", now))
