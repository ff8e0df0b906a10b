"""Work-ledger merging, summaries, ownership and planning over status rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sets import compact_ranges
from .topk import recent

# Status ranks, timestamp priority, smallest proof size, cells per lane.
STATUS_RANK = {"verified": 70, "done": 60, "quarantined": 50, "failed": 30, "released": 20, "claimed": 10, "running": 10}
STAMP_PRIORITY = ["verified_at", "finished_at", "failed_at", "released_at", "heartbeat_at", "claimed_at", "updated_at"]
MIN_PROOF_BYTES = 1024
CELLS_PER_LANE = 65536
ACTIVE = ("claimed", "running")
FINAL = ("done", "verified", "quarantined")


def normal_status(col: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(col).cast("string"), F.lit(""))))


def status_rank(status: Column) -> Column:
    out = F.lit(0)
    for name, rank in STATUS_RANK.items():
        out = F.when(status == name, rank).otherwise(out)
    return out


def best_timestamp(columns: Sequence[str]) -> Column:
    """First non-null stamp in priority order, else 0 (not the latest one)."""
    present = [c for c in STAMP_PRIORITY if c in columns]
    return F.coalesce(*[F.col(c).cast("double") for c in present], F.lit(0.0))


def record_score(df: DataFrame, key: str, proof: str = "proof_bytes") -> Column:
    fields = sum((F.col(c).isNotNull().cast("int") for c in df.columns), F.lit(0))
    return F.struct(
        status_rank(normal_status("status")).alias("rank"),
        (F.coalesce(F.col(proof).try_cast("bigint"), F.lit(0)) >= MIN_PROOF_BYTES).cast("int").alias("proof"),
        best_timestamp(df.columns).alias("stamp"),
        fields.alias("fields"),
    )


def merge_best(src: DataFrame, dst: DataFrame, key: str, include_active: bool = False) -> DataFrame:
    """Upsert ``src`` into ``dst``: a source row replaces only with a strictly greater score.

    Output: the surviving row plus ``action`` (added, replaced, kept, skipped_active,
    skipped_invalid, untouched) and ``conflict``. One row per key on each side.
    """
    cols = [c for c in dst.columns if c != key]
    pack = lambda d: F.struct(*cols)
    s = src.select(key, *cols).withColumn("_ss", record_score(src.select(key, *cols), key))
    s = s.select(key, pack(s).alias("_s"), "_ss", normal_status("status").alias("_st"))
    d = dst.select(key, *cols).withColumn("_ds", record_score(dst.select(key, *cols), key))
    d = d.select(key, pack(d).alias("_d"), "_ds", normal_status("status").alias("_dt"))
    both = s.join(d, key, "full_outer")
    active = F.col("_st").isin(*ACTIVE)
    action = (
        F.when(F.col("_s").isNull(), "untouched")
        .when(F.col("_st") == "", "skipped_invalid")
        .when(active & F.lit(not include_active), "skipped_active")
        .when(F.col("_d").isNull(), "added")
        .when(F.col("_ss") > F.col("_ds"), "replaced")
        .otherwise("kept")
    )
    out = both.withColumn("action", action)
    conflict = (
        F.when(F.col("action") == "replaced", (F.col("_st") != F.col("_dt")) & (F.col("_dt") != ""))
        .when(F.col("action") == "kept", F.col("_st") != F.col("_dt"))
        .otherwise(F.lit(False))
    )
    row = F.when(F.col("action").isin("added", "replaced"), F.col("_s")).otherwise(F.col("_d"))
    return out.select(key, row.alias("_row"), "action", conflict.alias("conflict")).select(
        key, *[F.col("_row")[c].alias(c) for c in cols], "action", "conflict"
    )


def merged_rows(merged: DataFrame) -> DataFrame:
    """The merged ledger: skipped source rows without an old row leave nothing behind."""
    gone = F.col("action").isin("skipped_active", "skipped_invalid") & F.col("status").isNull()
    return merged.filter(~gone).drop("action", "conflict")


def merge_counts(merged: DataFrame) -> DataFrame:
    return merged.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.count_if("conflict").alias("conflicts"))


def effective_status(now: Column, lease: str = "lease_until") -> Column:
    """Status with lapsed claims shown as ``expired_claims``."""
    st = normal_status("status")
    live = F.coalesce(F.col(lease).cast("double"), F.lit(0.0)) > now
    return F.when(st.isin(*ACTIVE) & ~live, "expired_claims").otherwise(st)


def ledger_summary(df: DataFrame, now: Column, target: int) -> DataFrame:
    """One row of counts; pending = target minus final and live active rows, at least 0."""
    st = effective_status(now)
    names = ["claimed", "running", "done", "failed", "released", "quarantined", "verified", "expired_claims"]
    busy = F.count_if(st.isin(*FINAL, *ACTIVE))
    return df.agg(
        *[F.count_if(st == n).alias(n) for n in names],
        F.greatest(F.lit(0), F.lit(target) - busy).alias("pending"),
    )


def status_ranges(df: DataFrame, key: str, now: Column) -> DataFrame:
    """Compact id ranges of done rows and of live active rows."""
    st = effective_status(now)
    kind = F.when(st == "done", "done").when(st.isin(*ACTIVE), "active")
    return compact_ranges(df.withColumn("kind", kind).filter(F.col("kind").isNotNull()), key, ["kind"])


def recent_done(df: DataFrame, key: str, n: int, stamp: str = "finished_at") -> DataFrame:
    return recent(df.filter(normal_status("status") == "done"), stamp, key, n)


def claimable(domain: DataFrame, ledger: DataFrame, done: DataFrame, key: str, now: Column, n: int) -> DataFrame:
    """First ``n`` domain keys that are neither final, nor under a live lease, nor done elsewhere."""
    taken = ledger.filter(effective_status(now).isin(*FINAL, *ACTIVE)).select(key)
    return domain.join(taken, key, "left_anti").join(done.select(key), key, "left_anti").orderBy(key).limit(n)


def check_ownership(events: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """First reject reason per event, null when accepted.

    Events: key, event, owner, proof_bytes, item_count. Ledger: key, status, device.
    """
    held = ledger.select(key, F.col("device").alias("_dev"), normal_status("status").alias("_st"))
    out = events.join(held, key, "left")
    ev, own = F.col("event"), F.col("_dev").eqNullSafe(F.col("owner"))
    free = F.col("_dev").isNull()
    reason = (
        F.when(ev.isin("heartbeat", "release") & (free | ~own), "not-owner")
        .when(ev.isin("heartbeat", "release") & ~F.coalesce(F.col("_st").isin(*ACTIVE), F.lit(False)), "not-active")
        .when((ev == "finish") & ~free & ~own & (F.col("_dev") != "folder-reconcile"), "not-owner")
        .when((ev == "fail") & ~free & ~own, "not-owner")
        .when((ev == "finish") & F.col("proof_bytes").isNull(), "no-proof")
        .when((ev == "finish") & (F.col("proof_bytes") < MIN_PROOF_BYTES), "proof-too-small")
        .when((ev == "finish") & ~F.coalesce(F.col("item_count") == CELLS_PER_LANE, F.lit(False)), "wrong-count")
    )
    return out.withColumn("reject", reason).drop("_dev", "_st")


def trusted_union(device_lanes: DataFrame, local: DataFrame, lane: str, device: str, order: str) -> DataFrame:
    """Per device: lanes, lanes first seen there, and lanes already seen earlier in device order.

    "Earlier" needs only the smallest device order per lane, so it is one aggregate and a join.
    """
    mine = device_lanes.select(device, order, lane).distinct()
    seen = local.select(lane, F.lit(-1).cast("bigint").alias(order)).unionByName(
        mine.select(lane, F.col(order).cast("bigint").alias(order))
    )
    first = seen.groupBy(lane).agg(F.min(order).alias("_first"))
    return (
        mine.join(first, lane)
        .groupBy(device, order)
        .agg(
            F.count(F.lit(1)).alias("lanes"),
            F.count_if(F.col("_first") == F.col(order)).alias("unique_lanes"),
            F.count_if(F.col("_first") < F.col(order)).alias("duplicate_lanes"),
        )
    )


def grand_total(device_lanes: DataFrame, local: DataFrame, lane: str, target: int) -> DataFrame:
    """Distinct lanes over all devices and the local set, capped at the target."""
    both = device_lanes.select(lane).union(local.select(lane)).distinct()
    remote_only = device_lanes.select(lane).distinct().join(local.select(lane), lane, "left_anti")
    return both.agg(F.least(F.count(F.lit(1)), F.lit(target)).alias("grand_total")).withColumn(
        "remote_total", F.least(remote_only.agg(F.count(F.lit(1))).scalar(), F.lit(target))
    )


def count_only_devices(devices: DataFrame, target: int) -> DataFrame:
    """Devices that report a count but no lane ranges: shown capped at the target, never added up.

    Devices: device, has_ranges, done_count, progress_count. A count cannot be checked for
    overlap with other devices, so it stays a diagnostic.
    """
    count = F.coalesce(F.col("done_count"), F.col("progress_count"), F.lit(0)).cast("bigint")
    source = F.when(F.col("done_count").isNotNull(), "ledger_count").otherwise("progress_count")
    return devices.filter(~F.coalesce("has_ranges", F.lit(False))).select(
        "device", F.greatest(F.lit(0), F.least(count, F.lit(target))).alias("lanes"), source.alias("source")
    )


def status_by_row_precedence(files: DataFrame, ledger: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Per expected key: duplicate > done > ledger-missing > error > missing.

    Files: key, one row per file. Ledger: key, done, error, file_present.
    """
    n = files.groupBy(key).agg(F.count(F.lit(1)).alias("files"))
    rows = ledger.select(key, F.col("done").alias("_done"), F.col("error").alias("_err"), F.col("file_present").alias("_there"))
    out = expected.join(n, key, "left").join(rows, key, "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    status = (
        F.when(F.coalesce("files", F.lit(0)) > 1, "duplicate")
        .when(F.coalesce("files", F.lit(0)) == 1, "done")
        .when(yes("_done") & yes("_there"), "done")
        .when(yes("_done"), "ledger-missing")
        .when(F.coalesce(F.length("_err"), F.lit(0)) > 0, "error")
        .otherwise("missing")
    )
    return out.select(*expected.columns, F.coalesce("files", F.lit(0)).alias("files"), status.alias("status"))


def reconcile_files(ledger: DataFrame, files: DataFrame, key: str, now: Column) -> DataFrame:
    """Files of proven size promote their lane to done; rows already done stay as they are.

    Ledger: key, status, device, finished_at, proof_bytes. Files: key, size (any number per key).
    """
    proof = files.filter(F.col("size") >= MIN_PROOF_BYTES).groupBy(key).agg(F.max("size").alias("_size"))
    out = ledger.join(proof, key, "full_outer")
    promote = F.col("_size").isNotNull() & ~F.coalesce(normal_status("status") == "done", F.lit(False))
    return out.select(
        key,
        F.when(promote, "done").otherwise(F.col("status")).alias("status"),
        F.when(promote, F.coalesce("device", F.lit("folder-reconcile"))).otherwise(F.col("device")).alias("device"),
        F.when(promote, now.cast("double")).otherwise(F.col("finished_at")).alias("finished_at"),
        F.when(promote, F.col("_size")).otherwise(F.col("proof_bytes")).alias("proof_bytes"),
        promote.alias("promoted"),
    )


def reconcile_remote(ledger: DataFrame, reports: DataFrame, key: str, now: Column, lease_seconds: float, proven: DataFrame | None = None) -> DataFrame:
    """Fold remote done/active reports into the ledger, devices in their given order.

    Ledger: key, status, device, lease_until, finished_at. Reports: key, device, pos, kind
    (done | active); ``pos`` orders the devices. Per lane: final rows win; a foreign live claim
    is a conflict; done marks the lane done; active makes it running with the longer of the old
    and the new lease. Lanes with a proven file go to done first. The fold runs over the
    devices that report one lane, a handful of entries inside the row.
    """
    t = now.cast("double")
    once = reports.groupBy(key, "device", "pos").agg(F.max((F.col("kind") == "done").cast("int")).alias("is_done"))
    per_lane = once.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "device", "is_done"))).alias("_reports"))
    out = ledger.select(key, "status", "device", "lease_until", "finished_at").join(per_lane, key, "full_outer")
    if proven is not None:
        out = out.join(proven.select(key).distinct().withColumn("_proof", F.lit(True)), key, "left")
    else:
        out = out.withColumn("_proof", F.lit(None).cast("boolean"))
    done_by_file = F.col("_proof") & F.exists("_reports", lambda r: r["is_done"] == 1) & ~normal_status("status").isin(*FINAL)
    done_by_file = F.coalesce(done_by_file, F.lit(False))
    start = F.struct(
        F.when(done_by_file, "done").otherwise(normal_status("status")).alias("status"),
        F.when(done_by_file, F.coalesce("device", F.lit("folder-reconcile"))).otherwise(F.col("device")).alias("device"),
        F.coalesce("lease_until", F.lit(0.0)).cast("double").alias("lease"),
        F.when(done_by_file, t).otherwise(F.col("finished_at")).cast("double").alias("finished"),
        F.lit(0).alias("conflicts"), F.lit(0).alias("done_in"), F.lit(0).alias("active_in"),
    )

    def fold(acc, r):
        final = acc["status"].isin(*FINAL)
        foreign = acc["status"].isin(*ACTIVE) & acc["device"].isNotNull() & (acc["device"] != r["device"]) & (acc["lease"] > t)
        take_done = ~final & ~foreign & (r["is_done"] == 1)
        take_active = ~final & ~foreign & (r["is_done"] == 0)
        taken = take_done | take_active
        return F.struct(
            F.when(take_done, "done").when(take_active, "running").otherwise(acc["status"]).alias("status"),
            F.when(taken, r["device"]).otherwise(acc["device"]).alias("device"),
            F.when(take_active, F.greatest(acc["lease"], t + lease_seconds)).otherwise(acc["lease"]).alias("lease"),
            F.when(take_done, F.coalesce(acc["finished"], t)).otherwise(acc["finished"]).alias("finished"),
            (acc["conflicts"] + (~final & foreign).cast("int")).alias("conflicts"),
            (acc["done_in"] + take_done.cast("int")).alias("done_in"),
            (acc["active_in"] + take_active.cast("int")).alias("active_in"),
        )

    state = F.aggregate(F.coalesce("_reports", F.expr("array()").cast("array<struct<pos:bigint,device:string,is_done:int>>")), start, fold)
    return out.select(key, state.alias("_s")).select(
        key, F.col("_s.status").alias("status"), F.col("_s.device").alias("device"), F.col("_s.lease").alias("lease_until"),
        F.col("_s.finished").alias("finished_at"), F.col("_s.conflicts").alias("conflicts"),
        F.col("_s.done_in").alias("done_imported"), F.col("_s.active_in").alias("active_imported"),
    )


def release_inactive(ledger: DataFrame, reports: DataFrame, key: str) -> DataFrame:
    """Claims of a reporting device on lanes it no longer reports become released."""
    devices = reports.select("device").distinct().withColumn("_reporting", F.lit(True))
    live = reports.select(key, "device").distinct().withColumn("_live", F.lit(True))
    out = ledger.join(devices, "device", "left").join(live, [key, "device"], "left")
    drop = normal_status("status").isin(*ACTIVE) & F.col("_reporting") & F.col("_live").isNull()
    return out.withColumn("status", F.when(F.coalesce(drop, F.lit(False)), "released").otherwise(F.col("status"))).select(*ledger.columns)
