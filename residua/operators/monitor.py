"""Worker slots, bundles and finish forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import duration_text
from .ordered import OrderedFrame, join_on
from .windows import latest_per_key


def _number(*columns: str) -> Column:
    """First usable number: null and zero fall through to the next column."""
    return F.coalesce(*[F.when(F.col(c) != 0, F.col(c)) for c in columns[:-1]], F.col(columns[-1]))


def slot_rows(running: DataFrame, done: DataFrame, slot: str = "slot") -> DataFrame:
    """Current job of each slot beside its latest finished job; either side may be absent.

    Running: slot, item, status, active_elapsed, elapsed, outer_elapsed, bundle_elapsed.
    Done: slot, seq, item, status, outer_elapsed, elapsed, complete_items.
    """
    last = latest_per_key(done.withColumn("_z", F.lit(0)), [slot], "seq", "_z", ["item", "status", "outer_elapsed", "elapsed", "complete_items"])
    last = last.select(
        slot, F.col("item").alias("last_item"), F.col("status").alias("last_status"),
        _number("outer_elapsed", "elapsed").alias("last_seconds"), F.col("complete_items").alias("last_items"),
    )
    now = running.select(
        slot, F.col("item").alias("current_item"), F.col("status").alias("current_status"),
        _number("active_elapsed", "elapsed", "outer_elapsed", "bundle_elapsed").alias("current_seconds"),
    )
    return now.join(last, slot, "full_outer")


def overlay_status(preview: DataFrame, sidecar: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Sidecar fields override preview fields where present."""
    side = sidecar.select(*keys, *[F.col(f).alias(f"_s_{f}") for f in fields])
    out = join_on(preview, side, keys)
    return out.withColumns({f: F.coalesce(F.col(f"_s_{f}"), F.col(f)) for f in fields}).drop(*[f"_s_{f}" for f in fields])


def active_item(df: DataFrame, keys: Sequence[str], pos: str, outer: str, duration: str = "duration", rows: int | None = None) -> DataFrame:
    """First non-terminal item of each bundle (the last one when all are terminal).

    Its elapsed time is its own duration, else the bundle's outer time minus the durations of
    the items before it; unknown when one of those is unknown.
    """
    open_pos = F.min(F.when(~F.col("status").isin("complete", "failed"), F.col(pos)))
    spans = df.groupBy(*keys).agg(F.coalesce(open_pos, F.max(pos)).alias("_at"))
    run = OrderedFrame.of(df, keys, [pos], rows).running(
        {"_before": ("sum", duration), "_known": ("count", duration), "_rows": ("count", F.lit(1)),
         "_lastpos": ("max", F.when(F.col("status").isin("complete", "failed"), F.col(pos)))},
        inclusive=False,
    ).done()
    here = join_on(run, spans, keys).filter(F.col(pos) == F.col("_at"))
    known = F.coalesce(F.col("_known"), F.lit(0)) == F.coalesce(F.col("_rows"), F.lit(0))
    left = F.when(known & F.col(outer).isNotNull(), F.greatest(F.lit(0.0), F.col(outer) - F.coalesce("_before", F.lit(0.0))))
    return here.withColumns(
        {"active_elapsed": F.round(F.coalesce(F.col(duration), left), 3), "last_pos": F.col("_lastpos")}
    ).drop("_before", "_known", "_rows", "_at", "_lastpos")


def item_count_from_text(col) -> Column:
    """Number of items a label such as ``0001..0004`` or ``a,b`` names; empty is 0."""
    c = F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
    lo = F.regexp_extract(c, r"^(?:0[xX])?([0-9a-fA-F]{1,8})\.\.", 1)
    hi = F.regexp_extract(c, r"\.\.(?:0[xX])?([0-9a-fA-F]{1,8})$", 1)
    span = F.conv(hi, 16, 10).cast("bigint") - F.conv(lo, 16, 10).cast("bigint") + 1
    parsed = (lo != "") & (hi != "")
    return (
        F.when(c == "", F.lit(0).cast("bigint"))
        .when(c.contains(".."), F.when(parsed, F.greatest(F.lit(1), span)).otherwise(F.lit(1)))
        .when(c.contains(","), F.greatest(F.lit(1), F.size(F.filter(F.split(c, ","), lambda p: F.trim(p) != ""))))
        .otherwise(F.lit(1))
        .cast("bigint")
    )


def forecast_finish(
    done: DataFrame, slots: DataFrame, order: str, complete: Column, target: int, workers: Column, n: int = 64
) -> DataFrame:
    """Seconds per item over the last ``n`` jobs (else the slots' last timings), rate and ETA.

    Done: order, outer_elapsed, elapsed, complete_items, label. Slots: last_seconds, last_items, label.
    """
    def sample(df: DataFrame, elapsed: Column, items: str) -> DataFrame:
        count = F.when(F.coalesce(F.col(items), F.lit(0)) > 0, F.col(items)).otherwise(item_count_from_text("label"))
        ok = (elapsed > 0) & (count > 0)
        return df.agg(F.avg(F.when(ok, elapsed / count)).alias("s"))

    last = done.orderBy(F.col(order).desc()).limit(n)
    jobs = sample(last, _number("outer_elapsed", "elapsed"), "complete_items")
    history = sample(slots, F.col("last_seconds"), "last_items")
    out = jobs.select(F.col("s").alias("_j"), history.scalar().alias("_h"), complete.alias("_c"), workers.alias("_w"))
    seconds = F.coalesce("_j", "_h")
    basis = F.when(F.col("_j").isNotNull(), "recent jobs").when(F.col("_h").isNotNull(), "slot timings").otherwise("warming up")
    w = F.greatest(F.lit(0), F.col("_w"))
    rate = F.when((seconds > 0) & (w > 0), w * 3600.0 / seconds)
    eta = F.greatest(F.lit(0), F.lit(target) - F.col("_c")) / (rate / 3600.0)
    return out.select(
        seconds.alias("seconds_per_item"), basis.alias("basis"), rate.alias("per_hour"), eta.alias("eta_seconds"),
        duration_text(eta).alias("eta_text"),
    )
