"""First/latest rows, runs, intervals, rates and stalls over ordered rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import EPSILON
from .ordered import OrderedFrame, first_n_per_group, join_on


def first_occurrence(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Earliest row per key: an aggregate with map-side combine, not a window."""
    if len(order) == 1 and not values:
        return df.groupBy(*keys).agg(F.min(order[0]).alias(order[0]))
    best = F.min(F.struct(*order, *[F.col(v).alias(f"_v{i}") for i, v in enumerate(values)]))
    out = df.groupBy(*keys).agg(best.alias("_best"))
    return out.select(
        *keys, *[F.col("_best")[o].alias(o) for o in order],
        *[F.col("_best")[f"_v{i}"].alias(v) for i, v in enumerate(values)],
    )


def require_covered(found: DataFrame, key: str, expected: int) -> DataFrame:
    """Fail when fewer than ``expected`` distinct keys were reached."""
    n = found.select(key).distinct().count()
    if n < expected:
        raise ValueError(f"stream covered {n} of {expected} keys within the limit")
    return found


def latest_per_key(df: DataFrame, keys: Sequence[str], stamp: str, tie: str, values: Sequence[str]) -> DataFrame:
    """Newest row per key; on an equal stamp the earliest ``tie`` stays."""
    best = F.max_by(F.struct(stamp, tie, *values), F.struct(F.col(stamp), -F.col(tie)))
    return df.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*")


def moving_average(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, width: int, edge: str = "repeat", out: str = "avg", rows: int | None = None
) -> DataFrame:
    """Centred mean of ``width`` rows; edges repeat the end value or count as zero."""
    before = width // 2
    after = width - 1 - before
    of = OrderedFrame.of(df, keys, order, rows)
    framed = of.bounded_frame(
        before,
        after,
        {
            "_sum": lambda w: F.sum(value).over(w),
            "_back": lambda w: F.count(F.lit(1)).over(w.rowsBetween(-before, -1)) if before else F.lit(0),
            "_ahead": lambda w: F.count(F.lit(1)).over(w.rowsBetween(1, after)) if after else F.lit(0),
        },
    )
    if edge == "zero":
        return framed.withColumn(out, F.col("_sum") / width).drop("_sum", "_back", "_ahead")
    ends = df.groupBy(*keys).agg(
        F.min_by(value, F.struct(*order)).alias("_first"), F.max_by(value, F.struct(*order)).alias("_last")
    )
    if keys:
        framed = join_on(framed, ends, keys)
    else:
        framed = framed.withColumns({c: ends.select(c).scalar() for c in ("_first", "_last")})
    total = F.col("_sum") + (F.lit(before) - F.col("_back")) * F.col("_first") + (F.lit(after) - F.col("_ahead")) * F.col("_last")
    return framed.withColumn(out, total / width).drop("_sum", "_back", "_ahead", "_first", "_last")


def smooth_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], vec: str, dims: int, width: int = 5) -> DataFrame:
    """Edge-padded moving average of vector rows, each row then scaled to unit length."""
    parts = df.withColumns({f"_x{i}": F.col(vec)[i].cast("double") for i in range(dims)})
    before = width // 2
    after = width - 1 - before
    framed = OrderedFrame.of(parts, keys, order).bounded_frame(
        before,
        after,
        {
            **{f"_s{i}": (lambda w, i=i: F.sum(f"_x{i}").over(w)) for i in range(dims)},
            "_back": lambda w: F.count(F.lit(1)).over(w.rowsBetween(-before, -1)) if before else F.lit(0),
            "_ahead": lambda w: F.count(F.lit(1)).over(w.rowsBetween(1, after)) if after else F.lit(0),
        },
    )
    ends = df.groupBy(*keys).agg(
        F.min_by(vec, F.struct(*order)).alias("_first"), F.max_by(vec, F.struct(*order)).alias("_last")
    )
    framed = join_on(framed, ends, keys)
    mean = F.array(
        *[
            (
                F.col(f"_s{i}")
                + (F.lit(before) - F.col("_back")) * F.col("_first")[i]
                + (F.lit(after) - F.col("_ahead")) * F.col("_last")[i]
            )
            / width
            for i in range(dims)
        ]
    )
    norm = F.sqrt(F.aggregate(mean, F.lit(0.0), lambda a, x: a + x * x)) + EPSILON
    return framed.withColumn(vec, F.transform(mean, lambda x: x / norm)).select(*df.columns)


def sliding_vectors(
    df: DataFrame, keys: Sequence[str], idx: str, vec: str, frames: int, step: int = 1, out: str = "window", rows: int | None = None
) -> DataFrame:
    """Windows of ``frames`` consecutive rows every ``step`` rows, flattened, centred, unit length.

    ``idx`` is dense from 0 per key. Each collected list has at most ``frames`` entries.
    """
    framed = OrderedFrame.of(df, keys, [idx], rows).bounded_frame(
        0, frames - 1, {"_rows": lambda w: F.collect_list(vec).over(w)}
    )
    flat = F.flatten(F.transform("_rows", lambda r: F.transform(r, lambda x: x.cast("double"))))
    full = framed.filter((F.size("_rows") == frames) & (F.col(idx) % step == 0)).withColumn("_flat", flat)
    mean = F.aggregate("_flat", F.lit(0.0), lambda a, x: a + x) / F.size("_flat")
    full = full.withColumn("_flat", F.transform("_flat", lambda x: x - mean))
    norm = F.sqrt(F.aggregate("_flat", F.lit(0.0), lambda a, x: a + x * x)) + EPSILON
    return full.select(*keys, idx, F.transform("_flat", lambda x: x / norm).alias(out))


def merge_intervals(
    df: DataFrame, keys: Sequence[str], start: str, end: str, tie: str, count: Column | None = None, score: str | None = None, rows: int | None = None
) -> DataFrame:
    """Union of intervals per key; touching intervals merge, a later start opens a new one."""
    of = OrderedFrame.of(df, keys, [start, end, tie], rows).running({"_reach": ("max", end)}, inclusive=False)
    opened = of._with(of.df.withColumn("_new", (F.col("_reach").isNull() | (F.col(start) > F.col("_reach"))).cast("bigint")))
    islands = opened.running({"_island": ("sum", "_new")}).done()
    aggs = [F.min(start).alias(start), F.max(end).alias(end), F.sum(count if count is not None else F.lit(1)).alias("n")]
    if score:
        aggs.append(F.max(score).alias("max_score"))
    return islands.groupBy(*keys, "_island").agg(*aggs).drop("_island")


def rle(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, rows: int | None = None) -> DataFrame:
    """Runs of equal consecutive values: run number, value, first/last order value, length."""
    of = OrderedFrame.of(df, keys, order, rows).neighbour({"_prev": value, "_seen": order[0]}, -1)
    change = F.col("_seen").isNull() | ~F.col(value).eqNullSafe(F.col("_prev"))
    of = of._with(of.df.withColumn("_chg", change.cast("bigint"))).running({"run": ("sum", "_chg")})
    return of.done().groupBy(*keys, "run").agg(
        F.first(value).alias(value),
        F.min(order[0]).alias("first"),
        F.max(order[0]).alias("last"),
        F.count(F.lit(1)).alias("n"),
    )


def expand_runs(df: DataFrame, value: str, n: str, keys: Sequence[str] = ()) -> DataFrame:
    """Inverse of :func:`rle`: one row per repetition."""
    from .sets import exploded_range

    return exploded_range(df.select(*keys, "run", value, n), F.lit(1), F.col(n), "step").select(*keys, "run", value, "step")


def frame_delta(df: DataFrame, keys: Sequence[str], label: str, first, last, value: str, partition: str) -> DataFrame:
    """value(last) - value(first) per key; fails when the two rows lie in different partitions."""
    pick = lambda name, c: F.max(F.when(F.col(label) == name, F.col(c)))
    rows = df.filter(F.col(label).isin(first, last)).groupBy(*keys).agg(
        pick(first, value).alias("_v0"), pick(last, value).alias("_v1"),
        pick(first, partition).alias("_p0"), pick(last, partition).alias("_p1"),
    )
    crossed = F.col("_p0") != F.col("_p1")
    delta = F.when(crossed, F.raise_error(F.lit("rows lie in different partitions"))).otherwise(F.col("_v1") - F.col("_v0"))
    return rows.select(*keys, delta.cast(df.schema[value].dataType).alias("delta"))


def frame_deltas(df: DataFrame, keys: Sequence[str], label: str, first, last, value: str, partition: str | Sequence[str]) -> DataFrame:
    """(keys, delta, problem): value(last) - value(first) per key, or why there is none.

    Problems: ``first-missing``, ``last-missing``, ``other-partition`` where the two rows differ in a partition column (null
    equals null). Of several rows with a label the one with the greatest (partition, value) counts.
    """
    parts = [partition] if isinstance(partition, str) else list(partition)
    here = F.struct(F.struct(*parts).alias("p"), F.col(value).alias("v"))
    pick = lambda name: F.max(F.when(F.col(label) == name, here))
    rows = df.filter(F.col(label).isin(first, last)).groupBy(*keys).agg(pick(first).alias("_a"), pick(last).alias("_b"))
    problem = (
        F.when(F.col("_a").isNull(), "first-missing").when(F.col("_b").isNull(), "last-missing")
        .when(~F.col("_a.p").eqNullSafe(F.col("_b.p")), "other-partition")
    )
    delta = F.when(problem.isNull(), F.col("_b.v") - F.col("_a.v")).cast(df.schema[value].dataType)
    return rows.select(*keys, delta.alias("delta"), problem.alias("problem"))


def check_monotonic(df: DataFrame, keys: Sequence[str], order: Sequence[str], a: str, b: str, lead: int | None = None, rows: int | None = None) -> DataFrame:
    """Rows that break non-decreasing order of ``a`` or ``b`` (or the fixed lead a - b)."""
    of = OrderedFrame.of(df, keys, order, rows).neighbour({"_pa": a, "_pb": b}, -1)
    broken = F.when(F.col(a) < F.col("_pa"), f"{a}-decreases").when(F.col(b) < F.col("_pb"), f"{b}-decreases")
    if lead is not None:
        broken = broken.when(F.col(a) - F.col(b) != lead, "lead-differs")
    return of.done().withColumn("violation", broken).filter(F.col("violation").isNotNull()).drop("_pa", "_pb")


def first_violation(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return first_occurrence(df, keys, order, ["violation"])


def recent_rate(df: DataFrame, keys: Sequence[str], stamp: str, tie: str, n: int = 50) -> DataFrame:
    """Rows per hour over the newest ``n`` rows per key; null with fewer than two or no elapsed time."""
    newest = first_n_per_group(df.select(*keys, stamp, tie), keys, [F.col(stamp).desc(), F.col(tie).desc()], n)
    out = newest.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), (F.max(stamp) - F.min(stamp)).alias("elapsed")
    )
    ok = (F.col("n") >= 2) & (F.col("elapsed") > 0)
    return out.withColumn("per_hour", F.when(ok, (F.col("n") - 1) / F.col("elapsed") * 3600.0))


def progress_rate(
    df: DataFrame, keys: Sequence[str], stamp: str, tie: str, complete: str, target: int, rows: int | None = None
) -> DataFrame:
    """Rate since a baseline that resets whenever the counter falls; ETA and confidence label."""
    of = OrderedFrame.of(df, keys, [stamp, tie], rows).neighbour({"_prev": complete}, -1)
    reset = F.col("_prev").isNull() | (F.col(complete) < F.col("_prev"))
    base = F.struct(F.col(stamp).alias("t"), F.col(tie).alias("k"), F.col(complete).alias("c"))
    of = of._with(of.df.withColumn("_base", F.when(reset, base))).running({"_base": ("max", "_base")})
    gained = F.greatest(F.lit(0), F.col(complete) - F.col("_base.c"))
    elapsed = F.greatest(F.lit(0.0), F.col(stamp).cast("double") - F.col("_base.t").cast("double"))
    out = of.done().withColumns({"gained": gained, "elapsed": elapsed})
    rate = F.when((F.col("elapsed") > 0) & (F.col("gained") > 0), F.col("gained") / F.col("elapsed") * 3600.0)
    out = out.withColumn("per_hour", rate)
    remaining = F.greatest(F.lit(0), F.lit(target) - F.col(complete))
    band = (
        F.when(F.col("per_hour").isNull(), "warming up")
        .when(F.col("gained") < 5, "wide")
        .when(F.col("gained") < 24, "medium")
        .otherwise("narrow")
    )
    return out.withColumns({"eta": remaining / (F.col("per_hour") / 3600.0), "confidence": band}).drop("_prev", "_base")


def stall_flags(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], duration: str,
    multiplier: float = 2.25, slack: float = 1800.0, no_baseline: float = 7200.0, rows: int | None = None,
) -> DataFrame:
    """Flag a duration above max(multiplier * previous, previous + slack), or above ``no_baseline`` alone."""
    of = OrderedFrame.of(df, keys, order, rows).neighbour({"previous": duration}, -1)
    prev = F.col("previous")
    limit = F.when(prev > 0, F.greatest(prev * multiplier, prev + slack)).otherwise(F.lit(no_baseline))
    return of.done().withColumn("stalled", F.coalesce(F.col(duration) > limit, F.lit(False)))


def ranked_preview(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """First and last ``n`` rows in order (``side``), each row once and with the exact number of rows shown on neither side.

    ``order`` names columns and ends with a unique one. With up to 2n rows nothing is left out and the last rows give way.
    """
    total = df.agg(F.count(F.lit(1))).scalar()
    head = df.orderBy(*order).limit(n).withColumn("side", F.lit("first"))
    tail = df.orderBy(*[F.col(c).desc_nulls_last() for c in order]).limit(n).withColumn("side", F.lit("last"))
    tail = tail.withColumn("_rest", total - n).withColumn("_rank", F.row_number().over(Window.orderBy(*[F.col(c).desc_nulls_last() for c in order])))
    tail = tail.filter(F.col("_rank") <= F.col("_rest")).drop("_rest", "_rank")
    return head.unionByName(tail).withColumn("omitted", F.greatest(F.lit(0), total - 2 * n))


def resolve_collisions(df: DataFrame, key: str, priority: Sequence[str], label: str) -> DataFrame:
    """One winner per key by smallest priority tuple; every loser paired with the winner.

    ``priority`` must be unique per row. The winner comes from an aggregate, so a hot key
    is combined before the shuffle and only joined back.
    """
    win = df.groupBy(key).agg(F.min(F.struct(*priority, F.col(label).alias("_label"))).alias("_w"))
    win = win.select(F.col(key), F.col("_w._label").alias("kept"), F.struct(*[F.col("_w")[p].alias(p) for p in priority]).alias("_wp"))
    joined = df.join(win, key)
    same = F.struct(*priority) == F.col("_wp")
    return joined.withColumn("is_kept", same).drop("_wp")


def share_running(df: DataFrame, value: str, tie: str, out: str = "share", rows: int | None = None) -> DataFrame:
    """Cumulative share of the total, largest value first."""
    flipped = df.withColumn("_neg", -F.col(value))
    run = OrderedFrame.of(flipped, [], ["_neg", tie], rows).running({"_run": ("sum", value)}).done()
    return run.withColumn(out, F.col("_run") / df.agg(F.sum(value)).scalar()).drop("_neg", "_run")


def schedule_rank(df: DataFrame, order: Sequence[str], rows: int | None = None) -> DataFrame:
    return OrderedFrame.of(df, [], order, rows).row_number("position").done()
