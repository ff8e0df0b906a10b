"""Rates, distributions, concentration and variance statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import percent, ratio, trailing_zeros16
from .ordered import OrderedFrame, join_on


def rate_by_feature(df: DataFrame, feature: Column, hits: str, cells: str, name: str = "feature") -> DataFrame:
    """Weighted miss rate per feature value: ratio of sums, not mean of ratios."""
    return (
        df.groupBy(feature.alias(name))
        .agg(F.sum(hits).alias("hits"), F.sum(cells).alias("cells"))
        .withColumn("rate", percent("hits", "cells"))
    )


def rates_by_features(df: DataFrame, features: dict[str, Column], hits: str, cells: str) -> DataFrame:
    """Rates for several features in one pass: one grouping set per feature."""
    names = list(features)
    rows = df.select(*[F.coalesce(c.cast("bigint"), F.lit(-1)).alias(n) for n, c in features.items()], hits, cells)
    agg = rows.groupingSets([[n] for n in names], *names).agg(
        F.sum(hits).alias("hits"), F.sum(cells).alias("cells"), *[F.grouping(n).alias(f"_g_{n}") for n in names]
    )
    feature = F.coalesce(*[F.when(F.col(f"_g_{n}") == 0, n) for n in names])
    value = F.coalesce(*[F.when(F.col(f"_g_{n}") == 0, F.col(n)) for n in names])
    out = agg.select(feature.alias("feature"), value.alias("value"), "hits", "cells")
    return out.withColumn("rate", percent("hits", "cells"))


def key_features(upper: str) -> dict[str, Column]:
    """The features rates are broken down by: decile of the 16-bit domain, high nibble, trailing zeros, mod 24."""
    u = F.col(upper).cast("bigint")
    return {
        "decile": F.least(F.floor(u * 10 / 65536), F.lit(9)),
        "high_nibble": F.shiftright(u, 12).bitwiseAND(15),
        "trailing_zeros": trailing_zeros16(u),
        "mod24": u % 24,
    }


def rate_matrix(df: DataFrame, row: Column, col: Column, values: Sequence, hits: str, cells: str) -> DataFrame:
    """Two-feature rate matrix, one column per listed column value."""
    cell = df.withColumn("_c", col).groupBy(row.alias("row")).pivot("_c", list(values))
    out = cell.agg(F.sum(hits).alias("h"), F.sum(cells).alias("n"))
    return out.select("row", *[percent(f"{v}_h", f"{v}_n").alias(f"rate_{v}") for v in values])


def marker_rates(df: DataFrame, by: Sequence[str], marker: Column, hits: str, cells: str) -> DataFrame:
    """Rates of marked against unmarked rows for every combination of ``by`` (cube)."""
    return (
        df.withColumn("marked", marker)
        .cube(*by)
        .agg(
            *[
                ratio(F.sum(F.when(m, F.col(hits))), F.sum(F.when(m, F.col(cells)))).alias(f"rate_{n}")
                for n, m in (("marked", F.col("marked")), ("unmarked", ~F.col("marked")))
            ]
        )
    )


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Equal-width histogram; the top edge belongs to the last bin, outside values are dropped."""
    x = F.col(value).cast("double")
    b = F.least(F.floor((x - lo) / ((hi - lo) / bins)), F.lit(bins - 1))
    return df.filter((x >= lo) & (x <= hi)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def ecdf(df: DataFrame, value: str, out: str = "ecdf", rows: int | None = None) -> DataFrame:
    """Distinct values with the share of rows at or below each.

    Counting per value first makes the ordered scan run over distinct values only.
    """
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    run = OrderedFrame.of(counts, [], [value], rows, bound=df).running({"_le": ("sum", "n")}).done()
    return run.withColumn(out, F.col("_le") / df.agg(F.count(F.lit(1))).scalar()).drop("_le")


def rank_curve(df: DataFrame, value: str, tie: str, rows: int | None = None) -> DataFrame:
    """Rank by descending value, from 1."""
    flipped = df.withColumn("_neg", -F.col(value))
    return OrderedFrame.of(flipped, [], ["_neg", tie], rows).row_number("rank").done().drop("_neg")


def concentration(df: DataFrame, value: str, tie: str, ks: Sequence[int], rows: int | None = None) -> DataFrame:
    """Share of the total held by the k largest rows, for each k (bounded top-k, then one sum)."""
    top = df.orderBy(F.col(value).desc(), F.col(tie)).limit(max(ks))
    placed = OrderedFrame.of(top.withColumn("_neg", -F.col(value)), [], ["_neg", tie], rows, bound=df).row_number("_rn").done()
    total = df.agg(F.sum(value)).scalar()
    sums = placed.agg(*[F.sum(F.when(F.col("_rn") <= k, F.col(value))).alias(f"k{k}") for k in ks])
    return sums.select(
        F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("held")) for k in ks])).alias("s")
    ).select("s.k", "s.held").withColumn("share", F.col("held") / total)


def lorenz(df: DataFrame, value: str, tie: str, points: int, rows: int | None = None) -> DataFrame:
    """Cumulative share of the total at ``points`` + 1 evenly spaced population shares, ascending."""
    placed = OrderedFrame.of(df.select(value, tie), [], [value, tie], rows)
    placed = placed.running({"_rn": ("count", F.lit(1)), "_run": ("sum", value)}).done()
    totals = df.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"))
    n, s = totals.select("n").scalar(), totals.select("s").scalar()
    at = F.floor(F.col("_rn") * points / n)
    before = F.floor((F.col("_rn") - 1) * points / n)
    hit = placed.withColumns({"_at": at, "_before": before}).filter(F.col("_at") > F.col("_before"))
    return hit.select(F.explode(F.sequence(F.col("_before") + 1, F.col("_at"))).alias("point"), (F.col("_run") / s).alias("share"))


def severity_bands(df: DataFrame, value: str, low: int = 255, high: int = 32768) -> DataFrame:
    band = F.when(F.col(value) <= low, "low").when(F.col(value) >= high, "high").otherwise("mid")
    return df.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


# The quantiles a profile reports.
PROFILE = [("p01", 0.01), ("p05", 0.05), ("median", 0.5), ("p95", 0.95), ("p99", 0.99)]


def quantile_profile(df: DataFrame, value: str, keys: Sequence[str] = (), exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """min, p01, p05, mean, median, p95, p99, max.

    Exact quantiles are read off value counts: the buffer of a group is its distinct values,
    so repeated values cost nothing; ``exact=False`` keeps a fixed-size sketch instead.
    """
    if not exact:
        q = [F.percentile_approx(value, p, accuracy).alias(n) for n, p in PROFILE]
        return df.groupBy(*keys).agg(F.min(value).alias("min"), F.avg(value).alias("mean"), F.max(value).alias("max"), *q)
    return _exact_profile(df, value, list(keys))


def _exact_profile(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Exact linear-interpolation quantiles by position: count per value, running count, pick."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    of = OrderedFrame.of(counts, keys, [value], bound=df).running({"_le": ("sum", "_n")})
    placed = of.done()
    totals = df.groupBy(*keys).agg(
        F.count(value).alias("_all"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean")
    )
    if keys:
        placed = join_on(placed, totals, keys)
        rest = [F.first(c).alias(c) for c in ("min", "mean", "max")]
    else:
        placed = placed.withColumns({c: totals.select(c).scalar() for c in ("_all", "min", "mean", "max")})
        rest = [F.first(c).alias(c) for c in ("min", "mean", "max")]
    x = F.col(value).cast("double")
    picks = []
    for name, p in PROFILE:
        pos = (F.col("_all") - 1) * p
        lo, hi = F.floor(pos), F.ceil(pos)
        at = lambda k: F.max(F.when((F.col("_le") - F.col("_n") <= k) & (F.col("_le") > k), x))
        frac = F.max(pos - lo)
        picks.append((at(lo) + (at(hi) - at(lo)) * frac).alias(name))
    return placed.groupBy(*keys).agg(*rest, *picks)


def variance_explained(df: DataFrame, group: Column, y: str) -> DataFrame:
    """R^2 of a categorical feature: between-group over total sum of squares, from group moments."""
    v = F.col(y).cast("double")
    g = df.filter(v.isNotNull()).groupBy(group.alias("_g")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q")
    )
    return g.agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("groups"),
        (F.sum(F.col("s") * F.col("s") / F.col("n")) - F.sum("s") * F.sum("s") / F.sum("n")).alias("ss_between"),
        (F.sum("q") - F.sum("s") * F.sum("s") / F.sum("n")).alias("ss_total"),
    ).withColumn("r2", ratio("ss_between", "ss_total"))


def transition_ratio(df: DataFrame, keys: Sequence[str], order: Sequence[str], bit: Column, rows: int | None = None) -> DataFrame:
    """Bit changes along the order over the random expectation 2p(1-p)(n-1)."""
    of = OrderedFrame.of(df.withColumn("_bit", bit.cast("int")), keys, order, rows).neighbour({"_prev": "_bit"}, -1)
    agg = of.done().groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("_bit").alias("ones"),
        F.coalesce(F.sum((F.col("_bit") != F.col("_prev")).cast("int")), F.lit(0)).alias("transitions"),
    )
    p = F.col("ones") / F.col("n")
    expected = p * 2.0 * (F.lit(1.0) - p) * (F.col("n") - 1)
    return agg.withColumn("expected", expected).withColumn("ratio", ratio("transitions", "expected"))


def unique_outcomes(df: DataFrame, outcome: Sequence[str], member: str) -> DataFrame:
    """Every member of every outcome, a row each, with the outcome's member count, first member, and whether it was hit once.

    Members stay rows: a common outcome is a long group, not a long array.
    """
    counts = df.groupBy(*outcome).agg(F.count(F.lit(1)).alias("n"), F.min(member).alias("first_member"))
    return join_on(df.select(*outcome, member), counts.withColumn("is_unique", F.col("n") == 1), list(outcome))


def job_totals(df: DataFrame, keys: Sequence[str], status: str, items: str, records: str) -> DataFrame:
    """Items of completed jobs, failed jobs and records.

    A completed job without an item count, or with none counted, stands for one item. Every
    status but ``complete`` is a failed job.
    """
    done = F.coalesce(F.col(status) == "complete", F.lit(False))
    count = F.when(F.coalesce(F.col(items), F.lit(0)) == 0, F.lit(1)).otherwise(F.col(items))
    return df.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(done, count)), F.lit(0)).cast("bigint").alias("complete_items"),
        F.count_if(~done).alias("failed_jobs"),
        F.coalesce(F.sum(F.coalesce(F.col(records), F.lit(0))), F.lit(0)).cast("bigint").alias("records"),
    )


def throughput_by_setting(df: DataFrame, setting: str, done: Column, records: str, seconds: str) -> DataFrame:
    return (
        df.groupBy(setting)
        .agg(F.count_if(done).alias("completed"), F.sum(records).alias("records"), F.sum(seconds).alias("elapsed"))
        .withColumn("per_hour", ratio(F.col("completed") * 3600.0, "elapsed"))
    )


def lane_failures(df: DataFrame, key: str, counters: Sequence[str]) -> DataFrame:
    """Keys with any non-zero counter, and how many counters are non-zero."""
    sums = df.groupBy(key).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters])
    nonzero = sum(((F.col(c) != 0).cast("int") for c in counters), F.lit(0))
    return sums.withColumn("failed_counters", nonzero).filter(F.col("failed_counters") > 0)


def hotspots(df: DataFrame, stages: Sequence[str]) -> DataFrame:
    """Stage times summed over all rows, largest first."""
    sums = df.agg(*[F.sum(s).alias(s) for s in stages])
    return sums.select(
        F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).cast("double").alias("total")) for s in stages])).alias("r")
    ).select("r.*").orderBy(F.col("total").desc(), "stage")
