"""Key sets, ranges, gaps and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import format_hex, parse_int_text, percent
from .ordered import OrderedFrame, dealt, first_n_per_group


def union_keys(frames: Sequence[DataFrame], key: str) -> DataFrame:
    out = frames[0].select(key)
    for f in frames[1:]:
        out = out.union(f.select(key))
    return out.distinct()


def except_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key).distinct(), key, "left_anti")


def intersect_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def complement_keys(df: DataFrame, key: str, lo: int, hi: int) -> DataFrame:
    """Keys of [lo, hi) that do not occur."""
    domain = df.sparkSession.range(lo, hi).withColumnRenamed("id", key)
    return domain.join(df.select(F.col(key).cast("bigint").alias(key)), key, "left_anti")


missing_keys = complement_keys


def two_way_anti(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys seen on one side only, tagged ``left_only`` / ``right_only``."""
    left = a.select(key).distinct().join(b.select(key), key, "left_anti").withColumn("side", F.lit("left_only"))
    right = b.select(key).distinct().join(a.select(key), key, "left_anti").withColumn("side", F.lit("right_only"))
    return left.unionByName(right)


def pair_completeness(a: DataFrame, b: DataFrame, key: str, lo: int, hi: int, bucket: Column | None = None) -> DataFrame:
    """Count of both / left_only / right_only / absent over the expected range, per bucket."""
    k = F.col(key).cast("bigint").alias(key)
    sides = (
        a.select(k, F.lit(1).alias("_a"), F.lit(0).alias("_b"))
        .unionByName(b.select(k, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
        .unionByName(a.sparkSession.range(lo, hi).select(F.col("id").alias(key), F.lit(0).alias("_a"), F.lit(0).alias("_b")))
        .groupBy(key)
        .agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
        .filter((F.col(key) >= lo) & (F.col(key) < hi))
    )
    status = (
        F.when((F.col("_a") == 1) & (F.col("_b") == 1), "both")
        .when(F.col("_a") == 1, "left_only")
        .when(F.col("_b") == 1, "right_only")
        .otherwise("absent")
    )
    sides = sides.withColumn("bucket", bucket if bucket is not None else F.lit(0)).withColumn("status", status)
    return sides.groupBy("bucket", "status").agg(F.count(F.lit(1)).alias("n"))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with the surplus row count."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
        .withColumn("surplus", F.col("n") - 1)
    )


def coverage(df: DataFrame, group: str, item: str, expected: int) -> DataFrame:
    """Distinct items per group against the expected number."""
    return (
        df.select(group, item)
        .distinct()
        .groupBy(group)
        .agg(F.count(item).alias("n_items"))
        .withColumn("missing", F.lit(expected) - F.col("n_items"))
        .withColumn("complete", F.col("n_items") >= expected)
        .withColumn("percent", percent("n_items", F.lit(expected)))
    )


def missing_samples(df: DataFrame, groups: DataFrame, group: str, item: str, lo: int, hi: int, n: int) -> DataFrame:
    """Up to ``n`` smallest missing items per group, found from the gaps between present items.

    Nothing of size groups x items is built: each gap yields at most ``n`` candidates.
    """
    present = df.select(group, F.col(item).cast("bigint").alias(item)).filter(
        (F.col(item) >= lo) & (F.col(item) < hi)
    )
    fences = groups.select(group).distinct().select(group, F.explode(F.array(F.lit(lo - 1).cast("bigint"), F.lit(hi).cast("bigint"))).alias(item))
    items = present.unionByName(fences).distinct()
    gaps = OrderedFrame.of(items, [group], [item], bound=df).neighbour({"_next": item}, 1).done()
    gaps = gaps.filter(F.col("_next") - F.col(item) > 1)
    last = F.least(F.col("_next") - 1, F.col(item) + n)
    out = gaps.select(group, F.explode(F.sequence(F.col(item) + 1, last)).alias(item))
    return first_n_per_group(out, [group], [item], n).select(group, item)


def compact_ranges(df: DataFrame, key: str, group: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """Maximal runs of consecutive ids: lo, hi, n and the text form."""
    ids = df.select(*group, F.col(key).cast("bigint").alias(key)).filter(F.col(key).isNotNull()).distinct()
    placed = OrderedFrame.of(ids, group, [key], rows, bound=df).row_number("_rn").done()
    runs = placed.groupBy(*group, (F.col(key) - F.col("_rn")).alias("_run")).agg(
        F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(F.lit(1)).alias("n")
    )
    text = F.when(F.col("lo") == F.col("hi"), format_hex("lo")).otherwise(
        F.concat(format_hex("lo"), F.lit("-"), format_hex("hi"))
    )
    return runs.drop("_run").withColumn("text", text)


def run_counts(df: DataFrame, key: str, group: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """Number of maximal runs of consecutive ids, and of distinct ids, per group.

    A run is counted where the id before is not the one below, so none is held in memory.
    """
    ids = df.select(*group, F.col(key).cast("bigint").alias(key)).filter(F.col(key).isNotNull())
    ids = dealt(ids, [*group, key], df).distinct()
    placed = OrderedFrame.of(ids, group, [key], rows, bound=df, deal=True).neighbour({"_prev": key}, -1).done()
    starts = ~F.col("_prev").eqNullSafe(F.col(key) - 1)
    return placed.groupBy(*group).agg(F.count_if(starts).alias("runs"), F.count(F.lit(1)).alias("present"))


def expand_ranges(df: DataFrame, text: str, lenient: bool = False, limit: int = 1 << 16, keep: Sequence[str] = ()) -> DataFrame:
    """Ids named by texts such as ``0-3, 7 0x10..0x12``; the first occurrence of an id is kept.

    Strict mode fails on bad tokens, on ranges that end before they start and on ids from ``limit`` on; lenient mode
    leaves the whole text out for any of these. A range is cut into pieces first, so none becomes one long array.
    """
    raw = F.filter(F.split(F.trim(F.col(text)), r"[\s,]+"), lambda t: t != "")

    def ends(token: Column) -> tuple[Column, Column, Column]:
        parts = F.split(F.regexp_replace(token, r"^([^.\-]+)(\.\.|-)(.+)$", "$1\u0001$3"), "\u0001")
        lo, hi = parse_int_text(F.element_at(parts, 1)), parse_int_text(F.element_at(parts, -1))
        return lo, hi, lo.isNull() | hi.isNull() | (hi < lo) | (hi >= limit)

    rows = df.select(*keep, raw.alias("_tokens"))
    if lenient:
        rows = rows.filter(~F.exists("_tokens", lambda t: ends(t)[2]))
    tokens = rows.select(*keep, F.posexplode("_tokens").alias("pos", "token"))
    lo, hi, bad = ends(F.col("token"))
    if not lenient:
        lo = F.when(bad, F.raise_error(F.concat(F.lit("bad range token: "), F.col("token")))).otherwise(lo)
    tokens = tokens.select(*keep, "pos", lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"))
    ids = exploded_range(tokens, F.col("lo"), F.col("hi"), "id").select(*keep, "pos", "id")
    return ids.groupBy(*keep, "id").agg(F.min("pos").alias("pos"))


RANGE_PIECE = 1 << 20


def exploded_range(df: DataFrame, lo: Column, hi: Column, name: str) -> DataFrame:
    """A row for each number from ``lo`` to ``hi``, in two steps: pieces of about a million, dealt anew, then numbers."""
    pieces = df.select("*", lo.cast("bigint").alias("_lo"), hi.cast("bigint").alias("_hi"))
    pieces = pieces.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_hi") - F.col("_lo")) / RANGE_PIECE))).alias("_piece"))
    first = F.col("_lo") + F.col("_piece") * RANGE_PIECE
    numbers = F.sequence(first, F.least(first + (RANGE_PIECE - 1), F.col("_hi")))
    return pieces.hint("rebalance").select("*", F.explode(numbers).alias(name)).drop("_lo", "_hi", "_piece")


def select_keys(df: DataFrame, keys: DataFrame, key: str, order: Sequence, limit: int | None = None) -> DataFrame:
    """Rows whose key is listed, then the first ``limit`` in order."""
    out = df.join(keys.select(key).distinct(), key, "left_semi")
    return out if limit is None else out.orderBy(*order).limit(limit)


def set_overlap(df: DataFrame, group: str, item: str, a, b) -> DataFrame:
    """Shared count and Jaccard of two groups' item sets in one aggregation, no self join."""
    sides = (
        df.filter(F.col(group).isin(a, b))
        .groupBy(item)
        .agg(F.max((F.col(group) == a).cast("int")).alias("_a"), F.max((F.col(group) == b).cast("int")).alias("_b"))
    )
    return sides.agg(
        F.coalesce(F.sum("_a"), F.lit(0)).alias("n_a"),
        F.coalesce(F.sum("_b"), F.lit(0)).alias("n_b"),
        F.coalesce(F.sum(F.col("_a") * F.col("_b")), F.lit(0)).alias("shared"),
        F.count(F.lit(1)).alias("n_union"),
    ).withColumn("jaccard", F.coalesce(F.col("shared") / F.when(F.col("n_union") > 0, F.col("n_union")), F.lit(0.0)))


def in_scope_bounds(target: int, domain: int = 1 << 16) -> tuple[int, int]:
    """Half-open range of ids a target counts: everything, or 1..target without the two top ids."""
    return (0, domain) if target >= domain else (1, min(target, domain - 2) + 1)


def id_range(spark: SparkSession, lo: int, hi: int, name: str) -> DataFrame:
    return spark.range(lo, hi).withColumnRenamed("id", name)
