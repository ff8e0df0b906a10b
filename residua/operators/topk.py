"""Top-k, sampling, paging and ordering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import OrderedFrame


def top_k(df: DataFrame, score: Column, tie: str, k: int, shown: str = "score") -> DataFrame:
    """k best by the unrounded score, earlier ``tie`` first; the shown score has 3 decimals."""
    return (
        df.withColumn("_score", score)
        .orderBy(F.col("_score").desc(), F.col(tie))
        .limit(k)
        .withColumn(shown, F.round("_score", 3))
        .drop("_score")
    )


def worst_n(df: DataFrame, key: str, n: int = 25) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), key).limit(n)


def frequent_keys(df: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Exact top-k composite keys with their share of all rows and the distinct key count."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.col("n").desc(), *keys).limit(k)
    return top.withColumns(
        {
            "share": F.col("n") / df.agg(F.count(F.lit(1))).scalar(),
            "n_distinct": counts.agg(F.count(F.lit(1))).scalar(),
        }
    )


def approx_distinct(df: DataFrame, keys: Sequence[str], rsd: float = 0.02) -> DataFrame:
    return df.agg(F.approx_count_distinct(F.struct(*keys), rsd).alias("n_distinct"))


def sample_keys(
    df: DataFrame, order: Sequence[str], n: int, mode: str = "first", explicit: DataFrame | None = None, rows: int | None = None
) -> DataFrame:
    """``first`` n rows, or n evenly spaced positions (repeats dropped).

    Rows named by ``explicit`` come first and are topped up to n; a positive n adds at least one.
    """
    if mode == "first":
        if explicit is None:
            return df.orderBy(*order).limit(n)
        named = df.join(explicit, explicit.columns, "left_semi")
        rest = df.join(explicit, explicit.columns, "left_anti").orderBy(*order).limit(max(1, n - named.count()) if n > 0 else 0)
        return named.unionByName(rest)
    if mode != "stride":
        raise ValueError(f"unknown sample mode: {mode!r}")
    placed = OrderedFrame.of(df, [], order, rows).row_number("_rn").done()
    total = df.agg(F.count(F.lit(1))).scalar()
    if n <= 0:
        return df.limit(0)
    if n == 1:
        return placed.filter(F.col("_rn") == 1).drop("_rn")
    # position p is picked when some i in [0, n) has floor(i * (total - 1) / (n - 1)) = p
    p = F.col("_rn") - 1
    nearest = F.ceil(p * (n - 1) / F.greatest(total - 1, F.lit(1)))
    hit = F.floor(nearest * (total - 1) / (n - 1)) == p
    return placed.filter((total <= n) | (hit & (nearest < n))).drop("_rn")


def page(df: DataFrame, order: Sequence, limit: int, offset: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def order_schedule(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.orderBy(*keys)


def recent(df: DataFrame, stamp: str, name: str, n: int) -> DataFrame:
    return df.orderBy(F.col(stamp).desc(), F.col(name).desc()).limit(n)


def order_and_group(
    df: DataFrame, mode: str, group: str, frame: str, live: str, raw: str, groups: int | None = None
) -> DataFrame:
    """Processing order as sort columns; ``seed`` mode numbers the groups and keeps the first ones.

    Group numbers rank the distinct group values, a table far smaller than the rows.
    """
    if mode == "target":
        return df.orderBy(live, raw)
    if mode != "seed":
        raise ValueError(f"unsupported order: {mode!r}")
    ids = df.select(group).distinct()
    ids = OrderedFrame.of(ids, [], [group], bound=df).row_number("group_no").done()
    out = df.join(ids, group)
    if groups is not None:
        out = out.filter(F.col("group_no") <= groups)
    return out.orderBy("group_no", frame, live, raw)
