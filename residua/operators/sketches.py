"""Profiles as mergeable sketches: made per partition, kept as columns, united without reading the rows again."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import PROFILE

#: Registers of a distinct sketch (base-2 logarithm) and size of a quantile sketch.
REGISTERS, ITEMS = 14, 800
#: Standard errors a distinct count is allowed to be off by.
DEVIATIONS = 4


def distinct_bound(registers: int = REGISTERS) -> float:
    """Relative error an estimate keeps in all but about one of 15,000 cases."""
    return DEVIATIONS * 1.04 / math.sqrt(1 << registers)


def rank_bound(items: int = ITEMS) -> float:
    """Share of the rows a quantile may lie away from its rank: four times the error that 99 of 100 quantiles keep."""
    return 4 * 2.296 / items**0.9021


def profile_sketches(df: DataFrame, by: Sequence[str], keys: Sequence[str], value: str, registers: int = REGISTERS, items: int = ITEMS) -> DataFrame:
    """One row per group of ``by``: rows, values, min, max, total, and sketches of the distinct ``keys`` and of the values.

    Null and NaN values are no values; null keys are keys. Spark merges the sketches of a group's parts before and after
    the shuffle, so a group of any size is a few kilobytes in any task.
    """
    number = F.col(value).cast("double")
    number = F.when(~F.isnan(number), number)
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    rows = df.select(*by, key.alias("_key"), number.alias("_value"))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count("_value").alias("n_values"), F.min("_value").alias("min"), F.max("_value").alias("max"), F.sum("_value").alias("total"),
        F.hll_sketch_agg("_key", registers).alias("distinct"), F.kll_sketch_agg_double("_value", items).alias("ranks"),
    )


def unite(profiles: DataFrame, by: Sequence[str]) -> DataFrame:
    """Profiles of coarser groups, of the same columns."""
    counts = [F.sum(c).alias(c) for c in ("n", "n_values", "total")]
    held = F.when(F.col("n_values") > 0, F.col("ranks"))
    return profiles.groupBy(*by).agg(
        *counts, F.min("min").alias("min"), F.max("max").alias("max"), F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double(held).alias("ranks")
    ).select(*by, "n", "n_values", "min", "max", "total", "distinct", "ranks")


def estimates(profiles: DataFrame, by: Sequence[str]) -> DataFrame:
    """Distinct count, mean and the quantiles of the exact profile; without values all but the counts are null."""
    some = F.col("n_values") > 0

    def quantile(p: float) -> Column:
        return F.when(some, F.kll_sketch_get_quantile_double("ranks", F.lit(float(p))))

    return profiles.select(
        *by, "n", "n_values", F.hll_sketch_estimate("distinct").alias("n_distinct"), "min", "max", F.when(some, F.col("total") / F.col("n_values")).alias("mean"), *[quantile(p).alias(n) for n, p in PROFILE]
    )


def checked(df: DataFrame, estimated: DataFrame, by: Sequence[str], keys: Sequence[str], value: str, registers: int = REGISTERS, items: int = ITEMS) -> DataFrame:
    """Whether each estimate keeps its bound, from one exact pass: columns ``<name>_ok`` beside the exact distinct count.

    A quantile keeps its bound if its rank, between the shares of rows below it and up to it, is near enough. ``by`` names at least one column.
    """
    near = rank_bound(items)
    number = F.col(value).cast("double")
    sides = estimated.select(*[F.col(b).alias(f"_{b}") for b in by], *[F.col(n).alias(f"_{n}") for n, _ in PROFILE])
    same = [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by]
    rows = df.filter(number.isNotNull() & ~F.isnan(number)).join(sides, same)
    shares = []
    for n, p in PROFILE:
        below, upto = F.avg((number < F.col(f"_{n}")).cast("int")), F.avg((number <= F.col(f"_{n}")).cast("int"))
        shares.append(((below <= p + near) & (upto >= p - near)).alias(f"{n}_ok"))
    ranks = rows.groupBy(*by).agg(*shares)
    exact = df.select(*by, *keys).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("exact_distinct"))
    out = estimated.alias("e")
    for side, name in ((exact, "x"), (ranks, "r")):
        on = [F.col(f"e.{b}").eqNullSafe(F.col(f"{name}.{b}")) for b in by]
        out = out.join(side.alias(name), on, "left")
    off = F.abs(F.col("n_distinct") - F.col("exact_distinct")) <= F.greatest(F.lit(1.0), distinct_bound(registers) * F.col("exact_distinct"))
    return out.select(*[F.col(f"e.{b}") for b in by], "n", "n_values", "min", "max", "exact_distinct", off.alias("distinct_ok"), *[F.col(f"{n}_ok") for n, _ in PROFILE])
