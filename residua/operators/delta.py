"""Lossless residual tables: store what a model gets wrong, rebuild, and prove equality."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import changed_mask, percent, residual_key
from .residual import first_match, candidate_vectors, residual_vs_model, with_vectors


def encode_exceptions(fact: DataFrame, model: DataFrame, lane: str, key: str, actual: str = "actual") -> DataFrame:
    """Only the cells the model misses, as XOR against the prediction (0 where none exists)."""
    scored = residual_vs_model(fact.select(lane, key, actual), model, key, actual)
    return scored.filter("miss").select(
        lane, key, F.col(actual).bitwiseXOR(F.coalesce("predicted", F.lit(0).cast("bigint"))).alias("xor")
    )


def decode_exceptions(cells: DataFrame, exceptions: DataFrame, model: DataFrame, lane: str, key: str) -> DataFrame:
    """Rebuild every cell: the prediction, XOR-ed where an exception is stored."""
    out = cells.select(lane, key).join(model.select(key, "predicted"), key, "left").join(exceptions, [lane, key], "left")
    value = F.coalesce("predicted", F.lit(0).cast("bigint")).bitwiseXOR(F.coalesce("xor", F.lit(0).cast("bigint")))
    return out.select(lane, key, value.alias("actual"))


@dataclass
class TwoStage:
    """The three tables of a two-stage encoding. ``shift``: class rows; ``explicit``: the rest.

    ``rows``, where known, holds all three as one frame with a ``kind`` column.
    """

    shift: DataFrame
    explicit: DataFrame
    misses: DataFrame
    rows: DataFrame | None = None


def _tables_of(rows: DataFrame, lane: str, key: str) -> TwoStage:
    return TwoStage(
        rows.filter("kind = 'shift'").select(lane, key, "class_id"),
        rows.filter("kind = 'explicit'").select(lane, key, "mask", "residual", "raw"),
        rows.select(lane, key),
        rows,
    )


def stored(tables: TwoStage, path: str, lane: str = "lane", key: str = "upper") -> TwoStage:
    """Write the encoded rows once, one folder per kind, and read the tables from there."""
    tables.rows.write.mode("overwrite").partitionBy("kind").parquet(path)
    return _tables_of(tables.rows.sparkSession.read.schema(tables.rows.schema).parquet(path), lane, key)


def _dimension(model: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """Prediction, default second-stage value and candidate vectors of each key, in one table."""
    rows = model.select(key, "predicted").join(candidate_vectors(candidates, key), key, "full_outer")
    return rows.withColumn("base", F.when(F.get("ids", F.lit(0)) == 0, F.get("values", F.lit(0))))


def _with_dimension(cells: DataFrame, model: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    return with_vectors(cells, _dimension(model, candidates, key), candidates.select(key).unionByName(model.select(key)), key)


def encode_two_stage(fact: DataFrame, model: DataFrame, candidates: DataFrame, lane: str, key: str, actual: str = "actual") -> TwoStage:
    """Model first; misses go to the first matching candidate class; what is left is explicit.

    Class 0 holds the default second-stage value: cells equal to it need no row beyond the
    miss mark. Higher classes store their class, unmatched cells store the changed fields
    against class 0 (or the raw value where a high bit differs or class 0 is absent).
    """
    scored = _with_dimension(fact.select(lane, key, actual), model, candidates, key).filter(~F.col(actual).eqNullSafe(F.col("predicted")))
    staged = first_match(scored, actual)
    fits = F.col("base").isNotNull() & (F.shiftrightunsigned(F.col(actual).bitwiseXOR(F.col("base")), 30) == 0)
    kind = F.when(F.col("class_id") > 0, "shift").when(F.col("class_id") < 0, "explicit").otherwise("default")
    left = F.col("class_id") < 0
    rows = staged.select(
        lane,
        key,
        F.when(F.col("class_id") > 0, F.col("class_id")).cast("int").alias("class_id"),
        F.when(left & fits, changed_mask(actual, "base")).alias("mask"),
        F.when(left & fits, residual_key(actual, "base")).alias("residual"),
        F.when(left & ~fits, F.col(actual)).alias("raw"),
        kind.alias("kind"),
    )
    return _tables_of(rows, lane, key)


def decode_two_stage(cells: DataFrame, tables: TwoStage, model: DataFrame, candidates: DataFrame, lane: str, key: str) -> DataFrame:
    """Model value, then class 0 for miss marks, then shift classes, then explicit rows.

    Fails when one cell is stored both as shift and as explicit.
    """
    from ..functions.keys import FIELD_MASK, FIELD_SHIFTS

    marks = (
        tables.misses.select(lane, key, F.lit(1).alias("_m"), F.lit(None).cast("int").alias("class_id"), F.lit(None).cast("int").alias("mask"), F.lit(None).cast("bigint").alias("residual"), F.lit(None).cast("bigint").alias("raw"), F.lit(0).alias("_kind"))
        .unionByName(tables.shift.select(lane, key, F.col("class_id").cast("int"), F.lit(1).alias("_kind")), allowMissingColumns=True)
        .unionByName(tables.explicit.withColumn("_kind", F.lit(2)), allowMissingColumns=True)
        .groupBy(lane, key)
        .agg(
            F.max("class_id").alias("class_id"), F.max("mask").alias("mask"), F.max("residual").alias("residual"), F.max("raw").alias("raw"),
            F.max((F.col("_kind") == 1).cast("int")).alias("_s"), F.max((F.col("_kind") == 2).cast("int")).alias("_e"),
        )
    )
    out = _with_dimension(cells.select(lane, key), model, candidates, key).join(marks, [lane, key], "left")
    out = out.withColumn("shifted", F.get("values", F.array_position("ids", F.col("class_id")).cast("int") - 1))
    zero = F.lit(0).cast("bigint")
    cleared, filled = zero, zero
    for i, shift in enumerate(FIELD_SHIFTS):
        changed = F.col("mask").bitwiseAND(1 << i) != 0
        new = F.shiftrightunsigned(F.col("residual"), 6 + 5 * i).bitwiseAND(FIELD_MASK)
        cleared = cleared.bitwiseOR(F.when(changed, F.lit(FIELD_MASK << shift).cast("bigint")).otherwise(zero))
        filled = filled.bitwiseOR(F.when(changed, F.shiftleft(new, shift)).otherwise(zero))
    rebuilt = F.col("base").bitwiseAND(F.bitwise_not(cleared)).bitwiseOR(filled)
    conflict = (F.col("_s") == 1) & (F.col("_e") == 1)
    value = (
        F.when(conflict, F.raise_error(F.lit("cell stored both as shift and as explicit")).cast("bigint"))
        .when(F.col("_e") == 1, F.coalesce(F.col("raw"), rebuilt))
        .when(F.col("_s") == 1, F.col("shifted"))
        .when(F.col("_s").isNotNull(), F.col("base"))
        .otherwise(F.col("predicted"))
    )
    return out.select(lane, key, value.alias("actual"))


def verify_roundtrip(a: DataFrame, b: DataFrame, lane: str, key: str, value: str = "actual") -> DataFrame:
    """Per lane: cells, mismatches and the first mismatching key."""
    left = a.select(lane, key, F.col(value).alias("_a"), F.lit(1).alias("_ia"))
    right = b.select(lane, key, F.col(value).alias("_b"), F.lit(1).alias("_ib"))
    both = left.join(right, [lane, key], "full_outer")
    bad = F.col("_ia").isNull() | F.col("_ib").isNull() | ~F.col("_a").eqNullSafe(F.col("_b"))
    return both.groupBy(lane).agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(bad).alias("mismatches"), F.min(F.when(bad, F.col(key))).alias("first_mismatch")
    )


def rule_residual(misses: DataFrame, predicted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Symmetric difference of the miss set and the predicted set, tagged by side."""
    both = (
        misses.select(*keys, F.lit(1).alias("_m"), F.lit(0).alias("_p"))
        .unionByName(predicted.select(*keys, F.lit(0).alias("_m"), F.lit(1).alias("_p")))
        .groupBy(*keys)
        .agg(F.max("_m").alias("_m"), F.max("_p").alias("_p"))
        .filter(F.col("_m") != F.col("_p"))
    )
    return both.select(*keys, F.when(F.col("_m") == 1, "missed_only").otherwise("predicted_only").alias("side"))


def factor_template(df: DataFrame, lane: str, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(lane table, report): columns constant within a lane are hoisted; varying ones are null.

    The report counts, per column, the lanes it is constant in and the rows of lanes where it
    deviates from the lane's smallest value.
    """
    spans = df.groupBy(lane).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.min(c).alias(f"_lo_{c}") for c in columns],
        *[F.max(c).alias(f"_hi_{c}") for c in columns],
        *[F.count(c).alias(f"_n_{c}") for c in columns],
    )
    same = {
        c: (F.col(f"_lo_{c}").eqNullSafe(F.col(f"_hi_{c}"))) & ((F.col(f"_n_{c}") == F.col("rows")) | (F.col(f"_n_{c}") == 0))
        for c in columns
    }
    table = spans.select(lane, "rows", *[F.when(same[c], F.col(f"_lo_{c}")).alias(c) for c in columns], *[same[c].alias(f"{c}_constant") for c in columns])
    lows = spans.select(lane, *[F.col(f"_lo_{c}") for c in columns])
    off = df.join(lows, lane).agg(*[F.count_if(~F.col(c).eqNullSafe(F.col(f"_lo_{c}"))).alias(c) for c in columns])
    return table, off


def residual_report(variants: dict[str, DataFrame], sizes: dict[str, int], baseline: str) -> DataFrame:
    """Rows and bytes per encoding variant, and percent saved against the baseline variant."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("variant"), "rows", (F.col("rows") * sizes[name]).alias("bytes")
        )
        for name, df in variants.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    base = parts[list(variants).index(baseline)].select("bytes").scalar()
    return out.withColumn("saved_pct", percent(base - F.col("bytes"), base))
