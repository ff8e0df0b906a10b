"""Model-versus-actual residual analysis over cells (row key, column key, packed value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import changed_bits, changed_count, changed_mask, percent, residual_key
from .ordered import join_on

#: Spark may broadcast vectors of so many values, some 12 MB where a key has 16.
BROADCAST_VALUES = 500_000


def residual_vs_model(fact: DataFrame, model: DataFrame, key: str, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Predicted value beside the actual one; ``miss`` where they differ or no prediction exists.

    No join hint: Spark broadcasts the model while its measured size allows, and otherwise
    runs a shuffle join with runtime skew splitting.
    """
    joined = fact.join(model.select(key, predicted), key, "left")
    return joined.withColumn("miss", ~F.col(actual).eqNullSafe(F.col(predicted)))


def marginal_counts(df: DataFrame, row: str, col: str, miss: Column) -> DataFrame:
    """Miss and cell totals per row key, per column key and overall in one pass."""
    return (
        df.groupingSets([[row], [col], []], row, col)
        .agg(F.sum(miss.cast("bigint")).alias("misses"), F.count(F.lit(1)).alias("cells"), F.grouping_id().alias("gid"))
        .select(
            F.when(F.col("gid") == 1, row).when(F.col("gid") == 2, col).otherwise("all").alias("axis"),
            F.coalesce(F.when(F.col("gid") == 1, F.col(row)), F.when(F.col("gid") == 2, F.col(col)), F.lit(-1)).cast("bigint").alias("key"),
            "misses",
            "cells",
        )
    )


def band_split_totals(df: DataFrame, row: str, col: str) -> DataFrame:
    """Totals per column band (col >> 8), per row mod 24, and per (row low byte, row mod 24)."""
    parts = df.select(
        F.shiftright(F.col(col).cast("bigint"), 8).alias("band"),
        (F.col(row).cast("bigint") % 24).alias("mod24"),
        F.col(row).cast("bigint").bitwiseAND(255).alias("low"),
    )
    return (
        parts.groupingSets([["band"], ["mod24"], ["low", "mod24"]], "band", "mod24", "low")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(*[F.coalesce(F.col(c), F.lit(-1)).alias(c) for c in ("band", "mod24", "low")], "n")
    )


def candidate_vectors(candidates: DataFrame, key: str) -> DataFrame:
    """One row per key: its class ids in order and the values beside them.

    A key has one candidate per class, so an entry is as long as the class list.
    """
    packed = F.sort_array(F.collect_list(F.struct(F.col("class_id"), F.col("value"))))
    rows = candidates.groupBy(key).agg(packed.alias("_p"))
    return rows.select(key, F.col("_p.class_id").alias("ids"), F.col("_p.value").alias("values"))


def with_vectors(fact: DataFrame, vectors: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """``fact`` with the row of ``vectors`` of its key; ``values`` has a row for each value in them.

    Spark estimates vectors by the compressed files they come from, with one element to an array, and would bring hundreds
    of MB to the driver as if they were a few. So the values are counted, and where there are many, both sides are shuffled.
    """
    many = values.count() > BROADCAST_VALUES
    return fact.join(vectors.hint("merge") if many else vectors, key, "left")


def classify_first_match(fact: DataFrame, candidates: DataFrame, key: str, actual: str) -> DataFrame:
    """Smallest class whose value for the key equals the actual; -1 when none does.

    The candidates become one vector per key, so this is a single lookup join on the key and
    a position search inside the row; fact rows are never multiplied.
    """
    out = with_vectors(fact, candidate_vectors(candidates, key), candidates, key)
    return first_match(out, actual).drop("ids", "values")


def first_match(rows: DataFrame, actual: str) -> DataFrame:
    at = F.array_position("values", F.col(actual)).cast("int")
    found = F.when(at > 0, F.get("ids", at - 1))
    return rows.withColumn("class_id", F.coalesce(found, F.lit(-1)))


def class_report(classified: DataFrame, group: str) -> DataFrame:
    """Count and percent per class, for each group and overall (group null).

    Rows are counted once per (group, class); every total is a sum over those counts.
    """
    base = classified.groupBy(group, "class_id").agg(F.count(F.lit(1)).alias("_c"))
    counts = (
        base.groupingSets([[group, "class_id"], ["class_id"]], group, "class_id")
        .agg(F.sum("_c").alias("n"), F.grouping_id().alias("_gid"))
    )
    matched = F.sum(F.when(F.col("class_id") >= 0, F.col("_c")).otherwise(F.lit(0)))
    totals = (
        base.groupingSets([[group], []], group)
        .agg(F.sum("_c").alias("total"), matched.alias("matched"), F.grouping_id().alias("_tid"))
        .withColumn("_gid", F.when(F.col("_tid") == 1, 2).otherwise(0))
        .drop("_tid")
    )
    out = join_on(counts.withColumn("_gid", F.col("_gid").cast("int")), totals.withColumn("_gid", F.col("_gid").cast("int")), [group, "_gid"])
    scope = F.when(F.col("_gid") == 0, "group").otherwise("all")
    return out.withColumns(
        {"scope": scope, "percent": percent("n", "total"), "unmatched": F.col("total") - F.col("matched")}
    ).drop("_gid")


def corrected_totals(report: DataFrame, replaced: DataFrame, key: str = "class_id") -> DataFrame:
    """Class totals after cells of a group were replaced: old minus removed plus added."""
    delta = replaced.groupBy(key).agg(F.sum("delta").alias("delta"))
    return report.join(delta, key, "full_outer").select(
        key, (F.coalesce("n", F.lit(0)) + F.coalesce("delta", F.lit(0))).alias("n")
    )


def offset_coverage(classified: DataFrame, max_offset: int = 15) -> DataFrame:
    """First-match counts per offset and the cumulative coverages 0-14, 1-14 and 1-15."""
    o = F.col("class_id")
    n = F.count(F.lit(1))
    between = lambda a, b: F.count_if((o >= a) & (o <= b))
    return classified.agg(
        n.alias("total"),
        *[F.count_if(o == k).alias(f"offset_{k}") for k in range(max_offset + 1)],
        between(0, 14).alias("matched_0_14"),
        between(1, 14).alias("matched_1_14"),
        between(1, 15).alias("matched_1_15"),
        (n - between(0, 14)).alias("left_0_14"),
        (n - between(1, 15)).alias("left_1_15"),
    ).withColumns(
        {"left_0_14_pct": percent("left_0_14", "total"), "left_1_15_pct": percent("left_1_15", "total")}
    )


def nearest_candidate(fact: DataFrame, candidates: DataFrame, key: str, actual: str, model_id: int, model: DataFrame | None = None) -> DataFrame:
    """Candidate with the fewest differing fields; the lower class wins ties, the model comes last.

    A key's candidates become one vector, and the search stays inside the row. Distance and class are packed into one
    number, whose minimum is the answer; nothing is multiplied, so a task holds its rows once, for the join.
    """
    kind = candidates.schema["class_id"].dataType
    options = candidates.select(key, "class_id", "value")
    if model is not None:
        options = options.unionByName(
            model.select(key, F.lit(model_id).cast(kind).alias("class_id"), F.col("predicted").alias("value"))
        )
    tried = F.transform(
        F.arrays_zip("ids", "values"), lambda o: F.shiftleft(changed_count(F.col(actual), o["values"]).cast("bigint"), 32) + o["ids"]
    )
    best = with_vectors(fact, candidate_vectors(options, key), options, key).withColumn("_b", F.array_min(tried)).drop("ids", "values")
    return best.withColumns(
        {"class_id": F.col("_b").bitwiseAND(0xFFFFFFFF).cast(kind), "distance": F.shiftright("_b", 32).cast("int")}
    ).drop("_b")


def candidate_value(df: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """The value of each row's ``class_id``."""
    return df.join(candidates.select(key, "class_id", "value"), [key, "class_id"], "left")


def select_baseline(df: DataFrame, actual: str, first: str, second: str) -> DataFrame:
    """Use ``second`` as baseline only where it changes strictly fewer fields than ``first``."""
    a, b = changed_count(actual, first), changed_count(actual, second)
    out = df.withColumns({"changed_first": a, "changed_second": b})
    use = F.col("changed_second") < F.col("changed_first")
    return out.withColumns(
        {
            "use_second": use,
            "baseline": F.when(use, F.col(second)).otherwise(F.col(first)),
            "changed_selected": F.least("changed_first", "changed_second"),
        }
    )


def baseline_totals(selected: DataFrame, keys: Sequence[str]) -> DataFrame:
    return selected.groupBy(*keys).agg(
        F.count_if("use_second").alias("second_selected"),
        F.count_if(~F.col("use_second")).alias("first_selected"),
        F.sum("changed_first").alias("changed_first"),
        F.sum("changed_second").alias("changed_second"),
        F.sum("changed_selected").alias("changed_selected"),
    )


def rule_group(lane) -> Column:
    """Group of a row key: (low byte, mod 24) as one number."""
    c = F.col(lane) if isinstance(lane, str) else lane
    return c.cast("bigint").bitwiseAND(255) * 24 + c.cast("bigint") % 24


def majority_rule(misses: DataFrame, lanes: DataFrame, lane: str, item: str, group: Column | None = None) -> DataFrame:
    """Per (group, item): is the item missed by more than half of the group's rows?

    ``lanes`` lists every row key (also those without misses); the miss table stays sparse.
    """
    g = rule_group(lane) if group is None else group
    sizes = lanes.select(lane).distinct().groupBy(g.alias("grp")).agg(F.count(F.lit(1)).alias("group_size"))
    counts = misses.select(lane, item).distinct().groupBy(g.alias("grp"), item).agg(F.count(F.lit(1)).alias("n"))
    out = counts.join(sizes, "grp")
    bit = F.col("n") * 2 > F.col("group_size")
    return out.withColumn("rule", bit).withColumn(
        "errors", F.when(bit, F.col("group_size") - F.col("n")).otherwise(F.col("n"))
    )


def rule_summary(rules: DataFrame, cells: int | None = None) -> DataFrame:
    out = rules.agg(
        F.count_if("rule").alias("predicted_cells"),
        F.sum("errors").alias("residual_errors"),
        F.min("group_size").alias("group_size_min"),
        F.max("group_size").alias("group_size_max"),
    )
    return out if cells is None else out.withColumn("error_rate", percent("residual_errors", F.lit(cells)))


def changed_histogram(df: DataFrame, actual: str, base: str) -> DataFrame:
    """Rows per number of changed fields, with the changes per field among them."""
    bits = changed_bits(actual, base)
    parts = df.withColumns({f"field_{i}": b for i, b in enumerate(bits)})
    parts = parts.withColumn("changed", sum((F.col(f"field_{i}") for i in range(6)), F.lit(0)))
    return parts.groupBy("changed").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"field_{i}").alias(f"field_{i}") for i in range(6)]
    )


def residual_columns(df: DataFrame, actual: str, base: str) -> DataFrame:
    return df.withColumns({"mask": changed_mask(actual, base), "residual": residual_key(actual, base)})


def best_layout(df: DataFrame, group: str, item: str, domain: int | Column) -> DataFrame:
    """Bytes per group as bitmap, index list, inverse list or run list; the least wins, first on ties.

    Sizes before compression: domain/8, 2 per present id, 1 + 2 per absent id, 4 per run.
    """
    from .sets import run_counts

    domain = F.lit(domain) if isinstance(domain, int) else domain
    runs = run_counts(df, item, [group])
    sizes = [
        ("bitmap", F.floor((domain + F.lit(7)) / 8).cast("bigint")),
        ("indices", F.col("present") * 2),
        ("inverse", (domain - F.col("present")) * 2 + 1),
        ("ranges", F.col("runs") * 4),
    ]
    best = F.array_min(F.array(*[F.struct(s.alias("size"), F.lit(i).alias("rank"), F.lit(n).alias("layout")) for i, (n, s) in enumerate(sizes)]))
    out = runs.withColumns({f"{n}_bytes": s for n, s in sizes}).withColumn("_best", best)
    return out.withColumns({"layout": F.col("_best.layout"), "best_bytes": F.col("_best.size")}).drop("_best")


def index_list_bytes(df: DataFrame, band: str, lane: str, item: str, lanes: int, slots: int = 256) -> DataFrame:
    """Index-list size per band: five bytes per slot plus two per minority member of each slot."""
    ones = df.select(band, lane, item).distinct().groupBy(band, item).agg(F.count(F.lit(1)).alias("ones"))
    return ones.groupBy(band).agg(
        (F.lit(slots * 5) + F.sum(F.least(F.col("ones"), F.lit(lanes) - F.col("ones"))) * 2).alias("bytes")
    )
