"""Schedules: pairing labelled rows, leads, resume scans and match assignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.generator import lcg_at, lcg_jump, lcg_output
from ..session import checkpointed
from .windows import first_occurrence


def pair_events(
    df: DataFrame, target: str, label: str, first: str, last: str, shared: Sequence[str], frame: str, state: str,
    delay: int | None = None, where: Column | None = None, strict: bool = True, bridge: bool = True,
) -> DataFrame:
    """First and last labelled rows of each target side by side, with the first failing check.

    Checks in order: a row missing, shared keys differ, delay differs, generator state does
    not bridge. ``strict`` raises on the first problem row instead of returning it.
    """
    rows = df.filter(F.col(label).isin(first, last))
    if where is not None:
        rows = rows.filter(where)
    at = lambda n, c: F.max(F.when(F.col(label) == n, F.col(c)))
    out = rows.groupBy(target).agg(
        *[at(first, c).alias(f"_a_{c}") for c in shared],
        *[at(last, c).alias(f"_b_{c}") for c in shared],
        at(first, frame).alias("first_frame"), at(last, frame).alias("last_frame"),
        at(first, state).alias("first_state"), at(last, state).alias("last_state"),
        F.count_if(F.col(label) == first).alias("_na"), F.count_if(F.col(label) == last).alias("_nb"),
    )
    differ = F.lit(False)
    for c in shared:
        differ = differ | ~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))
    gap = F.col("last_frame") - F.col("first_frame")
    problem = F.when((F.col("_na") == 0) | (F.col("_nb") == 0), "missing-row").when(differ, "shared-keys-differ")
    if delay is not None:
        problem = problem.when(gap != delay, "delay-differs")
    if bridge:
        moved = lcg_jump("first_state", delay) if delay is not None else lcg_at("first_state", gap)
        problem = problem.when(moved != F.col("last_state"), "state-does-not-bridge")
    out = out.withColumn("delay", gap).withColumn("problem", problem)
    if strict:
        guard = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(F.col("problem"), F.lit(": "), F.col(target).cast("string"))).cast("bigint"))
        out = out.withColumn("delay", F.coalesce(guard, F.col("delay")))
    return out.select(
        target, *[F.col(f"_a_{c}").alias(c) for c in shared], "first_frame", "last_frame", "first_state", "last_state", "delay", "problem"
    )


#: A generator output has 16 bits, and the stream comes back to its start after 2**32 steps.
OUTPUTS, PERIOD = 1 << 16, 1 << 32
#: Steps of the first search; every further one is as long as all before.
FIRST_STEPS = 1 << 18


def schedule_with_lead(targets: DataFrame, upper: str, start: int, lead: int, max_steps: int | None = None, strict: bool = True) -> DataFrame:
    """First step from ``lead`` on whose generator output is a pending target, for every distinct target.

    Stream positions are computed independently, so ranges of steps are scanned in parallel; each range is searched for
    the targets still open, at most one for each output, and is as long as all ranges before it together. The search ends when no
    target is open, at ``max_steps``, or after a whole period. Targets without a step are rows with a null step and a ``problem``:
    ``out-of-range`` where no output can have the value, else ``not-reached``. ``strict`` fails instead, naming up to 8.
    """
    spark = targets.sparkSession
    last = min(max_steps or PERIOD, max(1, lead) + PERIOD - 1)
    wanted = checkpointed(targets.select(F.col(upper).cast("bigint").alias(upper)).filter(F.col(upper).isNotNull()).distinct())
    open_targets = wanted.filter((F.col(upper) >= 0) & (F.col(upper) < OUTPUTS))
    found, begin, end = None, max(1, lead), max(1, lead)
    while begin <= last and not open_targets.isEmpty():
        end = min(last + 1, begin + max(FIRST_STEPS, begin))
        steps = spark.range(begin, end).withColumnRenamed("id", "step")
        stream = steps.select("step", lcg_output(lcg_at(F.lit(start).cast("bigint"), "step")).alias(upper))
        hits = checkpointed(first_occurrence(stream.join(F.broadcast(open_targets), upper, "left_semi"), [upper], ["step"], []).select(upper, "step"))
        found = hits if found is None else found.unionByName(hits)
        open_targets = checkpointed(open_targets.join(hits, upper, "left_anti"))
        begin = end
    if found is None:
        found = spark.createDataFrame([], f"{upper} bigint, step bigint")
    problem = F.when(F.col("step").isNull(), F.when((F.col(upper) < 0) | (F.col(upper) >= OUTPUTS), "out-of-range").otherwise("not-reached"))
    out = wanted.join(found, upper, "left").select(upper, "step", (F.col("step") - lead).alias("input_delta"), problem.alias("problem"))
    if strict:
        sample = [r[0] for r in out.filter("problem is not null").select(upper).orderBy(upper).limit(8).collect()]
        if sample:
            raise ValueError(f"schedule left targets uncovered within {last} steps, among them {sample}")
    return out


def schedule_from_frames(df: DataFrame, frame: str, input_frame: str, start_frame: int) -> DataFrame:
    """Steps from stored frames; an input before the start frame is an error."""
    delta = F.col(input_frame) - start_frame
    checked = F.when(delta < 0, F.raise_error(F.lit("target lies before the start frame")).cast("bigint")).otherwise(delta)
    return df.withColumns({"step": F.col(frame) - start_frame, "input_delta": checked})


def resume_scan(targets: DataFrame, artifacts: DataFrame, manifests: DataFrame, key: str, fields: Sequence[str], paths: Sequence[str], overwrite: bool = False) -> DataFrame:
    """First failing reason per target, else ``complete``.

    Targets: key, the expected ``fields`` and ``paths``. Artifacts: key, kind, digest.
    Manifests: key, readable, is_object, schema_version, the same fields, paths, and one
    digest per kind named ``<kind>_digest``. Kinds are the path names without ``_path``.
    """
    kinds = [p.removesuffix("_path") for p in paths]
    art = artifacts.groupBy(key).agg(*[F.max(F.when(F.col("kind") == k, F.col("digest"))).alias(f"_have_{k}") for k in kinds])
    man = manifests.select(
        F.col(key), F.lit(1).alias("_m"), "readable", "is_object", "schema_version",
        *[F.col(c).alias(f"_m_{c}") for c in (*fields, *paths)],
        *[F.col(f"{k}_digest") for k in kinds],
    )
    out = targets.join(art, key, "left").join(man, key, "left")
    reason = F.when(F.lit(overwrite), "overwrite-requested")
    for k in kinds:
        reason = reason.when(F.col(f"_have_{k}").isNull(), f"missing-{k}")
    reason = (
        reason.when(F.col("_m").isNull(), "missing-manifest")
        .when(~F.coalesce("readable", F.lit(False)), "unreadable-manifest")
        .when(~F.coalesce("is_object", F.lit(False)), "non-object-manifest")
        .when(~F.coalesce(F.col("schema_version") == 1, F.lit(False)), "manifest-schema-mismatch")
    )
    for c in fields:
        reason = reason.when(~F.col(c).eqNullSafe(F.col(f"_m_{c}")), f"manifest-{c.replace('_', '-')}-mismatch")
    for c in paths:
        reason = reason.when(~F.col(c).eqNullSafe(F.col(f"_m_{c}")), f"manifest-{c.replace('_', '-')}-mismatch")
    for k in kinds:
        reason = reason.when(~F.col(f"{k}_digest").eqNullSafe(F.col(f"_have_{k}")), f"{k}-digest-mismatch")
    return out.select(*targets.columns, reason.otherwise("complete").alias("reason"))


def reason_counts(scan: DataFrame) -> DataFrame:
    return scan.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def assign_match_and_nonmatch(records: DataFrame, bank: DataFrame, value: str, key: str, payload: Sequence[str], domain: int = 8192) -> DataFrame:
    """Match: the bank row whose key equals the value. Non-match: the row after it, else the
    lowest bank row with another key. A missing one is named in ``issue``.

    The fallback needs only the two smallest bank keys.
    """
    rows = bank.select(F.col(key).cast("bigint").alias("_k"), F.struct(F.col(key).cast("bigint").alias(key), *payload).alias("_p"))
    rows = rows.filter((F.col("_k") >= 0) & (F.col("_k") < domain))
    match = rows.select(F.col("_k").alias(value), F.col("_p").alias("match"))
    nxt = rows.select(((F.col("_k") - 1 + domain) % domain).alias(value), F.col("_p").alias("_next"))
    low = rows.orderBy("_k").limit(2).agg(F.array_sort(F.collect_list("_p")).alias("two"))
    two = low.select("two").scalar()
    out = records.join(match, value, "left").join(nxt, value, "left").withColumn("_two", two)
    first, second = F.try_element_at("_two", F.lit(1)), F.try_element_at("_two", F.lit(2))
    fallback = F.when(first[key] != F.col(value), first).otherwise(second)
    out = out.withColumn("nonmatch", F.coalesce(F.col("_next"), fallback))
    issue = F.when(F.col("match").isNull(), "missing_matching_row").when(F.col("nonmatch").isNull(), "missing_nonmatching_row")
    return out.withColumn("issue", issue).drop("_next", "_two")
