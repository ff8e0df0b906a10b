"""Rows of nested JSON reports that share no schema: lanes, facts and steps.

A report is parsed once to VARIANT and each row reads its own paths from it, so a field of an odd type spoils only its
own cell. Texts that are no JSON object give no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Numbers of a lane in a report that lists streams, and in a report of an audit.
STREAM_NUMBERS = {
    "stream_size": "bigint", "uncompressed_model_size": "bigint", "stream_to_source_zip_ratio": "double",
    "stream_to_uncompressed_model_ratio": "double",
}
AUDIT_NUMBERS = {
    "entry_count": "bigint", "zip_size_bytes": "bigint", "checksum_failures": "bigint", "template_mismatches": "bigint",
    "rebuild_mismatches": "bigint",
}
# Where a step's report keeps its counts of mismatches, in the order they are shown.
STEP_MISMATCHES = ["roundtrip_mismatches", "internal_crc_mismatches", "source_compare_mismatches", "crc_mismatches"]
DEVICE_MISMATCHES = ["mismatched_lanes", "mismatched_bytes"]


def at(doc: Column, path: str, kind: str = "string") -> Column:
    """Value at a dotted path; null where it is missing, null or of another kind."""
    return F.try_variant_get(doc, f"$.{path}", kind)


def _nested(value: Column) -> Column:
    """Whether a value is an object or an array."""
    return F.coalesce(F.schema_of_variant(value).rlike("^(OBJECT|ARRAY)"), F.lit(False))


def lane_rows(texts: DataFrame, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per lane of a report, of kind ``audit`` or ``inspect``.

    A report in which any lane has an ``entry_count`` is an audit, and only lanes with one are its rows; else every lane is
    an ``inspect`` row, with the report's level where it has none. Missing numbers are 0, missing texts empty; the columns
    of the other kind are null. Lanes that are no objects are left out.
    """
    doc = F.try_parse_json(text)
    docs = texts.select(*keep, at(doc, "level").alias("_level"), at(doc, "lanes", "array<variant>").alias("_lanes"))
    counted = lambda lane: at(lane, "entry_count", "variant").isNotNull()
    docs = docs.withColumn("_audit", F.exists("_lanes", counted))
    lane = F.col("_lane")
    rows = docs.select(*keep, "_level", "_audit", F.explode("_lanes").alias("_lane"))
    rows = rows.filter(F.schema_of_variant(lane).startswith("OBJECT") & (~F.col("_audit") | counted(lane)))

    def of(audit: bool, value: Column) -> Column:
        return F.when(F.col("_audit") if audit else ~F.col("_audit"), value)

    def number(name: str, kind: str) -> Column:
        return F.coalesce(at(lane, name, kind), F.lit(0).cast(kind))

    def word(name: str) -> Column:
        return F.coalesce(at(lane, name), F.lit(""))

    return rows.select(
        *keep,
        F.when(F.col("_audit"), "audit").otherwise("inspect").alias("kind"),
        at(lane, "lane").alias("lane"),
        number("predictor_exceptions", "bigint").alias("predictor_exceptions"),
        of(False, F.coalesce(at(lane, "level"), "_level", F.lit(""))).alias("level"),
        *[of(False, word(n)).alias(n) for n in ("codec", "codec_level")],
        *[of(False, number(n, k)).alias(n) for n, k in STREAM_NUMBERS.items()],
        of(True, word("audit_failed")).alias("audit_failed"),
        *[of(True, number(n, k)).alias(n) for n, k in AUDIT_NUMBERS.items()],
        of(True, number("timings_ms.total_ms", "double")).alias("total_ms"),
        of(True, F.coalesce(at(lane, "errors[0]"), F.lit(""))).alias("first_error"),
    )


def fact_rows(
    texts: DataFrame, text: str, facts: Mapping[str, str], keep: Sequence[str] = (), keep_empty: Sequence[str] = (), counts: Mapping[str, str] | None = None
) -> DataFrame:
    """(field, value) rows of what a report states, in the order of ``facts`` (label to dotted path), with ``place``.

    Objects and arrays are no facts; null and empty values are left out, except under the labels in ``keep_empty``, where
    they are empty texts. ``counts`` (label to path) adds the length of each of these arrays that a report has.
    """
    counts = {"lane table rows": "lanes", "outputs": "outputs"} if counts is None else counts
    doc = F.col("_doc")

    def fact(place: int, label: str, path: str) -> Column:
        found = at(doc, path, "variant")
        value = F.coalesce(found.try_cast("string"), F.lit(""))
        states = found.isNotNull() & ~_nested(found) & (F.lit(label in keep_empty) | (value != ""))
        return F.when(states, F.struct(F.lit(place).alias("place"), F.lit(label).alias("field"), value.alias("value")))

    def count(place: int, label: str, path: str) -> Column:
        found = at(doc, path, "array<variant>")
        return F.when(found.isNotNull(), F.struct(F.lit(place).alias("place"), F.lit(label).alias("field"), F.size(found).cast("string").alias("value")))

    listed = [fact(i, *item) for i, item in enumerate(facts.items())]
    listed += [count(len(facts) + i, *item) for i, item in enumerate(counts.items())]
    docs = texts.select(*keep, F.try_parse_json(text).alias("_doc"))
    return docs.select(*keep, F.explode(F.array_compact(F.array(*listed))).alias("_f")).select(*keep, "_f.*")


def step_rows(texts: DataFrame, text: str, label: str, keep: Sequence[str] = (), leave_out: Sequence[str] = ("gpu_cache",)) -> DataFrame:
    """One row per report of a release: state, reason for a fallback, mismatches, and times of the report and its path.

    A device that was asked for and not used falls back for its status where it names no reason. The path's time is the
    host's where its profile was used, else the device's where that was used. Missing values are empty texts or null times.
    """
    doc, host, device = F.col("_doc"), "cpu_decode_profile", "gpu_rebuild"
    word = lambda path: F.coalesce(at(doc, path), F.lit(""))
    true = lambda path: F.coalesce(at(doc, path, "boolean"), F.lit(False))
    reason = F.when(word(f"{device}.fallback_reason") != "", word(f"{device}.fallback_reason")).when(
        true(f"{device}.requested") & ~true(f"{device}.used"), word(f"{device}.status")
    )
    shown = [at(doc, p) for p in STEP_MISMATCHES] + [at(doc, f"{device}.{p}") for p in DEVICE_MISMATCHES]
    time = at(doc, "total_ms", "double")
    rows = texts.filter(~F.coalesce(F.col(label).isin(*leave_out), F.lit(False))).select(*keep, F.col(label).alias("_label"), F.try_parse_json(text).alias("_doc"))
    return rows.filter(F.schema_of_variant("_doc").startswith("OBJECT")).select(
        *keep,
        F.replace("_label", F.lit("_"), F.lit(" ")).alias("step"),
        word("ok").alias("ok"),
        word("schema").alias("schema"),
        word(f"{device}.status").alias("device_status"),
        word(f"{device}.used").alias("device_used"),
        F.coalesce(reason, F.lit("")).alias("fallback"),
        F.concat_ws("/", *[F.when(m != "", m) for m in shown]).alias("mismatches"),
        F.coalesce(time, F.when(F.col("_label") == "pack", at(doc, "build_ms", "double"))).alias("report_ms"),
        F.when(true(f"{host}.used"), at(doc, f"{host}.total_ms", "double")).when(true(f"{device}.used"), at(doc, f"{device}.total_ms", "double")).alias("path_ms"),
    )
