"""Schedules, ledgers, manifests, traces, reports and catalogue text as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import parse_hex, parse_int_text
from .members import RANGE_BYTES, listed, read_members

# Columns of the schedule file.
SCHEDULE_COLUMNS = [
    "initial_seed_16bit", "compatibility_percent", "target_half_16bit", "sweep_index",
    "frame_from_initial_seed", "t_minus", "rng_seed",
]


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def parse_schedule(df: DataFrame, event: str | None = "t-0") -> DataFrame:
    """Typed schedule rows from text columns; hex or decimal text; only the event row unless None."""
    require_columns(df, SCHEDULE_COLUMNS)
    label = F.lower(F.trim("t_minus"))
    rows = df.filter(label == event) if event is not None else df
    numbers = [c for c in SCHEDULE_COLUMNS if c != "t_minus"]
    return rows.select(*[parse_int_text(c).alias(c) for c in numbers], label.alias("t_minus"))


def schedule_findings(rows: DataFrame, expected: int | None = None) -> DataFrame:
    """(target_half_16bit, problem) of schedule rows: ``listed-twice``, ``missing`` (of targets 0 to ``expected`` - 1) and
    ``unreadable`` (a target that is no number, one row for all of them)."""
    counts = rows.groupBy(F.col("target_half_16bit").cast("bigint").alias("target_half_16bit")).agg(F.count(F.lit(1)).alias("n"))
    problem = F.when(F.col("target_half_16bit").isNull(), "unreadable").when(F.col("n") > 1, "listed-twice")
    found = counts.select("target_half_16bit", problem.alias("problem")).filter("problem IS NOT NULL")
    if expected is None:
        return found
    absent = rows.sparkSession.range(expected).select(F.col("id").alias("target_half_16bit")).join(counts, "target_half_16bit", "left_anti")
    return found.unionByName(absent.withColumn("problem", F.lit("missing")))


def read_schedule_csv(spark: SparkSession, path: str, event: str | None = "t-0", expected: int | None = None) -> DataFrame:
    """Schedule CSV with its guards: required columns, no duplicate target, enough distinct targets."""
    raw = spark.read.option("header", "true").option("mode", "FAILFAST").csv(path)
    rows = parse_schedule(raw, event)
    counts = rows.groupBy("target_half_16bit").count()
    state = counts.agg(F.count(F.lit(1)).alias("n"), F.max("count").alias("most")).first()
    if event is not None and (state["most"] or 0) > 1:
        raise ValueError("schedule lists a target twice")
    if expected is not None and state["n"] < expected:
        raise ValueError(f"schedule covers {state['n']} of {expected} targets")
    return rows


# Fields of a lane record in the ledger file.
LEDGER_FIELDS = T.StructType(
    [
        T.StructField(n, t)
        for n, t in [
            ("lane", T.StringType()), ("status", T.StringType()), ("device_id", T.StringType()), ("worker_id", T.StringType()),
            ("zip_size", T.StringType()), ("pk3_count", T.StringType()), ("lease_until_unix", T.StringType()),
            ("claimed_at_unix", T.StringType()), ("heartbeat_at_unix", T.StringType()), ("finished_at_unix", T.StringType()),
            ("verified_at_unix", T.StringType()), ("failed_at_unix", T.StringType()), ("released_at_unix", T.StringType()),
            ("updated_at_unix", T.StringType()), ("attempts", T.StringType()),
        ]
    ]
)


def parse_ledgers(texts: DataFrame, text: str, keep: Sequence[str] = (), domain: int = 1 << 16) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of ledger JSON texts with a ``records`` object keyed by hex lane.

    Values are read as text and coerced, so one malformed record never spoils its neighbours.
    """
    body = F.regexp_replace(F.col(text), "^﻿", "")
    doc = F.from_json(body, "struct<records:map<string,string>>")
    pairs = texts.select(*keep, F.explode_outer(doc["records"]).alias("key", "_raw"))
    pairs = pairs.withColumn("_rec", F.from_json("_raw", LEDGER_FIELDS))
    lane = parse_hex(F.coalesce("_rec.lane", F.col("key")))
    error = (
        F.when(F.col("key").isNull(), "ledger records field is missing or not an object")
        .when(~F.coalesce(F.ltrim("_raw").startswith("{"), F.lit(False)), "record is not an object")
        .when(lane.isNull(), "bad lane")
        .when(lane >= domain, "lane out of range")
    )
    pairs = pairs.withColumn("_lane", lane).withColumn("error", error)
    num = lambda c, t: F.col(f"_rec.{c}").try_cast(t)
    stamps = ["verified", "finished", "failed", "released", "heartbeat", "claimed", "updated"]
    rows = pairs.filter(F.col("error").isNull()).select(
        *keep, F.col("_lane").alias("lane"), F.lower(F.trim("_rec.status")).alias("status"), F.col("_rec.device_id").alias("device"),
        F.col("_rec.worker_id").alias("worker"), num("zip_size", "bigint").alias("proof_bytes"), num("pk3_count", "bigint").alias("item_count"),
        num("lease_until_unix", "double").alias("lease_until"), *[num(f"{s}_at_unix", "double").alias(f"{s}_at") for s in stamps],
        num("attempts", "int").alias("attempts"),
    )
    return rows, pairs.filter(F.col("error").isNotNull()).select(*keep, "key", "error")


def _as_document(field: str, opening: str, closing: str) -> Column:
    """A document that holds one member, so that what reads whole texts reads members too."""
    return F.concat(F.lit(f'{{"{field}":{opening}'), F.coalesce("text", F.lit("")), F.lit(f"{closing}}}"))


def _without_members(spark: SparkSession, path: str, members: DataFrame) -> DataFrame:
    return listed(spark, path).select("path").join(members.select("path").distinct(), "path", "left_anti")


def read_ledger_json(spark: SparkSession, path: str, domain: int = 1 << 16, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of ledger files, read by byte ranges; a file without ``records`` gives one error."""
    members = read_members(spark, path, "records", "{", range_bytes)
    rows, errors = parse_ledgers(members.select(_as_document("records", "{", "}").alias("value")), "value", domain=domain)
    none = _without_members(spark, path, members).select(F.lit(None).cast("string").alias("key"), F.lit("ledger records field is missing or not an object").alias("error"))
    return rows, errors.unionByName(none)


# Fields of an entry in the array ledger file.
ENTRY_FIELDS = (
    "shiny_value int, done boolean, tid int, sid int, save_path string, save_sha1 string, wait_frames int, "
    "rng_advance bigint, note string, error string"
)


def parse_entries(texts: DataFrame, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """Rows of the ``entries`` array of ledger JSON texts."""
    doc = F.from_json(F.regexp_replace(F.col(text), "^﻿", ""), f"struct<entries:array<struct<{_colon(ENTRY_FIELDS)}>>>")
    return texts.select(*keep, F.inline(doc["entries"]))


def _colon(ddl: str) -> str:
    return ", ".join(f"{p.split()[0]}:{p.split()[1]}" for p in ddl.split(", "))


def read_entries_ledger(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows of the ``entries`` arrays of ledger files, read by byte ranges."""
    members = read_members(spark, path, "entries", "[", range_bytes).filter("text IS NOT NULL")
    return parse_entries(members.select(_as_document("entries", "[", "]").alias("value")), "value")


def parse_manifests(texts: DataFrame, name: str, text: str, pattern: str, key_field: str = "key") -> DataFrame:
    """One row per manifest: key of the file name, parsed fields, and the first failing check."""
    doc = F.from_json(F.col(text), f"struct<{key_field}:string,path:string,sha1:string,completed:bigint,complete:boolean>")
    name_key = F.regexp_extract(F.col(name), pattern, 1)
    out = texts.select(
        F.col(name).alias("name"), F.when(name_key != "", F.conv(name_key, 16, 10).cast("bigint")).alias("key"), doc.alias("_d"), F.col(text).alias("_t")
    )
    body_key = parse_int_text(F.col("_d")[key_field])
    problem = (
        F.when(F.col("key").isNull(), "bad-name")
        .when(~F.coalesce(F.ltrim("_t").startswith("{"), F.lit(False)), "unreadable")
        .when(~F.coalesce(body_key == F.col("key"), F.lit(False)), "key-mismatch")
    )
    return out.withColumn("problem", problem).select("name", "key", "_d.path", F.col("_d.sha1").alias("sha"), "_d.completed", "_d.complete", "problem")


def read_manifests(spark: SparkSession, path: str, pattern: str, key_field: str = "key") -> DataFrame:
    texts = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("name"))
    return parse_manifests(texts, "name", "value", pattern, key_field)


def parse_traces(texts: DataFrame, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """Ordered sample rows of trace JSON texts; a trace without samples keeps one empty row."""
    doc = F.from_json(F.col(text), "struct<samples:array<struct<frame_index:int,applied_mask:int,values:map<string,bigint>>>>")
    return texts.select(*keep, F.posexplode_outer(doc["samples"]).alias("idx", "_s")).select(
        *keep, "idx", F.col("_s.frame_index").alias("frame_index"), F.col("_s.applied_mask").alias("applied_mask"), F.col("_s.values").alias("values")
    )


def read_traces(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Sample rows of trace files, read by byte ranges: (path, container, idx, frame_index, applied_mask, values).

    ``container`` is the byte at which a trace's samples begin, as a file may hold several traces; ``idx`` counts over all
    ranges of a trace. A trace, or a file, without samples keeps one empty row.
    """
    members = read_members(spark, path, "samples", "[", range_bytes)
    texts = members.select("path", "container", F.col("idx").alias("_idx"), _as_document("samples", "[", "]").alias("value"))
    rows = parse_traces(texts, "value", ["path", "container", "_idx"]).withColumn("idx", F.col("_idx").cast("bigint")).drop("_idx")
    return rows.unionByName(_without_members(spark, path, members), allowMissingColumns=True)


REPORT_SCHEMA = (
    "struct<samples:array<struct<lane_count:bigint,archive_bytes:bigint,"
    "levels:array<struct<level:int,size_bytes:bigint,unpack_ms:double>>,"
    "codecs:array<struct<codec:string,codec_level:int,level:int,size_bytes:bigint,unpack_ms:double>>,"
    "typed:array<struct<policy:string,size_bytes:bigint,unpack_ms:double>>,"
    "offload:struct<status:string,backend:string,output_bytes:bigint,kernel_ms:double>>>>"
)


def flatten_reports(texts: DataFrame, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """Nested benchmark reports to uniform rows of four kinds: level, codec, typed, offload.

    The four arrays of a sample become one array of uniform entries, so a report is parsed once.
    """
    doc = F.from_json(F.col(text), REPORT_SCHEMA)
    samples = texts.select(*keep, F.explode(doc["samples"]).alias("s"))
    none = F.lit(None).cast("int")

    def entry(kind, codec, codec_level, level, size, ms):
        return F.struct(
            F.lit(kind).alias("kind"), codec.alias("codec"), codec_level.cast("int").alias("codec_level"), level.cast("int").alias("level"),
            F.coalesce(size, F.lit(0)).cast("bigint").alias("size_bytes"), F.coalesce(ms, F.lit(0.0)).alias("unpack_ms"),
        )

    def each(name, make):
        return F.coalesce(F.transform(F.col(f"s.{name}"), make), F.array())

    off = F.col("s.offload")
    ran = off["status"].isNotNull() & ~off["status"].isin("not_run", "not_requested")
    offload = entry("offload", F.coalesce(off["backend"], F.lit("default")), none, F.lit(3), off["output_bytes"], off["kernel_ms"])
    entries = F.concat(
        each("levels", lambda e: entry("level", F.lit("default"), none, e["level"], e["size_bytes"], e["unpack_ms"])),
        each("codecs", lambda e: entry("codec", e["codec"], e["codec_level"], e["level"], e["size_bytes"], e["unpack_ms"])),
        each("typed", lambda e: entry("typed", e["policy"], none, F.lit(3), e["size_bytes"], e["unpack_ms"])),
        F.when(ran, F.array(offload)).otherwise(F.array()),
    )
    rows = samples.select(
        *keep, F.col("s.lane_count").alias("lane_count"), F.col("s.archive_bytes").alias("archive_bytes"), F.explode(entries).alias("e")
    ).select(*keep, "lane_count", "archive_bytes", "e.*")
    mib = F.when(F.col("unpack_ms") > 0, F.col("size_bytes") / 1048576.0 / (F.col("unpack_ms") / 1000.0)).otherwise(0.0)
    return rows.withColumn("mib_s", mib)


def parse_dat(texts: DataFrame, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """Catalogue text (``game ( name "x" rom ( name "y" size 1 crc AB md5 .. sha1 .. ) )``) to rows."""
    block = r'game\s*\(\s*((?:[^()"]|"[^"]*"|\((?:[^()"]|"[^"]*")*\))*)\)'
    games = texts.select(*keep, F.explode(F.regexp_extract_all(F.col(text), F.lit(block), 1)).alias("_g"))
    rom = r'rom\s*\(\s*((?:[^()"]|"[^"]*")*)\)'
    head = F.regexp_replace("_g", rom, "")
    roms = games.select(*keep, F.regexp_extract(head, r'name\s+"([^"]*)"', 1).alias("game"), F.explode(F.regexp_extract_all("_g", F.lit(rom), 1)).alias("_r"))
    word = lambda k: F.regexp_extract("_r", rf"\b{k}\s+\"?([^\s\"]+)", 1)
    return roms.select(
        *keep, "game", F.regexp_extract("_r", r'name\s+"([^"]*)"', 1).alias("name"), word("size").try_cast("bigint").alias("size"),
        F.conv(word("crc"), 16, 10).cast("bigint").alias("crc32"), F.lower(word("md5")).alias("md5"), F.lower(word("sha1")).alias("sha1"),
    )


def dat_gate(existing: DataFrame, incoming: DataFrame, name: str = "db", version: str = "version") -> DataFrame:
    """Incoming catalogues to load: none of the same name and the same or a newer version is there."""
    have = existing.groupBy(name).agg(F.max(version).alias("_have"))
    out = incoming.join(have, name, "left")
    action = F.when(F.col("_have").isNull(), "load").when(F.col(version) > F.col("_have"), "replace").otherwise("skip")
    return out.withColumn("action", action).drop("_have")


def load_dat(existing: DataFrame, incoming: DataFrame, name: str = "db", version: str = "version") -> DataFrame:
    """Rows after the load: skipped catalogues change nothing, replaced ones lose their old rows."""
    gate = dat_gate(existing.select(name, version).distinct(), incoming.select(name, version).distinct(), name, version)
    fresh = incoming.join(gate.filter("action <> 'skip'").select(name, version), [name, version], "left_semi")
    old = existing.join(gate.filter("action = 'replace'").select(name), name, "left_anti")
    return old.unionByName(fresh)
