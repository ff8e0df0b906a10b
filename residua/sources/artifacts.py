"""File listings, classification, library refresh and binary containers."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import lower_half, upper_half
from ..operators.ordered import join_on
from ..operators.sets import complement_keys


def list_files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = False) -> DataFrame:
    """(path, name, size, mtime) of files; the content column is never read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.load(path).select(
        "path",
        F.regexp_extract("path", r"([^/]+)$", 1).alias("name"),
        F.col("length").alias("size"),
        F.col("modificationTime").cast("double").alias("mtime"),
    )


def classify_artifacts(
    files: DataFrame, pattern: str, suffix: str, min_bytes: int, lo: int, hi: int, now: float | None = None, stale: float = 1800.0, order: Sequence[str] = ("name",)
) -> DataFrame:
    """Class per file, first that holds: out-of-scope, zero, tiny, duplicate, else valid.

    ``pattern`` has one group with the hex key. Names that do not match but carry the suffix
    are tmp (stale-tmp when old) or bad-name; other files are left out. The first file of a
    key in name order is the valid one, whatever its neighbours are called.
    """
    hexkey = F.regexp_extract("name", pattern, 1)
    key = F.when(hexkey != "", F.conv(hexkey, 16, 10).cast("bigint"))
    rows = files.withColumn("key", key)
    scoped = (F.col("key") >= lo) & (F.col("key") < hi)
    lower = F.lower("name")
    related = lower.endswith(suffix.lower()) | lower.contains(suffix.lower() + ".")
    age = F.lit(now) - F.col("mtime") if now is not None else F.lit(0.0)
    first = (
        F.when(F.col("key").isNotNull() & ~scoped, "out-of-scope")
        .when(F.col("key").isNotNull() & (F.col("size") <= 0), "zero")
        .when(F.col("key").isNotNull() & (F.col("size") < min_bytes), "tiny")
        .when(F.col("key").isNotNull(), "valid")
        .when(related & F.lower("name").contains(".tmp"), F.when(age >= stale, "stale-tmp").otherwise("tmp") if now is not None else F.lit("tmp"))
        .when(related, "bad-name")
    )
    rows = rows.withColumn("class", first).filter(F.col("class").isNotNull())
    keeper = rows.filter("class = 'valid'").groupBy("key").agg(F.min(F.struct(*order)).alias("_first"))
    rows = join_on(rows, keeper, ["key"])
    dup = (F.col("class") == "valid") & (F.struct(*order) != F.col("_first"))
    return rows.withColumn("class", F.when(dup, "duplicate").otherwise(F.col("class"))).drop("_first")


def artifact_summary(classified: DataFrame, lo: int, hi: int) -> DataFrame:
    """Counts per class, missing keys and progress percent, in one row."""
    names = ["valid", "duplicate", "zero", "tiny", "tmp", "stale-tmp", "bad-name", "out-of-scope"]
    total = hi - lo
    out = classified.agg(*[F.count_if(F.col("class") == n).alias(n.replace("-", "_")) for n in names])
    return out.withColumns(
        {
            "missing": F.lit(total) - F.col("valid"),
            "artifacts": F.col("duplicate") + F.col("zero") + F.col("tiny") + F.col("tmp") + F.col("stale_tmp") + F.col("bad_name"),
            "percent": F.when(F.lit(total) > 0, F.col("valid") * 100.0 / total).otherwise(0.0),
        }
    )


def scan_artifacts(spark: SparkSession, path: str, pattern: str, suffix: str, min_bytes: int, bounds: tuple[int, int], now: float | None = None) -> DataFrame:
    return classify_artifacts(list_files(spark, path), pattern, suffix, min_bytes, *bounds, now=now)


def missing_artifacts(classified: DataFrame, lo: int, hi: int) -> DataFrame:
    return complement_keys(classified.filter("class = 'valid'"), "key", lo, hi)


def collect_media(files: DataFrame, extensions: Sequence[str]) -> DataFrame:
    """Files with one of the suffixes, once per path, in case-insensitive order."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.filter(ext.isin([e.lower() for e in extensions])).dropDuplicates(["path"]).orderBy(F.lower("path"), "path")


def refresh_library(known: DataFrame, present: DataFrame, path: str = "path", root_exists: bool = True) -> DataFrame:
    """Plan of one root's refresh: ``reread`` known paths still there, ``delete`` vanished ones,
    ``add`` new ones. A vanished root deletes everything below it."""
    if not root_exists:
        return known.select(path, F.lit("delete").alias("action"))
    both = known.select(path, F.lit(1).alias("_k")).join(present.select(path, F.lit(1).alias("_p")), path, "full_outer")
    action = F.when(F.col("_p").isNull(), "delete").when(F.col("_k").isNull(), "add").otherwise("reread")
    return both.select(path, action.alias("action"))


def explode_fixed_width(df: DataFrame, key: str, block: str, bitmap: str | None, record: int, domain: int) -> DataFrame:
    """Binary block to (key, upper, record); only positions the bitmap marks present."""
    if bitmap is None:
        rows = df.select(key, block, F.explode(F.sequence(F.lit(0), F.lit(domain - 1))).alias("upper"))
    else:
        # bytes first: a byte without bits costs one test, and the block is never copied per row
        byte = F.conv(F.hex(F.substring(F.col(bitmap), F.col("_i") + 1, F.lit(1))), 16, 10).cast("int")
        rows = df.select(key, block, bitmap, F.explode(F.sequence(F.lit(0), F.lit((domain + 7) // 8 - 1))).alias("_i"))
        rows = rows.select(key, block, "_i", byte.alias("_byte")).filter("_byte <> 0")
        rows = rows.select(key, block, "_i", "_byte", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("_bit"))
        rows = rows.filter("shiftright(_byte, _bit) & 1 = 1").select(key, block, (F.col("_i") * 8 + F.col("_bit")).alias("upper"))
        rows = rows.filter(F.col("upper") < domain)
    return rows.select(key, "upper", F.substring(F.col(block), F.col("upper") * record + 1, F.lit(record)).alias("record"))


ENTRY_SCHEMA = "path string, name string, method int, size bigint, crc bigint, bytes binary, error string"


def explode_archives(files: DataFrame, tasks: int | None = None) -> DataFrame:
    """Zip containers (path, content) to one row per entry; read errors become rows.

    Containers are independent, so they are spread over tasks by path; everything after the
    byte reading is DataFrame work.
    """
    files = files.select("path", "content")
    files = files.repartition(tasks, "path") if tasks else files

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "name", "method", "size", "crc", "bytes", "error"]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        for info in archive.infolist():
                            try:
                                data, error = archive.read(info), None
                            except Exception as e:  # noqa: BLE001 - bad entries are reported as rows
                                data, error = None, str(e)
                            rows.append((path, info.filename, info.compress_type, info.file_size, info.CRC, data, error))
                            if len(rows) >= 4096:
                                yield pd.DataFrame(rows, columns=columns)
                                rows = []
                except Exception as e:  # noqa: BLE001
                    rows.append((path, None, None, None, None, None, f"bad_archive:{e}"))
                if rows:
                    frame = pd.DataFrame(rows, columns=columns)
                    for c, t in (("method", "Int32"), ("size", "Int64"), ("crc", "Int64")):
                        frame[c] = frame[c].astype(t)
                    yield frame

    return files.mapInPandas(read, ENTRY_SCHEMA)


def entry_errors(entries: DataFrame, key: str, pattern: str, record: int, methods: Sequence[int]) -> DataFrame:
    """All failing checks per entry: name, lower half against the container key, size, method, content key."""
    pid = F.conv(F.regexp_extract("name", pattern, 1), 16, 10).cast("bigint")
    out = entries.withColumn("pid", F.when(F.regexp_extract("name", pattern, 1) != "", pid))
    le = F.concat(*[F.substring("bytes", i, 1) for i in (4, 3, 2, 1)])
    content = F.conv(F.hex(le), 16, 10).cast("bigint")
    checks = [
        ("bad_names", F.col("pid").isNull()),
        ("bad_lower", lower_half("pid") != F.col(key)),
        ("bad_sizes", F.col("size") != record),
        ("bad_methods", ~F.col("method").isin(list(methods))),
        ("read_errors", F.col("error").isNotNull()),
        ("bad_content_key", (F.length("bytes") == record) & (content != F.col("pid"))),
    ]
    codes = F.array_compact(F.array(*[F.when(bad, code) for code, bad in checks]))
    return out.withColumns({"upper": upper_half("pid"), "codes": codes})


def upper_coverage(entries: DataFrame, key: str, expected: int) -> DataFrame:
    """Duplicate names and uppers, and whether all uppers occur, per container."""
    per_name = entries.groupBy(key, "name").agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.sum(F.col("n") - 1).alias("duplicate_names"))
    per_upper = (
        entries.filter(F.col("upper").isNotNull()).groupBy(key, "upper").agg(F.count(F.lit(1)).alias("n"))
        .groupBy(key).agg(F.sum(F.col("n") - 1).alias("duplicate_uppers"), F.count(F.lit(1)).alias("uppers"))
    )
    out = per_name.join(per_upper, key, "left")
    return out.withColumn("complete", F.coalesce(F.col("uppers") == expected, F.lit(False)))


# Record layout (bytes) of the 80-byte record.
RECORD_BYTES = 80
DATA_OFFSET = 32
BLOCK_BYTES = 12
# block order of a key is permutation number key mod 24, in lexicographic order
BLOCK_ORDERS = np.array(list(permutations(range(4))), dtype=np.int64)


def decode_record(col) -> Column:
    """80-byte record to typed columns: key, owner id, checksum state, fields of the data blocks.

    A record whose checksum already holds is plain; any other is XOR-ed with key ^ owner and
    its four blocks are put back in order first.
    """

    @F.pandas_udf(
        "struct<key bigint, owner bigint, checksum int, checksum_ok boolean, was_encrypted boolean, "
        "species int, item int, experience bigint, packed bigint, move1 int>"
    )
    def decode(raw: pd.Series) -> pd.DataFrame:
        good = raw.map(lambda b: b is not None and len(b) >= RECORD_BYTES).to_numpy(bool)
        fill = bytes(RECORD_BYTES)
        buf = np.frombuffer(b"".join(bytes(b[:RECORD_BYTES]) if ok else fill for b, ok in zip(raw, good)), dtype=np.uint8)
        rec = buf.reshape(len(raw), RECORD_BYTES).copy()
        head = rec[:, :DATA_OFFSET].copy().view("<u2")
        words = rec[:, :8].copy().view("<u4")
        key, owner = words[:, 0].astype(np.int64), words[:, 1].astype(np.int64)
        stored = head[:, 14].astype(np.int64)
        data = rec[:, DATA_OFFSET:].copy()
        total = lambda d: d.view("<u2").astype(np.int64).sum(axis=1) & 0xFFFF
        plain = total(data) == stored
        clear = (data.view("<u4") ^ (words[:, 0] ^ words[:, 1])[:, None]).view(np.uint8)
        blocks = clear.reshape(len(raw), 4, BLOCK_BYTES)
        # stored slot p holds block BLOCK_ORDERS[k][p]; argsort gives the slot of each block
        slot = np.argsort(BLOCK_ORDERS[key % 24], axis=1)
        clear = np.take_along_axis(blocks, slot[:, :, None], axis=1).reshape(len(raw), 48)
        data = np.where(plain[:, None], data, clear)
        u2, u4 = np.ascontiguousarray(data).view("<u2").astype(np.int64), np.ascontiguousarray(data).view("<u4").astype(np.int64)
        frame = pd.DataFrame(
            {
                "key": key, "owner": owner, "checksum": stored, "checksum_ok": total(np.ascontiguousarray(data)) == stored,
                "was_encrypted": ~plain, "species": u2[:, 0], "item": u2[:, 1], "experience": u4[:, 1],
                "packed": u4[:, 10], "move1": u2[:, 6],
            }
        ).astype("object")
        frame.loc[~good, :] = None
        return frame

    return decode(F.col(col) if isinstance(col, str) else col)
