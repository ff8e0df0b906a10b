"""Reports, partitioned exports, shards and split outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import markdown_text


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Rows as csv, json or a markdown table, one file set per call."""
    if kind == "csv":
        df.write.mode("overwrite").option("header", "true").csv(path)
    elif kind == "json":
        df.write.mode("overwrite").json(path)
    elif kind == "markdown":
        cells = [F.coalesce(markdown_text(F.col(c), table_cell=True), F.lit("")) for c in df.columns]
        df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value")).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown report kind: {kind!r}")


def report_summary(df: DataFrame, band: str) -> DataFrame:
    return df.groupBy(band).agg(F.count(F.lit(1)).alias("n")).orderBy(band)


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def versions(spark: SparkSession, path: str, prefix: str = "v") -> list[int]:
    """Numbers of the committed versions below a folder, in order; a write that was killed has left no marker."""
    fs, base = _folder(spark, path)
    if not fs.exists(base):
        return []
    found = [s.getPath() for s in fs.listStatus(base) if s.getPath().getName().startswith(prefix)]
    return sorted(int(f.getName()[len(prefix):]) for f in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS")))


def forget(spark: SparkSession, path: str) -> None:
    fs, folder = _folder(spark, path)
    fs.delete(folder, True)


def write_current(df: DataFrame, path: str) -> None:
    """Replace the table at ``path`` by a version of its own, which counts once it is complete.

    The version before stays until the next replacement, for readers that have begun, and for ``df`` itself, which may
    be made from the current table. One writer at a time.
    """
    spark = df.sparkSession
    known = versions(spark, path)
    df.write.mode("overwrite").parquet(f"{path}/v{known[-1] + 1 if known else 0:012d}")
    for old in known[:-1]:
        forget(spark, f"{path}/v{old:012d}")


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The last complete version of a table that ``write_current`` keeps."""
    known = versions(spark, path)
    if not known:
        raise FileNotFoundError(f"no complete version below {path}")
    return spark.read.parquet(f"{path}/v{known[-1]:012d}")


def export_partitions(df: DataFrame, path: str, lane: str, only: Column | None = None, band: int | None = None) -> None:
    """One folder per lane; ``only`` narrows to a record, a lane or a range.

    With ``band``, a folder ``band=n`` holds the lanes from ``n * band`` on, so many of them, in order: with many small lanes
    a folder for each costs more than its rows do. A reader of one lane asks for its band, and the files' statistics pass over
    the other lanes. The rebalance hint gathers a folder's rows into few files and still splits a folder too large for one.
    """
    rows = df if only is None else df.filter(only)
    if band is None:
        rows.hint("rebalance", F.col(lane)).write.mode("overwrite").partitionBy(lane).parquet(path)
        return
    rows = rows.withColumn("band", F.floor(F.col(lane) / band)).hint("rebalance", F.col("band"))
    rows.sortWithinPartitions("band", lane).write.mode("overwrite").partitionBy("band").parquet(path)


def shard_of(lane: str, lo: int, lanes_per_shard: int) -> Column:
    return F.floor((F.col(lane) - lo) / lanes_per_shard).cast("int")


def write_shards(df: DataFrame, path: str, lane: str, lo: int, hi: int, lanes_per_shard: int, order: Sequence[str]) -> DataFrame:
    """Consecutive lane ranges as shard folders; returns one manifest row per shard.

    Range partitioning keeps a shard's rows in few tasks without forcing a shard into one.
    """
    rows = df.filter((F.col(lane) >= lo) & (F.col(lane) < hi)).withColumn("shard", shard_of(lane, lo, lanes_per_shard))
    rows.repartitionByRange("shard", lane, *order).sortWithinPartitions("shard", lane, *order).write.mode("overwrite").partitionBy("shard").parquet(path)
    spark = df.sparkSession
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    sizes = files.groupBy(F.regexp_extract("path", r"shard=(\d+)", 1).cast("int").alias("shard")).agg(F.sum("length").alias("bytes"))
    return shard_manifest(spark.read.parquet(path), lane).join(sizes, "shard")


def shard_manifest(rows: DataFrame, lane: str) -> DataFrame:
    return rows.groupBy("shard").agg(F.min(lane).alias("from"), F.max(lane).alias("to"), F.count(F.lit(1)).alias("count"))


def consolidate_shards(shards: DataFrame, lane: str, shard: str, model: str | None = None, layout: str | None = None) -> DataFrame:
    """Union of shard rows after the guards: no lanes, a lane in two shards, differing model or layout.

    ``shards`` holds all rows with their shard id (one read over all shard folders).
    """
    owners = shards.groupBy(lane).agg(F.min(shard).alias("a"), F.max(shard).alias("b"))
    checks = [F.count(F.lit(1)).alias("lanes"), F.min(F.when(F.col("a") != F.col("b"), F.col(lane))).alias("twice")]
    state = owners.agg(*checks).first()
    if not state["lanes"]:
        raise ValueError("shards hold no lanes")
    if state["twice"] is not None:
        raise ValueError(f"lane {state['twice']} occurs in more than one shard")
    for what in (model, layout):
        if what and shards.agg(F.min(what) != F.max(what)).first()[0]:
            raise ValueError(f"shards differ in {what}")
    return shards


def shard_findings(shards: DataFrame, lane: str, shard: str, lo: int, lanes_per_shard: int) -> DataFrame:
    """(lane, shard, problem) of rows that do not lie where they should: ``in-two-shards``, ``wrong-shard``, ``no-lane``."""
    held = shards.groupBy(F.col(lane).alias("lane"), F.col(shard).alias("shard")).agg(F.count(F.lit(1)).alias("_n"))
    owners = held.groupBy("lane").agg(F.collect_set("shard").alias("_shards"))
    each = owners.select("lane", F.explode_outer("_shards").alias("shard"), F.size("_shards").alias("_n"))
    problem = (
        F.when(F.col("lane").isNull(), "no-lane").when(F.col("_n") > 1, "in-two-shards")
        .when(~F.col("shard").eqNullSafe(shard_of("lane", lo, lanes_per_shard)), "wrong-shard")
    )
    return each.select("lane", "shard", problem.alias("problem")).filter("problem IS NOT NULL")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def split_write(df: DataFrame, path: str, condition: Column) -> tuple[str, str]:
    """Matching rows to one output, the others to a second, in a single pass over the input.

    Returns the two folders; each is a table of its own, without rows where no row falls on its side.
    """
    side = F.when(F.coalesce(condition, F.lit(False)), "match").otherwise("rest")
    df.withColumn("side", side).write.mode("overwrite").partitionBy("side").parquet(path)
    spark = df.sparkSession
    folders = f"{path}/side=match", f"{path}/side=rest"
    for folder in folders:
        fs, target = _folder(spark, folder)
        if not fs.exists(target):
            spark.createDataFrame([], df.schema).write.parquet(folder)
    return folders
