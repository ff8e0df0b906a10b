"""Starting streams, and tables that a micro-batch replaces as a whole."""

from __future__ import annotations

import posixpath
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..session import shared_dir
from ..sources.sinks import forget, versions


def file_stream(
    spark: SparkSession, path: str, glob: str, files_per_trigger: int | None = None, bytes_per_trigger: int = 2 * 1024**3
) -> DataFrame:
    """A folder of parquet files as a stream, with the schema the files have now.

    A micro-batch takes a bounded amount of input, so however skewed the keys are, one key's
    share of a batch fits its task.
    """
    schema = spark.read.parquet(posixpath.join(path, glob)).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(files_per_trigger))
    else:
        reader = reader.option("maxBytesPerTrigger", str(bytes_per_trigger))
    return reader.parquet(path)


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process everything available into a parquet table in the shared folder and read it back."""
    spark = stream.sparkSession
    out, mark = shared_dir(spark, "table"), shared_dir(spark, "offsets")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", mark).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda batch, _id: batch.write.mode("overwrite").parquet(out)).start()
    finish(query)
    return spark.read.parquet(out)


def run_to_end(spark: SparkSession, stream: DataFrame, build: Callable[[DataFrame], DataFrame], event_time: str, end: Column, delay: str) -> DataFrame:
    """Process a finite replay that holds rows back behind a watermark, and let the last ones go.

    ``build`` turns the stream into the result. Beside ``stream`` it gets a clock: when everything has been read, one
    row with nothing but a time, ``delay`` beyond ``end``, moves the watermark past the last row, and the same query goes on.
    """
    out, mark, clock = shared_dir(spark, "table"), shared_dir(spark, "offsets"), shared_dir(spark, "clock")
    blank = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema])
    blank.limit(0).write.parquet(clock)
    both = stream.unionByName(spark.readStream.schema(stream.schema).parquet(clock))

    def go() -> None:
        writer = build(both).writeStream.outputMode("append").option("checkpointLocation", mark).trigger(availableNow=True)
        finish(writer.format("parquet").option("path", out).start())

    go()
    blank.withColumn(event_time, (end + F.expr(f"INTERVAL {delay}") + F.expr("INTERVAL 1 millisecond")).cast(stream.schema[event_time].dataType)).write.mode("append").parquet(clock)
    go()
    return spark.read.parquet(out)


def finish(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


class VersionedTable:
    """A table each micro-batch replaces: batch n writes version n+1 from version n.

    A version counts once its commit marker is there, so a failed or repeated batch changes
    nothing, and a restarted query finds the state on shared storage.
    """

    def __init__(self, spark: SparkSession, path: str, initial: DataFrame):
        self.spark, self.path, self.schema = spark, path, initial.schema
        if self._latest(1 << 62) is None:
            initial.write.mode("overwrite").parquet(self._dir(-1))

    def _dir(self, version: int) -> str:
        return f"{self.path}/v{version + 1:012d}"

    def _latest(self, before: int) -> int | None:
        jvm = self.spark._jvm
        base = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = base.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(base):
            return None
        found = []
        for status in fs.listStatus(base):
            name = status.getPath().getName()
            if name.startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                found.append(int(name[1:]) - 1)
        found = [v for v in found if v < before]
        return max(found) if found else None

    def read(self, before: int = 1 << 62) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self._dir(self._latest(before)))

    def update(self, batch_id: int, change: Callable[[DataFrame], DataFrame]) -> None:
        new = change(self.read(batch_id))
        new.select(*[f.name for f in self.schema]).write.mode("overwrite").parquet(self._dir(batch_id))
        self._forget(batch_id - 1)

    def _forget(self, before: int) -> None:
        """Drop versions no restart can ask for: a batch may be repeated, the ones before it not."""
        jvm = self.spark._jvm
        base = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = base.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for status in fs.listStatus(base):
            name = status.getPath().getName()
            if name.startswith("v") and int(name[1:]) - 1 < before:
                fs.delete(status.getPath(), True)


def fold_into(stream: DataFrame, table: VersionedTable, change: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Fold every micro-batch into the table with ``change(table, batch)``; return the final table."""
    mark = shared_dir(stream.sparkSession, "offsets")

    def step(batch: DataFrame, batch_id: int) -> None:
        table.update(batch_id, lambda old: change(old, batch))

    finish(stream.writeStream.foreachBatch(step).option("checkpointLocation", mark).trigger(availableNow=True).start())
    return table.read()


class BucketedTable:
    """A keyed table of which a micro-batch rewrites only the buckets that hold its keys.

    Version n + 1 is a list of (bucket, version that wrote it), at most one row per bucket, and counts once its
    commit marker is there. Batch n writes the buckets it touches beside the old ones, then the list; a batch that
    fails leaves the version before as it was, and one that is repeated after its commit changes nothing. Buckets that
    neither of the last two versions names are removed.
    """

    def __init__(self, spark: SparkSession, path: str, initial: DataFrame, key: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, initial.schema, key, buckets
        if not versions(spark, path, "list-"):
            self._commit(0, initial, {}, set())

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast(self.schema[self.key].dataType)), F.lit(self.buckets)).cast("int")

    def _data(self, version: int) -> str:
        return f"{self.path}/rows-{version:012d}"

    def _list(self, version: int) -> dict[int, int]:
        rows = self.spark.read.schema("bucket int, version bigint").parquet(f"{self.path}/list-{version:012d}")
        return {r["bucket"]: r["version"] for r in rows.collect()}

    def _rows(self, listed: dict[int, int]) -> DataFrame:
        paths = [f"{self._data(v)}/_bucket={b}" for b, v in sorted(listed.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _commit(self, version: int, rows: DataFrame, old: dict[int, int], touched: set[int]) -> dict[int, int]:
        # the rebalance hint gathers a bucket into few files and still splits one too large for a task
        typed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema], self._bucket().alias("_bucket"))
        typed.hint("rebalance", F.col("_bucket")).write.mode("overwrite").partitionBy("_bucket").parquet(self._data(version))
        written = self.spark.read.schema("_bucket int").parquet(self._data(version)).select("_bucket").distinct().collect()
        new = {b: v for b, v in old.items() if b not in touched} | {r["_bucket"]: version for r in written}
        listing = self.spark.createDataFrame(sorted(new.items()), "bucket int, version bigint").coalesce(1)
        listing.write.mode("overwrite").parquet(f"{self.path}/list-{version:012d}")
        return new

    def read(self) -> DataFrame:
        return self._rows(self._list(versions(self.spark, self.path, "list-")[-1]))

    def update(self, batch_id: int, batch: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Fold one micro-batch in; ``change`` sees the rows of the touched buckets and the batch, and must go key by key."""
        known = versions(self.spark, self.path, "list-")
        if batch_id + 1 in known:
            return
        touched = {r["b"] for r in batch.select(self._bucket().alias("b")).distinct().collect()}
        if not touched:
            return
        old = self._list(known[-1])
        held = self._rows({b: v for b, v in old.items() if b in touched})
        self._commit(batch_id + 1, change(held, batch), old, touched)
        for stale in known[:-1]:
            for b, v in self._list(stale).items():
                if old.get(b) != v:
                    forget(self.spark, f"{self._data(v)}/_bucket={b}")
            forget(self.spark, f"{self.path}/list-{stale:012d}")


def fold_by_key(stream: DataFrame, table: BucketedTable, change: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Fold every micro-batch into the buckets it touches; return the final table."""
    mark = shared_dir(stream.sparkSession, "offsets")
    writer = stream.writeStream.foreachBatch(lambda batch, batch_id: table.update(batch_id, batch, change))
    finish(writer.option("checkpointLocation", mark).trigger(availableNow=True).start())
    return table.read()


def log_epoch(batch: DataFrame, epoch: int, path: str) -> None:
    """The rows of one micro-batch as JSON lines in a folder of the epoch's own, which a repeated batch replaces."""
    batch.write.mode("overwrite").json(posixpath.join(path, f"epoch={epoch}"))


def append_events(stream: DataFrame, path: str, offsets: str | None = None) -> StreamingQuery:
    """The event log: every row once, however often a batch is repeated. With ``offsets`` a later run goes on where this one ends."""
    mark = offsets or shared_dir(stream.sparkSession, "offsets")
    writer = stream.writeStream.foreachBatch(lambda batch, epoch: log_epoch(batch, epoch, path))
    return writer.option("checkpointLocation", mark).trigger(availableNow=True).start()


def read_log(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of the log, with the ``epoch`` that brought each."""
    return spark.read.schema(StructType([*schema.fields, StructField("epoch", LongType())])).json(path)


def tail_errors(stream: DataFrame, is_error, stamp: str, tie: str, n: int) -> DataFrame:
    """The last ``n`` error rows, kept as a table of at most ``n`` rows."""
    spark = stream.sparkSession
    empty = spark.createDataFrame([], stream.schema)
    table = VersionedTable(spark, shared_dir(spark, "tail"), empty)

    def change(old: DataFrame, batch: DataFrame) -> DataFrame:
        return old.unionByName(batch.filter(is_error)).orderBy(F.col(stamp).desc(), F.col(tie).desc()).limit(n)

    return fold_into(stream, table, change)
