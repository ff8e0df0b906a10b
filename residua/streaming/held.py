"""Rows held in state until the watermark has passed them, by spans of time.

Names (lanes, users) are dealt into buckets, and a bucket is the key of the state: a call of the state costs the same for one
name as for hundreds. A bucket's rows wait in a map state under (span, part): a part is what one micro-batch brought for one span
of event time, as an Arrow block. A second map knows the first time of every span. An event-time timer stands at each of them.
What a batch brings adds parts and leaves the others alone; when a timer fires, only spans that begin below the watermark are read,
one at a time, in order. What each name of the bucket has come to is one more Arrow block.
"""

from __future__ import annotations

import math
from abc import abstractmethod
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The time of a row in milliseconds, rounded up: it is due once the watermark has reached it.
DUE = "_due"
BUCKETS = 1024
BUCKET = "_bucket"


def bucket_of(name: str, buckets: int) -> Column:
    """The bucket of a name; none for a row without a name, which only moves the watermark."""
    return F.when(F.col(name).isNotNull(), F.pmod(F.xxhash64(name), F.lit(buckets)).cast("int")).alias(BUCKET)


def use_rocks(spark: SparkSession) -> None:
    """Map state and timers need the store that keeps state on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def _packed(rows: pd.DataFrame) -> bytes:
    return _written(pa.RecordBatch.from_pandas(rows, preserve_index=False))


def _written(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


class HeldRows(StatefulProcessor):
    """Takes each name's rows in order of ``ts`` and, where times tie, of all columns in ``order``.

    ``ts`` is in seconds. A span is ``span_ms`` long; a task has the rows of one span of one bucket at a time, and the
    states of the bucket's names.
    """

    def __init__(self, name: str, columns: list[str], order: list[str], span_ms: int):
        self.name, self.columns, self.order, self.span_ms = name, [name, *columns], ["ts", *order], span_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spans = handle.getMapState("spans", "span bigint", "first bigint, parts int")
        self.rows = handle.getMapState("rows", "span bigint, part int", "rows binary")
        self.now = handle.getValueState("now", "states binary")
        self.taken: tuple[int, set] = (-1, set())

    def close(self) -> None:
        pass

    @abstractmethod
    def step(self, now: dict, rows: pd.DataFrame) -> pd.DataFrame:
        """Output rows of rows in order; ``now``, the state of each name as a tuple, is brought up to date in place."""

    def look(self, now: dict, reached: int) -> tuple[pd.DataFrame, int | None]:
        """What the watermark alone changes after all due rows: output rows, a time in milliseconds at which to look again."""
        return pd.DataFrame(), None

    def _states(self) -> dict:
        if not self.now.exists():
            return {}
        names, *fields = _unpacked(self.now.get()[0]).columns
        return dict(zip(names.to_pylist(), zip(*[f.to_pylist() for f in fields], strict=True), strict=True))

    def _keep(self, now: dict) -> None:
        fields = list(zip(*now.values(), strict=True))
        batch = pa.RecordBatch.from_arrays([pa.array(list(now)), *[pa.array(f) for f in fields]], ["name", *[f"f{i}" for i in range(len(fields))]])
        self.now.update((_written(batch),))

    def _hold(self, span: int, rows: pd.DataFrame, fresh: bool) -> None:
        old = None if fresh else self.spans.getValue((span,))
        first, parts = old if old is not None else (None, 0)
        earliest = int(rows[DUE].min())
        self.rows.updateValue((span, parts), (_packed(rows),))
        if first is None or earliest < first:
            self.handle.registerTimer(earliest)
            first = earliest
        self.spans.updateValue((span,), (first, parts + 1))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if not pd.isna(key[0]):
            for batch in rows:
                batch = batch[["ts", *self.columns]].copy()
                batch[DUE] = (batch["ts"] * 1000).map(math.ceil).astype("int64")
                for span, part in batch.groupby(batch[DUE] // self.span_ms):
                    self._hold(int(span), part, False)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        reached = timerValues.getCurrentWatermarkInMs()
        if self.taken[0] != reached:
            self.taken = (reached, set())
        if key in self.taken[1]:  # an earlier timer of the batch has taken all that is due
            return
        self.taken[1].add(key)
        now = self._states()
        due = sorted((first, span[0], parts) for span, (first, parts) in self.spans.iterator() if first <= reached)
        for _, span, parts in due:
            tables = [_unpacked(self.rows.getValue((span, p))[0]) for p in range(parts)]
            held = pa.concat_tables(tables, promote_options="permissive").to_pandas()
            held = held.sort_values(self.order, kind="stable", key=lambda c: c if c.dtype.kind in "if" else c.astype("string"))
            for part in range(parts):
                self.rows.removeKey((span, part))
            self.spans.removeKey((span,))
            ready = held[held[DUE] <= reached]
            if len(ready) < len(held):
                self._hold(span, held[held[DUE] > reached], True)
            if len(ready) and len(out := self.step(now, ready)):
                yield out
        if now:
            out, again = self.look(now, reached)
            self._keep(now)
            if again is not None:
                self.handle.registerTimer(max(again, reached + 1))
            if len(out):
                yield out
