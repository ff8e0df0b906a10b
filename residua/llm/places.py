"""Places of rows in a total order, and texts as sequences of their distinct parts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_table

#: A task takes this many characters of text at a time.
SLICE_CHARS = 16_000_000


def part_and_place(df: DataFrame, order: Sequence[Column], parts: int) -> DataFrame:
    """``df`` dealt by ranges of ``order`` and sorted, with ``_part`` and ``_in_part``, its place there.

    Parts follow each other in the order, so a row's place among all is its place in its part plus the rows of
    the parts before. The columns of ``order`` should tell rows apart, or equal ones stay in one task.
    """
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return ranged.withColumns({"_part": F.shiftright("_at", 33).cast("int"), "_in_part": F.col("_at").bitwiseAND((1 << 33) - 1)}).drop("_at")


def bases(sizes: DataFrame, size: str) -> DataFrame:
    """``_part`` and ``_base``, the sum of ``size`` over the parts before; there is a row for each part, as many as tasks."""
    rows = sorted((r["_part"], r[size]) for r in sizes.collect())
    before = np.cumsum([0] + [n for _, n in rows]).tolist()
    return F.broadcast(sizes.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(rows, before, strict=False)], "_part int, _base long"))


def placed(df: DataFrame, order: Sequence[Column], name: str, rows: int, rows_per_part: int = 2_000_000) -> DataFrame:
    """The ``rows`` rows of ``df`` with ``_place``, the number from 0 in ``order``, found by ranges: no task sees more than its range.

    The rows are written once, sorted, below the shared folder.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // rows_per_part + 1)
    kept = shared_table(part_and_place(df, order, parts), name)
    start = bases(kept.groupBy("_part").agg(F.count("*").alias("n")), "n")
    return kept.join(start, "_part").withColumn("_place", F.col("_in_part") + F.col("_base")).drop("_part", "_in_part", "_base")


def slices(batches: Iterator[pa.RecordBatch], text: int, chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices whose texts (column ``text``) hold about ``chars`` bytes; a longer text stands alone."""
    for batch in batches:
        sizes = np.fromiter((len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(text).cast(pa.binary())), np.int64, batch.num_rows)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + chars, side="right")))
            yield batch.take(pa.array(np.arange(start, end)))  # a copy: some Arrow kernels misread arrays that start within a buffer
            start = end


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``starts[i] .. starts[i] + sizes[i] - 1`` of all i, one after the other."""
    total = int(sizes.sum())
    first = np.cumsum(sizes) - sizes
    return np.repeat(starts - first, sizes) + np.arange(total)


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of ``values`` of the given sizes, 0 for an empty group."""
    ends = np.cumsum(sizes)
    running = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return running[ends] - running[ends - sizes]
