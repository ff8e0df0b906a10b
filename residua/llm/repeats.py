"""What the two searches for repeated passages share: chunks of documents, spans to remove, and their merge."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_table
from .places import placed

CHUNK = 4 << 20


def by_row(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id``, ``text`` and ``key``, a number of each row's own in ascending order of the ids, null last.

    Where ids tell the rows apart they are the keys. Else rows are numbered by ranges of (id, hash of the text) and written.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    same = rows.groupBy("doc_id").agg(F.count("*").alias("n"))
    n, most, unnamed = same.agg(F.sum("n"), F.max("n"), F.count_if(F.col("doc_id").isNull())).first()
    if not n or (most == 1 and not unnamed):
        return rows.withColumn("key", F.col("doc_id"))
    kept = shared_table(rows.withColumn("row", F.monotonically_increasing_id()), "repeats-rows")
    order = [F.asc_nulls_last("doc_id"), F.xxhash64("text").asc(), F.col("row").asc()]
    return shared_table(placed(kept, order, "repeats-order", n).select("doc_id", "text", F.col("_place").alias("key")), "repeats-keyed")


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Ids and texts of about ``size`` bytes together; a longer text is a chunk of its own."""
    ids: list[int] = []
    texts: list[bytes] = []
    held = 0
    for batch in batches:
        for i, t in zip(batch.column(0), batch.column(1), strict=True):
            key, text = i.as_py(), (t.as_py() or "").encode()
            if ids and held + len(text) > size:
                yield np.array(ids, np.int64), texts
                ids, texts, held = [], [], 0
            ids.append(key)
            texts.append(text)
            held += len(text)
    if ids:
        yield np.array(ids, np.int64), texts


def merged_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans in ascending order, overlapping and touching ones of a document joined."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    # within a document, ends are made ascending by a running maximum over (document number, end)
    number = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]])).astype(np.int64)
    reach = np.maximum.accumulate((number << np.int64(40)) + end)
    fresh = np.ones(len(doc), bool)
    fresh[1:] = ((number[1:] << np.int64(40)) + start[1:]) > reach[:-1]
    first = np.flatnonzero(fresh)
    last = np.concatenate([first[1:] - 1, [len(doc) - 1]])
    return doc[first], start[first], reach[last] & np.int64((1 << 40) - 1)


def spans_batch(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["doc", "start", "end"])


def with_spans(rows: DataFrame, spans: DataFrame, finish: Callable, schema: str) -> DataFrame:
    """``finish(id, text, spans)`` for each row of ``rows`` (``doc_id``, ``text``, ``key``), its spans merged and in order."""
    packed = spans.groupBy("doc").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))  # at most a document's own
    joined = rows.join(packed, F.col("key") == F.col("doc"), "left").select("doc_id", "text", "starts", "ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in batches:
            out = []
            for doc_id, text, starts, ends in zip(*(batch.column(i) for i in range(4)), strict=True):
                a, b = (none, none) if starts.as_py() is None else (starts.values.to_numpy(), ends.values.to_numpy())
                _, a, b = merged_spans(np.zeros(len(a), np.int64), a, b)
                out.append((doc_id.as_py(), *finish((text.as_py() or "").encode(), a, b)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) if i else pa.array(c, pa.int64()) for i, c in enumerate(zip(*out, strict=True))], [f.split()[0] for f in schema.split(", ")])

    return joined.mapInArrow(run, schema)
