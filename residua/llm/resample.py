"""Importance resampling of documents towards a target collection, by hashed word runs.

Words come from an untrained Regex split of the tokenizers library over ASCII-lowered text, with offsets. A task
splits only the distinct blank-separated chunks of its batch; the offsets say which chunk a word came from, and
texts are sequences of chunks. A document's words stand in one buffer, joined by a blank; a run of words is the
pair of its first word's start and its last word's end there, and the CRC of that slice names its bucket.

Documents and target each give a histogram of buckets, counted in tasks and added by Spark. The gain of a bucket
is a scaled log ratio of the two; a document's weight is the mean over its runs, and a Gumbel term from a hash
of its id turns the highest scores into a draw without replacement. Ranks come from ranges of the score.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from .common import shared_table
from .places import placed, ragged, slices, sums

#: What stands between words: ASCII but digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The split is quickest over short strings.
SPLIT_CHARS = 10_000


def _chunk_words(chunks: list[str], split: pre_tokenizers.PreTokenizer) -> tuple[list[str], np.ndarray]:
    """All words of the chunks in order, and how many each chunk has; a chunk holds no blank."""
    words: list[str] = []
    counts = np.zeros(len(chunks), np.int64)
    first, n = 0, len(chunks)
    while first < n:
        last, size = first, 0
        while last < n and (last == first or size + len(chunks[last]) < SPLIT_CHARS):
            size += len(chunks[last]) + 1
            last += 1
        starts = np.cumsum([0] + [len(c) + 1 for c in chunks[first:last]])
        found = split.pre_tokenize_str(" ".join(chunks[first:last]))
        words += [w for w, _ in found]
        at = np.fromiter((span[0] for _, span in found), np.int64, len(found))
        counts[first:last] = np.bincount(np.searchsorted(starts, at, side="right") - 1, minlength=last - first)[: last - first]
        first = last
    return words, counts


def _runs(words: list[bytes], longest: int, buckets: int) -> Iterator[int]:
    """Buckets of all runs of 1 to ``longest`` words, as slices of one buffer."""
    buffer = memoryview(b" ".join(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    for n in range(1, longest + 1):
        for a, b in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=False):
            yield zlib.crc32(buffer[a:b]) % buckets


def text_buckets(texts: pa.Array, longest: int, buckets: int, split: pre_tokenizers.PreTokenizer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: the number of words, the number of runs, and the buckets of its runs, one text after the other."""
    lowered = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    parts = pc.split_pattern(lowered, " ")
    coded = parts.flatten().dictionary_encode()
    per_text = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    words, counts = _chunk_words(coded.dictionary.to_pylist(), split)
    chunk = coded.indices.to_numpy(zero_copy_only=False)
    n_words = sums(counts[chunk], per_text)
    first = np.cumsum(counts) - counts
    order = ragged(first[chunk], counts[chunk])  # places in ``words``, in the order of the texts
    raw = [w.encode() for w in words]
    if longest == 1:
        named = np.fromiter((zlib.crc32(w) % buckets for w in raw), np.int64, len(raw))
        return n_words, n_words, named[order]
    n_runs = sum((np.maximum(n_words - n + 1, 0) for n in range(1, longest + 1)), np.zeros(len(n_words), np.int64))
    bounds = np.concatenate([[0], np.cumsum(n_words)]).tolist()
    found = (b for a, z in zip(bounds, bounds[1:], strict=False) for b in _runs([raw[i] for i in order[a:z]], longest, buckets))
    return n_words, n_runs, np.fromiter(found, np.int64, int(n_runs.sum()))


def featured(docs: DataFrame, longest: int, buckets: int, doc_id: str | None, text: str) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features`` and ``runs``, the buckets of the document's runs as packed 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = pre_tokenizers.Split(Regex(BETWEEN), "removed")
        for batch in slices(batches, 1):
            n_words, n_runs, found = text_buckets(batch.column(1), longest, buckets, split)
            packed = found.astype("<u4").tobytes()
            ends = np.cumsum(n_runs) * 4
            runs = [packed[e - 4 * n : e] for e, n in zip(ends.tolist(), n_runs.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n_runs), pa.array(runs, pa.binary())], ["doc_id", "n_words", "n_features", "runs"])

    key = F.col(doc_id).cast("bigint") if doc_id else F.lit(None).cast("bigint")
    return docs.select(key.alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_words long, n_features long, runs binary")


def histogram(rows: DataFrame, buckets: int) -> np.ndarray:
    """Counts of all buckets: one histogram a task, added up by Spark; ``buckets`` bounds what the driver gets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for runs in batch.column(0):
                total += np.bincount(np.frombuffer(runs.as_buffer(), "<u4"), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    counts = np.zeros(buckets, np.int64)
    for r in rows.select("runs").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["bucket"]] = r["n"]
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each of the B buckets, in doubles."""
    b, s_all, t_all = float(len(source)), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + b) / ((s + 1.0) * (t_all + b)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weighed(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """``weight`` in place of ``runs``: the floored mean gain of the runs, 0 without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = [int(gain[np.frombuffer(x.as_buffer(), "<u4")].sum()) // (len(x.as_buffer()) // 4) if len(x.as_buffer()) else 0 for x in batch.column(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(weight, pa.int64())], ["row", "doc_id", "n_words", "n_features", "weight"])

    return rows.select("row", "doc_id", "n_words", "n_features", "runs").mapInArrow(run, "row long, doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln((h + 0.5) / 2**32))), h the first 32 bits of sha256 of ``seed:doc_id``."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(head, 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / F.lit(4294967296.0))) * -1000.0).cast("bigint")


def resampled(
    docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: int = 2024, doc_id: str = "doc_id", text: str = "text", target_text: str = "text"
) -> DataFrame:
    """``doc_id``, ``n_features``, ``weight``, ``score``, ``rank``, ``n_words`` of every document.

    ``rank`` is 1, 2, 3... for the floor(``percent`` x N / 100) highest scores of the N documents with at least
    ``min_words`` words, else null; ties go to the smaller id, null last, then to fewer features. Null and empty texts
    have no words, no features and weight 0. Every row counts on its own, repeated ones too; a null id hashes as
    an empty string. An empty target gives gains from the documents alone, an empty table no rows. Only id and text are read.
    """
    rows = shared_table(featured(docs, longest, buckets, doc_id, text).withColumn("row", F.monotonically_increasing_id()), "resample-runs")
    gain = gains(histogram(rows, buckets), histogram(featured(target, longest, buckets, None, target_text), buckets))
    scored = _weighed(rows, gain).withColumns({"score": F.col("weight") + gumbel(F.col("doc_id"), seed), "out": F.col("n_words") < min_words})
    total, able = rows.agg(F.count("*"), F.count_if(F.col("n_words") >= min_words)).first()
    drawn = able * percent // 100
    # the row number only tells equal rows apart, so that ranges can part them
    order = [F.col("out"), F.desc("score"), F.asc_nulls_last("doc_id"), F.col("n_features"), F.col("n_words"), F.col("row")]
    ranked = placed(scored, order, "resample-scores", total)
    rank = F.when(F.col("_place") < drawn, F.col("_place") + 1).cast("bigint")
    return ranked.select("doc_id", "n_features", "weight", "score", rank.alias("rank"), "n_words")
