"""Line dedup: documents probe a sharded minimal perfect hash over the lines that repeat.

1. Each task hashes the keys of its lines to 128 bits and combines them (documents, largest id) before
   they are shuffled, so a line that a third of the documents hold is one row per task and flush.
2. Keys found in enough documents are split by hash into shards. A task turns each shard into a minimal
   perfect hash (levels of bit arrays; a key's slot is the rank of its bit) that indexes a 64-bit
   fingerprint, a document count and the largest id.
3. Documents probe the arrays where they stand; no line is joined and no text is shuffled. Arrays
   travel to the tasks in blocks of at most ``bound`` bytes. If they need more than one block, each block is a pass over the
   documents, and the keys it drops come together by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, checkpointed

STRIP = BLANKS.encode()
KEYS_PER_SHARD = 50_000
FLUSH = 400_000
BYTES_PER_KEY = 24
NO_ID = np.iinfo(np.int64).min
MIX = np.uint64(0x9E3779B97F4A7C15)


def line_key(line: bytes, least: int) -> bytes | None:
    """The stripped line with A-Z lower-cased, or None if it has under ``least`` code points."""
    key = line.strip(STRIP).lower()
    if len(key) < least or (not key.isascii() and len(key.decode()) < least):
        return None
    return key


def _hashed(keys: list[bytes]) -> np.ndarray:
    """Two 64-bit words for each key."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), dtype="<i8").reshape(-1, 2)


def _documents(batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes]]:
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        yield doc_id, (text or "").encode()


def _line_counts(least: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list[int]] = {}

        def flush():
            words = np.frombuffer(b"".join(seen), dtype="<i8").reshape(-1, 2)
            n, most = np.array(list(seen.values()), dtype=np.int64).reshape(-1, 2).T
            seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (words[:, 0], words[:, 1], n, most)], ["h1", "h2", "n", "last"])

        for batch in batches:
            for doc_id, data in _documents(batch):
                me = NO_ID if doc_id is None else doc_id
                for key in {line_key(x, least) for x in data.split(b"\n")} - {None}:
                    was = seen.setdefault(xxhash.xxh3_128_digest(key), [0, NO_ID])
                    was[0] += 1
                    was[1] = max(was[1], me)
                if len(seen) > FLUSH:
                    yield from flush()
        yield from flush()

    return count


def _spread(words: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (words[:, 0].view(np.uint64) + np.uint64(level + 1) * MIX) ^ words[:, 1].view(np.uint64)
        x = (x ^ (x >> np.uint64(31))) * MIX
        return x ^ (x >> np.uint64(29))


class PerfectHash:
    """Minimal perfect hash over distinct 128-bit keys: level by level, keys alone on their bit stay there."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits  # bits of all levels, packed, levels padded to whole bytes
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        flags = np.unpackbits(bits, bitorder="little")
        self.flags, self.ranks = flags, np.cumsum(flags, dtype=np.int64)

    @classmethod
    def build(cls, words: np.ndarray) -> PerfectHash:
        sizes, levels = [], []
        while len(words):
            size = -(-2 * len(words) // 8) * 8
            at = (_spread(words, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            sizes.append(size)
            words = words[~alone[at]]
        return cls(np.array(sizes, dtype=np.int64), np.concatenate(levels) if levels else np.zeros(0, np.uint8))

    def slots(self, words: np.ndarray) -> np.ndarray:
        """A slot for each word pair; for pairs that are not keys any slot, or -1."""
        out, todo = np.full(len(words), -1, dtype=np.int64), np.arange(len(words))
        for level, size in enumerate(self.sizes):
            at = (_spread(words[todo], level) % np.uint64(size)).astype(np.int64) + self.starts[level]
            hit = self.flags[at] == 1
            out[todo[hit]] = self.ranks[at[hit]] - 1
            todo = todo[~hit]
            if not len(todo):
                break
        return out


def _shard(group: pd.DataFrame) -> pd.DataFrame:
    words = group[["h1", "h2"]].to_numpy(np.int64)
    index = PerfectHash.build(words)
    slots = index.slots(words)
    finger, n, last = (np.empty(len(words), dtype) for dtype in (np.int64, np.int32, np.int64))
    finger[slots], n[slots], last[slots] = words[:, 1], np.minimum(group["n"], 2**31 - 1), group["last"]
    parts = [x.tobytes() for x in (index.sizes, index.bits, finger, n, last)]
    return pd.DataFrame([[group["shard"].iloc[0], *parts]], columns=["shard", "sizes", "bits", "finger", "n", "last"])


def line_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 20, min_docs: int = 3, keys_per_shard: int = KEYS_PER_SHARD) -> tuple[DataFrame, int, int]:
    """The shards as rows (``shard`` and five arrays as bytes), their number, and the number of keys."""
    seen = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_line_counts(least), "h1 long, h2 long, n long, last long")
    often = checkpointed(seen.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("last").alias("last")).filter(F.col("n") >= min_docs))
    keys = often.count()
    shards = max(1, -(-keys // keys_per_shard))
    rows = often.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int")).groupBy("shard")
    return checkpointed(rows.applyInPandas(_shard, "shard int, sizes binary, bits binary, finger binary, n binary, last binary")), shards, keys


def _loaded(rows: list) -> dict[int, tuple]:
    return {r["shard"]: (PerfectHash(np.frombuffer(r["sizes"], np.int64), np.frombuffer(r["bits"], np.uint8)), np.frombuffer(r["finger"], np.int64), np.frombuffer(r["last"], np.int64)) for r in rows}


def _droppable(arrays: dict[int, tuple], shards: int, words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which (key, document) pairs lose their lines."""
    out, of = np.zeros(len(words), bool), np.mod(words[:, 0], shards)
    for shard, (index, finger, last) in arrays.items():
        mine = np.flatnonzero(of == shard)
        slots = index.slots(words[mine])
        mine, slots = mine[slots >= 0], slots[slots >= 0]
        known = finger[slots] == words[mine, 1]
        mine, slots = mine[known], slots[known]
        out[mine] = (last[slots] != ids[mine]) & (last[slots] != NO_ID)
    return out


def _lines(batch: pa.RecordBatch, least: int) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Lines of each document; of all lines with a key: their hashes, ids, and place among the batch's lines."""
    docs, keys, ids, places, at = [], [], [], [], 0
    for doc_id, data in _documents(batch):
        lines = data.split(b"\n")
        docs.append(lines)
        for i, line in enumerate(lines):
            if (key := line_key(line, least)) is not None:
                keys.append(key)
                ids.append(NO_ID if doc_id is None else doc_id)
                places.append(at + i)
        at += len(lines)
    return docs, _hashed(keys), np.array(ids, np.int64), np.array(places, np.int64)


def _result(batch: pa.RecordBatch, docs: list, drop: np.ndarray) -> pa.RecordBatch:
    n, dropped, texts, at = [], [], [], 0
    for lines in docs:
        gone = drop[at : at + len(lines)]
        at += len(lines)
        n.append(len(lines))
        dropped.append(int(gone.sum()))
        texts.append(b"\n".join([x for x, g in zip(lines, gone, strict=True) if not g]) if dropped[-1] else b"\n".join(lines))
    columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array([x.decode() for x in texts], pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_lines", "n_dropped", "kept"])


SCHEMA = "doc_id long, n_lines long, n_dropped long, kept string"


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 20, min_docs: int = 3, bound: int = 64 << 20, keys_per_shard: int = KEYS_PER_SHARD) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_lines``, ``n_dropped``, ``kept`` (the text left).

    A key (line stripped, A-Z lower-cased) of at least ``least`` code points that at least ``min_docs``
    rows hold loses its lines everywhere but in the largest id that holds it. A null text is an empty one: one empty line.
    Every row counts as a document; rows that share the largest id all keep the line, a null id is below
    all others, and a key that only null ids hold stays. Other columns of ``docs`` are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    index, shards, keys = line_index(docs, doc_id, text, least, min_docs, keys_per_shard)
    per_block = max(1, bound // (BYTES_PER_KEY * min(max(keys, 1), 2 * keys_per_shard)))
    context = docs.sparkSession.sparkContext

    def arrays(block: int):
        return context.broadcast(index.filter((F.col("shard") >= block) & (F.col("shard") < block + per_block)).collect())

    if shards <= per_block:
        sent = arrays(0)

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loaded = _loaded(sent.value)
            for batch in batches:
                found, words, ids, places = _lines(batch, least)
                drop = np.zeros(sum(map(len, found)), bool)
                drop[places[_droppable(loaded, shards, words, ids)]] = True
                yield _result(batch, found, drop)

        return rows.mapInArrow(finish, SCHEMA)

    def prober(sent):
        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loaded = _loaded(sent.value)
            for batch in batches:
                _, words, ids, _ = _lines(batch, least)
                gone = _droppable(loaded, shards, words, ids)
                where, order = np.unique(ids[gone], return_inverse=True)
                split = np.split(words[gone][np.argsort(order, kind="stable")], np.cumsum(np.bincount(order, minlength=len(where)))[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(where), pa.array([np.ascontiguousarray(x).tobytes() for x in split[: len(where)]], pa.binary())], ["of", "keys"])

        return probe

    parts = [rows.mapInArrow(prober(arrays(b)), "of long, keys binary") for b in range(0, shards, per_block)]
    gone = parts[0]
    for part in parts[1:]:
        gone = gone.unionByName(part)
    gone = gone.groupBy("of").agg(F.collect_set("keys").alias("keys"))  # at most the document's own lines
    both = rows.join(gone, F.coalesce("doc_id", F.lit(NO_ID)) == F.col("of"), "left").select("doc_id", "text", "keys")

    def finish_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, words, _, places = _lines(batch, least)
            lengths = np.array([len(x) for x in found], np.int64)
            of = np.repeat(np.arange(len(found)), lengths)[places] if len(places) else places
            hashes = [w.tobytes() for w in words]
            sets = [{k[i : i + 16] for k in keys or () for i in range(0, len(k), 16)} for keys in batch.column(2).to_pylist()]
            drop = np.zeros(int(lengths.sum()), bool)
            for place, doc, h in zip(places, of, hashes, strict=True):
                drop[place] = h in sets[doc]
            yield _result(batch, found, drop)

    return both.mapInArrow(finish_joined, SCHEMA)


