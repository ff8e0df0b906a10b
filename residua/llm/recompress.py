"""Repeated word passages by recompression.

Each document's words are recompressed: a round names the runs of equal symbols, then the pairs of a left
and a right symbol, sides being drawn by name. A name is a fingerprint of what it stands for, so names are
global without an exchange, and equal passages get equal symbols wherever these do not touch the
passage's ends: every boundary carries the stretch of words that decided it, and boundaries
whose stretch lies inside a window are the same in each copy of the window.

A window is therefore filed under the rarest-looking (smallest) pair of neighbouring symbols among the boundaries it
decides, or under itself if it decides none (long runs). Consecutive windows filed under one boundary travel as one
entry with their fingerprints, packed by hash bucket. A bucket compares the windows of equal symbols,
keeps the first one by (document, position) and marks the words of all others.

Skew: entries equal as a whole within a chunk of a task leave only the first. A symbol pair with very many
different entries in one chunk is hot: its windows are filed by their own fingerprint instead of the pair, and a note
in the pair's bucket sends what colder chunks filed there the same way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_table
from .repeats import by_row, chunks, merged_spans, spans_batch, with_spans
from .shingles import BASE, INVERSE, M1, M2, mix, powers, word_hashes

WINDOW = 20
ROUNDS = 2
HOT = 64
FAR = np.int64(1) << np.int64(40)
LOW = np.uint64((1 << 24) - 1)
ENTRY = np.dtype([("h", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("n", "u1"), ("offset", "u1")])
ALONE = 255  # offset of a window that decides no boundary
FINGER = 6


def _rolling(words: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Fingerprints of words[a:b], the same wherever the words stand."""
    prefix = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(BASE, len(words)), out=prefix[1:])
    down = powers(INVERSE, len(words) + 1)
    return lambda a, b: mix((prefix[b] - prefix[a]) * down[a] + (b - a).astype(np.uint64) * M2)


def recompress(words: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Boundaries between symbols after ``rounds`` rounds: position, fingerprint of the two symbols
    that met there in the last round, and the stretch [low, high) of words that decided it (unbounded at a document's start)."""
    cut = np.arange(len(words))
    name = words.copy()
    hard = np.zeros(len(words), bool)
    firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    hard[firsts[counts > 0]] = True
    low, high, beside = cut.copy(), cut.copy(), name  # between words there is always a boundary
    end = np.int64(len(words))  # the same for the end of the last document

    def settle(keep: np.ndarray) -> None:
        nonlocal cut, hard, low, high, end
        lower = np.where(hard, -FAR, np.concatenate([[-FAR], low[:-1]]))
        upper = np.where(hard, FAR, np.concatenate([high[1:], [end]]))
        cut, hard, low, high, end = cut[keep], hard[keep], lower[keep], upper[keep], FAR

    for r in range(rounds):
        if not len(cut):
            break
        keep = np.ones(len(name), bool)
        keep[1:] = (name[1:] != name[:-1]) | hard[1:]
        at = np.flatnonzero(keep)
        length = np.diff(np.concatenate([at, [len(name)]])).astype(np.uint64)
        name = np.where(length > 1, mix(name[at] * M1 + length), name[at])
        settle(keep)
        right = (mix(name + np.uint64(2 * r + 1)) >> np.uint64(63)).astype(bool)
        keep = np.ones(len(name), bool)
        keep[1:] = right[:-1] | ~right[1:] | hard[1:]
        at = np.flatnonzero(keep)
        beside = mix(np.concatenate([[np.uint64(0)], name[:-1]]) * M2 + name * M1)[at]  # the symbols its stretch covers whole
        follower = np.concatenate([at[1:], [len(name)]]) - at > 1
        name = np.where(follower, mix(mix(name[at] + M2) * M1 + name[np.minimum(at + 1, len(name) - 1)]), name[at])
        settle(keep)
    return cut, beside, low, high


def _filed(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """For each window: its start, the key it is filed under, and the distance to the boundary (``ALONE``: none)."""
    ends = np.cumsum(counts)
    starts = np.arange(len(words))
    starts = starts[starts + size <= np.repeat(ends, counts)]
    cut, beside, low, high = recompress(words, counts)
    first, last = np.searchsorted(low_order(low), starts), np.searchsorted(high_order(high), starts + size, side="right")
    found = np.full(len(starts), -1, np.int64)
    some = np.flatnonzero(last > first)
    if len(some):
        ranked = (beside & ~LOW) | np.arange(len(beside), dtype=np.uint64)
        a, b = first[some], last[some]
        level = np.frexp((b - a).astype(float))[1] - 1
        best = np.empty(len(some), np.uint64)
        table = ranked
        for k in range(int(level.max()) + 1):
            mine = np.flatnonzero(level == k)
            best[mine] = np.minimum(table[a[mine]], table[b[mine] - (1 << k)])
            table = np.minimum(table[: -(1 << k)], table[1 << k :]) if len(table) > 1 << k else table
        found[some] = (best & LOW).astype(np.int64)
    return starts, found, cut, beside


def low_order(low: np.ndarray) -> np.ndarray:
    """Unbounded stretches at a document's start take the place of the boundary before, to keep the order ascending."""
    return np.maximum.accumulate(low)


def high_order(high: np.ndarray) -> np.ndarray:
    return np.minimum.accumulate(high[::-1])[::-1]


def _entries(words: np.ndarray, counts: np.ndarray, size: int):
    """Windows filed under one boundary, one after the other, as entries: first window, number, key, offset, and the
    windows' fingerprints, keys and places."""
    starts, found, cut, beside = _filed(words, counts, size)
    finger = _rolling(words)
    of_window = finger(starts, starts + size)
    alone = found < 0
    key = np.where(alone, of_window, beside[found] if len(beside) else of_window)
    offset = np.where(alone, ALONE, (cut[found] if len(cut) else starts) - starts)
    fresh = np.ones(len(starts), bool)
    fresh[1:] = alone[1:] | (found[1:] != found[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(fresh)
    n = np.diff(np.concatenate([first, [len(starts)]]))
    whole = mix(finger(starts[first], starts[first] + n + size - 1) + offset[first].astype(np.uint64) * M1)
    return starts, of_window, key, offset, first, n, whole


def _window_keys(h: np.ndarray, offset: np.ndarray, finger: np.ndarray) -> np.ndarray:
    """One key per window from the pair it is filed under, its offset and its fingerprint."""
    return mix((h + offset.astype(np.uint64) * M2) ^ mix(finger))


def _file(size: int, buckets: int) -> Callable:
    """Documents to rows: kind 0 a packet of entries, kind 1 spans known to go, kind 2 windows filed by themselves."""
    keep_bits = np.uint64((1 << (8 * FINGER)) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches):
            words, counts = word_hashes(texts)
            starts, of_window, key, offset, first, n, whole = _entries(words, counts, size)
            begin = np.cumsum(counts) - counts
            doc_of = np.repeat(np.arange(len(ids)), counts)
            doc = ids[doc_of[starts[first]]] if len(first) else np.zeros(0, np.int64)
            at = starts[first] - begin[doc_of[starts[first]]] if len(first) else np.zeros(0, np.int64)
            # equal entries: the first one by (document, position) stands for all
            order = np.lexsort((at, doc, whole))
            again = np.zeros(len(order), bool)
            again[1:] = whole[order[1:]] == whole[order[:-1]]
            later, order = order[again], order[~again]
            gone = [(doc[later], at[later], at[later] + n[later] + size - 1)]
            # hot pairs
            h = key[first[order]]
            names, inverse, often = np.unique(h, return_inverse=True, return_counts=True)
            hot = (often > HOT)[inverse]
            cold, warm = order[~hot], order[hot]
            flat = np.repeat(first[warm], n[warm]) + _ramp(n[warm])
            windows = _window_keys(key[flat], offset[flat], of_window[flat] & keep_bits)
            w_doc, w_at = np.repeat(doc[warm], n[warm]), np.repeat(at[warm], n[warm]) + _ramp(n[warm])
            by = np.lexsort((w_at, w_doc, windows))
            twice = np.zeros(len(by), bool)
            twice[1:] = windows[by[1:]] == windows[by[:-1]]
            gone.append((w_doc[by[twice]], w_at[by[twice]], w_at[by[twice]] + size))
            alone = by[~twice]
            yield from _rows(2, w_doc[alone], w_at[alone], windows[alone].view(np.int64))
            yield from _rows(1, *merged_spans(*(np.concatenate(c) for c in zip(*gone, strict=True))))
            # packets; a note of a hot pair is an entry without windows
            notes = names[often > HOT]
            head = np.zeros(len(cold) + len(notes), ENTRY)
            head["h"][: len(cold)], head["h"][len(cold) :] = key[first[cold]], notes
            head["doc"][: len(cold)], head["start"][: len(cold)], head["n"][: len(cold)], head["offset"][: len(cold)] = doc[cold], at[cold], n[cold], offset[first[cold]]
            bucket = (mix(head["h"]) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            flat = np.repeat(np.concatenate([first[cold], np.zeros(len(notes), np.int64)])[by], head["n"][by]) + _ramp(head["n"][by])
            bytes_of = of_window[flat].view(np.uint8).reshape(-1, 8)[:, :FINGER]
            limits = np.searchsorted(bucket[by], np.arange(buckets + 1))
            reach = np.concatenate([[0], np.cumsum(head["n"][by], dtype=np.int64)])
            which, blobs = [], []
            for b in np.flatnonzero(np.diff(limits)):
                lo, hi = limits[b], limits[b + 1]
                which.append(int(b))
                blobs.append(np.uint32(hi - lo).tobytes() + head[by[lo:hi]].tobytes() + bytes_of[reach[lo] : reach[hi]].tobytes())
            if blobs:
                yield _row_batch(0, np.array(which), np.zeros(len(which), np.int64), np.zeros(len(which), np.int64), np.zeros(len(which), np.int64), blobs)

    return run


def _ramp(n: np.ndarray) -> np.ndarray:
    """0 ... n[0]-1, 0 ... n[1]-1, and so on."""
    n = n.astype(np.int64)
    total = np.cumsum(n)
    return np.arange(total[-1] if len(n) else 0) - np.repeat(total - n, n)


SCHEMA = "kind byte, bucket long, doc long, start long, other long, packet binary"


def _row_batch(kind: int, bucket, doc, start, other, packets) -> pa.RecordBatch:
    columns = [pa.array(np.full(len(doc), kind, np.int8)), *(pa.array(np.asarray(x, np.int64)) for x in (bucket, doc, start, other)), pa.array(packets, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SCHEMA.split(", ")])


def _rows(kind: int, doc: np.ndarray, start: np.ndarray, other: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows that only pass through; they are dealt by document."""
    for i in range(0, len(doc), 50_000):
        part = slice(i, i + 50_000)
        yield _row_batch(kind, -1 - (mix(doc[part].view(np.uint64)) % np.uint64(1 << 20)).astype(np.int64), doc[part], start[part], other[part], [None] * len(doc[part]))


def _unpack(packets: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    heads, fingers = [], []
    for data in packets:
        n = int(np.frombuffer(data, "<u4", 1)[0])
        heads.append(np.frombuffer(data, ENTRY, n, 4))
        fingers.append(np.frombuffer(data, np.uint8, offset=4 + n * ENTRY.itemsize).reshape(-1, FINGER))
    padded = np.zeros((sum(map(len, fingers)), 8), np.uint8)
    padded[:, :FINGER] = np.concatenate(fingers)
    return np.concatenate(heads), padded.view(np.uint64).ravel()


def _settle_bucket(packets: list[bytes], size: int):
    """Spans whose windows start earlier elsewhere in the bucket, and the windows of hot pairs."""
    head, finger = _unpack(packets)
    reach = np.cumsum(head["n"], dtype=np.int64) - head["n"]
    _, inverse, often = np.unique(head["h"], return_inverse=True, return_counts=True)
    noted = np.zeros(len(often), bool)
    noted[inverse[head["n"] == 0]] = True
    rows = np.flatnonzero((often > 1)[inverse] & (head["n"] > 0))
    rows = rows[np.lexsort((head["start"][rows], head["doc"][rows]))]  # windows of one document ascend too
    n = head["n"][rows].astype(np.int64)
    step = _ramp(n)
    offset = np.repeat(head["offset"][rows].astype(np.int64), n)
    offset = np.where(offset == ALONE, ALONE, offset - step)
    windows = _window_keys(np.repeat(head["h"][rows], n), offset, finger[np.repeat(reach[rows], n) + step])
    doc, start = np.repeat(head["doc"][rows], n), np.repeat(head["start"][rows].astype(np.int64), n) + step
    hot = np.repeat(noted[inverse[rows]], n)
    cold = np.flatnonzero(~hot)
    by = cold[np.argsort(windows[cold], kind="stable")]
    again = np.zeros(len(by), bool)
    again[1:] = windows[by[1:]] == windows[by[:-1]]
    same_place = np.zeros(len(by), bool)  # repeated rows of one id at one position are not earlier than each other
    heads = np.flatnonzero(~again)
    lead = by[np.repeat(heads, np.diff(np.concatenate([heads, [len(by)]])))] if len(by) else by
    same_place = (doc[by] == doc[lead]) & (start[by] == start[lead])
    gone = by[again & ~same_place]
    return merged_spans(doc[gone], start[gone], start[gone] + size), (doc[hot], start[hot], windows[hot].view(np.int64))


def _settle(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        last = None

        def close():
            spans, windows = _settle_bucket(held, size)
            yield from _rows(1, *spans)
            yield from _rows(2, *windows)

        for batch in batches:
            kinds, buckets = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            through = np.flatnonzero(kinds != 0)
            if len(through):
                yield batch.take(pa.array(through))
            for i in np.flatnonzero(kinds == 0):
                if held and buckets[i] != last:
                    yield from close()
                    held = []
                last = buckets[i]
                held.append(batch.column(5)[i].as_py())
        if held:
            yield from close()

    return run


def repeated_words(rows: DataFrame, size: int = WINDOW, buckets: int | None = None) -> DataFrame:
    """Spans of words (``doc``, ``start``, ``end``) covered by windows of ``size`` words that also start earlier:
    in a row of smaller ``key``, or earlier in the same one. Spans may overlap.

    ``rows`` has ``text`` and ``key``, see :func:`by_row`. A null text has no words.
    """
    if not 2 <= size < ALONE:
        raise ValueError("size must be from 2 to 254")
    buckets = buckets or 8 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    filed = rows.select("key", "text").mapInArrow(_file(size, buckets), SCHEMA)
    settled = filed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_settle(size), SCHEMA)
    settled = shared_table(settled.select("kind", "doc", "start", "other"), "repeated-words")
    spans = settled.filter("kind = 1").select("doc", "start", F.col("other").alias("end"))
    windows = settled.filter("kind = 2").select("doc", "start", F.col("other").alias("window"))
    first = windows.groupBy("window").agg(F.count("*").alias("n"), F.min(F.struct("doc", "start")).alias("first")).filter("n > 1")
    later = windows.join(first, "window").filter((F.col("doc") > F.col("first.doc")) | ((F.col("doc") == F.col("first.doc")) & (F.col("start") > F.col("first.start"))))
    return spans.unionByName(later.select("doc", "start", (F.col("start") + size).alias("end")))


def _cut(text: bytes, start: np.ndarray, end: np.ndarray) -> tuple[int, int, str]:
    words = text.split()
    removed, kept, at = 0, [], 0
    for a, b in zip(start.tolist(), np.minimum(end, len(words)).tolist(), strict=True):
        kept += words[at:a]
        removed += max(0, b - a)
        at = max(at, b)
    kept += words[at:]
    return len(words), removed, b" ".join(kept).decode()


def without_repeated_words(docs: DataFrame, size: int = WINDOW, doc_id: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept`` (the words left, joined by one blank) of every row.

    See :func:`repeated_words`; windows are judged on the input. Every row is a document of its own: rows that share an id follow each
    other in an order that depends on their texts, rows without one come last. Other columns are ignored, an empty table gives none.
    """
    rows = by_row(docs, doc_id, text)
    return with_spans(rows, repeated_words(rows, size, buckets), _cut, "doc_id long, n_words long, n_removed long, kept string")
