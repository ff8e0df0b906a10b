"""Repeated byte passages by a sparse suffix array over range-partitioned buckets.

Of every window the suffix that starts at its smallest 32-byte string (by hash, leftmost of equals) stands for
it, so equal windows are stood for by suffixes with equal leading bytes at equal distance, and only
about one suffix in ninety is needed. Consecutive windows with one suffix form an entry.

1. Suffixes are range-partitioned by their leading bytes with sampled splitters and sorted. Entries equal as a whole
   are repeats, unread. Where entries of one leading string differ, one of each kind stays open.
2. Open entries fetch their bytes, are range-partitioned anew, and each bucket sorts their windows by
   multikey quicksort, eight bytes a round, dropping windows as soon as they stand alone. Equal leading
   bytes never straddle a splitter; groups that straddle the batches of a bucket are held until complete.

Skew: entries equal within a chunk of a task send one of them with a count. A leading string with very many different entries
in one chunk, or too many in its bucket, is hot: its windows are counted under their own 128-bit digests, spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_table
from .recompress import _ramp
from .repeats import by_row, chunks, merged_spans, with_spans
from .shingles import M1, mix, prefix_hashes, range_hashes

WINDOW = 200
LEAD = 32
HOT = 64
CHUNK = 2 << 20
HELD = 200_000
SORTED_BYTES = 4 << 20
ENTRY, SPAN, DIGEST, NOTE, OPEN, OPEN_HOT = range(6)
SCHEMA = "kind byte, lead long, h long, whole long, doc long, place long, n long"
LOW = np.uint64(0xFFFFFFFF)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive values, from running minima of blocks in both directions."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on as one big-endian number; zeros follow the end."""
    out = np.zeros(len(data), np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    for i in range(8):
        out = (out << np.uint64(8)) | padded[i : i + len(data)]
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    """Longs in the same order as the unsigned numbers."""
    return (x ^ np.uint64(1 << 63)).view(np.int64)


def _entries(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, size: int, lead: int):
    """Entries of a chunk: first window, number, suffix, hash of the leading bytes, hash of all bytes and the distance."""
    n = len(data)
    if n < size:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    prefix = prefix_hashes(data)
    at = np.arange(n - lead + 1)
    h = range_hashes(prefix, at, at + lead)
    packed = (h & ~LOW) | at.astype(np.uint64)
    suffix = (sliding_least(packed, size - lead + 1) & LOW).astype(np.int64)
    inside = np.zeros(n + 1, np.int32)
    room = ends - begins >= size
    np.add.at(inside, begins[room], 1)
    np.add.at(inside, ends[room] - size + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside[: len(suffix)]) > 0)
    of = suffix[starts]
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (of[1:] != of[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(fresh)
    count = np.diff(np.concatenate([first, [len(starts)]]))
    start, of = starts[first], of[first]
    whole = mix(range_hashes(prefix, start, start + count + size - 1) + (of - start).astype(np.uint64) * M1)
    return start, count, of, h[of], whole


def _batch(kind, lead, h, whole, doc, place, n) -> pa.RecordBatch:
    columns = [np.full(len(doc), kind, np.int8), *(np.asarray(x, np.int64) for x in (lead, h, whole, doc, place, n))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [f.split()[0] for f in SCHEMA.split(", ")])


def _place(start: np.ndarray, count: np.ndarray, distance: np.ndarray) -> np.ndarray:
    return (start.astype(np.int64) << 20) | (count.astype(np.int64) << 10) | distance


def _unplace(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 20, (place >> 10) & 1023, place & 1023


def _spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Spans only pass through; they are dealt by a hash of the document."""
    doc, start, end = merged_spans(doc, start, end)
    deal = mix(doc.view(np.uint64)).view(np.int64)
    return _batch(SPAN, deal, deal, np.zeros(len(doc)), doc, start, end)


def _digests(doc: np.ndarray, start: np.ndarray, digests: list[bytes], n: np.ndarray) -> pa.RecordBatch:
    words = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return _batch(DIGEST, words[:, 0], words[:, 1], np.zeros(len(doc)), doc, start, n)


def _file(size: int, lead: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches, CHUNK):
            flat = b"".join(texts)
            data = np.frombuffer(flat, np.uint8)
            ends = np.cumsum([len(t) for t in texts])
            begins = ends - [len(t) for t in texts]
            start, count, of, h, whole = _entries(data, begins, ends, size, lead)
            if not len(start):
                continue
            owner = np.searchsorted(ends, start, side="right")
            doc, at = ids[owner], start - begins[owner]
            leads = _signed(words_at(data)[of])
            distance = of - start
            kinds, inverse, often = np.unique(whole, return_inverse=True, return_counts=True)
            twice = (often > 1)[inverse]
            stand = np.zeros(len(kinds), np.int64)
            stand[inverse[::-1]] = np.arange(len(whole))[::-1]  # the first of each kind
            names, which, spread = np.unique(h[stand], return_inverse=True, return_counts=True)
            hot = (spread > HOT)[which]
            gone = [(doc[twice], at[twice], (at + count + size - 1)[twice])]
            if hot.any():
                warm = stand[hot]
                w = np.repeat(start[warm], count[warm]) + _ramp(count[warm])
                digest = [xxhash.xxh3_128_digest(flat[i : i + size]) for i in w.tolist()]
                _, back, n = np.unique(np.frombuffer(b"".join(digest), "<u8").reshape(-1, 2), axis=0, return_inverse=True, return_counts=True)
                back = back.ravel()
                n = n + np.bincount(back, weights=np.repeat(often[hot] > 1, count[warm])).astype(np.int64)
                w_owner = np.searchsorted(ends, w, side="right")
                w_doc, w_at = ids[w_owner], w - begins[w_owner]
                again = (n > 1)[back]
                gone.append((w_doc[again], w_at[again], w_at[again] + size))
                lone = np.unique(back, return_index=True)[1]
                yield _digests(w_doc[lone], w_at[lone], [digest[i] for i in lone], n[back[lone]])
                noted = np.unique(which[hot], return_index=True)[1]
                note = warm[noted]
                zero = np.zeros(len(note))
                yield _batch(NOTE, leads[note], h[note].view(np.int64), np.full(len(note), np.iinfo(np.int64).min), zero, zero, zero)
            yield _spans(*(np.concatenate(c) for c in zip(*gone, strict=True)))
            cold = stand[~hot]
            yield _batch(ENTRY, leads[cold], h[cold].view(np.int64), whole[cold].view(np.int64), doc[cold], _place(at[cold], count[cold], distance[cold]), np.minimum(often[~hot], 2))

    return run


def _settled(rows: dict[str, np.ndarray], size: int, hot: bool) -> Iterator[pa.RecordBatch]:
    """Complete groups: spans of entries that are repeated whole, and one open entry of each kind where kinds differ."""
    note = rows["kind"] == NOTE
    group = np.ones(len(note), bool)
    group[1:] = (rows["lead"][1:] != rows["lead"][:-1]) | (rows["h"][1:] != rows["h"][:-1])
    number = np.cumsum(group) - 1
    noted = np.zeros(number[-1] + 1, bool)
    noted[number[note]] = True
    noted |= hot
    real = np.flatnonzero(~note)
    if not len(real):
        return
    r = {k: v[real] for k, v in rows.items()}
    number = number[real]
    run = np.ones(len(real), bool)
    run[1:] = (number[1:] != number[:-1]) | (r["whole"][1:] != r["whole"][:-1])
    first = np.flatnonzero(run)
    total = np.add.reduceat(r["n"], first)
    repeated = np.repeat(total > 1, np.diff(np.concatenate([first, [len(real)]])))
    start, count, _ = _unplace(r["place"][repeated])
    if repeated.any():
        yield _spans(r["doc"][repeated], start, start + count + size - 1)
    kinds = np.bincount(number[first], minlength=len(noted))
    for kind, chosen in ((OPEN, first[(kinds[number[first]] > 1) & ~noted[number[first]]]), (OPEN_HOT, first[noted[number[first]]])):
        if len(chosen):
            # an entry known to be repeated counts twice: whoever meets its windows is repeated
            twice = np.where(repeated[chosen], 2, 1)
            yield _batch(kind, r["lead"][chosen], r["h"][chosen], r["whole"][chosen], r["doc"][chosen], r["place"][chosen], twice)


def _settle(size: int) -> Callable:
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        hot: tuple | None = None  # a group too large to hold, already settled in part

        def settle(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
            if not len(rows["kind"]):
                return
            in_hot = (rows["lead"] == hot[0]) & (rows["h"] == hot[1]) if hot else np.zeros(len(rows["kind"]), bool)
            for flag in (True, False):
                part = {k: v[in_hot == flag] for k, v in rows.items()}
                if len(part["kind"]):
                    yield from _settled(part, size, flag)

        for batch in batches:
            kinds = batch.column(0).to_numpy()
            through = np.flatnonzero((kinds == SPAN) | (kinds == DIGEST))
            if len(through):
                yield batch.take(pa.array(through))
            mine = np.flatnonzero((kinds == ENTRY) | (kinds == NOTE))
            rows = {k: batch.column(i).to_numpy()[mine] for i, k in enumerate(names)}
            if held is not None:
                rows = {k: np.concatenate([held[k], v]) for k, v in rows.items()}
            if not len(rows["kind"]):
                held = rows
                continue
            last = (rows["lead"] == rows["lead"][-1]) & (rows["h"] == rows["h"][-1])
            begin = int(np.argmax(last))
            if len(last) - begin > HELD:  # settle all of the group but its last kind as hot
                yield from settle({k: v[:begin] for k, v in rows.items()})
                hot = (rows["lead"][-1], rows["h"][-1])
                tail = begin + int(np.argmax(rows["whole"][begin:] == rows["whole"][-1]))
                if len(last) - tail > HELD:
                    start, count, _ = _unplace(rows["place"][tail + 1 :])
                    yield _spans(rows["doc"][tail + 1 :], start, start + count + size - 1)
                    rows = {k: v[: tail + 1].copy() for k, v in rows.items()}
                    rows["n"][tail] = 2
                yield from settle({k: v[begin:tail] for k, v in rows.items()})
                held = {k: v[tail:] for k, v in rows.items()}
            else:
                yield from settle({k: v[:begin] for k, v in rows.items()})
                held = {k: v[begin:] for k, v in rows.items()}
        if held is not None:
            yield from settle(held)

    return run


def _fetch(size: int) -> Callable:
    """Open entries of a document to their bytes, those of hot strings to digests of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, hot = [], ([], [], [], [])
            for doc, text, entries in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data = (text.as_py() or "").encode()
                for e in entries.as_py():
                    start, count = e["place"] >> 20, (e["place"] >> 10) & 1023
                    if start + count + size - 1 > len(data):
                        continue  # another text under the same id
                    if e["kind"] == OPEN:
                        out.append((e["lead"], e["h"], doc, e["place"], e["n"], data[start : start + count + size - 1]))
                        continue
                    for i in range(start, start + count):
                        for values, x in zip(hot, (doc, i, xxhash.xxh3_128_digest(data[i : i + size]), e["n"]), strict=True):
                            values.append(x)
            if out:
                lead, h, doc, place, n, data = zip(*out, strict=True)
                zero = pa.array(np.full(len(lead), OPEN, np.int8))
                yield pa.RecordBatch.from_arrays([zero, *(pa.array(x, pa.int64()) for x in (lead, h, doc, place, n)), pa.array(data, pa.binary())], FETCHED)
            if hot[0]:
                # windows repeated within the batch are spans already; one of each kind goes on with their count
                words = np.frombuffer(b"".join(hot[2]), "<i8").reshape(-1, 2)
                _, first, kinds, number = np.unique(words, axis=0, return_index=True, return_inverse=True, return_counts=True)
                kinds = kinds.ravel()
                doc, at, n = (np.array(hot[i], np.int64) for i in (0, 1, 3))
                total = np.bincount(kinds, weights=n).astype(np.int64)
                again = (number > 1)[kinds]
                spans = merged_spans(doc[again], at[again], at[again] + size)
                none = np.zeros(len(spans[0]), np.int64)
                for kind, columns in ((SPAN, (none, none, *spans)), (DIGEST, (words[first, 0], words[first, 1], doc[first], at[first], total))):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, np.int8)), *(pa.array(x) for x in columns), pa.nulls(len(columns[0]), pa.binary())], FETCHED)

    return run


FETCHED = ["kind", "lead", "h", "doc", "place", "n", "bytes"]
FETCHED_SCHEMA = "kind byte, lead long, h long, doc long, place long, n long, bytes binary"


def multikey_classes(data: np.ndarray, at: np.ndarray, group: np.ndarray, size: int) -> np.ndarray:
    """Equal strings: a class number for each string data[at : at + size] of a group, -1 for those that stand alone.

    Multikey quicksort in rounds: strings of one class are split by their next eight bytes, and a class
    of one is not looked at again.
    """
    words = words_at(data)
    left = np.arange(len(at))
    cls = np.unique(group, return_inverse=True)[1].ravel()
    out = np.full(len(at), -1, np.int64)
    for depth in range(0, size, 8):
        word = words[at[left] + depth]
        if size - depth < 8:
            word = word >> np.uint64(8 * (8 - size + depth))
        order = np.lexsort((word, cls))
        c, w = cls[order], word[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (c[1:] != c[:-1]) | (w[1:] != w[:-1])
        number = np.cumsum(fresh) - 1
        shared = np.bincount(number)[number] > 1 if len(number) else fresh
        left, cls = left[order[shared]], number[shared]
        if not len(left):
            return out
    out[left] = cls
    return out


def _compare(size: int) -> Callable:
    """Buckets of open entries, sorted by leading bytes, to spans."""

    def settle(rows: list[tuple]) -> pa.RecordBatch | None:
        lead, h, doc, place, known, parts = (list(x) for x in zip(*rows, strict=True))
        start, count, distance = _unplace(np.array(place))
        data = np.frombuffer(b"".join(parts), np.uint8)
        begin = np.cumsum([len(p) for p in parts]) - [len(p) for p in parts]
        step = _ramp(count)
        entry = np.repeat(np.arange(len(parts)), count)
        key = mix(np.array(h, np.int64).view(np.uint64) + np.array(lead, np.int64).view(np.uint64) * M1)
        cls = multikey_classes(data, begin[entry] + step, mix(key[entry] + (distance[entry] - step).astype(np.uint64)), size)
        hit = np.flatnonzero(cls >= 0)
        if not len(hit):
            return None
        doc, at = np.array(doc, np.int64)[entry[hit]], start[entry[hit]] + step[hit]
        doc, at, end = merged_spans(doc, at, at + size)
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(at), pa.array(end)], ["doc", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last, total = None, 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if held and row[:2] != last and total > SORTED_BYTES:
                    if (found := settle(held)) is not None:
                        yield found
                    held, total = [], 0
                last = row[:2]
                held.append(row)
                total += len(row[5])
        if held and (found := settle(held)) is not None:
            yield found

    return run


def repeated_bytes(rows: DataFrame, size: int = WINDOW, lead: int = LEAD) -> DataFrame:
    """Spans of bytes (``doc``, ``start``, ``end``) covered by strings of ``size`` bytes that also start anywhere else,
    in another row or the same one. Spans may overlap.

    ``rows`` has ``text`` and ``key``, see :func:`by_row`. A null text has no bytes.
    """
    if not 8 <= lead < size < 1024:
        raise ValueError("lead must be from 8 on, size above lead and below 1024")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    filed = rows.select("key", "text").mapInArrow(_file(size, lead), SCHEMA)
    sorted_ = filed.repartitionByRange(parts, "lead", "h").sortWithinPartitions("lead", "h", "whole", "kind")
    settled = shared_table(sorted_.mapInArrow(_settle(size), SCHEMA), "suffixes")
    as_span = ("doc", F.col("place").alias("start"), F.col("n").alias("end"))
    spans = settled.filter(F.col("kind") == SPAN).select(*as_span)
    # an entry stands in one document, so the list is at most as long as the document
    entries = settled.filter(F.col("kind").isin(OPEN, OPEN_HOT)).groupBy("doc").agg(F.collect_list(F.struct("kind", "lead", "h", "place", "n")).alias("entries"))
    open_ = rows.join(entries, F.col("key") == F.col("doc")).select("doc", "text", "entries")
    fetched = shared_table(open_.mapInArrow(_fetch(size), FETCHED_SCHEMA), "suffix-bytes")
    spans = spans.unionByName(fetched.filter(F.col("kind") == SPAN).select(*as_span))
    bucketed = fetched.filter(F.col("kind") == OPEN).repartitionByRange(parts, "lead", "h").sortWithinPartitions("lead", "h")
    compared = bucketed.select("lead", "h", "doc", "place", "n", "bytes").mapInArrow(_compare(size), "doc long, start long, end long")
    digests = settled.filter(F.col("kind") == DIGEST).select("lead", "h", "doc", "place", "n").unionByName(fetched.filter(F.col("kind") == DIGEST).select("lead", "h", "doc", "place", "n"))
    often = digests.groupBy("lead", "h").agg(F.sum("n").alias("all")).filter(F.col("all") > 1)
    # a digest with a count of its own comes from windows whose spans are known already
    counted = digests.filter("n = 1").join(often, ["lead", "h"]).select("doc", F.col("place").alias("start"), (F.col("place") + size).alias("end"))
    return spans.unionByName(compared).unionByName(counted)


def _cut(text: bytes, start: np.ndarray, end: np.ndarray) -> tuple[int, int, int, bytes]:
    kept, at, removed = [], 0, 0
    start, end = start[start < len(text)], end[start < len(text)]
    for a, b in zip(start.tolist(), np.minimum(end, len(text)).tolist(), strict=True):
        kept.append(text[at:a])
        removed += b - a
        at = b
    kept.append(text[at:])
    return len(text), removed, len(start), b"".join(kept)


def without_repeated_bytes(docs: DataFrame, size: int = WINDOW, lead: int = LEAD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (the bytes left) of every row.

    See :func:`repeated_bytes`; strings are judged on the input. Every row is a document of its own, whatever its id. Other columns are
    ignored, an empty table gives none.
    """
    rows = by_row(docs, doc_id, text)
    return with_spans(rows, repeated_bytes(rows, size, lead), _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
