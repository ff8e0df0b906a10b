"""Members of large JSON files, read by byte ranges.

A file is cut at any byte. The first pass notes for each range what it does to the parser's state, for each state it may
begin in; a fold over these notes, one small row per range, gives every range its true state. The second pass emits the
members that begin in a range and reads on to the end of the last one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed

RANGE_BYTES = 32 << 20
#: Tasks of a pass; more ranges than this share tasks.
MOST_TASKS = 100_000
ROWS_PER_BATCH, BYTES_PER_BATCH = 4096, 8 << 20

# state at a byte: IN_STRING and ESCAPED (an odd run of backslashes ends before it) are bits
IN_STRING, ESCAPED, STATES = 1, 2, 4
_STEP = np.zeros(256, np.int64)
_STEP[list(b"{[")], _STEP[list(b"}]")] = 1, -1
_MARK = _STEP != 0
_MARK[ord(",")] = True
_KEY = re.compile(rb'"(?:[^"\\]|\\.)*"\Z', re.S)
_BLANK = b" \t\r\n"


def _opened(path: str):
    """A seekable file; a compressed one is unpacked whole, since it has no ranges."""
    local = re.match(r"file:/+", path)
    fs, name = (pa.fs.LocalFileSystem(), "/" + path[local.end():]) if local else pa.fs.FileSystem.from_uri(path)
    if _COMPRESSED.search(path):
        with fs.open_input_stream(name, compression="detect") as packed:
            return pa.BufferReader(packed.read())
    return fs.open_input_file(name)


_COMPRESSED = re.compile(r"\.(gz|bz2|zst|lz4)$", re.I)


def _structure(data: bytes, state: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions and bytes of brackets and commas outside strings, and the state at the end."""
    raw = np.frombuffer(data, np.uint8)
    slashes = np.flatnonzero(raw == ord("\\"))
    if state & ESCAPED:
        slashes = slashes[slashes > 0]
    escaped = np.zeros(0, np.int64)
    if len(slashes):
        cuts = np.flatnonzero(np.diff(slashes) != 1) + 1
        ends = np.append(cuts, len(slashes))
        odd = np.diff(ends, prepend=0) % 2 == 1
        escaped = slashes[ends - 1][odd] + 1
    if state & ESCAPED:
        escaped = np.append(0, escaped)
    quotes = np.setdiff1d(np.flatnonzero(raw == ord('"')), escaped, assume_unique=True)
    marks = np.flatnonzero(_MARK[raw])
    marks = marks[(np.searchsorted(quotes, marks) + state) & IN_STRING == 0]
    end = (state + len(quotes)) & IN_STRING
    return marks, raw[marks], end | (ESCAPED if len(escaped) and escaped[-1] == len(raw) else 0)


def _key_before(file, at: int) -> str | None:
    """Key of the value that begins at a byte; None for an element of an array or a root."""
    reach = 256
    while True:
        start = max(0, at - reach)
        text = file.read_at(at - start, start).rstrip(_BLANK)
        if text and not text.endswith(b":"):
            return None
        found = _KEY.search(text[:-1].rstrip(_BLANK))
        if found:
            try:
                return json.loads(found.group())
            except ValueError:
                return None
        if not start:
            return None
        reach *= 2


def _effect(file, start: int, data: bytes, state: int) -> dict:
    """What a range does to the nesting if it begins in ``state``.

    ``low`` is its lowest level relative to its start and ``commas`` the commas there. Only levels 1 and 2 of a document
    are asked for, so of the brackets left open those at the two levels above ``low`` are kept.
    """
    marks, kinds, end = _structure(data, state)
    step = _STEP[kinds]
    level = np.cumsum(step)
    low = min(0, int(level.min())) if len(level) else 0
    comma = step == 0
    later = np.minimum.accumulate(level[::-1])[::-1]
    opened = []
    for i in np.flatnonzero((step == 1) & (later >= level) & (level <= low + 2)):
        at = start + int(marks[i])
        after = int(np.count_nonzero(comma[i:] & (level[i:] == level[i])))
        opened.append([chr(kinds[i]), at, _key_before(file, at), after])
    return {"end": end, "low": low, "total": int(step.sum()), "commas": int(np.count_nonzero(comma & (level == low))), "opened": opened}


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            with _opened(row["path"]) as file:
                end = min(row["end"], file.size())
                data = file.read_at(max(0, end - row["start"]), row["start"])
                plain = [_effect(file, row["start"], data, s) for s in (0, IN_STRING)]
                bent = plain if data[:1] not in (b'"', b"\\") else [_effect(file, row["start"], data, s | ESCAPED) for s in (0, IN_STRING)]
            yield pa.RecordBatch.from_pylist([{**row, "effect": json.dumps(plain + bent)}])


def _with_states(ranges: pd.DataFrame) -> pd.DataFrame:
    """The state each range of one file begins in, by a fold over the effects of those before it."""
    ranges = ranges.sort_values("start", ignore_index=True)
    state, depth, held, out = 0, 0, [], []
    for text in ranges["effect"]:
        out.append(json.dumps([state, depth, held]))
        effect = json.loads(text)[state]
        base = max(0, depth + effect["low"])
        held = [list(h) for h in held[:base]]
        if 1 <= base <= len(held):
            held[base - 1][3] += effect["commas"]
        held += effect["opened"][: max(0, 2 - base)]
        state, depth = effect["end"], max(0, depth + effect["total"])
    return ranges[["path", "start", "end"]].assign(state=out)


def _members_of(file, row: dict, field: str | None, kind: str) -> Iterator[dict]:
    """Members that begin in a range: after the container's bracket or after a comma of its level."""
    state, depth, held = json.loads(row["state"])
    start, size = row["start"], file.size()
    end = min(row["end"], size)
    if start >= end:
        return
    wanted_level = 1 if field is None else 2
    slack = 1 << 16
    while True:
        stop = min(size, end + slack)
        data = file.read_at(stop - start, start)
        marks, kinds, _ = _structure(data, state)
        step = _STEP[kinds]
        level = depth + np.cumsum(step)
        event = np.where(step == -1, level == wanted_level - 1, level == wanted_level)
        places, whats = marks[event].tolist(), step[event].tolist()
        if not places or places[0] >= end - start or places[-1] >= end - start or stop == size:
            break
        slack *= 4
    now = held[wanted_level - 1] if len(held) >= wanted_level else None
    shapes = kinds[event].tolist()
    for i, (at, what) in enumerate(zip(places, whats)):
        if at >= end - start:
            return
        if what == -1:
            now = None
            continue
        if what == 1:
            now = [chr(shapes[i]), start + at, _key_before(file, start + at) if field is not None else None, 0]
        elif now is not None:
            now = [*now[:3], now[3] + 1]
        if now is None or now[2] != field:
            continue
        body = data[at + 1 : places[i + 1] if i + 1 < len(places) else len(data)].strip(_BLANK)
        if now[0] == kind and body:
            yield {"path": row["path"], "container": now[1], "idx": now[3], "text": body.decode("utf-8", "replace")}
        elif what == 1:
            yield {"path": row["path"], "container": now[1], "idx": None, "text": None}


def _members(field: str | None, kind: str) -> Callable:
    schema = pa.schema([("path", pa.string()), ("container", pa.int64()), ("idx", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with _opened(row["path"]) as file:
                    rows, held = [], 0
                    for member in _members_of(file, row, field, kind):
                        rows.append(member)
                        held += len(member["text"] or "")
                        if len(rows) >= ROWS_PER_BATCH or held >= BYTES_PER_BATCH:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def listed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length")


def read_members(spark: SparkSession, path: str, field: str | None, kind: str = "{", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, container, idx, text) of the members of an object (``kind`` ``{``) or an array (``[``) in JSON files.

    The container is the value of ``field`` in a root object, or the root itself where ``field`` is None. ``container`` is
    the byte its bracket stands at and ``idx`` counts its members from 0, over all ranges; ``text`` is an element, or a
    key with its value. A file may hold several documents one after the other; white space and a byte order mark between
    them do not matter. A container that is empty or of the other kind gives one row with null ``idx`` and ``text``; a
    document without the field, like a file without bytes, gives none. Of a file that breaks off, the rest of the last member is a member.
    Malformed text does not fail the read, but where its brackets do not match members may be lost.

    Ranges of ``range_bytes`` are read twice by as many tasks; a task holds one range and one member. Compressed files
    (gz, bz2, zst, lz4) are one range each. The state of the ranges is found when this is called.
    """
    files = listed(spark, path)
    packed = F.col("path").rlike(f"(?i){_COMPRESSED.pattern}")
    starts = F.when(packed | (F.col("length") <= range_bytes), F.array(F.lit(0).cast("bigint"))).otherwise(
        F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(range_bytes).cast("bigint"))
    )
    far = F.when(packed, F.lit(1 << 62)).otherwise(F.col("start") + range_bytes).alias("end")
    ranges = files.filter("length > 0").select("path", F.explode(starts).alias("start")).select("path", "start", far)
    tasks = max(1, min(MOST_TASKS, ranges.count()))
    noted = ranges.repartition(tasks, "path", "start").mapInArrow(_effects, "path string, start bigint, end bigint, effect string")
    states = checkpointed(noted.groupBy("path").applyInPandas(_with_states, "path string, start bigint, end bigint, state string"))
    return states.repartition(tasks, "path", "start").mapInArrow(_members(field, kind), "path string, container bigint, idx bigint, text string")
