"""Files of token ids: canonical Huffman bits in independent blocks, in the order of the documents' ids.

Texts are encoded by the tokenizers library. A task takes the distinct chunks of its batch (text up to the next
change from a visible character to a blank or line end, where byte-level pre-tokens always end), encodes strings of
many of them, tells them apart by the offsets of the ids, and puts texts together from chunks.

The ids are written once, counted per task and added up by Spark; the counts of the vocabulary give one code book. Documents
are packed where they stand, then dealt by ranges of their id and laid down as segments:

    magic, version, documents n, blocks b                                              4 x u32, little-endian
    ids, bytes of each document                                                        n x u64, n x u64
    bit offset of each block within its document, a checkpoint every ``BLOCK`` ids     b x u64
    bits

A segment is a row of Parquet files, so every store that Spark writes to holds it and a lost executor leaves no half
of it. Beside the segments stand the code book (a code length per id) and the first id of every part. Any block decodes alone.
"""

from __future__ import annotations

import posixpath
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..session import shared_dir
from .common import shared_table, worker_slot
from .huffman import Code, code_lengths
from .places import bases, part_and_place, ragged, slices, sums

MAGIC, VERSION = 0x46445449, 1
#: Ids of a block, of a segment (whole documents, so one may exceed it), of a range of documents.
BLOCK, SEGMENT_IDS, PART_IDS = 512, 1 << 20, 1 << 26
SEGMENT_DOCUMENTS = 1 << 16
CODE_LIMIT = 18
#: Bytes of a string made of chunks, characters of a piece of a long text, of a task's slice of texts; ids put together at a time.
JOINED_BYTES, LONG_CHARS, TEXT_CHARS, TAKEN_IDS = 20_000, 200_000, 32_000_000, 1 << 20
#: Chunks that a worker keeps, unless one slice of texts has more.
KNOWN_CHUNKS = 1_200_000
#: Before a blank or line end that follows a visible character a byte-level pre-token ends.
VISIBLE = r"!-~\pL\pN\pM\pP\pS"
SEAM = re.compile(r"(?<=[!-~\w])(?=[ \n\t\r])")


class Encoder:
    """Ids of texts by one tokenizer file."""

    def __init__(self, data: bytes, as_text: bool):
        self.tokenizer = Tokenizer.from_buffer(data)
        self.tokenizer.encode_special_tokens = as_text
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        #: A token of a byte-level vocabulary is written with a character for each byte.
        self.bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]
        #: Chunks met lately, their ids, and the first place and number of the ids of each.
        self.known, self.ids = pa.array([], pa.large_string()), np.zeros(0, np.uint32)
        self.first, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _whole(self, text: str) -> np.ndarray:
        """One text, in pieces cut at seams so that no call is long."""
        cuts, last = [0], 0
        while len(text) - last > LONG_CHARS:
            found = SEAM.search(text, last + LONG_CHARS)
            if not found:
                break
            last = found.start()
            cuts.append(last)
        pieces = [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]
        return np.concatenate([np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, np.uint32) for p in pieces])

    def _joined(self, chunks: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids of chunks that start with a blank and end visibly, and the number of each: encoded in strings of many, parted by the ids' offsets."""
        ends = np.cumsum(pc.binary_length(chunks).to_numpy(zero_copy_only=False).astype(np.int64))
        found, sizes = [], np.zeros(len(ends), np.int64)
        first, before = 0, 0
        while first < len(ends):
            last = max(first + 1, int(np.searchsorted(ends, before + JOINED_BYTES, side="right")))
            text = "".join(chunks.slice(first, last - first).to_pylist())
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.cumsum(self.bytes[ids])
            sizes[first:last] = np.diff(np.searchsorted(stops, ends[first:last] - before, side="right"), prepend=0)
            found.append(ids)
            first, before = last, int(ends[last - 1])
        return found, sizes

    def _chunk_ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and of each chunk its first place there and its number of ids."""
        at = pc.index_in(chunks, value_set=self.known)
        new = at.is_null().to_numpy(zero_copy_only=False)
        fresh = chunks.filter(pa.array(new))
        ids, first, sizes = self._fresh(fresh)
        place = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        place[new] = len(self.known) + np.arange(len(fresh))
        flat = np.concatenate([self.ids, ids])
        first, sizes = np.concatenate([self.first, first + len(self.ids)]), np.concatenate([self.sizes, sizes])
        if len(sizes) <= KNOWN_CHUNKS:
            self.known, self.ids, self.first, self.sizes = pa.concat_arrays([self.known, fresh]), flat, first, sizes
        else:  # only what was met last
            self.known, self.sizes = chunks, sizes[place]
            self.ids, self.first = flat[ragged(first[place], self.sizes)], np.cumsum(self.sizes) - self.sizes
        return flat, first[place], sizes[place]

    def _fresh(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # between such chunks there is a seam
        fit = pc.match_substring_regex(chunks, f"(?s)^[ \\n].*[{VISIBLE}]$").to_numpy(zero_copy_only=False)
        sizes = np.zeros(len(chunks), np.int64)
        found, sizes[fit] = self._joined(chunks.filter(pa.array(fit)))
        rest = np.flatnonzero(~fit)
        for i in rest.tolist():
            text = chunks[i].as_py()
            found.append(self._whole(text) if text else np.zeros(0, np.uint32))
            sizes[i] = len(found[-1])
        order = np.concatenate([np.flatnonzero(fit), rest])
        first = np.empty(len(chunks), np.int64)
        first[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate([*found, np.zeros(0, np.uint32)]), first, sizes

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of consecutive texts, one text after the other, and the number of each; some texts at a time. Null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        rough = pc.match_substring_regex(texts, f"[^{VISIBLE}][ \\n]")
        marked = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n")
        if pc.any(rough).as_py():  # runs of blanks: cut only after visible characters
            fine = pc.replace_substring_regex(texts.filter(rough), f"([{VISIBLE}])([ \\n])", "\\1\0\\2")
            marked = pc.replace_with_mask(marked, rough, fine)
        zero = pc.match_substring(texts, "\0")
        if pc.any(zero).as_py():  # the mark stands in the text itself
            marked = pc.if_else(zero, "", marked)
        odd = set(np.flatnonzero(zero.to_numpy(zero_copy_only=False)).tolist())
        parts = pc.split_pattern(marked, "\0")
        del marked
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64))])
        coded = parts.flatten().dictionary_encode()
        del parts
        flat, first, sizes = self._chunk_ids(coded.dictionary)
        chunk = coded.indices.to_numpy(zero_copy_only=False)
        del coded
        ends = np.cumsum(sums(sizes[chunk], np.diff(bounds)))
        start = 0
        while start < len(texts):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + TAKEN_IDS, side="right")))
            mine = chunk[bounds[start] : bounds[stop]]
            ids, n = flat[ragged(first[mine], sizes[mine])], np.diff(np.concatenate([[before], ends[start:stop]]))
            for i in sorted(odd.intersection(range(start, stop))):
                at = int(n[: i - start].sum())
                whole = self._whole(texts[i].as_py())
                ids, n[i - start] = np.concatenate([ids[:at], whole, ids[at + n[i - start] :]]), len(whole)
            yield ids, n
            start = stop


def tokens(docs: DataFrame, tokenizer: bytes, end: int | None = 0, as_text: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n`` and ``ids`` (packed 16-bit integers, 32-bit where the vocabulary is larger) of whole texts, ``end`` last.

    ``as_text``: strings of special tokens in a text are ordinary text.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer)
    kind = id_type(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_slot(("tokens", as_text, zlib.crc32(sent.value)), lambda: Encoder(sent.value, as_text))
        for batch in slices(batches, 1, TEXT_CHARS):
            done = 0
            for ids, n in encoder.encode(batch.column(1)):
                if end is not None:
                    ids, n = np.insert(ids, np.cumsum(n), end), n + 1
                packed = ids.astype(kind).tobytes()
                stops = (np.cumsum(n) * np.dtype(kind).itemsize).tolist()
                rows = [packed[a:b] for a, b in zip([0, *stops], stops, strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(n)), pa.array(n), pa.array(rows, pa.binary())], ["doc_id", "n", "ids"])
                done += len(n)

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, ids binary")


def id_type(tokenizer: bytes) -> str:
    return "<u2" if Tokenizer.from_buffer(tokenizer).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def id_counts(rows: DataFrame, vocabulary: int, kind: str) -> np.ndarray:
    """How often each id occurs: counted in tasks, added by Spark; the vocabulary bounds what the driver gets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                total += np.bincount(np.frombuffer(ids.as_buffer(), kind), minlength=vocabulary) if len(ids.as_buffer()) > vocabulary else 0
            short = b"".join(x.as_py() for x in batch.column(0) if len(x.as_buffer()) <= vocabulary)
            total += np.bincount(np.frombuffer(short, kind), minlength=vocabulary)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    counts = np.zeros(vocabulary, np.int64)
    for r in rows.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    return counts


def _packed(rows: DataFrame, lengths: np.ndarray, kind: str) -> DataFrame:
    """``doc_id``, ``n``, ``row``, ``marks`` (checkpoints) and ``bits`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)
        for batch in slices(batches, 3, 4 * SEGMENT_IDS):
            n = batch.column(2).to_numpy()
            ids = np.frombuffer(b"".join(x.as_py() for x in batch.column(3)), kind)
            data, sizes, marks, blocks = code.pack(ids, n, BLOCK)
            ends, stops = np.cumsum(sizes).tolist(), (np.cumsum(blocks) * 8).tolist()
            marks = marks.astype("<u8").tobytes()
            columns = [[whole[a:b] for a, b in zip([0, *to], to, strict=False)] for whole, to in ((marks, stops), (data, ends))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, pa.binary()) for c in columns)], ["row", "doc_id", "n", "marks", "bits"])

    return rows.select("row", "doc_id", "n", "ids").mapInArrow(run, "row long, doc_id long, n long, marks binary, bits binary")


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive documents of a part as segments; a task holds the documents of one segment."""
    held: list[tuple] = []
    state = {"ids": 0, "part": None, "seq": 0, "first": 0}

    def flush() -> pa.RecordBatch:
        n = np.array([h[1] for h in held], "<u8")
        sizes = np.array([len(h[3]) for h in held], "<u8")
        marks = b"".join(h[2] for h in held)
        head = np.array([MAGIC, VERSION, len(held), len(marks) // 8], "<u4").tobytes()
        body = b"".join([head, n.tobytes(), sizes.tobytes(), marks, *(h[3] for h in held)])
        row = [[state["part"]], [state["seq"]], [state["first"]], [int(n.sum())], [[h[0] for h in held]], [body]]
        state.update(seq=state["seq"] + 1, first=state["first"] + int(n.sum()), ids=0)
        held.clear()
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], ["part", "seq", "first", "n_ids", "doc_ids", "body"])

    for batch in batches:
        for part, doc, n, marks, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (state["part"] != part or state["ids"] + n > SEGMENT_IDS or len(held) == SEGMENT_DOCUMENTS):
                yield flush()
            if state["part"] != part:
                state.update(part=part, seq=0, first=0)
            held.append((doc, n, marks, bits))
            state["ids"] += n
    if held:
        yield flush()


def write(docs: DataFrame, tokenizer: bytes, path: str, end: int | None = 0, as_text: bool = True, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes the ids of all documents below ``path``, a folder that does not exist yet, in ascending order of ``doc_id``.

    Null and empty texts have ``end`` alone; rows with a null id come last, those of one id in order of length. Every row is
    a document, repeated ones too. An empty table gives files without segments. Other columns are not read.
    """
    spark = docs.sparkSession
    kind = id_type(tokenizer)
    vocabulary = max(Tokenizer.from_buffer(tokenizer).get_vocab_size(with_added_tokens=True), (end or 0) + 1)
    rows = shared_table(tokens(docs, tokenizer, end, as_text, doc_id, text).withColumn("row", F.monotonically_increasing_id()), "token-ids")
    counts = id_counts(rows, vocabulary, kind)
    lengths = code_lengths(counts, CODE_LIMIT)
    spark.createDataFrame([(lengths.tobytes(), int(counts.sum()))], "lengths binary, n_ids long").coalesce(1).write.parquet(posixpath.join(path, "codebook"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(counts.sum()) // PART_IDS + 1)
    order = [F.asc_nulls_last("doc_id"), F.col("n"), F.col("row")]
    ranged = part_and_place(_packed(rows, lengths, kind), order, parts).select("_part", "doc_id", "n", "marks", "bits")
    laid = ranged.mapInArrow(_segments, "part int, seq long, first long, n_ids long, doc_ids array<long>, body binary")
    laid.write.option("compression", "none").parquet(posixpath.join(path, "segments"))


def _book(spark: SparkSession, path: str) -> np.ndarray:
    return np.frombuffer(spark.read.parquet(posixpath.join(path, "codebook")).first()["lengths"], np.uint8)


def _laid(spark: SparkSession, path: str) -> DataFrame:
    """The segments with ``start``, the number of ids before them in all files."""
    segments = spark.read.parquet(posixpath.join(path, "segments"))
    start = bases(segments.groupBy(F.col("part").alias("_part")).agg(F.sum("n_ids").alias("n")), "n")
    return segments.join(start, F.col("part") == F.col("_part")).withColumn("start", F.col("first") + F.col("_base")).drop("_part", "_base")


class Segment:
    """Tables of one segment's bytes."""

    def __init__(self, body: bytes):
        head = np.frombuffer(body, "<u4", 4).astype(np.int64)
        if head[0] != MAGIC or head[1] != VERSION:
            raise ValueError("not a segment of token ids")
        n, b = int(head[2]), int(head[3])
        tables = np.frombuffer(body, "<u8", 2 * n + b, 16).astype(np.int64)
        self.n, sizes, marks = tables[:n], tables[n : 2 * n], tables[2 * n :]
        self.bits = body[16 + 8 * (2 * n + b) :]
        blocks = -(-self.n // BLOCK)
        nth = np.arange(b) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        self.offsets = marks + np.repeat((np.cumsum(sizes) - sizes) * 8, blocks)
        self.counts = np.minimum(np.repeat(self.n, blocks) - nth * BLOCK, BLOCK)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before), ``n_tokens`` and ``ids`` (packed 32-bit integers) of all documents of the files."""
    lengths = _book(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)
        for batch in batches:
            for start, docs, body in zip(*batch.columns, strict=True):
                segment = Segment(body.as_py())
                ids = code.unpack(segment.bits, segment.offsets, segment.counts).astype("<u4").tobytes()
                ends = np.cumsum(segment.n)
                rows = [ids[4 * a : 4 * b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]
                columns = [pa.array(docs.as_py(), pa.int64()), pa.array(ends - segment.n + start.as_py()), pa.array(segment.n), pa.array(rows, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])

    return _laid(spark, path).select("start", "doc_ids", "body").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def window(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """``at`` and ``id``: ids number ``start`` to ``stop - 1`` of all. Only segments and blocks that hold some are decoded."""
    lengths = _book(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)
        for batch in batches:
            for before, body in zip(*batch.columns, strict=True):
                segment = Segment(body.as_py())
                first = np.cumsum(segment.counts) - segment.counts + before.as_py()
                hit = (first < stop) & (first + segment.counts > start)
                at = ragged(first[hit], segment.counts[hit])
                ids = code.unpack(segment.bits, segment.offsets[hit], segment.counts[hit])
                inside = (at >= start) & (at < stop)
                yield pa.RecordBatch.from_arrays([pa.array(at[inside]), pa.array(ids[inside])], ["at", "id"])

    near = _laid(spark, path).filter((F.col("start") < stop) & (F.col("start") + F.col("n_ids") > start))
    return near.select("start", "body").mapInArrow(run, "at long, id long")


def digests(docs: DataFrame, tokenizer: bytes, end: int | None = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the files below the shared folder, reads them back: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``."""
    path = shared_dir(docs.sparkSession, "token-files")
    write(docs, tokenizer, path, end, doc_id=doc_id, text=text)
    return read(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
