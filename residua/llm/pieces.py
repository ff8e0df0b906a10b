"""SentencePiece encoding and decoding of whole texts, exact for merge-type models.

A sequence of tokens is what merging by score gives exactly when each token encodes to itself and each
adjacent pair, merged anew from characters, comes out as that pair. So encoding is a search: take
the longest token at a position (found for all positions by one Aho-Corasick pass), check it against
its left neighbour, fall back to its next shorter prefix, and step back when none is left, marking
the position as failed so that no position is given up twice.

Where no token has a blank mark after another character, texts fall into chunks (blank marks and the
characters up to the next mark) that encode alone; a worker remembers the chunks it has encoded.
Documents are encoded where they stand: nothing is shuffled, and memory is the vocabulary, one batch
and a bounded memory of chunks.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_slot

MARK = "▁"
END = (1 << 60, "")
REMEMBERED = 150_000
LONGEST_REMEMBERED = 64


class Memory(dict):
    """Ids of chunks met lately: when full, what it holds becomes the old half, from which chunks met again come back."""

    def __init__(self, encode):
        self.encode, self.old = encode, {}

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        ids = self.old.pop(chunk, None)
        if ids is None:
            ids = self.encode(chunk)
        if len(chunk) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[chunk] = ids
        return ids


class PieceCoder:
    """Encoder and decoder of one model, given as its serialised bytes."""

    def __init__(self, model: bytes):
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(sp.get_piece_size())
        plain = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = sp.unk_id()
        self.digits = [str(i) for i in ids]
        self.by_chunk = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.matcher = ahocorasick.Automaton()
        for p in self.ids:
            self.matcher.add_word(p, p)
        self.matcher.make_automaton()
        self.pairs: dict[str, dict[str, bool]] = defaultdict(dict)  # by left token, then right token
        self.shorter: dict[str, str | None] = {}
        self.sound: dict[str, bool] = {}
        self.memory = Memory(self.chunk_ids)

    def merge(self, text: str) -> list[str]:
        """Merge from characters, best score first, leftmost of equals: the definition, for short texts."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging the two tokens' characters anew gives the two tokens back."""
        row = self.pairs[a]
        known = row.get(b)
        if known is None:
            known = row[b] = self.merge(a + b) == [a, b]
        return known

    def usable(self, token: str) -> bool:
        """Whether the token encodes to itself; a single character always stands for itself."""
        known = self.sound.get(token)
        if known is None:
            known = self.sound[token] = len(token) == 1 or self.merge(token) == [token]
        return known

    def prefix(self, token: str) -> str | None:
        """The longest usable proper prefix."""
        if token not in self.shorter:
            found = (token[:n] for n in range(len(token) - 1, 0, -1) if n == 1 or token[:n] in self.ids)
            self.shorter[token] = next((p for p in found if self.usable(p)), None)
        return self.shorter[token]

    def split(self, text: str) -> list[str]:
        """The tokens of a marked text."""
        n = len(text)
        longest = self.matcher.iter_long
        failed = bytearray(n + 1)
        pairs, sound = self.pairs, self.sound
        out: list[str] = []
        pos = 0
        before: dict[str, bool] | None = None  # what is known of the last token's right neighbours
        scan, scanned = longest(text), 0  # longest matches one after the other, and where the next one starts
        found: tuple[int, str] | None = None  # the scan's next match, if it starts further on

        def match(pos: int) -> str:
            nonlocal scan, scanned, found
            if scanned != pos:
                scan, scanned, found = longest(text, pos), pos, None
            if found is None:
                found = next(scan, END)
            last, token = found
            if last - len(token) + 1 == pos:
                scanned, found = last + 1, None
            else:
                scanned, token = pos + 1, text[pos]  # no piece starts here
            return token if sound.get(token) or self.usable(token) else self.prefix(token)

        token = match(0)
        while True:
            end = pos + len(token)
            if not failed[end]:
                fits = before is None or before.get(token)
                if fits is None:
                    fits = self.compatible(out[-1], token)
                if fits:
                    out.append(token)
                    if end == n:
                        return out
                    pos, before = end, pairs[token]
                    token = match(pos)
                    continue
            token = self.prefix(token)
            while token is None:
                failed[pos] = 1
                last = out.pop()  # the first position cannot fail: some encoding exists
                pos -= len(last)
                before = pairs[out[-1]] if out else None
                token = self.prefix(last)

    def chunk_ids(self, chunk: str) -> tuple[int, ...]:
        tokens = self.split(chunk)
        ids = tuple(map(self.ids.get, tokens))
        if None not in ids:
            return ids
        out = []
        for token, i in zip(tokens, ids, strict=True):
            if i is not None:
                out.append(i)
            elif self.bytes[0] != self.unknown:
                out.extend(self.bytes[b] for b in token.encode())
            else:
                out.append(self.unknown)
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        if not self.by_chunk:
            return list(self.chunk_ids(marked))
        return list(chain.from_iterable(map(self.memory.__getitem__, CHUNK.findall(marked))))

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids) if ids else ""


CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def coder_of(model: bytes) -> PieceCoder:
    """The worker's coder of this model: a worker serves many tasks and keeps what it has learned."""
    return worker_slot(("pieces", model), lambda: PieceCoder(model))


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoded(docs: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``ids``, the token ids of the whole text; null and empty texts have none.

    The model must be a merge-type one with identity normalisation and a leading blank mark.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(sent.value)
        for batch in batches:
            ids = pa.array([coder.encode(t or "") for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, model: bytes, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``doc_id`` and ``text`` of token ids; a null list gives an empty text."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(sent.value)
        for batch in batches:
            texts = pa.array([coder.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["doc_id", "text"])

    return rows.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, "doc_id long, text string")


def token_digests(docs: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``: encoding and decoding in one pass.

    Every row gets a row, repeated ones and null ids too; null and empty texts have no tokens.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(sent.value)
        for batch in batches:
            n, first, second = [], [], []
            for value in batch.column(1):
                ids = coder.encode(value.as_py() or "")
                n.append(len(ids))
                first.append(hashlib.sha256(",".join(map(coder.digits.__getitem__, ids)).encode()).hexdigest())
                second.append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
