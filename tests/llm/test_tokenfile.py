"""Huffman codes and files of token ids."""

import heapq
import zlib

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from residua.llm import tokenfile
from residua.llm.huffman import Code, code_lengths
from residua.session import shared_dir

FILE = path("byte_bpe_50k.json")


def library():
    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    return t


def least_total(counts):
    """Total bits of an unlimited Huffman code."""
    heap = [int(c) for c in counts if c]
    if len(heap) == 1:
        return heap[0]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        total += both
        heapq.heappush(heap, both)
    return total


@pytest.mark.parametrize("seed", range(6))
def test_lengths_are_least(seed):
    rng = np.random.default_rng(seed)
    counts = (rng.zipf(1.4, 300) * rng.integers(0, 2, 300)).astype(np.int64)
    free = code_lengths(counts, 60)
    assert (free * counts).sum() == least_total(counts)
    tight = code_lengths(counts, 9)
    assert tight.max() <= 9 and sum(2.0 ** -int(x) for x in tight if x) == 1
    assert (tight * counts).sum() >= (free * counts).sum()


def test_limited_lengths_by_search():
    counts = np.array([1, 1, 2, 3, 5, 8])
    best = min(sum(a * b for a, b in zip(sorted(counts, reverse=True), lengths, strict=True)) for lengths in _kraft(6, 3))
    assert (code_lengths(counts, 3) * counts).sum() == best
    assert code_lengths(np.array([0, 7, 0]), 5).tolist() == [0, 1, 0]
    assert code_lengths(np.zeros(4, int), 5).tolist() == [0] * 4
    assert code_lengths(np.ones(9, int), 2).max() == 4  # two bits cannot tell nine apart


def _kraft(n, limit, least=1, left=1.0):
    if n == 0:
        yield ()
        return
    for length in range(least, limit + 1):
        if 2.0**-length * n <= left + 1e-9 or 2.0**-length <= left:
            for rest in _kraft(n - 1, limit, length, left - 2.0**-length):
                if left >= 2.0**-length:
                    yield (length, *rest)


@pytest.mark.parametrize("block", [1, 7, 512])
def test_pack_and_unpack(block):
    rng = np.random.default_rng(block)
    symbols = rng.zipf(1.3, 5000) % 700
    sizes = rng.multinomial(5000, np.ones(40) / 40)
    sizes = np.concatenate([[0], sizes, [0, 0]])
    code = Code(code_lengths(np.bincount(symbols, minlength=700), 14))
    data, n_bytes, marks, blocks = code.pack(symbols, sizes, block)
    assert len(data) == n_bytes.sum()
    base = np.repeat((np.cumsum(n_bytes) - n_bytes) * 8, blocks)
    nth = np.arange(len(base)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    counts = np.minimum(np.repeat(sizes, blocks) - nth * block, block)
    assert code.unpack(data, marks + base, counts).tolist() == symbols.tolist()
    some = rng.permutation(len(counts))[:5]  # blocks alone
    first = np.cumsum(counts) - counts
    assert code.unpack(data, (marks + base)[some], counts[some]).tolist() == [x for i in some for x in symbols[first[i] : first[i] + counts[i]].tolist()]


ODD = [
    "", None, " ", "  ", "\n", "a", " a", "a ", "a  b", "a\n\n  b\tc \n", "it's we'll\n'tis '  s", "x\0y \0 z", "\0", "日本語 テキスト　 全角  nbsp  sep",
    "<|endoftext|> is text <|endoftext|>", "é à\nb", "​zero ​ width", "\x85next \x1c line\x1f x", "tabs\t\t in\r\n lines \r x", "a" * 3000, "🙂 🙂🙂\n🙂", " \n \n x", "1,234.5 km² ½ Ⅷ",
]


def odd_texts(n=400, seed=1):
    rng = np.random.default_rng(seed)
    pieces = [" ", "  ", "\n", "a", "B", "'s", "é", "　", "\t", ".", "1", "word", "\0", "日", " ", "<|endoftext|>", "́"]
    return ODD + ["".join(rng.choice(pieces, rng.integers(1, 25))) for _ in range(n)]


def test_encoder_equals_library(monkeypatch):
    monkeypatch.setattr(tokenfile, "JOINED_BYTES", 50)
    monkeypatch.setattr(tokenfile, "LONG_CHARS", 70)
    monkeypatch.setattr(tokenfile, "TAKEN_IDS", 900)
    monkeypatch.setattr(tokenfile, "KNOWN_CHUNKS", 600)
    with open(FILE, "rb") as f:
        encoder = tokenfile.Encoder(f.read(), True)
    t, texts = library(), odd_texts() + ["long words and\nlines, " * 400, "longer " + "x y" * 700]
    for part in (texts[:100], texts, texts[::-1], texts[::3]):
        ids, n = (np.concatenate(x) for x in zip(*encoder.encode(pa.array(part)), strict=True))
        want = [t.encode(x or "", add_special_tokens=False).ids for x in part]
        assert n.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]


def test_files(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "SEGMENT_IDS", 500)
    monkeypatch.setattr(tokenfile, "SEGMENT_DOCUMENTS", 40)
    monkeypatch.setattr(tokenfile, "BLOCK", 16)
    texts = odd_texts() + ["word and word " * 300] * 3
    rows = [(len(texts) - i if i % 50 else None, t) for i, t in enumerate(texts)] + [(5, "twice"), (5, "twice"), (-3, "first")]
    df = spark.createDataFrame([(i, t, 1, "n") for i, t in rows], "doc_id long, text string, row int, part string")
    with open(FILE, "rb") as f:
        data = f.read()
    folder = shared_dir(spark, "token-test")
    tokenfile.write(df, data, folder)
    got = tokenfile.read(spark, folder).toPandas().sort_values("start").reset_index(drop=True)
    t = library()
    ids = {x: t.encode(x, add_special_tokens=False).ids + [0] for x in {x or "" for _, x in rows}}
    want = sorted((i is None, i or 0, len(ids[x or ""]), ids[x or ""]) for i, x in rows)
    found = [(np.isnan(i), 0 if np.isnan(i) else int(i), n, np.frombuffer(b, "<u4").tolist()) for i, n, b in zip(got.doc_id, got.n_tokens, got.ids, strict=True)]
    assert sorted(found) == want
    assert [f[:3] for f in found] == [w[:3] for w in want]
    assert got.start.tolist() == np.concatenate([[0], np.cumsum(got.n_tokens)[:-1]]).tolist()
    stream = [x for f in found for x in f[3]]
    for a, b in ((0, 1), (100, 1200), (len(stream) - 5, len(stream) + 9), (7, 7)):
        part = tokenfile.window(spark, folder, a, b).orderBy("at").collect()
        assert [(r["at"], r["id"]) for r in part] == list(enumerate(stream))[a:b]


def test_digests_of_tables(spark):
    with open(FILE, "rb") as f:
        data = f.read()
    df = spark.createDataFrame([(2, "b c"), (1, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokenfile.digests(df, data).collect()}
    ids = library().encode("b c", add_special_tokens=False).ids + [0]
    assert got == {1: (0, 1, zlib.crc32(bytes(4))), 2: (1, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))}
    assert tokenfile.digests(df.limit(0), data).count() == 0


def test_whole_table_equals_library(spark):
    from conftest import SMALL

    from residua.llm import plans

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()
    t, start, want = library(), 0, {}
    for d in docs:
        ids = t.encode(d["text"] or "", add_special_tokens=False).ids + [0]
        want[d["doc_id"]] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in plans.token_files(spark, SMALL).collect()}
    assert got == want
