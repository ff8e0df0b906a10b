"""Piece coding, exact and near dedup, lines, words and bytes against brute force, on awkward rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from residua.llm import exact, lines, near, pieces, recompress, shingles, suffixes

MODEL = pieces.model_bytes(public_tokenizers.path("piece_bpe_32k.model"))
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, row string, name string, doc long, block long"


def frame(spark, rows):
    """Rows (id, text) with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", None, 7, None) for i, t in rows], SCHEMA).repartition(3)


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "délta", "ε", "x", "y2", "z\u00a0z"] + [f"w{i}" for i in range(60)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(10, 70))) for _ in range(4)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            kind = rng.random()
            parts.append(rng.choice(passages) if kind < 0.4 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 40))))
        texts.append(rng.choice(["\n", " ", " \n\t"]).join(parts))
    texts += [texts[5], texts[5] + " ", texts[6].replace(" ", "\n"), "", None, " \t", "x " * 3000, "x " * 3001, "a" * 30000]
    base = [rng.choice(words) for _ in range(200)]
    for k in range(6):
        near_copy = list(base)
        near_copy[k * 20] = f"new{k}"
        texts.append(" ".join(near_copy))
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def test_pieces_equal_the_library(docs, rows):
    sp = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    got = {r["doc_id"]: r for r in pieces.token_digests(docs, MODEL).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        ids = sp.encode(text or "")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), sha(",".join(map(str, ids))))
        assert got[i]["decoded_sha256"] == sha(sp.decode(ids))


def test_pieces_random_strings_and_roundtrip(spark):
    sp, coder = sentencepiece.SentencePieceProcessor(model_proto=MODEL), pieces.PieceCoder(MODEL)
    rng = random.Random(1)
    names = list(coder.ids)
    for k in range(4000):
        if k % 2:
            text = "".join(rng.choice(names).replace(pieces.MARK, " ") for _ in range(rng.randint(1, 8)))
        else:
            text = "".join(rng.choice("abeilnorst  \n\t▁éß日🙂\x00ﬁ") for _ in range(rng.randint(1, 30)))
        assert coder.encode(text) == sp.encode(text), text
    texts = [(1, "a  b\n日本🙂"), (2, None), (3, "")]
    df = frame(spark, texts)
    back = pieces.decoded(pieces.encoded(df, MODEL), MODEL)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {1: "a  b\n日本🙂", 2: "", 3: ""}


def test_exact_dedup(docs, rows):
    norm = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t in rows}
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm[i]].append((-len(t or ""), i))
    for block in (7, 4096):
        got = {r["doc_id"]: r for r in exact.exact_duplicates(docs, block=block).collect()}
        assert len(got) == len(rows)
        for i, _ in rows:
            keep = min(groups[norm[i]])[1]
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (keep, len(groups[norm[i]]), keep == i, sha(norm[i]))


def test_exact_dedup_repeated_and_null_ids(spark):
    got = exact.exact_duplicates(frame(spark, [(1, "a b"), (1, "a b"), (None, "ab"), (None, None)])).collect()
    assert len(got) == 4
    assert sum(r["kept"] for r in got) == 2
    assert [r["keep_id"] for r in got if r["group_size"] == 3] == [1, 1, 1]


def link_components(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: root(i) for i in ids}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("small,block", [(256, 512), (3, 2)])
def test_near_dedup(docs, rows, small, block, monkeypatch):
    monkeypatch.setattr(near, "SMALL", small)
    monkeypatch.setattr(near, "BLOCK", block)
    component, size = link_components(rows, 4, 80)
    got = {r["doc_id"]: r for r in near.near_duplicates(docs).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == component
    assert {i: r["n_shingles"] for i, r in got.items()} == size
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())


def test_near_dedup_null_and_repeated_ids(spark):
    text = "one two three four five six"
    got = near.near_duplicates(frame(spark, [(4, text), (4, text), (2, text), (None, text), (9, "")])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, True), (2, 2, True), (4, 2, False), (4, 2, False), (9, 9, True)]


def line_truth(rows, least=20, docs=3):
    key = lambda line: line.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    out = {}
    for i, t in rows:
        found = (t or "").split("\n")
        kept = [x for x in found if not (len(key(x)) >= least and len(holders[key(x)]) >= docs and max(holders[key(x)]) != i)]
        out[i] = (len(found), len(found) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("bound,keys", [(64 << 20, 50_000), (1, 2)])
def test_line_dedup(docs, rows, bound, keys):
    """One block of arrays, and as many blocks as shards."""
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept"]) for r in lines.drop_repeated_lines(docs, bound=bound, keys_per_shard=keys).collect()}
    truth = line_truth(rows)
    assert got == truth
    assert sum(x[1] for x in truth.values()) > 5


def test_line_dedup_null_ids(spark):
    line = "a line that is long enough to count"
    got = lines.drop_repeated_lines(frame(spark, [(None, line), (1, line), (3, line), (3, line), (None, None)])).collect()
    assert sorted((r["doc_id"] or 0, r["n_dropped"]) for r in got) == [(0, 0), (0, 1), (1, 1), (3, 0), (3, 0)]


def test_perfect_hash_is_minimal():
    import numpy as np

    keys = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, (5000, 2))
    index = lines.PerfectHash.build(keys)
    assert sorted(index.slots(keys)) == list(range(5000))


def words_truth(rows, size):
    first, out = {}, {}
    for i, t in sorted(rows):
        w = WORD.findall(t or "")
        for p in range(len(w) - size + 1):
            first.setdefault(tuple(w[p : p + size]), (i, p))
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for p in range(len(w) - size + 1):
            if first[tuple(w[p : p + size])] < (i, p):
                gone.update(range(p, p + size))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize("size,hot", [(20, 64), (5, 1)])
def test_substring_dedup(docs, rows, size, hot, monkeypatch):
    monkeypatch.setattr(recompress, "HOT", hot)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in recompress.without_repeated_words(docs, size).collect()}
    assert got == words_truth(rows, size)


def bytes_truth(rows, size):
    seen, out = Counter(), {}
    data = {i: (t or "").encode() for i, t in rows}
    for b in data.values():
        seen.update(b[p : p + size] for p in range(len(b) - size + 1))
    for i, b in data.items():
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if seen[b[p : p + size]] > 1:
                gone[p : p + size] = b"\1" * size
        out[i] = (len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("size,hot,held", [(200, 64, 200_000), (40, 2, 5)])
def test_suffix_dedup(docs, rows, size, hot, held, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "HELD", held)
    monkeypatch.setattr(suffixes, "CHUNK", 3000)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.without_repeated_bytes(docs, size).collect()}
    assert got == bytes_truth(rows, size)


def test_passages_null_ids(spark):
    passage = " ".join(f"word{i}" for i in range(60))
    df = frame(spark, [(5, passage), (None, "head " + passage), (None, None), (5, passage)])
    got = recompress.without_repeated_words(df).collect()
    # every row is a document of its own: of the two rows of id 5 one comes first
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in got) == [(0, 0), (0, 60), (5, 0), (5, 60)]
    got = suffixes.without_repeated_bytes(df).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in got) == [(0, 0), (0, len(passage)), (5, len(passage)), (5, len(passage))]


@pytest.mark.parametrize("shared", [None, 7])
def test_texts_under_one_id_leave_each_other_alone(spark, shared):
    """One text that repeats itself and one without any repeat, under one id or none."""
    looped = " ".join(f"loop{i}" for i in range(45)) * 2
    plain = " ".join(f"größer{i}" for i in range(90))
    df = frame(spark, [(shared, looped), (shared, plain), (3, "short")])
    words = sorted((r["n_words"], r["n_removed"], r["kept"] == plain) for r in recompress.without_repeated_words(df).collect())
    truth = words_truth([(1, looped)], 20)[1]
    assert words == sorted([(truth[0], truth[1], False), (90, 0, True), (1, 0, False)])
    got = {r["n_bytes"]: (r["n_removed"], bytes(r["kept"])) for r in suffixes.without_repeated_bytes(df).collect()}
    assert got[len(plain.encode())] == (0, plain.encode())
    assert got[len(looped.encode())][0] == bytes_truth([(1, looped)], 200)[1][1]


def test_recompression_is_consistent():
    """Windows with equal words are filed under equal keys at equal distance, whatever surrounds them."""
    rng = random.Random(7)
    for _ in range(60):
        alphabet = [f"v{k}" for k in range(rng.choice([2, 5, 40]))]
        texts = [" ".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120))).encode() for _ in range(8)]
        words, counts = shingles.word_hashes(texts)
        starts, found, cut, beside = recompress._filed(words, counts, 8)
        filed = defaultdict(set)
        for p, f in zip(starts, found, strict=True):
            filed[tuple(words[p : p + 8])].add((int(cut[f]) - p, int(beside[f])) if f >= 0 else None)
        assert all(len(v) == 1 for v in filed.values())


@pytest.mark.parametrize(
    "run",
    [
        lambda d: pieces.token_digests(d, MODEL),
        exact.exact_duplicates,
        near.near_duplicates,
        lines.drop_repeated_lines,
        recompress.without_repeated_words,
        suffixes.without_repeated_bytes,
    ],
)
def test_empty_table(spark, run):
    assert run(frame(spark, []).filter(F.lit(True))).count() == 0


def test_groups_across_batches():
    table = pa.table({"a": [1, 1, 2, 2, 2, 3], "b": [0, 0, 0, 1, 1, 1], "v": list(range(6))})
    got = [g["v"].to_pylist() for g in near.groups(iter(table.to_batches(max_chunksize=2)), 2)]
    assert got == [[0, 1], [2], [3, 4], [5]]
