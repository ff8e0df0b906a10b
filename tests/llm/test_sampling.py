"""Resampling towards a target."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Regex, pre_tokenizers

from residua.llm import places, resample

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def runs_of(text, longest):
    words = WORDS.findall(lowered(text))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, longest, buckets, percent, min_words):
    def bucket(x):
        return zlib.crc32(x.encode()) % buckets

    s = Counter(bucket(x) for _, t in docs for x in runs_of(t, longest)[1])
    t = Counter(bucket(x) for y in target for x in runs_of(y, longest)[1])
    sa, ta = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sa + buckets) / ((s[b] + 1) * (ta + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        n, found = runs_of(text, longest)
        weight = sum(gain[bucket(x)] for x in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[4]))
    drawn = [(*r, k + 1) for k, r in enumerate(able[: len(able) * percent // 100])]
    rest = Counter(tuple(r) for r in rows) - Counter(r[:5] for r in drawn)
    return Counter(drawn) + Counter({(*r, None): n for r, n in rest.items()})


TEXTS = ["", None, "  ", "Ab aB ab\tAB", "naïve Élan ΣΑΣ 日本語 x2\x7f\x00y", "a" * 50_000, "word " * 3000, "İ I ı", "one,two;three\nfour five", "7 8 9 10", "..."]


@pytest.mark.parametrize("longest,buckets", [(1, 10_000), (3, 97)])
def test_resampled(spark, longest, buckets):
    rng = np.random.default_rng(3)
    texts = TEXTS + [" ".join(f"w{x}" for x in rng.zipf(1.5, rng.integers(1, 60)) % 500) for _ in range(150)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(20, texts[20]), (20, texts[21]), (None, texts[30]), (None, texts[30]), (None, None)]
    target = ["w1 w2 w3 naïve", None, "W7 w7"]
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in docs], "doc_id long, text string, row int, weight string")
    got = resample.resampled(df, spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, buckets=buckets, percent=40, min_words=4)
    found = Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["n_words"], r["rank"]) for r in got.collect())
    assert found == brute(docs, target, longest, buckets, 40, 4)


def test_resampled_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample.resampled(none, none).count() == 0
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert [r["rank"] for r in resample.resampled(one, none, percent=100, min_words=1).collect()] == [1]


def test_split_by_offsets_equals_words():
    split = pre_tokenizers.Split(Regex(resample.BETWEEN), "removed")
    texts = [t for t in TEXTS] + ["x" * 9_999 + " " + "y,z " * 5000]
    n, runs, found = resample.text_buckets(pa.array(texts), 1, 1000, split)
    want = [[zlib.crc32(w.encode()) % 1000 for w in WORDS.findall(lowered(t))] for t in texts]
    assert n.tolist() == runs.tolist() == [len(w) for w in want]
    assert found.tolist() == [b for w in want for b in w]


def test_places(spark):
    df = spark.range(5000).selectExpr("id", "id % 3 as k")
    got = places.placed(df, [df["k"], df["id"]], "places", 5000, rows_per_part=300).orderBy("_place").collect()
    assert [r["_place"] for r in got] == list(range(5000))
    assert [(r["k"], r["id"]) for r in got] == sorted((i % 3, i) for i in range(5000))


def test_slices_of_a_batch():
    """Texts of every slice are whole, whatever its place in the batch."""
    split = pre_tokenizers.Split(Regex(resample.BETWEEN), "removed")
    texts = [f"Été {i} über " * (i % 7) if i % 5 else None for i in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(texts)], ["doc_id", "text"])
    ids, found = [], []
    for part in places.slices(iter([batch]), 1, 500):
        ids += part.column(0).to_pylist()
        n, _, buckets = resample.text_buckets(part.column(1), 1, 1000, split)
        found += np.split(buckets, np.cumsum(n)[:-1])
    assert ids == list(range(300))
    assert [f.tolist() for f in found] == [[zlib.crc32(w.encode()) % 1000 for w in WORDS.findall(lowered(t))] for t in texts]
