"""Cover trees and hard negatives."""

import math

import numpy as np
import pytest

from residua.llm import covertree, negatives


def test_tree_covers_and_separates():
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.integers(-300, 300, (400, 3)), np.tile([[5, 5, 5]], (150, 1))])
    tree = covertree.build(np.arange(550), np.zeros(550, int), v, leaf=4)
    x = covertree.augmented(tree["vectors"])
    assert np.allclose((x**2).sum(axis=1), (x**2).sum(axis=1)[0])
    ends = []
    for (start, end, first, n), centre, radius in zip(tree["nodes"], tree["centres"], tree["radii"], strict=True):
        gap = np.sqrt(((tree["vectors"][start:end] - centre) ** 2).sum(axis=1))
        assert (gap <= radius + 1e-6).all()
        if n:
            kids = tree["nodes"][first : first + n]
            assert kids[0][0] == start and kids[-1][1] == end and (kids[1:, 0] == kids[:-1, 1]).all()
            assert (tree["radii"][first : first + n][kids[:, 2] >= 0] <= radius / covertree.BASE + 1e-6).all()
        else:
            ends.append((start, end))
    ends.sort()
    assert ends[0][0] == 0 and ends[-1][1] == 550 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
    assert sorted(tree["ids"].tolist()) == list(range(550))


def test_net_separates():
    x = covertree.augmented(np.random.default_rng(1).integers(-50, 50, (900, 2)))
    child = covertree._net(x, 30.0)
    heads = [int(np.flatnonzero(child == c)[0]) for c in range(child.max() + 1)]
    gaps = np.sqrt(((x[heads][:, None] - x[heads][None]) ** 2).sum(axis=2))
    assert (gaps + np.eye(len(heads)) * 1e9 > 30.0 - 1e-6).all()
    assert (np.sqrt(((x - x[heads][child]) ** 2).sum(axis=1)) <= 30.0 + 1e-6).all()


def test_search_skips_nodes():
    """Clustered points: most nodes of a narrow window are never verified."""
    rng = np.random.default_rng(2)
    v = (rng.normal(size=(40, 1, 4)) * 2000 + rng.normal(size=(40, 100, 4)) * 20).reshape(-1, 4).astype(np.int64)
    tree = covertree.build(np.arange(4000), rng.integers(0, 2, 4000), v)
    seen = []

    class Counted(covertree.Windows):
        def _verify(self, tree, start, end, of):
            seen.append(end - start)
            super()._verify(tree, start, end, of)

    block = {"ids": np.array([-1]), "vectors": v[:1], "labels": np.array([0]), "of": np.array([0]), "low": np.array([covertree.LOWEST]), "high": np.array([covertree.HIGHEST])}
    windows = Counted(block, 5, False)
    windows.search(tree)
    scores = tree["vectors"] @ v[0]
    want = sorted((-s, i) for s, i, lab in zip(scores, tree["ids"], tree["labels"], strict=True) if lab != 0)[:5]
    assert [(-s, i) for i, s in zip(*windows.best[1:], strict=True)] == want
    assert sum(seen) < 1200


def brute(rows, every, k, m, low, high, factor):
    fine = [(i, lab, tuple(math.floor(factor * x) for x in v)) for i, lab, v in rows if None not in (i, lab, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a in sorted({i for i, _, _ in fine if i % every == 0}):
        lab, _, v = min((lab, len(v), v) for i, lab, v in fine if i == a)
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, other == lab) for i, other, w in fine if i != a and len(w) == len(v)]
        best = sorted((s, i) for s, i, same in scored if same)[:k]
        for s, p in sorted(set(best)):
            fit = sorted((t, i) for t, i, same in scored if not same and low * -s <= 100 * -t <= high * -s)[:m]
            out += [(a, p, r + 1, i, -s, -t) for r, (t, i) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows,leaf", [(8192, 64), (40, 4)])
def test_mined(spark, shard_rows, leaf, monkeypatch):
    monkeypatch.setattr(negatives, "PACK", 5)
    monkeypatch.setattr(negatives, "CHUNK", 2)
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 4)) if i % 3 else 1, [float(x) for x in rng.normal(size=3) + 0.3 * (i % 2)]) for i in range(360)]
    rows += [(400 + i, i % 2, [0.25, 0.5, 0.5]) for i in range(60)]  # one hot vector, ties by id
    rows += [(1000, None, [1.0] * 3), (None, 1, [1.0] * 3), (1010, 1, None), (1020, 1, [1.0, None, 0.0]), (1030, 1, [math.nan] * 3), (1040, 1, [math.inf] * 3), (1050, 99, [1.0] * 3)]
    rows += [(20, 1, [0.5, 0.5, 0.25]), (20, 1, [0.5, 0.5, 0.25]), (33, 2, [0.5] * 3), (1060, 0, [1.0, 2.0]), (1070, 0, [2.0, 2.0]), (1071, 1, [1.5, 1.5]), (1080, 5, [])]
    df = spark.createDataFrame([(i, v, lab, "s", "b") for i, lab, v in rows], "vec_id long, embedding array<double>, label int, shard string, block string")
    got = negatives.mined(df, every=10, positives=4, negatives=2, shard_rows=shard_rows, leaf=leaf).collect()
    found = sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got)
    assert found == brute(rows, 10, 4, 2, 50, 95, 256)
    assert found


def test_mined_empty(spark):
    assert negatives.mined(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    one = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert negatives.mined(one).count() == 0
