"""Ordered scans give the same rows whether a group is cut into blocks or not.

One key holds a third of the rows (and one order value many of them), and the block size is
far below the group size, so every carry between blocks is exercised.
"""

import random

import numpy as np
import pandas as pd
import pytest
from oracle import differences
from pyspark.sql import Window
from pyspark.sql import functions as F

from residua.operators import motif, sets, stats, topk, windows
from residua.operators.ordered import OrderedFrame, with_row_number
from residua.operators.quality import digest_tree, ordered_digest

ROWS = 60


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = []
    for i in range(1500):
        key = "hot" if rng.random() < 0.34 else (None if rng.random() < 0.05 else f"k{rng.randrange(40)}")
        stamp = 500 if rng.random() < 0.1 else rng.randrange(1000)
        rows.append((key, stamp, i, rng.randrange(4), float(rng.randrange(100))))
    df = spark.createDataFrame(rows, "k string, t bigint, id bigint, v int, x double").repartition(6)
    return df.cache()


def same(a, b):
    assert differences(a.toPandas(), b.toPandas()) is None


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_blocks_are_cut_and_bounded(skewed, keys):
    of = OrderedFrame.of(skewed, keys, ["t", "id"], ROWS)
    assert of.blocked
    sizes = of.df.groupBy(*of.parts).count()
    assert sizes.agg(F.max("count")).first()[0] <= 2 * ROWS
    if keys:
        assert of.df.filter("k <> 'hot'").select("_blk").distinct().count() == 1


def test_blocks_of_one_tied_value(spark):
    tied = spark.range(6000, numPartitions=5).select(F.lit("a").alias("k"), F.lit(7).alias("t"), "id")
    of = OrderedFrame.of(tied, ["k"], ["t", "id"], 500)
    assert of.df.groupBy(*of.parts).count().agg(F.max("count")).first()[0] <= 1000
    same(of.row_number("n").done(), tied.withColumn("n", F.col("id") + 1))
    assert {r["c"] for r in of.cume_dist("c").done().select("c").distinct().collect()} == {1.0}


def test_blocks_of_disjoint_groups(spark):
    """Every group has edges of its own: groups that lie apart on the order column are cut alike."""
    df = spark.range(40 * 300, numPartitions=5).select((F.col("id") % 40).alias("g"), "id")
    df = df.select("g", (F.col("g") * 10**6 + F.col("id") * F.col("id") % 1009).alias("t"), "id")
    of = OrderedFrame.of(df, ["g"], ["t", "id"], 100)
    assert of.blocked
    assert of.df.groupBy(*of.parts).count().agg(F.max("count")).first()[0] <= 200
    same(of.row_number("n").done(), df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("t", "id"))))


def test_cume_dist_with_values_over_many_blocks(spark):
    df = spark.range(2000, numPartitions=4).select(F.when(F.col("id") % 9 > 0, F.col("id") % 3).alias("t"), "id")
    got = OrderedFrame.of(df, [], ["t", "id"], 100).cume_dist("c").done()
    same(got, df.withColumn("c", F.cume_dist().over(Window.partitionBy().orderBy("t"))))


def test_order_by_text(spark):
    df = spark.range(500, numPartitions=3).select(F.sha1(F.col("id").cast("string")).alias("t"), "id")
    got = with_row_number(df, [], ["t", "id"], rows=50)
    same(got, df.withColumn("rn", F.row_number().over(Window.partitionBy().orderBy("t"))))


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running(skewed, keys, inclusive):
    aggs = {"s": ("sum", "x"), "n": ("count", F.lit(1)), "hi": ("max", "x"), "lo": ("min", "x")}
    got = OrderedFrame.of(skewed, keys, ["t", "id"], ROWS).running(aggs, inclusive).done()
    w = Window.partitionBy(*keys).orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    want = skewed.withColumns({"s": F.sum("x").over(w), "n": F.count(F.lit(1)).over(w), "hi": F.max("x").over(w), "lo": F.min("x").over(w)})
    fill = {"n": 0}
    same(got.na.fill(fill), want.na.fill(fill))


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("step", [-1, 1])
def test_neighbour(skewed, keys, step):
    got = OrderedFrame.of(skewed, keys, ["t", "id"], ROWS).neighbour({"o": "v", "oi": "id"}, step).done()
    w = Window.partitionBy(*keys).orderBy("t", "id")
    fn = F.lag if step < 0 else F.lead
    same(got, skewed.withColumns({"o": fn("v").over(w), "oi": fn("id").over(w)}))


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_cume_dist(skewed, keys):
    got = OrderedFrame.of(skewed, keys, ["t"], ROWS).cume_dist("c").done()
    same(got, skewed.withColumn("c", F.cume_dist().over(Window.partitionBy(*keys).orderBy("t"))))


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_bounded_frame(skewed, keys):
    got = OrderedFrame.of(skewed, keys, ["t", "id"], 20).bounded_frame(7, 3, {"s": lambda w: F.sum("x").over(w)})
    w = Window.partitionBy(*keys).orderBy("t", "id").rowsBetween(-7, 3)
    same(got, skewed.withColumn("s", F.sum("x").over(w)))


BIG = 10**9
OPERATORS = {
    "rle": lambda d, r: windows.rle(d, ["k"], ["t", "id"], "v", r),
    "rle_all": lambda d, r: windows.rle(d, [], ["t", "id"], "v", r),
    "average": lambda d, r: windows.moving_average(d, ["k"], ["t", "id"], "x", 5, "repeat", rows=r),
    "average_all_zero": lambda d, r: windows.moving_average(d, [], ["t", "id"], "x", 4, "zero", rows=r),
    "intervals": lambda d, r: windows.merge_intervals(d.withColumn("e", F.col("t") + F.col("v")), ["k"], "t", "e", "id", score="x", rows=r),
    "monotonic": lambda d, r: windows.check_monotonic(d, ["k"], ["t", "id"], "x", "v", rows=r),
    "progress": lambda d, r: windows.progress_rate(d, ["k"], "t", "id", "v", 10, rows=r),
    "stalls": lambda d, r: windows.stall_flags(d, ["k"], ["t", "id"], "x", slack=5.0, no_baseline=50.0, rows=r),
    "share": lambda d, r: windows.share_running(d, "x", "id", rows=r),
    "ranges": lambda d, r: sets.compact_ranges(d, "t", ["k"], r),
    "ranges_all": lambda d, r: sets.compact_ranges(d, "t", [], r),
    "rank": lambda d, r: stats.rank_curve(d, "x", "id", r),
    "ecdf": lambda d, r: stats.ecdf(d, "t", rows=r),
    "lorenz": lambda d, r: stats.lorenz(d, "x", "id", 25, r),
    "transitions": lambda d, r: stats.transition_ratio(d, ["k"], ["t", "id"], F.col("v") > 1, r),
    "stride": lambda d, r: topk.sample_keys(d, ["t", "id"], 37, "stride", rows=r),
    "digest": lambda d, r: digest_tree(d.na.fill("none", ["k"]), ["k"], ["t", "id"], F.col("id").cast("string"), rows=r),
    "suppress": lambda d, r: motif.suppress_overlaps(d.na.fill("none", ["k"]).withColumn("e", F.col("t") + F.col("v")), "k", "t", "e", "x", "id", 2.0, rows=r),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operator_with_and_without_blocks(skewed, name):
    same(OPERATORS[name](skewed, ROWS), OPERATORS[name](skewed, BIG))


def test_order_timestamps_and_nulls(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i % 7) for i in range(200)], "id bigint, t bigint")
    got = with_row_number(df, [], ["t", "id"], rows=20).orderBy("rn").select("id").toPandas()["id"].tolist()
    want = df.orderBy(F.col("t").asc_nulls_first(), "id").toPandas()["id"].tolist()
    assert got == want


def greedy(rows, gap):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[3], r[4])):
        if all(abs(r[1] - k[1]) >= gap and max(r[1], k[1]) >= min(r[2], k[2]) for k in kept if k[0] == r[0]):
            kept.append(r)
    return {r[4] for r in kept}


@pytest.mark.parametrize("max_island", [10**9, 40, 5])
def test_suppression_equals_quadratic_greedy(spark, max_island):
    rng = random.Random(123)
    rows = []
    for i in range(400):
        s = rng.uniform(0, 600)
        rows.append(("a" if rng.random() < 0.7 else "b", s, s + rng.uniform(0, 9), round(rng.random(), 2), i))
    df = spark.createDataFrame(rows, "f string, s double, e double, score double, id int")
    got = motif.suppress_overlaps(df, "f", "s", "e", "score", "id", 2.0, max_island).toPandas()
    assert set(got["id"]) == greedy(rows, 2.0)
    assert len(got) == len(set(got["id"]))


def test_digests_follow_their_own_group(spark):
    import hashlib

    sha = lambda parts: hashlib.sha256(("[" + ",".join(parts) + "]").encode()).hexdigest()

    def tree(level, fanout):
        while True:
            level = [sha(level[i : i + fanout]) for i in range(0, len(level), fanout)]
            if len(level) == 1:
                return level[0]

    sizes = {"a": 3, "b": 8, "c": 9, "d": 65, "e": 6000}
    df = spark.createDataFrame([(k, i) for k, n in sizes.items() for i in range(n)] + [(None, 1)], "k string, id int").repartition(5)
    text = F.col("id").cast("string")
    want = {k: [str(i) for i in range(n)] for k, n in sizes.items()} | {None: ["1"]}
    got = {r["k"]: r["digest"] for r in digest_tree(df, ["k"], ["id"], text, fanout=8).collect()}
    assert got == {k: tree(v, 8) for k, v in want.items()}
    plain = {r["k"]: r["digest"] for r in ordered_digest(df, ["k"], ["id"], text).collect()}
    assert plain == {k: sha(v) for k, v in want.items()}


def test_suppression_with_zero_length_hits(spark):
    rows = [("a", 1.0, 1.0, 0.9, 0), ("a", 1.0, 1.0, 0.8, 1), ("a", 2.0, 3.0, 0.7, 2), ("a", 2.5, 2.5, 0.6, 3)]
    rows += [("b", float(i), i + 1.5, i / 100, 10 + i) for i in range(8)]  # scores rise
    df = spark.createDataFrame(rows, "f string, s double, e double, score double, id int")
    for island in (10**9, 5):
        got = motif.suppress_overlaps(df, "f", "s", "e", "score", "id", 0.0, island).toPandas()
        assert set(got["id"]) == greedy(rows, 0.0)


def rounds_of(monkeypatch, df, *args):
    calls, once = [], motif._round
    monkeypatch.setattr(motif, "_round", lambda *a: calls.append(1) or once(*a))
    got = motif.suppress_overlaps(df, "f", "s", "e", "score", "id", *args).toPandas()
    assert len(got) == len(set(got["id"]))
    return set(got["id"]), len(calls)


def test_suppression_rounds_count_borders(spark, monkeypatch):
    """Rising scores are one chain of dependent hits; rounds follow the number of blocks."""
    rows = [("a", float(i), i + 1.5, float(i), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "f string, s double, e double, score double, id int").repartition(4)
    kept, rounds = rounds_of(monkeypatch, df, 0.0, 1200)
    assert kept == set(range(2999, -1, -2)) and 0 < rounds <= 4


@pytest.mark.parametrize("seed", range(2))
def test_suppression_of_piles_and_long_hits(spark, monkeypatch, seed):
    """Tied starts and scores, hits without length, and hits that reach over many blocks."""
    rng = random.Random(seed)
    rows = []
    for i in range(300):
        s = float(rng.choice([100, 200, rng.randrange(300)]))
        rows.append(("a", s, s + rng.choice([0, 0, 1, 2, 250 if rng.random() < 0.05 else 3]), rng.randrange(20) / 20, i))
    df = spark.createDataFrame(rows, "f string, s double, e double, score double, id int").repartition(4)
    gap = [0.0, 2.5][seed]
    kept, rounds = rounds_of(monkeypatch, df, gap, 60)
    assert kept == greedy(rows, gap) and rounds


def test_quantiles_with_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 300, 2000)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    spark.conf.set("spark.residua.rowsPerBlock", "50")
    try:
        got = stats.quantile_profile(df, "x").first()
    finally:
        spark.conf.unset("spark.residua.rowsPerBlock")
    for name, p in stats.PROFILE:
        assert abs(got[name] - np.quantile(x, p)) < 1e-9
