"""Exact top-k inner products: a ball tree per shard, branch and bound, blocks of queries.

Rows are hashed into shards of bounded size; one task builds a shard's ball tree once and stores it as
arrays in a row. Queries form blocks. A block first searches one shard; the k-th score it finds is a
lower bound of each query's final one and travels with the block to all other shards, where nodes are
taken in order of their upper bound (query times centre plus query length times radius) and dropped
once no query of the block can gain. The few best rows of each shard are merged by query.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

SHARD_ROWS = 16_384
BLOCK_QUERIES = 1_024
LEAF = 256
LOWEST = np.iinfo(np.int64).min


def usable(vector: Column) -> Column:
    """Not null, and all components finite numbers."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def scaled(vector: Column, factor: int = 64) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * factor).cast("bigint"))


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as found:
        return dict(found)


def build_tree(ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> bytes:
    """Split at the median along the direction between two far points until leaves are small."""
    v = vectors.astype(np.float64)
    order, nodes = np.arange(len(ids)), []  # start, end, left, right
    centres, radii = [], []
    todo = [(0, len(ids), -1, 0)]
    while todo:
        start, end, parent, side = todo.pop()
        part = v[order[start:end]]
        centre = part.mean(axis=0)
        gaps = np.sqrt(((part - centre) ** 2).sum(axis=1))
        me = len(nodes)
        nodes.append([start, end, -1, -1])
        centres.append(centre)
        radii.append(gaps.max())
        if parent >= 0:
            nodes[parent][2 + side] = me
        if end - start > leaf and gaps.max() > 0:
            far = part[gaps.argmax()]
            other = part[((part - far) ** 2).sum(axis=1).argmax()]
            along = part @ (other - far)
            middle = (end - start) // 2
            order[start:end] = order[start:end][np.argpartition(along, middle)]
            todo += [(start, start + middle, me, 0), (start + middle, end, me, 1)]
    return _packed(ids=ids[order], vectors=vectors[order], nodes=np.array(nodes), centres=np.array(centres), radii=np.array(radii))


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles while every sum stays below 2**53, else in Python integers, clipped to a long."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, q.shape[1])
    if bound < 2**53:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    exact = q.astype(object) @ v.astype(object).T
    return np.clip(exact, LOWEST, 2**63 - 1).astype(np.int64)


def search_tree(tree: dict[str, np.ndarray], query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (query position, row id, score) of one shard, those below ``floor`` left out."""
    q = queries.astype(np.float64)
    lengths = np.sqrt((q**2).sum(axis=1))
    nodes, centres, radii = tree["nodes"], tree["centres"], tree["radii"]
    kth = floor.copy()
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def bounds(node: int, of: np.ndarray) -> np.ndarray:
        b = q[of] @ centres[node] + lengths[of] * radii[node]
        return b + 1e-6 * (1 + np.abs(b) + lengths[of] * (np.abs(centres[node]).max(initial=0) + radii[node]))

    everyone = np.arange(len(q))
    top = bounds(0, everyone)
    heap = [(-top.max(initial=-np.inf), 0, everyone, top)]
    while heap:
        _, node, of, upper = heapq.heappop(heap)
        of = of[upper >= kth[of]]  # a tie may still win by its id
        if not len(of):
            continue
        start, end, left, right = nodes[node]
        if left >= 0:
            for child in (left, right):
                b = bounds(child, of)
                heapq.heappush(heap, (-b.max(), int(child), of, b))
            continue
        ids = tree["ids"][start:end]
        scores = _products(queries[of], tree["vectors"][start:end])
        row, col = np.nonzero((scores >= kth[of][:, None]) & (query_ids[of][:, None] != ids[None, :]))
        if not len(row):
            continue
        pos, who, score = (np.concatenate(x) for x in zip(best, (of[row], ids[col], scores[row, col]), strict=True))
        order = np.lexsort((who, -score, pos))
        pos, who, score = pos[order], who[order], score[order]
        first = np.searchsorted(pos, pos, side="left")
        rank = np.arange(len(pos)) - first
        full = rank == k - 1
        kth[pos[full]] = np.maximum(kth[pos[full]], score[full])
        keep = rank < k
        best = pos[keep], who[keep], score[keep]
    return best


def _grow(leaf: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        vectors = np.array(group["v"].tolist(), dtype=np.int64).reshape(len(group), -1)
        tree = build_tree(group["vec_id"].to_numpy(np.int64), vectors, leaf)
        return pd.DataFrame({"dim": [group["dim"].iloc[0]], "shard": [group["shard"].iloc[0]], "tree": [tree]})

    return run


def _search(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                block = _unpacked(r.queries)
                ids, vectors = block["ids"], block["vectors"]
                floor = block["floor"].copy()
                pos, who, score = search_tree(_unpacked(r.tree), ids, vectors, floor, k)
                n = np.bincount(pos, minlength=len(ids))
                last = np.cumsum(n) - 1
                floor[n >= k] = np.maximum(floor[n >= k], score[last[n >= k]])
                again = _packed(ids=ids, vectors=vectors, floor=floor) if r.first else b""
                found = _packed(query=ids[pos], vec=who, score=score)
                yield pd.DataFrame({"dim": [r.dim], "block": [r.block], "shard": [r.shard], "queries": [again], "found": [found]})

    return run


def _pack_queries(group: pd.DataFrame) -> pd.DataFrame:
    vectors = np.array(group["v"].tolist(), dtype=np.int64).reshape(len(group), -1)
    data = _packed(ids=group["vec_id"].to_numpy(np.int64), vectors=vectors, floor=np.full(len(group), LOWEST))
    return pd.DataFrame({"dim": [group["dim"].iloc[0]], "block": [group["block"].iloc[0]], "queries": [data]})


def _rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for data in batch["found"]:
            found = _unpacked(data)
            yield pd.DataFrame({"query_id": found["query"], "vec_id": found["vec"], "score": found["score"]})


def top_k(rows: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES, leaf: int = LEAF) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the ``k`` highest inner products of each query.

    Components become floor(64 x). Queries are rows whose id is divisible by ``every``; ties go to the smaller
    id. Rows with a null id, a null vector, or a component that is null or not finite take no part. Only vectors of the
    same length meet. A row is no candidate for a query of its own id; of repeated query ids the smallest vector asks.
    """
    v = F.col(vector)
    # the test of the vector comes before the scaling, in one expression, so that no bad component is scaled
    points = rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.when(usable(v), scaled(v)).alias("v")).filter("vec_id is not null and v is not null")
    points = points.withColumn("dim", F.size("v"))
    counts = checkpointed(points.groupBy("dim").agg(F.count("*").alias("n"), F.sum((F.col("vec_id") % every == 0).cast("int")).alias("asked")))
    plan = F.broadcast(counts.select("dim", F.ceil(F.col("n") / shard_rows).alias("shards"), F.greatest(F.ceil(F.col("asked") / block_queries), F.lit(1)).alias("blocks"))) if counts.count() < 10_000 else counts
    points = points.join(plan, "dim")
    sharded = points.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(1)), "shards").cast("int"))
    trees = checkpointed(sharded.groupBy("dim", "shard").applyInPandas(_grow(leaf), "dim int, shard int, tree binary"))
    asking = points.filter(F.col("vec_id") % every == 0).groupBy("vec_id", "dim", "shards", "blocks").agg(F.min("v").alias("v"))
    asking = asking.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(2)), "blocks").cast("int"))
    blocks = asking.groupBy("dim", "block").applyInPandas(_pack_queries, "dim int, block int, queries binary").join(plan.select("dim", "shards"), "dim")

    schema = "dim int, block int, shard int, queries binary, found binary"
    pilot = blocks.withColumn("shard", F.pmod("block", "shards").cast("int")).join(trees, ["dim", "shard"], "left").filter("tree is not null").withColumn("first", F.lit(True))
    begun = checkpointed(pilot.select("dim", "block", "shard", "queries", "tree", "first").mapInPandas(_search(k), schema))
    others = begun.join(plan.select("dim", "shards"), "dim").select("dim", "block", "queries", F.col("shard").alias("done"), F.explode(F.sequence(F.lit(0), F.col("shards").cast("int") - 1)).alias("shard"))
    others = others.filter("shard <> done").join(trees, ["dim", "shard"]).withColumn("first", F.lit(False))
    rest = others.select("dim", "block", "shard", "queries", "tree", "first").mapInPandas(_search(k), schema)
    found = begun.select("found").unionByName(rest.select("found")).mapInPandas(_rows_of, "query_id long, vec_id long, score long")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
