"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


EDGES_PER_TASK = 200_000


def local_labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges and the smallest node it reaches over them."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        if (label[a] == least).all() and (label[b] == least).all():
            return nodes, nodes[label]
        for end in (a, b):
            np.minimum.at(label, label[end], least)
            np.minimum.at(label, end, least)
        while (label[label] != label).any():
            label = label[label]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if len(b)]
    if held:
        node, least = local_labels(*(np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1)))
        hung = node != least
        yield pa.RecordBatch.from_arrays([pa.array(node[hung]), pa.array(least[hung])], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, its smallest reachable node, for every node of ``edges`` (``u``, ``v``).

    Tasks of at most ``EDGES_PER_TASK`` edges first contract what they hold to stars; one task is enough for few
    edges. Otherwise each round hangs the larger neighbours of a node under its smallest one, then the smaller ones,
    until every component is a star. A round only moves edges, never makes more of them, and a minimum per
    node combines map-side, so a hub of any degree is split by the join.
    """
    e = checkpointed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    tasks = -(-_state(e)[0] // EDGES_PER_TASK)
    if tasks:
        e = checkpointed((e.coalesce(1) if tasks == 1 else e.repartition(tasks)).mapInArrow(_stars, "u long, v long"))
    was = _state(e) if tasks <= 1 else None
    while (now := _state(e)) != was:
        was = now
        if not now[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = checkpointed(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u")
        small = moved.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = checkpointed(small.distinct())
    leaves = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)
