"""Hard negatives: rows of another label whose score lies in a window below a positive's.

Rows are dealt to shards by label (small labels share one), then by the nearest of a few rows of a bounded sample, then by hash; a task
grows one shard's cover tree and at once finds its own anchors' positives there, a floor for each. Shards show only centre and
radius; a block of anchors meets them in packs, and trees are fetched for the pairs that survive. With its positives an
anchor has one window each; the same search runs with the windows, first in the shard that promises most to a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_table, small
from .covertree import HIGHEST, LEAF, LOWEST, Windows, build, packed, reach, unpacked
from .search import usable

SHARD_ROWS = 8_192
#: Rows of the sample that deals shards, for each of the most frequent vector lengths; it never decides what is found.
PIVOTS, PIVOT_LENGTHS = 1_024, 16
#: Shards that a block looks at in one go, and blocks that share one look.
PACK, CHUNK = 1_024, 64

FOUND = "block string, anchor_id long, positive_id long, positive_score long, vec_id long, score long"


def scaled(vector: Column, factor: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * factor).cast("bigint"))


def _vectors(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.int64).reshape(len(column), -1)


def _with_cell(points: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``cell``: the nearest of the first ``cells`` rows of the sample of its length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell = np.zeros(len(batch), np.int32)
            for (dim, n), at in batch.groupby(["dim", "cells"]).indices.items():
                if n > 1 and dim in pivots:
                    centres = pivots[dim][:n]
                    x = _vectors(batch["v"].iloc[at]).astype(np.float64)
                    cell[at] = ((centres**2).sum(axis=1)[None, :] - 2 * (x @ centres.T)).argmin(axis=1)
            yield batch.drop(columns="cells").assign(cell=cell)

    return points.mapInPandas(run, "vec_id long, label long, dim int, v array<bigint>, row long, bucket string, cell int")


def dealt(points: DataFrame, shard_rows: int) -> DataFrame:
    """The points with ``bucket`` (a large label, or some small ones) and ``shard``, of about ``shard_rows`` rows at most."""
    labels = points.groupBy("dim", "label").agg(F.count("*").alias("n"))
    rest = labels.groupBy("dim").agg(F.coalesce(F.sum(F.when(F.col("n") <= shard_rows, F.col("n"))), F.lit(0)).alias("rest"))
    shared = F.concat(F.lit("S"), F.pmod(F.xxhash64("label"), F.greatest(F.ceil(F.col("rest") / shard_rows), F.lit(1))).cast("string"))
    labels = labels.join(rest, "dim").select("dim", "label", "n", F.when(F.col("n") > shard_rows, F.concat(F.lit("L"), F.col("label").cast("string"))).otherwise(shared).alias("bucket"))
    cells = F.least(F.lit(PIVOTS), F.ceil(F.sum("n") / shard_rows)).cast("int").alias("cells")
    labels = shared_table(labels.join(labels.groupBy("dim", "bucket").agg(cells), ["dim", "bucket"]), "negatives-labels")
    lengths = [r["dim"] for r in labels.groupBy("dim").agg(F.sum("n").alias("n"), F.max("cells").alias("cells")).filter("cells > 1").orderBy(F.desc("n"), "dim").limit(PIVOT_LENGTHS).collect()]
    nth = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("row"), "row"))
    sample = points.filter(F.col("dim").isin(lengths)).withColumn("nth", nth).filter(F.col("nth") <= PIVOTS).select("dim", "v").collect()
    pivots = {d: np.array([r["v"] for r in sample if r["dim"] == d], np.float64) for d in lengths}
    named = points.join(small(labels.select("dim", "label", "bucket", "cells"), labels.count()), ["dim", "label"])
    placed = shared_table(_with_cell(named.select("vec_id", "label", "dim", "v", "row", "bucket", "cells"), pivots), "negatives-cells")
    groups = placed.groupBy("dim", "bucket", "cell").agg(F.ceil(F.count("*") / shard_rows).alias("subs"))
    shard = F.concat_ws(":", "dim", "bucket", "cell", F.pmod(F.xxhash64("row"), "subs"))
    return placed.join(groups, ["dim", "bucket", "cell"]).select("vec_id", "label", "dim", "v", "bucket", shard.alias("shard"))


def _rows(block: str, windows: Windows, data: dict[str, np.ndarray]) -> pd.DataFrame:
    query, who, score = windows.best
    named = {c: data[c][query] for c in ("positive_id", "positive_score")}
    return pd.DataFrame({"block": np.full(len(query), block, object), "anchor_id": windows.ids[windows.of[query]], **named, "vec_id": who, "score": score})


def _grow(k: int, leaf: int):
    def run(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame()
        tree = build(rows["vec_id"].to_numpy(np.int64), rows["label"].to_numpy(np.int64), _vectors(rows["v"]), leaf)
        first = rows.iloc[0]
        out = {"shard": first["shard"], "dim": first["dim"], "bucket": first["bucket"], "tree": packed(**tree), "centre": tree["centres"][0].tolist(), "radius": float(tree["radii"][0])}
        out |= {"label": int(tree["labels"][0]) if (tree["labels"] == tree["labels"][0]).all() else None, "queries": None, "found": None}
        if len(anchors):
            n = len(anchors)
            block = {"ids": anchors["vec_id"].to_numpy(np.int64), "labels": anchors["label"].to_numpy(np.int64), "vectors": _vectors(anchors["v"]), "of": np.arange(n)}
            block |= {"low": np.full(n, LOWEST), "high": np.full(n, HIGHEST), "positive_id": np.zeros(n, np.int64), "positive_score": np.zeros(n, np.int64)}
            windows = Windows(block, k, True)
            windows.search(tree)
            out |= {"queries": packed(**block | {"low": windows.low}), "found": packed(**_rows(first["shard"], windows, block).drop(columns="block"))}
        return pd.DataFrame([out]).astype({"label": "Int64"})

    return run


def _unfold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for block, data in zip(batch["block"], batch["found"], strict=True):
            found = pd.DataFrame(unpacked(data))
            yield found.assign(block=block)[["block", "anchor_id", "positive_id", "positive_score", "vec_id", "score"]]


def _packs(shards: DataFrame, keys: list[str]) -> DataFrame:
    """Centres and radii of up to about ``PACK`` shards a row."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        labels = group["label"].astype("Int64")
        data = packed(centres=np.array(group["centre"].tolist()), radii=group["radius"].to_numpy(np.float64), labels=labels.fillna(0).to_numpy(np.int64), alone=labels.notna().to_numpy(bool))
        return pd.DataFrame([{**{k: group[k].iloc[0] for k in (*keys, "pack")}, "shards": group["shard"].tolist(), "summary": data}])

    n = shards.count() // PACK + 1
    rows = shards.withColumn("pack", F.pmod(F.xxhash64("shard"), F.lit(n)).cast("int"))
    kinds = {"dim": "dim int", "bucket": "bucket string"}
    return rows.groupBy(*keys, "pack").applyInPandas(run, f"{', '.join(kinds[k] for k in keys)}, pack int, shards array<string>, summary binary")


def _surviving(same: bool):
    """Pairs of a block and a shard whose reach meets an open window, with the number of such windows."""

    def run(pack: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        if not len(pack) or not len(blocks):
            return pd.DataFrame()
        data, names = unpacked(pack["summary"].iloc[0]), np.array(pack["shards"].iloc[0], object)
        out = []
        for block, queries in zip(blocks["block"], blocks["queries"], strict=True):
            q = unpacked(queries)
            low, high = reach(q["vectors"].astype(np.float64), data["centres"], data["radii"])
            useless = data["alone"][None, :] & ((data["labels"][None, :] == q["labels"][:, None]) != same)
            hit = (high[q["of"]] >= q["low"][:, None]) & (low[q["of"]] <= q["high"][:, None]) & ~useless[q["of"]]
            promise = hit.sum(axis=0)
            at = np.flatnonzero(promise)
            out.append(pd.DataFrame({"block": np.full(len(at), block, object), "shard": names[at], "promise": promise[at]}))
        return pd.concat(out)

    return run


def _chunked(df: DataFrame, chunks: int) -> DataFrame:
    """With ``chunk``; the columns are new ones, so that the result joins with what it was made from."""
    rows = df.withColumn("chunk", F.pmod(F.xxhash64("block"), F.lit(chunks)).cast("int"))
    return rows.toDF(*rows.columns)


def surviving(blocks: DataFrame, packs: DataFrame, keys: list[str], chunks: int, same: bool) -> DataFrame:
    by = [*keys, "pack", "chunk"]
    asked = _chunked(blocks.join(packs.select(*keys, "pack"), keys).select(*keys, "pack", "block", "queries"), chunks)
    shown = packs.join(asked.select(*by).distinct().toDF(*by), [*keys, "pack"])
    return shown.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(_surviving(same), "block string, shard string, promise long")


def _look(k: int, same: bool):
    def run(trees: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        if not len(trees) or not len(blocks):
            return pd.DataFrame()
        tree = unpacked(trees["tree"].iloc[0])
        out = []
        for block, queries in zip(blocks["block"], blocks["queries"], strict=True):
            data = unpacked(queries)
            windows = Windows(data, k, same)
            windows.search(tree)
            out.append(_rows(block, windows, data))
        return pd.concat(out)

    return run


def looked(pairs: DataFrame, blocks: DataFrame, trees: DataFrame, chunks: int, k: int, same: bool) -> DataFrame:
    """What the blocks find in the shards of ``pairs``: a task has one tree and about ``CHUNK`` blocks."""
    asked = _chunked(pairs.select("block", "shard").join(blocks.select("block", "queries"), "block"), chunks)
    shown = trees.select("shard", "tree").join(asked.select("shard", "chunk").distinct().toDF("shard", "chunk"), "shard")
    return shown.groupBy("shard", "chunk").cogroup(asked.groupBy("shard", "chunk")).applyInPandas(_look(k, same), FOUND)


def _best(found: DataFrame, k: int, *keys: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _with_windows(low: int, high: int):
    """The queries of a block: one for each positive of an anchor."""

    def run(blocks: pd.DataFrame, positives: pd.DataFrame) -> pd.DataFrame:
        if not len(blocks) or not len(positives):
            return pd.DataFrame()
        block = unpacked(blocks["queries"].iloc[0])
        at = np.argsort(block["ids"])
        of = at[np.searchsorted(block["ids"][at], positives["anchor_id"].to_numpy(np.int64))]
        score = positives["score"].to_numpy(np.int64)
        exact = [int(s) for s in score]
        block |= {"of": of, "positive_id": positives["vec_id"].to_numpy(np.int64), "positive_score": score}
        block |= {"low": np.array([-(-low * s // 100) for s in exact], np.int64), "high": np.array([high * s // 100 for s in exact], np.int64)}
        return pd.DataFrame([{"block": blocks["block"].iloc[0], "dim": blocks["dim"].iloc[0], "queries": packed(**block)}])

    return run


def _raised(k: int):
    """The queries with the floors that what was found gives."""

    def run(blocks: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(blocks):
            return pd.DataFrame()
        row = blocks.iloc[0].copy()
        data = unpacked(row["queries"])
        number = {(int(data["ids"][o]), int(p)): i for i, (o, p) in enumerate(zip(data["of"], data["positive_id"], strict=True))}
        windows = Windows(data, k, False)
        query = np.array([number[a, p] for a, p in zip(found["anchor_id"], found["positive_id"], strict=True)], np.int64)
        windows.add(query, found["vec_id"].to_numpy(np.int64), found["score"].to_numpy(np.int64))
        row["queries"] = packed(**data | {"low": windows.low})
        return pd.DataFrame([row])

    return run


def mined(
    rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, factor: int = 256,
    vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", shard_rows: int = SHARD_ROWS, leaf: int = LEAF,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    Anchors are rows whose id is divisible by ``every``. A row's score is the inner product of vectors of floor(``factor`` x).
    The positives are the anchor's best other rows of its label; for each, the best rows of another label whose score is between ``low`` and
    ``high`` percent of the positive's. Ties go to the smaller id. Rows with a null id, label or vector, or a component that is null or not
    finite take no part; only vectors of the same length meet. A row never meets its own id; of rows that repeat an anchor's id the one with the
    smallest label, then vector asks, and a positive's repeated id asks once for each score. Anchors without a positive, and positives without a
    row in the window, give no rows, as an empty table.
    """
    v = F.col(vector)
    # the test of the vector comes before the scaling, in one expression, so that no bad component is scaled
    points = rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).cast("bigint").alias("label"), F.when(usable(v), scaled(v, factor)).alias("v"))
    points = points.filter("vec_id is not null and label is not null and v is not null")
    points = shared_table(points.select("vec_id", "label", F.size("v").alias("dim"), "v", F.monotonically_increasing_id().alias("row")), "negatives-points")
    spread = shared_table(dealt(points, shard_rows), "negatives-dealt")
    asks = F.min(F.struct("label", "dim", "v", "shard"))
    anchors = spread.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(asks.alias("a")).select("vec_id", "a.label", "a.v", "a.shard")
    schema = "shard string, dim int, bucket string, tree binary, centre array<double>, radius double, label long, queries binary, found binary"
    grown = shared_table(spread.groupBy("shard").cogroup(anchors.groupBy("shard")).applyInPandas(_grow(positives, leaf), schema), "negatives-trees")
    shards = grown.select("shard", "dim", "bucket", "centre", "radius", "label")
    blocks = grown.filter("queries is not null").select(F.col("shard").alias("block"), "dim", "bucket", "queries")
    chunks = blocks.count() // CHUNK + 1

    near = surviving(blocks, _packs(shards, ["dim", "bucket"]), ["dim", "bucket"], chunks, True).filter("block <> shard")
    own = grown.filter("found is not null").select(F.col("shard").alias("block"), "found").mapInPandas(_unfold, FOUND)
    first = _best(own.unionByName(looked(near, blocks, grown, chunks, positives, True)), positives, "anchor_id")
    asked = blocks.groupBy("block").cogroup(first.select("block", "anchor_id", "vec_id", "score").distinct().groupBy("block"))
    queries = shared_table(asked.applyInPandas(_with_windows(low, high), "block string, dim int, queries binary"), "negatives-queries")

    packs = _packs(shards, ["dim"])
    most = surviving(queries, packs, ["dim"], chunks, False).groupBy("block").agg(F.max_by("shard", F.struct("promise", "shard")).alias("shard"))
    pilot = shared_table(looked(most, queries, grown, chunks, negatives, False), "negatives-pilot")
    raised = shared_table(queries.groupBy("block").cogroup(pilot.groupBy("block")).applyInPandas(_raised(negatives), "block string, dim int, queries binary"), "negatives-raised")
    others = surviving(raised, packs, ["dim"], chunks, False).join(most, ["block", "shard"], "left_anti")
    found = pilot.unionByName(looked(others, raised, grown, chunks, negatives, False))
    best = _best(found, negatives, "anchor_id", "positive_id", "positive_score")
    return best.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
