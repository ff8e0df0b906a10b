"""Near duplicates: a chosen-path similarity join over minwise sketches, confirmed on full shingle sets.

1. One pass makes each document's shingle set, its 128-bit fingerprint and a sketch of minwise tokens.
   Documents with equal sets fold into the one with the smallest id.
2. Independent trees branch the documents by minwise tokens at coordinates chosen by tree and path. A node
   with one document ends. A small node is compared exhaustively. A large node first meets a pivot: documents about
   as close to it as a link are set under it and leave (whatever they link to is, by the triangle
   inequality, within reach of the pivot too and gets its edge), and the others branch on.
   What is left large after the last level is compared in blocks, pair of blocks by pair of blocks.
   Only a forest of candidate edges leaves a node, never all pairs.
3. Candidate edges make loose clusters. Each cluster's full sets are shipped once, in blocks, and every two
   documents that are not yet in one component are compared exactly.
4. Components of the exact links give the classes.

A linked pair meets at each of the ten coordinates with the probability of its similarity, so at 0.8 the chance to miss it in
all trees is below 1e-4 even where it must survive two more levels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .graph import components
from .shingles import mix, shingle_sets

COORDINATES = 64
TREES = 10
SMALL = 256
BLOCK = 512
LEVELS = 3
NOISE = 0.2  # four standard deviations of an estimate from 64 coordinates at similarity 0.8
FACTORS = np.random.default_rng(8).integers(1, 1 << 62, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
UPPER_HALF = np.uint64(32)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Minwise tokens of nonempty sets, one row of 32-bit values per set."""
    out = np.empty((len(sets), COORDINATES), np.uint32)
    at = 0
    while at < len(sets):
        end, size = at + 1, len(sets[at])
        while end < len(sets) and size + len(sets[end]) < 1 << 18:
            size += len(sets[end])
            end += 1
        flat = np.concatenate(sets[at:end])
        starts = np.cumsum([0, *map(len, sets[at : end - 1])])
        for i, factor in enumerate(FACTORS):
            out[at:end, i] = np.minimum.reduceat(flat * factor, starts) >> UPPER_HALF
        at = end
    return out


def _lowered(values: list) -> list[bytes]:
    return [(t or "").encode().lower() for t in values]


def _sketch(n: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, len(ids), 1000):
                sets = shingle_sets(_lowered(texts[at : at + 1000].to_pylist()), n)
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                marks = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "<i8").reshape(-1, 2)
                blobs: list[bytes | None] = [None] * len(sets)
                keys: list[list[int] | None] = [None] * len(sets)
                if len(full):
                    tokens = sketches([sets[i] for i in full])
                    trees = np.arange(TREES, dtype=np.uint64) << np.uint64(32)
                    nodes = mix(tokens[:, :TREES].astype(np.uint64) + trees).view(np.int64).tolist()
                    for i, row, node in zip(full, tokens, nodes, strict=True):
                        blobs[i], keys[i] = row.tobytes(), node
                columns = [ids[at : at + 1000], pa.array(sizes, pa.int64()), pa.array(np.ascontiguousarray(marks[:, 0])), pa.array(np.ascontiguousarray(marks[:, 1])), pa.array(blobs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "m1", "m2", "sketch", "keys"])

    return run


def _tokens(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _meet_pivot(threshold: float) -> Callable:
    """Rows (key, doc, sketch, pivot, pivot_sketch) to edges (kind 0) and child nodes (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            key, doc, pivot = (batch.column(i).to_numpy() for i in (0, 1, 3))
            mine = _tokens(batch.column(2))
            likeness = (mine == _tokens(batch.column(4))).mean(axis=1)
            under = (likeness >= 2 * threshold - 1 - NOISE + 0.05) & (doc != pivot)
            on = (likeness < threshold) & (doc != pivot)
            k = key[on].view(np.uint64)
            out = [(np.zeros(under.sum(), np.int8), doc[under], pivot[under])]
            for turn in (1, 2):  # one coordinate always, a second one for a quarter of the nodes: 1 / threshold on average
                pick = mix(k + np.uint64(turn))
                chosen = np.ones(len(k), bool) if turn == 1 else (pick >> np.uint64(40)) % np.uint64(1000) < int(1000 / threshold - 1000)
                where = (pick % np.uint64(COORDINATES)).astype(np.int64)
                child = mix(pick + mine[on][np.arange(len(k)), where]).view(np.int64)
                out.append((np.ones(chosen.sum(), np.int8), doc[on][chosen], child[chosen]))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "doc", "other"])

    return run


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b

    def roots(self) -> np.ndarray:
        return np.array([self.root(i) for i in range(len(self.up))])


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal leading ``keys`` columns of an input sorted by them, also across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        columns = [batch.column(i).to_numpy() for i in range(keys)]
        change = np.zeros(n, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), n]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def _compare_sketches(least: float) -> Callable:
    """Groups (key, left, right; doc, block, sketch) to a forest of pairs whose sketches are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for group in groups(batches, 3):
            doc, tokens = group["doc"].to_numpy(), _tokens(group["sketch"])
            forest = Forest(len(doc))
            for i in range(len(doc) - 1):
                alike = np.flatnonzero((tokens[i + 1 :] == tokens[i]).mean(axis=1) >= least) + i + 1
                found.extend((int(doc[i]), int(doc[j])) for j in alike if doc[i] != doc[j] and forest.join(i, int(j)))
            if len(found) > 50_000:
                yield _edges(found)
                found = []
        if found:
            yield _edges(found)

    return run


def exact_links(sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """A forest that connects what links of at least ``percent`` connect; sets already connected are not compared."""
    forest, sizes = Forest(len(sets)), np.array([len(s) for s in sets])
    flat, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)])
    for i in range(len(sets) - 1):
        roots = forest.roots()[i + 1 :]
        near = (roots != forest.root(i)) & (100 * np.minimum(sizes[i + 1 :], sizes[i]) >= percent * np.maximum(sizes[i + 1 :], sizes[i]))
        others = np.flatnonzero(near) + i + 1
        if not len(others):
            continue
        if len(others) > 8:
            place = np.minimum(np.searchsorted(sets[i], flat), sizes[i] - 1)
            common = np.add.reduceat(sets[i][place] == flat, starts[:-1])[others]
        else:
            common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in others])
        for j, both in zip(others, common, strict=True):
            if 100 * both >= percent * (sizes[i] + sizes[j] - both) and forest.join(i, int(j)):
                yield i, int(j)


def _confirm(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for group in groups(batches, 3):
            doc = group["doc"].to_numpy()
            sets = [np.frombuffer(s, np.uint64) for s in group["set"].to_pylist()]
            if len(doc) > 1:
                found.extend((int(doc[i]), int(doc[j])) for i, j in exact_links(sets, percent))
            if len(found) > 50_000:
                yield _edges(found)
                found = []
        if found:
            yield _edges(found)

    return run


def _full_sets(n: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                sets = shingle_sets(_lowered(part.column(1).to_pylist()), n)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets], pa.binary()), part.column(2), part.column(3)], ["doc", "set", "key", "n"])

    return run


def _in_blocks(rows: DataFrame, size: int, *values: str) -> DataFrame:
    """Rows of groups (``key`` with ``n`` members) dealt to all pairs of blocks of about ``size`` members."""
    blocks = F.ceil(F.col("n") / size).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc", F.lit(3)), blocks).cast("int"))
    pairs = rows.select("key", "doc", *values, "block", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    # a block meets itself once: where other = block
    out = pairs.select("key", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "doc", *values)
    return out.repartition("key", "left", "right").sortWithinPartitions("key", "left", "right", "doc")


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` of every row.

    Texts are linked when 100 * common >= percent * union over their sets of shingles of ``words`` words
    (A-Z lower-cased); ``component_id`` is the smallest id reachable over links. Texts without words, null ones included, and
    rows with a null id link with nothing; the latter have a null component and are kept. Rows that share an id
    are one node. Other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    sketched = checkpointed(rows.mapInArrow(_sketch(words), "doc_id long, n_shingles long, m1 long, m2 long, sketch binary, keys array<long>"))
    usable = sketched.filter("doc_id is not null and n_shingles > 0")
    folded = usable.groupBy("n_shingles", "m1", "m2").agg(F.min("doc_id").alias("doc"))
    equal = usable.select("doc_id", "n_shingles", "m1", "m2").join(folded, ["n_shingles", "m1", "m2"]).filter("doc_id <> doc").select(F.col("doc_id").alias("u"), F.col("doc").alias("v"))
    heads = usable.join(folded, ["n_shingles", "m1", "m2"]).filter("doc_id = doc").select("doc", "sketch", "keys").dropDuplicates(["doc", "sketch"])
    heads = checkpointed(heads)
    tokens = heads.select("doc", "sketch")

    threshold = percent / 100
    nodes = heads.select(F.explode("keys").alias("key"), "doc")
    leaves, loose = [], []
    for level in range(LEVELS):
        sized = nodes.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("doc"), "doc")).alias("pivot")).filter("n > 1")
        nodes = checkpointed(nodes.join(sized, "key").select("key", "doc", "n", F.col("pivot.doc").alias("pivot")))
        leaves.append(nodes.filter(F.col("n") <= SMALL).select("key", "doc", "n"))
        large = nodes.filter(F.col("n") > SMALL)
        if large.isEmpty():
            break
        if level == LEVELS - 1:
            leaves.append(large.select("key", "doc", "n"))
            break
        faced = large.join(tokens, "doc").join(tokens.select(F.col("doc").alias("pivot"), F.col("sketch").alias("pivot_sketch")), "pivot")
        met = checkpointed(faced.select("key", "doc", "sketch", "pivot", "pivot_sketch").mapInArrow(_meet_pivot(threshold), "kind byte, doc long, other long"))
        loose.append(met.filter("kind = 0").select(F.col("doc").alias("u"), F.col("other").alias("v")))
        nodes = met.filter("kind = 1").select(F.col("other").alias("key"), "doc").distinct()
    last = leaves[0]
    for part in leaves[1:]:
        last = last.unionByName(part)
    dealt = _in_blocks(last.join(tokens, "doc"), SMALL, "sketch")
    loose.append(dealt.mapInArrow(_compare_sketches(threshold - NOISE), "u long, v long"))
    edges = loose[0]
    for part in loose[1:]:
        edges = edges.unionByName(part)

    clusters = components(edges)
    sizes = clusters.groupBy("component").agg(F.count("*").alias("n"))
    members = checkpointed(clusters.join(sizes, "component").select(F.col("node").alias("doc_id"), F.col("component").alias("key"), "n"))
    full = rows.join(members, "doc_id").select("doc_id", "text", "key", "n").mapInArrow(_full_sets(words), "doc long, set binary, key long, n long")
    links = _in_blocks(full, BLOCK, "set").mapInArrow(_confirm(percent), "u long, v long")
    found = components(links.unionByName(equal)).select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))
    out = sketched.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (component == F.col("doc_id"))).alias("kept"))
