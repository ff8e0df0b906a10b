"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is hashed into ``2**BITS`` blocks, whatever its size. A source's quota is a number of
passes over all its blocks plus a prefix of their permuted order; the block at the edge is refined by
the next digits of the same hash, down to single documents, so quotas are met to within half a
document and no window ever sees more than ``2**BITS`` rows of a source plus one edge. A binary tree
then splits the block draws: at each node a uniformly drawn half of the draws goes left, which makes the
counts per source a multivariate hypergeometric draw. A leaf is an output shard; its draws of a
source are a disjoint run of that source's permuted blocks, shuffled inside the shard.

All of it is DataFrame work. A document decides from its own hash and a table with a few rows per
source, so texts are shuffled only when the mixed corpus is written out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, small

BITS = 10
BLOCKS = 1 << BITS
#: A task of the written mix takes about so many words.
SHARD_WORDS = 16_000_000


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def _digest(seed: int) -> Column:
    """62 hash bits of the id: the digits that choose block, inner block and order."""
    return F.xxhash64(F.lit(seed), F.col("doc_id")).bitwiseAND(F.lit((1 << 62) - 1))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _rank(seed: int) -> Column:
    """Place of block ``b`` in the permuted order of its source: an affine map with odd factor."""
    mix = F.xxhash64(F.lit(seed), F.lit("order"), F.coalesce("source", F.lit("")), F.col("source").isNull())
    factor = mix.bitwiseAND(F.lit(0xFFFFF)).bitwiseOR(F.lit(1))
    return F.pmod(factor * F.col("b") + F.pmod(F.shiftright(mix, 24), F.lit(BLOCKS)), F.lit(BLOCKS))


def targets(sizes: DataFrame, weights: Sequence[float], budget: float, cap: float) -> DataFrame:
    """Target words of each source: ``source``, ``source_size``, ``target``.

    ``sizes`` has one row per source. Weights repeat over the sources in code point order, null last.
    Sources in ascending order of limit over weight: those that reach ``cap`` times their size form a
    prefix, and the first one that does not fixes the share per unit of weight for all after it.
    """
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(order, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(cap))
    rows = rows.withColumn("limit", F.col("most") / F.col("weight"))
    by = Window.orderBy("limit", F.col("source").asc_nulls_last())
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) * float(budget) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    rows = rows.withColumn("share", left / F.sum("weight").over(after)).withColumn("n", F.row_number().over(by))
    free = F.col("limit") > F.col("share")
    rows = rows.withColumn("edge", F.min(F.when(free, F.struct("n", "share"))).over(everything))
    capped = F.col("edge").isNull() | (F.col("n") < F.col("edge.n"))
    return rows.select("source", "source_size", F.when(capped, F.col("most")).otherwise(F.col("weight") * F.col("edge.share")).alias("target"))


def _edge(rows: DataFrame, order: str, out: str) -> DataFrame:
    """Per source, the digit at which the running size passes ``need``, and what is still needed there."""
    w = Window.partitionBy("source").orderBy(order)
    run = rows.withColumn("past", F.sum("size").over(w)).withColumn("ahead", F.col("past") - F.col("size"))
    return run.filter((F.col("ahead") <= F.col("need")) & (F.col("need") < F.col("past"))).select("source", F.col(order).alias(out), (F.col("need") - F.col("ahead")).alias("need"))


def draw(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, cap: float = 2.0, shards: int = 16, seed: int = 17) -> DataFrame:
    """How often the mix takes each document, and where to.

    ``docs`` has ``doc_id``, ``source`` and ``size``. Adds ``source_size``, ``target``, ``copies``
    (0, 1, ... up to ``cap`` rounded up) and ``shards``, an array with one shard for each copy. ``shards`` must
    be a power of two. Rows of one id are taken alike. A null source is a source of its own, a null
    size is 0. The result depends on ids, sources, sizes and the seed only. Other columns stay, but those named like added ones.
    """
    return _drawn(docs, weights, budget, cap, shards, seed)[0]


def _drawn(docs: DataFrame, weights: Sequence[float], budget: float, cap: float, shards: int, seed: int) -> tuple[DataFrame, float]:
    """The draw, and the words of all targets."""
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    h = _digest(seed)
    others = [c for c in docs.columns if c not in ("doc_id", "source", "size", "source_size", "target", "copies", "shards")]
    packed = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(0))
    rows = docs.select("doc_id", "source", "size", packed.alias("_others")).withColumns({"size": F.coalesce("size", F.lit(0)), "h": h, "b": h.bitwiseAND(F.lit(BLOCKS - 1))})
    rows = rows.withColumn("rank", _rank(seed))
    inner = F.shiftright("h", BITS).bitwiseAND(F.lit(BLOCKS - 1))

    blocks = checkpointed(rows.groupBy("source", "rank").agg(F.sum("size").alias("size")))
    sources = targets(blocks.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, cap)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    sources = checkpointed(sources.withColumn("passes", passes).withColumn("need", F.col("target") - F.col("passes") * F.col("source_size")))
    n, total = sources.agg(F.count("*"), F.coalesce(F.sum("target"), F.lit(0.0))).first()

    def with_edge(left: DataFrame, edge: DataFrame, *on: str) -> DataFrame:
        other = small(edge.withColumnRenamed("source", "of"), n)
        keep = _same("source", "of")
        for c in on:
            keep = keep & (F.col(c) == F.col(f"edge_{c}"))
        return left.join(other, keep).drop("of")

    edge1 = checkpointed(_edge(with_edge(blocks, sources.select("source", "need")), "rank", "edge_rank"))
    at1 = with_edge(rows.withColumn("inner", inner), edge1, "rank")
    edge2 = checkpointed(_edge(at1.groupBy("source", "inner", "need", "edge_rank").agg(F.sum("size").alias("size")), "inner", "edge_inner").join(edge1.select(F.col("source").alias("of"), "edge_rank"), _same("source", "of")).drop("of"))
    at2 = with_edge(rows.withColumn("inner", inner), edge2, "rank", "inner")
    w = Window.partitionBy("source").orderBy("h")
    last = at2.groupBy("source", "h", "need").agg(F.sum("size").alias("size")).withColumn("ahead", F.sum("size").over(w) - F.col("size"))
    last = last.filter(F.col("ahead") + F.col("size") / 2 <= F.col("need")).groupBy("source").agg(F.max("h").alias("edge_h"))
    cuts = sources.select("source", "source_size", "target", "passes")
    for extra in (edge2.drop("need"), last):
        cuts = cuts.join(extra.withColumnRenamed("source", "of"), _same("source", "of"), "left").drop("of")
    cuts = checkpointed(cuts)

    # block draws: all blocks once per pass, then the permuted prefix with the block at the edge
    draws = cuts.select("source", F.explode(F.sequence(F.lit(0), F.col("passes") * BLOCKS + F.coalesce("edge_rank", F.lit(0)))).alias("draw"))
    draws = draws.withColumn("node", F.lit(0))
    for level in range(shards.bit_length() - 1):
        node = Window.partitionBy("node")
        chance = F.xxhash64(F.lit(seed), F.lit(level), "node", "source", "draw")
        place = F.row_number().over(node.orderBy(chance, "source", "draw"))
        left = place <= F.floor((F.count("*").over(node) + F.col("node") % 2) / 2)
        draws = draws.withColumn("node", F.col("node") * 2 + F.when(left, 0).otherwise(1))
    quotas = draws.groupBy("source", "node").agg(F.count("*").alias("quota"))
    run = Window.partitionBy("source").orderBy("node")
    quotas = quotas.withColumn("end", F.sum("quota").over(run))
    leaves = quotas.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("end", "node"))).alias("leaves"))
    cuts = cuts.join(leaves.withColumnRenamed("source", "of"), _same("source", "of"), "left").drop("of")

    cuts = small(checkpointed(cuts).withColumnRenamed("source", "of"), n)
    chosen = rows.withColumn("inner", inner).join(cuts, _same("source", "of"))
    extra = F.col("rank") < F.col("edge_rank")
    deeper = (F.col("inner") < F.col("edge_inner")) | ((F.col("inner") == F.col("edge_inner")) & (F.col("h") <= F.col("edge_h")))
    extra = F.coalesce(extra | ((F.col("rank") == F.col("edge_rank")) & deeper), F.lit(False))
    copies = F.col("passes") + (extra & (F.col("passes") < cap)).cast("int")
    draw_no = lambda k: (k * BLOCKS + F.col("rank")).cast("long")
    shard = lambda k: F.element_at(F.filter("leaves", lambda x: x["end"] > draw_no(k)), 1)["node"]
    found = F.when(copies > 0, F.transform(F.sequence(F.lit(0), copies - 1), shard)).otherwise(F.array().cast("array<int>"))
    kept = [F.col(f"_others.`{c}`").alias(c) if c in others else F.col(c) for c in docs.columns if c in others or c in ("doc_id", "source")]
    # decided before the other columns come back: their names must not be met while the decision is resolved
    decided = chosen.select("doc_id", "source", "_others", "size", "source_size", "target", copies.alias("copies"), found.alias("shards"))
    return decided.select(*kept, "size", "source_size", "target", "copies", "shards"), total


def mixed(
    docs: DataFrame, plan_columns: Sequence[str] = (), seed: int = 17, shards: int = 16, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, cap: float = 2.0, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, one row per copy taken, dealt to shards and shuffled inside them.

    Every shard is written in as many parts as its share of the targets asks for, by ranges of the shuffled order, so a task has
    about ``shard_words`` words however large the mix is. Columns of ``docs`` may have any names but ``doc_id``, ``source`` and ``text``
    have their usual meaning.
    """
    names = docs.columns
    packed = docs.select("doc_id", "source", words().alias("size"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    plan, total = _drawn(packed, weights, budget, cap, shards, seed)
    per_shard = max(1, -(-int(total) // (shards * shard_words)))
    taken = plan.select("row", F.posexplode("shards").alias("copy", "shard"))
    # the text is part of the hash, so that rows of one id are spread
    chance = F.xxhash64(F.lit(seed), F.lit("shuffle"), "row.doc_id", "row.text", "copy")
    part = F.floor(F.pmod(chance, F.lit(1 << 32)) * per_shard / (1 << 32)).cast("int")
    dealt = taken.withColumn("chance", F.pmod(chance, F.lit(1 << 32))).repartitionById(shards * per_shard, F.col("shard") * per_shard + part)
    dealt = dealt.sortWithinPartitions("shard", "chance")
    return dealt.select(*[F.col(f"row.`{c}`").alias(c) for c in names], *plan_columns)
