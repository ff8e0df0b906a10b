"""Exact duplicates by deterministic block naming, in DataFrame operations only.

A text without white space is cut into blocks of fixed length. Equal blocks get one integer name:
the smallest position at which the block occurs, found by an aggregate that combines map-side, so a
block that a third of the rows share costs one row per task. A document is then a string of names;
adjacent pairs are named in the same way, round by round, until one name per document is left. Names
are given to contents, not to hashes of them, so two documents share (rounds, name) exactly when their
texts are equal.

Shuffles: the blocks twice (naming, and joining the names back, where adaptive execution splits a hot
block), then only names of documents with more than one block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, checkpointed, scalar, text_of

BLOCK = 4096


def without_blanks(text: Column) -> Column:
    for c in BLANKS:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _named(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with ``name``: an integer for each distinct value of ``keys``.

    The position of a row must be stable under recomputation: ``df`` is a scan or a checkpoint.
    """
    names = df.select(*keys, F.monotonically_increasing_id().alias("at")).groupBy(*keys).agg(F.min("at").alias("name"))
    return df.join(names, keys)


def identities(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, row: str | None = None) -> DataFrame:
    """One row per input row: ``row``, ``doc_id``, ``n_points``, ``text_sha256``, ``rounds``, ``name``.

    Rows agree on (rounds, name) exactly when their texts are equal without white space. A null text
    is an empty one. Every row counts, also repeated rows and rows with a null id. Only the named
    columns are read; others, whatever their names, are ignored. ``row`` names a column that tells rows apart; without it they are numbered here.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    rows = docs.select(number.alias("row"), F.col(doc_id).alias("doc_id"), F.char_length(whole).alias("n_points"), without_blanks(whole).alias("body"))
    parts = F.regexp_extract_all("body", F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    rows = rows.withColumn("parts", F.when(F.col("body") == "", F.array(F.lit(""))).otherwise(parts))
    head = F.col("i") == 0
    blocks = rows.select(
        "row",
        "doc_id",
        "n_points",
        F.sha2(F.encode("body", "UTF-8"), 256).alias("sha"),
        F.size("parts").alias("m"),
        F.posexplode("parts").alias("i", "block"),
    ).select("row", "m", "i", "block", F.when(head, F.struct("doc_id", "n_points", "sha")).alias("head"))
    first = checkpointed(_named(blocks, ["block"]).drop("block"))

    done = first.filter("m = 1").select("row", F.lit(0).alias("rounds"), "name")
    rest = first.filter("m > 1").select("row", "m", "i", "name")
    most = scalar(first.agg(F.max("m"))) or 1
    for level in range(1, math.ceil(math.log2(most)) + 1):
        half = F.floor(F.col("i") / 2).cast("int")
        pairs = rest.groupBy("row", "m", half.alias("j")).agg(
            F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
        )
        named = checkpointed(_named(checkpointed(pairs), ["left", "right"]).select("row", "m", F.col("j").alias("i"), "name"))
        done = done.unionByName(named.filter(F.col("m") <= 2**level).select("row", F.lit(level).alias("rounds"), "name"))
        rest = named.filter(F.col("m") > 2**level)
    heads = first.filter("i = 0").select("row", "head.doc_id", "head.n_points", F.col("head.sha").alias("text_sha256"))
    return heads.join(done, "row")


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, row: str | None = None) -> DataFrame:
    """Groups of equal texts: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Of each group the row with the most code points stays, then the smallest id (null last), then the
    first row read, so that of repeated rows one stays. An empty table gives an empty result. Where ``row`` names a column that
    tells rows apart, the smallest one stands for the first, and the result has it as ``row``.
    """
    named = identities(docs, doc_id, text, block, row)
    best = F.min(F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    groups = named.groupBy("rounds", "name").agg(F.count("*").alias("group_size"), best.alias("best"))
    out = named.join(groups, ["rounds", "name"])
    return out.select(*(["row"] if row else []), "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256")
