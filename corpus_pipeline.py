"""A training corpus from ``documents``: language, exact and near duplicates, mixture, tokens.

Every stage takes all that its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from residua.llm import exact, language, mixture, near, pieces
from residua.llm.common import checkpointed, shared_table, small, table

PIECES = "piece_bpe_32k.model"


def _numbered(docs: DataFrame) -> DataFrame:
    """``row``, all columns of ``docs`` in one, and ``number``, a number of each row's own that is the same whenever the row is read.

    The number is that of the file and the place in it; of rows that no file holds, the place in a checkpoint.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    try:
        placed = docs.select(row, F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    except AnalysisException:
        return checkpointed(docs.select(row, F.monotonically_increasing_id().alias("number")))
    files = placed.select(F.col("file").alias("of")).distinct()
    numbers = checkpointed(files.withColumn("no", F.row_number().over(Window.orderBy("of")).cast("long")))
    rows = placed.join(small(numbers, numbers.count()), F.col("file") == F.col("of"))
    return rows.select("row", (F.shiftleft("no", 40) + F.col("at")).alias("number"))


def _texts(rows: DataFrame) -> DataFrame:
    return rows.select("number", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"))


def _only(rows: DataFrame, kept: Column, decisions: DataFrame) -> DataFrame:
    """The rows of ``rows`` whose number ``kept`` of ``decisions`` names, as they came."""
    return rows.join(decisions.select(kept.alias("kept")), F.col("number") == F.col("kept"), "left_semi").select("row.*")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a word of any language: null texts and texts without a letter."""
    return language.filtered(docs, language.fitted(docs))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows whose texts are equal without white space, one stays: the longest, then the smallest id, null last."""
    rows = _numbered(docs)
    return _only(rows, F.col("row"), exact.exact_duplicates(_texts(rows), row="number").filter("kept"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked at a similarity of 0.8 over shingles of five words, one stays: the smallest id, null last."""
    rows = _numbered(docs)
    linked = near.near_duplicates(_texts(rows), percent=80, words=5, doc_id="number").select(F.col("doc_id").alias("member"), "component_id")
    ids = _texts(rows).select("number", "doc_id")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "member"))
    return _only(rows, F.col("best.member"), linked.join(ids, F.col("member") == F.col("number")).groupBy("component_id").agg(best.alias("best")))


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh 3, 1, 2, repeating; 150 % of the words, no source above twice its size; one row per copy taken."""
    return mixture.mixed(docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digests of ids and decoded text."""
    return pieces.token_digests(docs, pieces.model_bytes(public_tokenizers.path(PIECES)))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixture", mixture_stage),
    ("pieces", pieces_stage),
]

#: The fitted language model, the sketches and the draws are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
