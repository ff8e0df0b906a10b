"""Helpers that several corpus operators share."""

from __future__ import annotations

import gc
import posixpath
import sys
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed, shared_dir

#: White space of all contracts here: blank and \t \n \v \f \r.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(posixpath.join(folder, f"{name}.parquet"))


def text_of(column: str = "text") -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the cluster's shared folder, and read again."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def worker_slot(key: tuple, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task: one model with its memory, dropped when another one is asked for."""
    kept = sys.__dict__.setdefault("_corpus_worker_slot", {})
    if key not in kept:
        kept.clear()
        gc.collect()
        kept[key] = make()
    return kept[key]


def scalar(df: DataFrame):
    """The single value of a one-row, one-column aggregate."""
    return df.first()[0]


def small(df: DataFrame, rows: int, limit: int = 200_000) -> DataFrame:
    """A broadcast hint only where the counted rows stay under a limit; beyond it Spark shuffles."""
    return F.broadcast(df) if rows <= limit else df


__all__ = ["BLANKS", "WORD", "checkpointed", "scalar", "shared_table", "small", "table", "text_of", "worker_slot"]
