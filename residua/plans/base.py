"""Registry, table access and the derived tables several plans share."""

from __future__ import annotations

import posixpath
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.generator import jump_constants
from ..operators.ordered import dealt

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables by name, read on demand."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(posixpath.join(self.folder, f"{name}.parquet"))

    @cached_property
    def events(self) -> DataFrame:
        """Events with ``us``, the event time in microseconds."""
        df = self.spark.read.parquet(posixpath.join(self.folder, "events.parquet"))
        return df.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))

    @cached_property
    def fact(self) -> DataFrame:
        """One row per order line: row key, column key, packed value."""
        return self.lineitem.select(F.col("l_suppkey").alias("lane"), F.col("l_partkey").alias("upper"), packed_line().alias("actual"))

    @cached_property
    def cells(self) -> DataFrame:
        """One packed value per (lane, upper), with a bounded number of rows to a task."""
        return dealt(self.fact, ["lane", "upper"], self.lineitem).groupBy("lane", "upper").agg(F.max("actual").alias("actual"))

    @cached_property
    def model(self) -> DataFrame:
        return self.part.select(F.col("p_partkey").alias("upper"), packed_part(0, 0).alias("predicted"))

    @cached_property
    def candidates(self) -> DataFrame:
        """Sixteen candidate values per column key."""
        c = F.col("class_id")
        rows = self.part.select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("class_id"))
        return rows.select(F.col("p_partkey").alias("upper"), "class_id", packed_part(c + 1, F.floor((c + 1) / 7)).alias("value"))


def packed_line() -> Column:
    status = F.when(F.col("l_linestatus") == "O", 32).otherwise(0)
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1024).otherwise(2048)
    return (F.lit(1 << 30) + F.col("l_linenumber") + status + flag).cast("bigint")


def packed_part(shift, turn) -> Column:
    number = (F.col("p_size") + shift) % 7 + 1
    return (F.lit(1 << 30) + number + (F.col("p_partkey") + shift) % 2 * 32 + (F.col("p_size") + turn) % 3 * 1024).cast("bigint")


FACT_SQL = """fact AS (SELECT l_suppkey AS lane, l_partkey AS upper, CAST(1073741824 + l_linenumber
  + CASE WHEN l_linestatus = 'O' THEN 32 ELSE 0 END
  + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1024 ELSE 2048 END AS BIGINT) AS actual FROM lineitem)"""
CELLS_SQL = FACT_SQL + ", cells AS (SELECT lane, upper, max(actual) AS actual FROM fact GROUP BY lane, upper)"
MODEL_SQL = """model AS (SELECT p_partkey AS upper, CAST(1073741824 + p_size % 7 + 1 + p_partkey % 2 * 32
  + p_size % 3 * 1024 AS BIGINT) AS predicted FROM part)"""
CAND_SQL = """cand AS (SELECT p_partkey AS upper, CAST(c AS INTEGER) AS class_id, CAST(1073741824 + (p_size + c + 1) % 7 + 1
  + (p_partkey + c + 1) % 2 * 32 + (p_size + (c + 1) // 7) % 3 * 1024 AS BIGINT) AS value FROM part, range(16) r(c))"""
BEST_SQL = "best AS (SELECT upper, value, min(class_id) AS class_id FROM cand GROUP BY upper, value)"


def changed_sql(a: str, b: str) -> str:
    """Number of differing 5-bit fields, in SQL."""
    return "(" + " + ".join(f"CAST(((xor({a}, {b}) >> {s}) & 31) <> 0 AS INTEGER)" for s in (0, 5, 10, 20, 25, 15)) + ")"


def lcg_sql(source: str, state: str, steps: str, bits: int) -> str:
    """FROM-clause text giving ``source`` plus column ``s``: the state after ``steps`` steps."""
    out = f"(SELECT *, CAST({state} AS HUGEINT) AS s FROM {source})"
    for i in range(bits):
        a, c = jump_constants(1 << i)
        out = f"(SELECT * EXCLUDE (s), CASE WHEN ({steps} >> {i}) & 1 = 1 THEN (s * {a} + {c}) % 4294967296 ELSE s END AS s FROM {out})"
    return out


def query(name: str, sql: str | None = None):
    """Register a plan over :class:`Tables` and, where SQL can express it, its twin."""

    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def cents(col: str) -> Column:
    return F.round(F.col(col) * 100).cast("bigint")


def r4(col, name: str, digits: int = 4) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c, digits).alias(name)


# event types as work-ledger statuses
STATUS_OF = {"signup": "claimed", "click": "done", "view": "released", "purchase": "verified", "error": "failed"}
STATUS_SQL = "CASE event_type WHEN 'signup' THEN 'claimed' WHEN 'click' THEN 'done' WHEN 'view' THEN 'released' WHEN 'purchase' THEN 'verified' ELSE 'failed' END"


def event_status() -> Column:
    out = F.lit("failed")
    for kind, status in STATUS_OF.items():
        out = F.when(F.col("event_type") == kind, status).otherwise(out)
    return out
