"""Delta-encoding plans over the packed cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import delta as D
from ..session import shared_dir
from .base import BEST_SQL, CAND_SQL, CELLS_SQL, MODEL_SQL, Tables, packed_part, query, r4

MODEL_PART_SQL = MODEL_SQL + " , m AS (SELECT model.* FROM model JOIN part ON upper = p_partkey WHERE p_size <> 7)"


def partial_model(t: Tables):
    """The model without the parts of one size, so that cells without a prediction occur."""
    return t.part.filter("p_size <> 7").select(F.col("p_partkey").alias("upper"), packed_part(0, 0).alias("predicted"))


@query("encode_exceptions", f"WITH {CELLS_SQL}, {MODEL_PART_SQL} SELECT lane, upper, xor(actual, coalesce(predicted, 0)) AS xor FROM cells LEFT JOIN m USING (upper) WHERE actual IS DISTINCT FROM predicted")
def encode_exceptions(t: Tables):
    return D.encode_exceptions(t.cells, partial_model(t), "lane", "upper")


@query("decode", f"WITH {CELLS_SQL} SELECT lane, upper, actual FROM cells")
def decode(t: Tables):
    exceptions = D.encode_exceptions(t.cells, partial_model(t), "lane", "upper")
    return D.decode_exceptions(t.cells, exceptions, partial_model(t), "lane", "upper")


@query("roundtrip", f"WITH {CELLS_SQL} SELECT lane, count(*) AS cells, CAST(0 AS BIGINT) AS mismatches FROM cells GROUP BY lane")
def roundtrip(t: Tables):
    """Encode, store, read back, rebuild, compare."""
    tables = D.encode_two_stage(t.cells, t.model, t.candidates, "lane", "upper")
    tables = D.stored(tables, shared_dir(t.spark, "encoded"))
    back = D.decode_two_stage(t.cells, tables, t.model, t.candidates, "lane", "upper")
    return D.verify_roundtrip(t.cells, back, "lane", "upper").select("lane", "cells", "mismatches")


@query(
    "two_stage",
    f"""WITH {CELLS_SQL}, {MODEL_SQL}, {CAND_SQL}, {BEST_SQL}, miss AS (SELECT lane, upper, actual FROM cells JOIN model USING (upper) WHERE actual <> predicted),
    k AS (SELECT lane, miss.upper, coalesce(class_id, -1) AS class_id FROM miss LEFT JOIN best ON miss.upper = best.upper AND actual = value)
    SELECT lane, CASE WHEN class_id > 0 THEN 'shift' WHEN class_id < 0 THEN 'explicit' ELSE 'default' END AS kind, count(*) AS n FROM k GROUP BY 1, 2""",
)
def two_stage(t: Tables):
    tables = D.encode_two_stage(t.cells, t.model, t.candidates, "lane", "upper")
    return tables.rows.groupBy("lane", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "residual_report",
    f"""WITH {CELLS_SQL}, {MODEL_SQL}, {CAND_SQL}, {BEST_SQL}, miss AS (SELECT lane, upper, actual FROM cells JOIN model USING (upper) WHERE actual <> predicted),
    k AS (SELECT coalesce(class_id, -1) AS class_id FROM miss LEFT JOIN best ON miss.upper = best.upper AND actual = value),
    r AS (SELECT 'raw' AS variant, count(*) AS rows, count(*) * 8 AS bytes FROM cells UNION ALL SELECT 'xor', count(*), count(*) * 6 FROM miss UNION ALL SELECT 'explicit', count(*), count(*) * 6 FROM k WHERE class_id < 0)
    SELECT variant, rows, bytes, round(100.0 * ((SELECT count(*) * 8 FROM cells) - bytes) / (SELECT count(*) * 8 FROM cells), 4) AS saved_pct FROM r""",
)
def residual_report(t: Tables):
    tables = D.encode_two_stage(t.cells, t.model, t.candidates, "lane", "upper")
    variants = {"raw": t.cells, "xor": tables.misses, "explicit": tables.explicit}
    out = D.residual_report(variants, {"raw": 8, "xor": 6, "explicit": 6}, "raw")
    return out.select("variant", "rows", "bytes", r4("saved_pct", "saved_pct"))


@query(
    "template_factor",
    """SELECT l_suppkey, count(*) AS rows, max(l_returnflag) = min(l_returnflag) AS l_returnflag_constant, coalesce(CASE WHEN max(l_returnflag) = min(l_returnflag) THEN min(l_returnflag) END, '') AS l_returnflag,
    max(s) = min(s) AS s_constant, coalesce(CASE WHEN max(s) = min(s) THEN min(s) END, '') AS s FROM (SELECT *, 'lane-' || (l_suppkey % 7) AS s FROM lineitem) GROUP BY l_suppkey""",
)
def template_factor(t: Tables):
    rows = t.lineitem.select("l_suppkey", "l_returnflag", F.concat(F.lit("lane-"), (F.col("l_suppkey") % 7).cast("string")).alias("s"))
    table, _ = D.factor_template(rows, "l_suppkey", ["l_returnflag", "s"])
    return table.select("l_suppkey", "rows", F.coalesce("l_returnflag", F.lit("")).alias("l_returnflag"), F.coalesce("s", F.lit("")).alias("s"), "l_returnflag_constant", "s_constant")


@query("template_deviations", "SELECT count(*) FILTER (l_linestatus <> lo) AS l_linestatus FROM lineitem JOIN (SELECT l_suppkey, min(l_linestatus) AS lo FROM lineitem GROUP BY 1) USING (l_suppkey)")
def template_deviations(t: Tables):
    return D.factor_template(t.lineitem.select("l_suppkey", "l_linestatus"), "l_suppkey", ["l_linestatus"])[1]
