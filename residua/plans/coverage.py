"""Key set, range and coverage plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sets as S
from .base import Tables, query, r4


def doc_range(t: Tables) -> int:
    return t.documents.agg(F.max("doc_id")).first()[0] + 1


@query("missing_keys", "SELECT i AS doc_id FROM range((SELECT max(doc_id) + 1 FROM documents)) r(i) WHERE i NOT IN (SELECT doc_id FROM labels)")
def missing_keys(t: Tables):
    return S.missing_keys(t.labels, "doc_id", 0, doc_range(t))


@query("union_keys", "SELECT doc_id FROM documents UNION SELECT doc_id FROM labels")
def union_keys(t: Tables):
    return S.union_keys([t.documents, t.labels], "doc_id")


@query("except_keys", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def except_keys(t: Tables):
    return S.except_keys(t.documents, t.labels, "doc_id").select("doc_id", "lang")


@query("intersect_keys", "SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def intersect_keys(t: Tables):
    keys = ["l_suppkey", "l_partkey"]
    return S.intersect_keys(t.lineitem.filter("l_returnflag = 'A'"), t.lineitem.filter("l_returnflag = 'R'"), keys)


@query("two_way_anti", "SELECT doc_id, 'left_only' AS side FROM (SELECT doc_id FROM documents WHERE n_chars > 500 EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right_only' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents WHERE n_chars > 500)")
def two_way_anti(t: Tables):
    return S.two_way_anti(t.documents.filter("n_chars > 500"), t.labels, "doc_id")


@query(
    "pair_completeness",
    """WITH a AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), b AS (SELECT DISTINCT doc_id FROM documents WHERE n_chars > 500)
    SELECT i % 10 AS bucket, CASE WHEN i IN (FROM a) AND i IN (FROM b) THEN 'both' WHEN i IN (FROM a) THEN 'left_only' WHEN i IN (FROM b) THEN 'right_only' ELSE 'absent' END AS status, count(*) AS n
    FROM range((SELECT max(doc_id) + 1 FROM documents)) r(i) GROUP BY 1, 2""",
)
def pair_completeness(t: Tables):
    return S.pair_completeness(t.labels.filter("quality = 1"), t.documents.filter("n_chars > 500"), "doc_id", 0, doc_range(t), F.col("doc_id") % 10)


@query("duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n, count(*) - 1 AS surplus FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicates(t: Tables):
    return S.duplicates(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("coverage", """WITH m AS (SELECT max(doc_id) + 1 AS total FROM documents), c AS (SELECT source, count(DISTINCT doc_id) AS n FROM documents GROUP BY source)
    SELECT source, n AS n_items, total - n AS missing, n >= total AS complete, round(100.0 * n / total, 4) AS percent FROM c, m""")
def coverage(t: Tables):
    return S.coverage(t.documents.select("source", F.col("doc_id").alias("item")), "source", "item", t.documents.agg(F.max("doc_id")).first()[0] + 1)


@query(
    "missing_samples",
    """WITH g AS (SELECT DISTINCT l_suppkey FROM lineitem), m AS (SELECT l_suppkey, i AS item, row_number() OVER (PARTITION BY l_suppkey ORDER BY i) AS rn
    FROM g, range((SELECT max(p_partkey) + 1 FROM part)) r(i) WHERE (l_suppkey, i) NOT IN (SELECT l_suppkey, l_partkey FROM lineitem)) SELECT l_suppkey, item FROM m WHERE rn <= 5""",
)
def missing_samples(t: Tables):
    hi = t.part.agg(F.max("p_partkey")).first()[0] + 1
    rows = t.lineitem.select("l_suppkey", F.col("l_partkey").alias("item"))
    return S.missing_samples(rows, rows, "l_suppkey", "item", 0, hi, 5)


RANGES_SQL = """SELECT lo, hi, n, CASE WHEN lo = hi THEN printf('0x%04X', lo) ELSE printf('0x%04X-0x%04X', lo, hi) END AS text FROM
 (SELECT min(doc_id) AS lo, max(doc_id) AS hi, count(*) AS n FROM (SELECT doc_id, doc_id - row_number() OVER (ORDER BY doc_id) AS g FROM (SELECT DISTINCT doc_id FROM labels)) GROUP BY g)"""


@query("compact_ranges", RANGES_SQL)
def compact_ranges(t: Tables):
    return S.compact_ranges(t.labels, "doc_id")


@query("expand_ranges", "SELECT DISTINCT doc_id AS id FROM labels")
def expand_ranges(t: Tables):
    """Ranges and back: the ids the compact texts name."""
    return S.expand_ranges(S.compact_ranges(t.labels, "doc_id"), "text", limit=1 << 40).select("id")


@query(
    "expand_ranges_lenient",
    """WITH x AS (SELECT doc_id, doc_id % 50 AS lo, doc_id % 50 + doc_id % 7 - 1 AS hi FROM documents)
    SELECT DISTINCT doc_id, CAST(i AS BIGINT) AS id FROM (SELECT doc_id, unnest(range(lo, hi + 1)) AS i FROM x WHERE hi >= lo AND hi < 40)""",
)
def expand_ranges_lenient(t: Tables):
    """Per document a range text, some of them running backwards and so left out."""
    lo = F.col("doc_id") % 50
    text = F.concat(lo.cast("string"), F.lit(".."), (lo + F.col("doc_id") % 7 - 1).cast("string"), F.lit(" #"), F.col("doc_id").cast("string"))
    rows = t.documents.select("doc_id", F.regexp_replace(text, " #.*$", "").alias("text"))
    out = S.expand_ranges(rows.filter(~F.col("text").contains("..-")), "text", lenient=True, limit=40, keep=["doc_id"])
    return out.select("doc_id", "id").distinct()


@query(
    "set_overlap",
    """WITH a AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A'), r AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R')
    SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM r) AS n_b, count(*) AS shared, (SELECT count(*) FROM (FROM a UNION FROM r)) AS n_union,
    round(count(*) / (SELECT count(*) FROM (FROM a UNION FROM r)), 9) AS jaccard FROM a JOIN r USING (l_partkey)""",
)
def set_overlap(t: Tables):
    out = S.set_overlap(t.lineitem, "l_returnflag", "l_partkey", "A", "R")
    return out.select("n_a", "n_b", "shared", "n_union", r4("jaccard", "jaccard", 9))


@query("select_keys", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) ORDER BY o_orderkey LIMIT 100")
def select_keys(t: Tables):
    rich = t.customer.filter("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return S.select_keys(t.orders.select("o_orderkey", "o_custkey"), rich, "o_custkey", ["o_orderkey"], 100)
