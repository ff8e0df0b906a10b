"""Residual analysis plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import changed_count, percent
from ..operators import residual as R
from ..operators import stats as S
from ..operators import topk as K
from .base import BEST_SQL, CAND_SQL, FACT_SQL, MODEL_SQL, Tables, changed_sql, query, r4

MISS_SQL = f"WITH {FACT_SQL}, {MODEL_SQL}, scored AS (SELECT lane, upper, actual, predicted, actual IS DISTINCT FROM predicted AS miss FROM fact LEFT JOIN model USING (upper))"
CLASS_SQL = f"WITH {FACT_SQL}, {CAND_SQL}, {BEST_SQL}, k AS (SELECT lane, f.upper, actual, coalesce(b.class_id, -1) AS class_id FROM fact f LEFT JOIN best b ON f.upper = b.upper AND f.actual = b.value)"


def scored(t: Tables):
    return R.residual_vs_model(t.fact, t.model, "upper")


def classified(t: Tables):
    return R.classify_first_match(t.fact, t.candidates, "upper", "actual")


@query(
    "residual_by_mod",
    """WITH m AS (SELECT p_brand, avg(l_extendedprice) AS expected FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand),
    pm AS (SELECT p_partkey, expected FROM part JOIN m USING (p_brand)),
    s AS (SELECT l_partkey % 24 AS mod24, CASE WHEN abs(l_extendedprice - expected) > 0.5 * expected THEN 1 ELSE 0 END AS miss
          FROM lineitem JOIN pm ON l_partkey = p_partkey)
    SELECT mod24, CAST(sum(miss) AS BIGINT) AS hits, count(*) AS cells, round(100.0 * sum(miss) / count(*), 4) AS rate FROM s GROUP BY mod24""",
)
def residual_by_mod(t: Tables):
    """Misses of a per-brand price model by column key mod 24."""
    lines = t.lineitem.select("l_partkey", "l_extendedprice")
    part = t.part.select("p_partkey", "p_brand")
    per_part = lines.groupBy("l_partkey").agg(F.sum("l_extendedprice").alias("s"), F.count("l_extendedprice").alias("n"))
    model = per_part.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg((F.sum("s") / F.sum("n")).alias("expected"))
    by_part = part.join(model, "p_brand").select(F.col("p_partkey").alias("l_partkey"), "expected")
    fact = lines.join(by_part, "l_partkey")
    miss = (F.abs(F.col("l_extendedprice") - F.col("expected")) > F.col("expected") * 0.5).cast("int")
    rated = S.rate_by_feature(fact.select("l_partkey", miss.alias("hits"), F.lit(1).alias("cells")), F.col("l_partkey") % 24, "hits", "cells", "mod24")
    return rated.select("mod24", "hits", "cells", r4("rate", "rate"))


@query(
    "class_report",
    CLASS_SQL
    + """, c AS (SELECT lane, class_id, count(*) AS n FROM k GROUP BY GROUPING SETS ((lane, class_id), (class_id))),
    t AS (SELECT lane, count(*) AS total, count(*) FILTER (class_id >= 0) AS matched FROM k GROUP BY GROUPING SETS ((lane), ()))
    SELECT coalesce(c.lane, -1) AS lane, class_id, n, total, matched, total - matched AS unmatched, round(100.0 * n / total, 4) AS percent
    FROM c JOIN t ON c.lane IS NOT DISTINCT FROM t.lane""",
)
def class_report(t: Tables):
    out = R.class_report(classified(t), "lane")
    return out.select(F.coalesce("lane", F.lit(-1)).alias("lane"), "class_id", "n", "total", "matched", "unmatched", r4("percent", "percent"))


@query(
    "corrected_totals",
    CLASS_SQL + " SELECT c AS class_id, count(*) AS n FROM (SELECT CASE WHEN lane % 10 = 0 THEN -1 ELSE class_id END AS c FROM k) GROUP BY 1 UNION ALL SELECT DISTINCT class_id, 0 FROM k WHERE class_id NOT IN (SELECT CASE WHEN lane % 10 = 0 THEN -1 ELSE class_id END FROM k)",
)
def corrected_totals(t: Tables):
    """Class totals after every tenth lane turned out unclassified: old counts, less what left a class, plus what came."""
    rows = classified(t)
    report = R.class_report(rows, "lane").filter("scope = 'all'").select("class_id", "n")
    turned = rows.filter("lane % 10 = 0").groupBy("class_id").agg(F.count(F.lit(1)).alias("c"))
    moves = turned.select(F.inline(F.array(F.struct("class_id", (-F.col("c")).alias("delta")), F.struct(F.lit(-1).alias("class_id"), F.col("c").alias("delta")))))
    return R.corrected_totals(report, moves).select("class_id", F.col("n").cast("bigint").alias("n"))


@query(
    "offset_coverage",
    CLASS_SQL
    + """ SELECT count(*) AS total, count(*) FILTER (class_id BETWEEN 0 AND 14) AS matched_0_14, count(*) FILTER (class_id BETWEEN 1 AND 14) AS matched_1_14,
    count(*) FILTER (class_id BETWEEN 1 AND 15) AS matched_1_15, count(*) FILTER (class_id = 0) AS offset_0, count(*) FILTER (class_id = 7) AS offset_7,
    round(100.0 * count(*) FILTER (NOT class_id BETWEEN 0 AND 14) / count(*), 4) AS left_0_14_pct FROM k""",
)
def offset_coverage(t: Tables):
    out = R.offset_coverage(classified(t))
    return out.select("total", "matched_0_14", "matched_1_14", "matched_1_15", "offset_0", "offset_7", r4("left_0_14_pct", "left_0_14_pct"))


@query(
    "nearest_candidate",
    f"""WITH {FACT_SQL}, {CAND_SQL}, {MODEL_SQL}, options AS (SELECT * FROM cand UNION ALL SELECT upper, 16, predicted FROM model),
    d AS (SELECT lane, fact.upper, actual, class_id, {changed_sql('actual', 'value')} AS distance,
       row_number() OVER (PARTITION BY fact.lane, fact.upper, actual ORDER BY {changed_sql('actual', 'value')}, class_id) AS rn
       FROM (SELECT DISTINCT * FROM fact) fact JOIN options ON fact.upper = options.upper)
    SELECT lane, class_id, distance, count(*) AS n FROM fact JOIN (SELECT * FROM d WHERE rn = 1) b USING (lane, upper, actual) GROUP BY lane, class_id, distance""",
)
def nearest_candidate(t: Tables):
    near = R.nearest_candidate(t.fact, t.candidates, "upper", "actual", 16, t.model)
    return near.groupBy("lane", "class_id", "distance").agg(F.count(F.lit(1)).alias("n"))


@query(
    "select_baseline",
    f"""WITH {FACT_SQL}, {CAND_SQL}, {MODEL_SQL}, s AS (SELECT lane % 24 AS grp, {changed_sql('actual', 'value')} AS a, {changed_sql('actual', 'predicted')} AS b
    FROM fact JOIN (SELECT upper, value FROM cand WHERE class_id = 0) USING (upper) JOIN model USING (upper))
    SELECT grp, count(*) FILTER (b < a) AS second_selected, count(*) FILTER (NOT b < a) AS first_selected, CAST(sum(a) AS BIGINT) AS changed_first,
    CAST(sum(b) AS BIGINT) AS changed_second, CAST(sum(least(a, b)) AS BIGINT) AS changed_selected FROM s GROUP BY grp""",
)
def select_baseline(t: Tables):
    base = t.candidates.filter("class_id = 0").select("upper", F.col("value").alias("first"))
    rows = t.fact.join(base, "upper").join(t.model, "upper")
    chosen = R.select_baseline(rows, "actual", "first", "predicted").withColumn("grp", F.col("lane") % 24)
    return R.baseline_totals(chosen, ["grp"])


def error_cells(t: Tables):
    """Users' hours of day with an error event, and all users."""
    cells = t.events.select(F.col("user_id").alias("lane"), F.floor(F.col("us") / 3600000000).cast("bigint").alias("h"), "event_type")
    cells = cells.select("lane", (F.col("h") % 24).alias("item"), "event_type")
    return cells.filter("event_type = 'error'").select("lane", "item"), cells.select("lane")


RULE_SQL = """WITH e AS (SELECT user_id AS lane, (epoch_us(ts) // 3600000000) % 24 AS item, event_type FROM events),
 miss AS (SELECT DISTINCT lane, item FROM e WHERE event_type = 'error'), lanes AS (SELECT DISTINCT lane, lane % 5 AS grp FROM e),
 sizes AS (SELECT grp, count(*) AS group_size FROM lanes GROUP BY grp),
 rules AS (SELECT grp, item, n, group_size, n * 2 > group_size AS rule, CASE WHEN n * 2 > group_size THEN group_size - n ELSE n END AS errors
   FROM (SELECT lane % 5 AS grp, item, count(*) AS n FROM miss GROUP BY 1, 2) JOIN sizes USING (grp))"""


@query("majority_rule", RULE_SQL + " SELECT grp, item, n, group_size, rule, errors FROM rules")
def majority_rule(t: Tables):
    miss, lanes = error_cells(t)
    return R.majority_rule(miss, lanes, "lane", "item", F.col("lane") % 5).select("grp", "item", "n", "group_size", "rule", "errors")


@query(
    "rule_summary",
    RULE_SQL + " SELECT count(*) FILTER (rule) AS predicted_cells, CAST(sum(errors) AS BIGINT) AS residual_errors, min(group_size) AS group_size_min, max(group_size) AS group_size_max FROM rules",
)
def rule_summary(t: Tables):
    miss, lanes = error_cells(t)
    return R.rule_summary(R.majority_rule(miss, lanes, "lane", "item", F.col("lane") % 5))


@query(
    "rule_residual",
    RULE_SQL
    + """, pred AS (SELECT lane, item FROM lanes JOIN (SELECT grp, item FROM rules WHERE rule) USING (grp))
    SELECT * , 'missed_only' AS side FROM (SELECT lane, item FROM miss EXCEPT SELECT lane, item FROM pred)
    UNION ALL SELECT *, 'predicted_only' FROM (SELECT lane, item FROM pred EXCEPT SELECT lane, item FROM miss)""",
)
def rule_residual(t: Tables):
    from ..operators.delta import rule_residual as residual

    miss, lanes = error_cells(t)
    rules = R.majority_rule(miss, lanes, "lane", "item", F.col("lane") % 5).filter("rule").select("grp", "item")
    predicted = lanes.distinct().withColumn("grp", F.col("lane") % 5).join(rules, "grp").select("lane", "item")
    return residual(miss.distinct(), predicted, ["lane", "item"])


@query(
    "marginals",
    MISS_SQL
    + """ SELECT CASE WHEN g = 1 THEN 'lane' WHEN g = 2 THEN 'upper' ELSE 'all' END AS axis, CASE WHEN g = 1 THEN lane WHEN g = 2 THEN upper ELSE -1 END AS key, misses, cells
    FROM (SELECT lane, upper, grouping(lane, upper) AS g, count(*) FILTER (miss) AS misses, count(*) AS cells FROM scored GROUP BY GROUPING SETS ((lane), (upper), ()))""",
)
def marginals(t: Tables):
    return R.marginal_counts(scored(t), "lane", "upper", F.col("miss"))


@query(
    "band_split",
    f"""WITH {FACT_SQL}, p AS (SELECT upper >> 8 AS band, lane % 24 AS mod24, lane & 255 AS low FROM fact)
    SELECT coalesce(band, -1) AS band, coalesce(mod24, -1) AS mod24, coalesce(low, -1) AS low, count(*) AS n FROM p GROUP BY GROUPING SETS ((band), (mod24), (low, mod24))""",
)
def band_split(t: Tables):
    return R.band_split_totals(t.fact, "lane", "upper")


@query(
    "changed_histogram",
    f"""WITH {FACT_SQL}, {MODEL_SQL}, s AS (SELECT xor(actual, predicted) AS x, {changed_sql('actual', 'predicted')} AS changed FROM fact JOIN model USING (upper))
    SELECT changed, count(*) AS n, """
    + ", ".join(f"count(*) FILTER (((x >> {s}) & 31) <> 0) AS field_{i}" for i, s in enumerate((0, 5, 10, 20, 25, 15)))
    + " FROM s GROUP BY changed",
)
def changed_histogram(t: Tables):
    return R.changed_histogram(t.fact.join(t.model, "upper"), "actual", "predicted")


@query(
    "residual_keys",
    f"""WITH {FACT_SQL}, {MODEL_SQL}, m AS (SELECT actual, xor(actual, predicted) AS x FROM fact JOIN model USING (upper)),
    k AS (SELECT """
    + " | ".join(f"(CASE WHEN ((x >> {s}) & 31) <> 0 THEN {1 << i} | (((actual >> {s}) & 31) << {6 + 5 * i}) ELSE 0 END)" for i, s in enumerate((0, 5, 10, 20, 25, 15)))
    + """ AS residual FROM m) SELECT CAST(residual AS BIGINT) AS residual, count(*) AS n, round(count(*) / (SELECT count(*) FROM k), 6) AS share,
    (SELECT count(DISTINCT residual) FROM k) AS n_distinct FROM k GROUP BY residual ORDER BY n DESC, residual LIMIT 20""",
)
def residual_keys(t: Tables):
    """Most frequent composite residuals."""
    rows = R.residual_columns(t.fact.join(t.model, "upper"), "actual", "predicted")
    return K.frequent_keys(rows.select("residual"), ["residual"], 20).select("residual", "n", r4("share", "share", 6), "n_distinct")


@query(
    "best_layout",
    """WITH i AS (SELECT DISTINCT l_suppkey AS lane, l_partkey AS upper FROM lineitem), r AS (SELECT lane, upper, upper - row_number() OVER (PARTITION BY lane ORDER BY upper) AS g FROM i),
    s AS (SELECT lane, count(DISTINCT g) AS runs, count(*) AS present FROM r GROUP BY lane),
    z AS (SELECT lane, runs, present, (d + 7) // 8 AS bitmap_bytes, present * 2 AS indices_bytes, (d - present) * 2 + 1 AS inverse_bytes, runs * 4 AS ranges_bytes FROM s, (SELECT max(p_partkey) + 1 AS d FROM part))
    SELECT *, least(bitmap_bytes, indices_bytes, inverse_bytes, ranges_bytes) AS best_bytes, CASE least(bitmap_bytes, indices_bytes, inverse_bytes, ranges_bytes)
    WHEN bitmap_bytes THEN 'bitmap' WHEN indices_bytes THEN 'indices' WHEN inverse_bytes THEN 'inverse' ELSE 'ranges' END AS layout FROM z""",
)
def best_layout(t: Tables):
    return R.best_layout(t.fact, "lane", "upper", t.part.agg(F.max("p_partkey")).first()[0] + 1)


@query(
    "index_list_bytes",
    """WITH o AS (SELECT l_partkey >> 8 AS band, l_partkey, count(DISTINCT l_suppkey) AS ones FROM lineitem GROUP BY 1, 2)
    SELECT band, CAST(1280 + 2 * sum(least(ones, (SELECT count(DISTINCT l_suppkey) FROM lineitem) - ones)) AS BIGINT) AS bytes FROM o GROUP BY band""",
)
def index_list_bytes(t: Tables):
    lanes = t.fact.agg(F.count_distinct("lane")).first()[0]
    return R.index_list_bytes(t.fact.withColumn("band", F.shiftright("upper", 8)), "band", "lane", "upper", lanes)


@query(
    "rate_by_feature",
    """WITH f AS (SELECT l_orderkey & 65535 AS u, CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS hit FROM lineitem),
    x AS (SELECT u * 10 // 65536 AS decile, (u >> 12) & 15 AS high_nibble, CASE WHEN u = 0 THEN 16 ELSE bit_count((u & -u) - 1) END AS trailing_zeros, u % 24 AS mod24, hit FROM f),
    y AS (SELECT 'decile' AS feature, decile AS v, hit FROM x UNION ALL SELECT 'high_nibble', high_nibble, hit FROM x
      UNION ALL SELECT 'trailing_zeros', trailing_zeros, hit FROM x UNION ALL SELECT 'mod24', mod24, hit FROM x)
    SELECT feature, CAST(v AS BIGINT) AS value, CAST(sum(hit) AS BIGINT) AS hits, count(*) AS cells, round(100.0 * sum(hit) / count(*), 4) AS rate FROM y GROUP BY feature, v""",
)
def rate_by_feature(t: Tables):
    rows = t.lineitem.select(F.col("l_orderkey").bitwiseAND(65535).alias("u"), (F.col("l_discount") > 0.05).cast("int").alias("hit"), F.lit(1).alias("one"))
    out = S.rates_by_features(rows, S.key_features("u"), "hit", "one")
    return out.select("feature", "value", "hits", "cells", r4("rate", "rate"))


@query(
    "rate_matrix",
    "SELECT l_partkey % 24 AS row, "
    + ", ".join(
        f"round(coalesce(100.0 * count(*) FILTER (l_linenumber = {i} AND l_discount > 0.05) / nullif(count(*) FILTER (l_linenumber = {i}), 0), 0), 4) AS rate_{i}"
        for i in range(1, 8)
    )
    + " FROM lineitem GROUP BY 1",
)
def rate_matrix(t: Tables):
    rows = t.lineitem.select("l_partkey", "l_linenumber", (F.col("l_discount") > 0.05).cast("int").alias("hit"), F.lit(1).alias("one"))
    out = S.rate_matrix(rows, F.col("l_partkey") % 24, F.col("l_linenumber"), range(1, 8), "hit", "one")
    return out.select("row", *[r4(f"rate_{i}", f"rate_{i}") for i in range(1, 8)])


@query(
    "marker_rates",
    """SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS status,
    round(coalesce(1.0 * count(*) FILTER (l_quantity > 25 AND l_discount > 0.05) / nullif(count(*) FILTER (l_quantity > 25), 0), 0), 6) AS rate_marked,
    round(coalesce(1.0 * count(*) FILTER (NOT l_quantity > 25 AND l_discount > 0.05) / nullif(count(*) FILTER (NOT l_quantity > 25), 0), 0), 6) AS rate_unmarked
    FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""",
)
def marker_rates(t: Tables):
    rows = t.lineitem.select("l_returnflag", "l_linestatus", "l_quantity", (F.col("l_discount") > 0.05).cast("int").alias("hit"), F.lit(1).alias("one"))
    out = S.marker_rates(rows, ["l_returnflag", "l_linestatus"], F.col("l_quantity") > 25, "hit", "one")
    return out.select(
        F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("status"),
        r4("rate_marked", "rate_marked", 6), r4("rate_unmarked", "rate_unmarked", 6),
    )


@query(
    "observation_audit",
    f"""WITH {FACT_SQL}, {MODEL_SQL} SELECT count(*) AS checked, count(*) FILTER (actual & 31 IS DISTINCT FROM predicted & 31) AS number_mismatch,
    count(*) FILTER (actual & 32 IS DISTINCT FROM predicted & 32) AS status_mismatch FROM fact LEFT JOIN model USING (upper)""",
)
def observation_audit(t: Tables):
    from ..operators.quality import observation_audit as audit

    low = lambda c, m: F.col(c).bitwiseAND(m)
    rows = t.fact.join(t.model, "upper", "left")
    return audit(rows, [("number_mismatch", low("actual", 31) == low("predicted", 31)), ("status_mismatch", low("actual", 32) == low("predicted", 32))])


@query(
    "lane_failures",
    """SELECT l_suppkey AS lane, count(*) FILTER (l_quantity >= 50) AS a, count(*) FILTER (l_discount = 0 AND l_tax = 0 AND l_linenumber = 7) AS b,
    CAST(least(count(*) FILTER (l_quantity >= 50), 1) + least(count(*) FILTER (l_discount = 0 AND l_tax = 0 AND l_linenumber = 7), 1) AS INTEGER) AS failed_counters FROM lineitem GROUP BY 1
    HAVING count(*) FILTER (l_quantity >= 50) + count(*) FILTER (l_discount = 0 AND l_tax = 0 AND l_linenumber = 7) > 0""",
)
def lane_failures(t: Tables):
    bad = (F.col("l_discount") == 0) & (F.col("l_tax") == 0) & (F.col("l_linenumber") == 7)
    rows = t.lineitem.select(F.col("l_suppkey").alias("lane"), (F.col("l_quantity") >= 50).cast("int").alias("a"), bad.cast("int").alias("b"))
    return S.lane_failures(rows, "lane", ["a", "b"])


@query("hotspots", "SELECT 'l_quantity' AS stage, round(sum(l_quantity), 2) AS total FROM lineitem UNION ALL SELECT 'l_linenumber', round(sum(l_linenumber), 2) FROM lineitem")
def hotspots(t: Tables):
    return S.hotspots(t.lineitem, ["l_quantity", "l_linenumber"]).select("stage", r4("total", "total", 2))


@query(
    "candidate_distance_percent",
    f"""WITH {FACT_SQL}, {MODEL_SQL} SELECT lane, round(100.0 * count(*) FILTER ({changed_sql('actual', 'predicted')} > 1) / count(*), 4) AS far_percent FROM fact JOIN model USING (upper) GROUP BY lane""",
)
def candidate_distance_percent(t: Tables):
    rows = t.fact.join(t.model, "upper").groupBy("lane").agg(F.count_if(changed_count("actual", "predicted") > 1).alias("far"), F.count(F.lit(1)).alias("n"))
    return rows.select("lane", r4(percent("far", "n"), "far_percent"))
