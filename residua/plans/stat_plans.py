"""Distribution, concentration, variance and ranking plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordered as O
from ..operators import sketches as H
from ..operators import stats as S
from ..operators import topk as K
from ..operators import windows as W
from .base import Tables, cents, query, r4


@query(
    "histogram",
    "SELECT CAST(least(floor((c_acctbal + 1000) / 550), 19) AS BIGINT) AS bin, count(*) AS n FROM customer WHERE c_acctbal BETWEEN -1000 AND 10000 GROUP BY 1",
)
def histogram(t: Tables):
    return S.histogram(t.customer, "c_acctbal", -1000.0, 10000.0, 20)


@query("ecdf", "SELECT CAST(round(c_acctbal * 100) AS BIGINT) AS v, count(*) AS n, round(max(cd), 9) AS ecdf FROM (SELECT c_acctbal, cume_dist() OVER (ORDER BY CAST(round(c_acctbal * 100) AS BIGINT)) AS cd FROM customer) GROUP BY 1")
def ecdf(t: Tables):
    return S.ecdf(t.customer.select(cents("c_acctbal").alias("v")), "v").select("v", "n", r4("ecdf", "ecdf", 9))


@query("cume_dist_by_key", "SELECT o_orderkey, round(cume_dist() OVER (PARTITION BY o_custkey ORDER BY CAST(round(o_totalprice * 100) AS BIGINT)), 9) AS cd FROM orders")
def cume_dist_by_key(t: Tables):
    rows = t.orders.select("o_orderkey", "o_custkey", cents("o_totalprice").alias("v"))
    return O.OrderedFrame.of(rows, ["o_custkey"], ["v", "o_orderkey"]).cume_dist("cd").done().select("o_orderkey", r4("cd", "cd", 9))


@query("rank_curve", "SELECT c_custkey, row_number() OVER (ORDER BY CAST(round(c_acctbal * 100) AS BIGINT) DESC, c_custkey) AS rank FROM customer")
def rank_curve(t: Tables):
    return S.rank_curve(t.customer.select("c_custkey", cents("c_acctbal").alias("v")), "v", "c_custkey").select("c_custkey", "rank")


ORDER_CENTS = "o AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS v FROM orders)"


def order_cents(t: Tables):
    return t.orders.select("o_orderkey", cents("o_totalprice").alias("v"))


@query(
    "concentration",
    f"""WITH {ORDER_CENTS}, r AS (SELECT v, row_number() OVER (ORDER BY v DESC, o_orderkey) AS rn FROM o)
    SELECT CAST(k AS INTEGER) AS k, CAST(sum(v) AS BIGINT) AS held, round(sum(v) / (SELECT sum(v) FROM o), 9) AS share FROM r JOIN (SELECT unnest([1, 10, 100, 1000]) AS k) ON rn <= k GROUP BY k""",
)
def concentration(t: Tables):
    return S.concentration(order_cents(t), "v", "o_orderkey", [1, 10, 100, 1000]).select("k", "held", r4("share", "share", 9))


@query(
    "lorenz",
    f"""WITH {ORDER_CENTS}, r AS (SELECT sum(v) OVER (ORDER BY v, o_orderkey ROWS UNBOUNDED PRECEDING) AS run, row_number() OVER (ORDER BY v, o_orderkey) AS rn, count(*) OVER () AS n, sum(v) OVER () AS s FROM o),
    p AS (SELECT CAST(range AS BIGINT) AS point FROM range(1, 21))
    SELECT point, round(min(run) / any_value(s), 9) AS share FROM p JOIN r ON rn * 20 >= point * n GROUP BY point""",
)
def lorenz(t: Tables):
    return S.lorenz(order_cents(t), "v", "o_orderkey", 20).select("point", r4("share", "share", 9))


@query(
    "bands",
    """SELECT CASE WHEN v <= 255 THEN 'low' WHEN v >= 32768 THEN 'high' ELSE 'mid' END AS band, count(*) AS n, CAST(sum(v) AS BIGINT) AS total
    FROM (SELECT CAST(round(o_totalprice * 100) AS BIGINT) & 65535 AS v FROM orders) GROUP BY 1""",
)
def bands(t: Tables):
    return S.severity_bands(t.orders.select(cents("o_totalprice").bitwiseAND(65535).alias("v")), "v")


@query("share_running", f"WITH {ORDER_CENTS} SELECT o_orderkey, round(sum(v) OVER (ORDER BY v DESC, o_orderkey ROWS UNBOUNDED PRECEDING) / (SELECT sum(v) FROM o), 9) AS share FROM o")
def share_running(t: Tables):
    return W.share_running(order_cents(t), "v", "o_orderkey").select("o_orderkey", r4("share", "share", 9))


@query(
    "quantiles",
    """SELECT l_returnflag, min(v) AS min, max(v) AS max, round(avg(v), 4) AS mean, round(quantile_cont(v, 0.01), 4) AS p01, round(quantile_cont(v, 0.05), 4) AS p05,
    round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.95), 4) AS p95, round(quantile_cont(v, 0.99), 4) AS p99
    FROM (SELECT l_returnflag, CAST(round(l_extendedprice * 100) AS BIGINT) AS v FROM lineitem) GROUP BY l_returnflag""",
)
def quantiles(t: Tables):
    out = S.quantile_profile(t.lineitem.select("l_returnflag", cents("l_extendedprice").alias("v")), "v", ["l_returnflag"])
    return out.select("l_returnflag", "min", "max", *[r4(c, c) for c in ("mean", "p01", "p05", "median", "p95", "p99")])


@query(
    "variance_explained",
    """WITH g AS (SELECT l_partkey % 24 AS g, count(*) AS n, sum(CAST(l_quantity AS HUGEINT)) AS s, sum(CAST(l_quantity * l_quantity AS HUGEINT)) AS q FROM lineitem GROUP BY 1)
    SELECT CAST(sum(n) AS BIGINT) AS n, count(*) AS groups, round((sum(1.0 * s * s / n) - 1.0 * sum(s) * sum(s) / sum(n)) / (sum(q) - 1.0 * sum(s) * sum(s) / sum(n)), 8) AS r2 FROM g""",
)
def variance_explained(t: Tables):
    return S.variance_explained(t.lineitem, F.col("l_partkey") % 24, "l_quantity").select("n", "groups", r4("r2", "r2", 8))


@query(
    "transitions",
    """WITH b AS (SELECT user_id, CAST(value > 25 AS INTEGER) AS bit, lag(CAST(value > 25 AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events),
    a AS (SELECT user_id, count(*) AS n, CAST(sum(bit) AS BIGINT) AS ones, count(*) FILTER (bit <> prev) AS transitions FROM b GROUP BY user_id)
    SELECT user_id, n, ones, transitions, round(coalesce(transitions / nullif(2.0 * ones / n * (1 - ones / n) * (n - 1), 0), 0), 6) AS ratio FROM a""",
)
def transitions(t: Tables):
    out = S.transition_ratio(t.events, ["user_id"], ["event_id"], F.col("value") > 25)
    return out.select("user_id", "n", "ones", "transitions", r4("ratio", "ratio", 6))


@query(
    "unique_outcomes",
    """SELECT l_quantity, l_discount, l_tax, m, count(*) OVER w AS n, min(m) OVER w AS first_member, count(*) OVER w = 1 AS is_unique
    FROM (SELECT *, l_orderkey * 10 + l_linenumber AS m FROM lineitem) WINDOW w AS (PARTITION BY l_quantity, l_discount, l_tax)""",
)
def unique_outcomes(t: Tables):
    rows = t.lineitem.withColumn("m", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return S.unique_outcomes(rows, ["l_quantity", "l_discount", "l_tax"], "m")


@query("frequent_keys", """SELECT l_partkey, l_linenumber, count(*) AS n, round(count(*) / (SELECT count(*) FROM lineitem), 9) AS share,
 (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_linenumber FROM lineitem)) AS n_distinct FROM lineitem GROUP BY 1, 2 ORDER BY n DESC, l_partkey, l_linenumber LIMIT 50""")
def frequent_keys(t: Tables):
    out = K.frequent_keys(t.lineitem, ["l_partkey", "l_linenumber"], 50)
    return out.select("l_partkey", "l_linenumber", "n", r4("share", "share", 9), "n_distinct")


@query("approx_distinct")
def approx_distinct(t: Tables):
    return K.approx_distinct(t.lineitem, ["l_partkey", "l_suppkey"])


@query(
    "sketch_profile",
    """SELECT l_returnflag, count(*) AS n, min(l_extendedprice)::DOUBLE AS min, max(l_extendedprice)::DOUBLE AS max, count(DISTINCT (l_partkey, l_suppkey)) AS exact_distinct, true AS distinct_ok,
    true AS p01_ok, true AS p05_ok, true AS median_ok, true AS p95_ok, true AS p99_ok FROM lineitem GROUP BY 1""",
)
def sketch_profile(t: Tables):
    """Sketches kept by flag and line number, united by flag, and held against one exact pass."""
    keys = ["l_partkey", "l_suppkey"]
    kept = H.profile_sketches(t.lineitem, ["l_returnflag", "l_linenumber"], keys, "l_extendedprice")
    united = H.estimates(H.unite(kept, ["l_returnflag"]), ["l_returnflag"])
    return H.checked(t.lineitem, united, ["l_returnflag"], keys, "l_extendedprice").drop("n_values")


@query(
    "job_totals",
    """SELECT o_orderpriority AS prio, CAST(coalesce(sum(CASE WHEN coalesce(items, 0) = 0 THEN 1 ELSE items END) FILTER (st = 'complete'), 0) AS BIGINT) AS complete_items, count(*) FILTER (st <> 'complete') AS failed_jobs,
    CAST(sum(rec) AS BIGINT) AS records FROM (SELECT o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'P' THEN 'failed' ELSE 'running' END AS st,
    CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 7 END AS items, o_orderkey % 100 AS rec FROM orders) GROUP BY 1""",
)
def job_totals(t: Tables):
    st = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "P", "failed").otherwise("running")
    rows = t.orders.select(
        F.col("o_orderpriority").alias("prio"), st.alias("st"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 7).alias("items"), (F.col("o_orderkey") % 100).alias("rec")
    )
    return S.job_totals(rows, ["prio"], "st", "items", "rec")


@query(
    "throughput_by_setting",
    "SELECT event_type, count(*) FILTER (value > 10) AS completed, CAST(sum(user_id) AS BIGINT) AS records, round(sum(value), 2) AS elapsed, round(count(*) FILTER (value > 10) * 3600.0 / sum(value), 6) AS per_hour FROM events GROUP BY 1",
)
def throughput_by_setting(t: Tables):
    out = S.throughput_by_setting(t.events, "event_type", F.col("value") > 10, "user_id", "value")
    return out.select("event_type", "completed", "records", r4("elapsed", "elapsed", 2), r4("per_hour", "per_hour", 6))


@query("worst_n", "SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_discount > 0.05 GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 25")
def worst_n(t: Tables):
    return K.worst_n(t.lineitem.filter("l_discount > 0.05"), "l_partkey")


@query("order_schedule", "SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_totalprice, o_orderkey) AS position FROM orders")
def order_schedule(t: Tables):
    return W.schedule_rank(t.orders.select("o_custkey", "o_totalprice", "o_orderkey"), ["o_custkey", "o_totalprice", "o_orderkey"]).select("o_orderkey", "position")


@query(
    "sample_stride",
    """WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS p, count(*) OVER () AS n FROM part), i AS (SELECT DISTINCT i * ((SELECT count(*) FROM part) - 1) // 36 AS p FROM range(37) x(i))
    SELECT p_partkey FROM r JOIN i USING (p)""",
)
def sample_stride(t: Tables):
    return K.sample_keys(t.part.select("p_partkey"), ["p_partkey"], 37, "stride")


@query("sample_first", "SELECT p_partkey FROM part WHERE p_size = 7 UNION ALL (SELECT p_partkey FROM part WHERE p_size <> 7 ORDER BY p_partkey LIMIT (SELECT greatest(1, 100 - count(*)) FROM part WHERE p_size = 7))")
def sample_first(t: Tables):
    named = t.part.filter("p_size = 7").select("p_partkey")
    return K.sample_keys(t.part.select("p_partkey"), ["p_partkey"], 100, "first", named)


@query("page", "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 20 OFFSET 40")
def page(t: Tables):
    return K.page(t.part.select("p_partkey", "p_name"), ["p_name", "p_partkey"], 20, 40)


@query(
    "order_and_group",
    "SELECT * FROM (SELECT o_orderkey, o_custkey, dense_rank() OVER (ORDER BY o_custkey) AS group_no FROM orders) WHERE group_no <= 200",
)
def order_and_group(t: Tables):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    return K.order_and_group(rows, "seed", "o_custkey", "o_totalprice", "o_orderkey", "o_orderkey", 200).select("o_orderkey", "o_custkey", "group_no")


@query("recent_n", "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 12")
def recent_n(t: Tables):
    return K.recent(t.events, "us", "event_id", 12).select("event_id", "user_id")


@query("ranked_preview", """WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS a, row_number() OVER (ORDER BY event_id DESC) AS b FROM events)
    SELECT event_id, CASE WHEN a <= 10 THEN 'first' ELSE 'last' END AS side, greatest(0, (SELECT count(*) FROM events) - 20) AS omitted FROM r WHERE a <= 10 OR b <= 10""")
def ranked_preview(t: Tables):
    return W.ranked_preview(t.events.select("event_id"), ["event_id"], 10)
