"""Ordered-row plans: runs, intervals, rates, stalls, collisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import motif as M
from ..operators import windows as W
from .base import Tables, cents, query, r4


@query("rle", """WITH c AS (SELECT user_id, event_id, event_type, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS chg FROM events),
 r AS (SELECT *, sum(chg) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM c)
 SELECT user_id, CAST(run AS BIGINT) AS run, any_value(event_type) AS event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM r GROUP BY user_id, run""")
def rle(t: Tables):
    return W.rle(t.events.select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], "event_type")


@query("rle_all", """WITH c AS (SELECT event_id, event_type, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (ORDER BY event_id) THEN 1 ELSE 0 END AS chg FROM events),
 r AS (SELECT *, sum(chg) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM c)
 SELECT CAST(run AS BIGINT) AS run, any_value(event_type) AS event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM r GROUP BY run""")
def rle_all(t: Tables):
    """Runs over the whole table as one sequence."""
    return W.rle(t.events.select("event_id", "event_type"), [], ["event_id"], "event_type")


@query("rle_roundtrip", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def rle_roundtrip(t: Tables):
    """Runs expanded again give every row back."""
    runs = W.rle(t.events.select("event_id", "event_type"), [], ["event_id"], "event_type")
    return W.expand_runs(runs, "event_type", "n").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("latest_per_key", "SELECT user_id, max(epoch_us(ts)) AS us, arg_max(event_id, ts) AS event_id, arg_max(event_type, ts) AS event_type FROM events GROUP BY user_id")
def latest_per_key(t: Tables):
    return W.latest_per_key(t.events, ["user_id"], "us", "event_id", ["event_type"]).select("user_id", "us", "event_id", "event_type")


for edge, sql_edge in (("repeat", "f"), ("zero", "0.0")):

    @query(
        f"moving_average_{edge}",
        f"""WITH w AS (SELECT event_type, event_id, value, first_value(value) OVER p AS f, last_value(value) OVER p AS l,
        lag(value, 2) OVER o AS a, lag(value, 1) OVER o AS b, lead(value, 1) OVER o AS c, lead(value, 2) OVER o AS d FROM events
        WINDOW p AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), o AS (PARTITION BY event_type ORDER BY event_id))
        SELECT event_id, round((coalesce(a, {sql_edge}) + coalesce(b, {sql_edge}) + value + coalesce(c, {sql_edge.replace('f', 'l')}) + coalesce(d, {sql_edge.replace('f', 'l')})) / 5, 6) AS avg FROM w""",
    )
    def moving_average(t: Tables, edge=edge):
        rows = t.events.select("event_type", "event_id", "value")
        return W.moving_average(rows, ["event_type"], ["event_id"], "value", 5, edge).select("event_id", r4("avg", "avg", 6))


@query(
    "sliding_vectors",
    """WITH r AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS idx, value, user_id FROM events),
    w AS (SELECT event_type, idx, list(value) OVER f AS vs, list(CAST(user_id AS DOUBLE)) OVER f AS us FROM r WINDOW f AS (PARTITION BY event_type ORDER BY idx ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
    c AS (SELECT event_type, idx, list_concat(vs, us) AS x, (list_sum(vs) + list_sum(us)) / 8 AS m, vs[1] AS v1 FROM w WHERE len(vs) = 4 AND idx % 2 = 0),
    n AS (SELECT event_type, idx, v1 - m AS first, sqrt(list_sum(list_transform(x, lambda v: (v - m) * (v - m)))) AS norm FROM c)
    SELECT event_type, idx, CAST(8 AS INTEGER) AS dims, round(first / (norm + 0.000001), 6) AS head, round(norm / (norm + 0.000001), 6) AS length FROM n""",
)
def sliding_vectors(t: Tables):
    """Windows of four events as unit vectors."""
    from ..functions.vectors import l2_norm
    from ..operators.ordered import with_row_number

    rows = with_row_number(t.events.select("event_type", "event_id", F.array("value", F.col("user_id").cast("double")).alias("vec")), ["event_type"], ["event_id"], "rn")
    out = W.sliding_vectors(rows.select("event_type", (F.col("rn") - 1).alias("idx"), "vec"), ["event_type"], "idx", "vec", 4, 2)
    return out.select("event_type", "idx", F.size("window").alias("dims"), r4(F.element_at("window", 1), "head", 6), r4(l2_norm("window"), "length", 6))


INTERVALS_SQL = "i AS (SELECT user_id, event_id, epoch_us(ts) AS st, epoch_us(ts) + CAST(round(value * 10000000) AS BIGINT) AS en FROM events)"


def intervals(t: Tables):
    length = F.round(F.col("value") * 10000000).cast("bigint")
    return t.events.select("user_id", "event_id", F.col("us").alias("st"), (F.col("us") + length).alias("en"), "value")


@query(
    "merge_intervals",
    f"""WITH {INTERVALS_SQL}, m AS (SELECT *, max(en) OVER (PARTITION BY user_id ORDER BY st, en, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
    g AS (SELECT *, sum(CASE WHEN reach IS NULL OR st > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY st, en, event_id ROWS UNBOUNDED PRECEDING) AS island FROM m)
    SELECT user_id, min(st) AS st, max(en) AS en, count(*) AS n FROM g GROUP BY user_id, island""",
)
def merge_intervals(t: Tables):
    return W.merge_intervals(intervals(t), ["user_id"], "st", "en", "event_id")


SUPPRESSED_SQL = f"""WITH RECURSIVE {INTERVALS_SQL}, h AS (SELECT i.user_id, i.event_id, st / 1e6 AS s, en / 1e6 AS e, events.value FROM i JOIN events USING (event_id)),
    c AS MATERIALIZED (SELECT a.event_id AS worse, b.event_id AS better FROM h a JOIN h b ON a.user_id = b.user_id AND (b.value > a.value OR (b.value = a.value AND b.event_id < a.event_id))
     AND (abs(a.s - b.s) < 600 OR greatest(a.s, b.s) < least(a.e, b.e))),
    p AS (SELECT 0 AS round, event_id FROM h UNION ALL SELECT * FROM (
     WITH live AS (SELECT x.round, worse, better FROM c JOIN p x ON x.event_id = worse JOIN p y ON y.event_id = better)
     SELECT DISTINCT round + 1, worse FROM live WHERE worse NOT IN (SELECT worse FROM live WHERE better NOT IN (SELECT worse FROM live)))),
    final AS (SELECT event_id, max(round) AS round FROM p GROUP BY 1)
    SELECT h.* FROM h JOIN final USING (event_id) WHERE NOT EXISTS (SELECT 1 FROM c JOIN p ON p.event_id = c.better WHERE c.worse = h.event_id AND p.round = final.round)"""


@query("suppress_overlaps", SUPPRESSED_SQL)
def suppress_overlaps(t: Tables):
    """Best-first suppression of event intervals per user."""
    rows = intervals(t).select("user_id", "event_id", (F.col("st") / 1e6).alias("s"), (F.col("en") / 1e6).alias("e"), "value")
    return M.suppress_overlaps(rows, "user_id", "s", "e", "value", "event_id", 600.0)


@query(
    "monotonic",
    """WITH p AS (SELECT o_orderkey, o_custkey, epoch(o_orderdate) AS a, CAST(round(o_totalprice) AS BIGINT) AS b, lag(epoch(o_orderdate)) OVER w AS pa, lag(CAST(round(o_totalprice) AS BIGINT)) OVER w AS pb FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
    SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(CASE WHEN a < pa THEN 'a-decreases' ELSE 'b-decreases' END, o_orderkey) AS violation FROM p WHERE a < pa OR b < pb GROUP BY o_custkey""",
)
def monotonic(t: Tables):
    rows = t.orders.select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("timestamp").cast("bigint").alias("a"), F.round("o_totalprice").cast("bigint").alias("b"))
    broken = W.check_monotonic(rows, ["o_custkey"], ["o_orderkey"], "a", "b")
    return W.first_violation(broken, ["o_custkey"], ["o_orderkey"])


@query(
    "frame_delta",
    """SELECT l_orderkey, max(v) FILTER (l_linenumber = 2) - max(v) FILTER (l_linenumber = 1) AS delta FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS v FROM lineitem)
    WHERE l_linenumber IN (1, 2) GROUP BY l_orderkey HAVING count(DISTINCT l_linenumber) = 2""",
)
def frame_delta(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", cents("l_extendedprice").alias("v"), F.lit(0).alias("p"))
    return W.frame_delta(rows, ["l_orderkey"], "l_linenumber", 1, 2, "v", "p").filter("delta IS NOT NULL")


@query(
    "frame_deltas",
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag AS p, CAST(round(l_extendedprice * 100) AS BIGINT) AS v FROM lineitem WHERE l_linenumber IN (1, 2)),
    b AS (SELECT l_orderkey, max(CASE WHEN l_linenumber = 1 THEN {'p': p, 'v': v} END) AS x, max(CASE WHEN l_linenumber = 2 THEN {'p': p, 'v': v} END) AS y FROM r GROUP BY 1)
    SELECT l_orderkey, CASE WHEN x.p = y.p THEN y.v - x.v ELSE 0 END AS delta, CASE WHEN x IS NULL THEN 'first-missing' WHEN y IS NULL THEN 'last-missing' WHEN x.p <> y.p THEN 'other-partition' ELSE '' END AS problem FROM b""",
)
def frame_deltas(t: Tables):
    """Orders whose first two lines were returned differently have no delta."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", cents("l_extendedprice").alias("v"), "l_returnflag")
    out = W.frame_deltas(rows, ["l_orderkey"], "l_linenumber", 1, 2, "v", "l_returnflag")
    return out.select("l_orderkey", F.coalesce("delta", F.lit(0)).alias("delta"), F.coalesce("problem", F.lit("")).alias("problem"))


@query(
    "recent_rate",
    """SELECT user_id, count(*) AS n, max(epoch_us(ts)) - min(epoch_us(ts)) AS elapsed, round((count(*) - 1) / (max(epoch_us(ts)) - min(epoch_us(ts))) * 3600, 15) AS per_hour FROM
    (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 50 GROUP BY user_id""",
)
def recent_rate(t: Tables):
    return W.recent_rate(t.events, ["user_id"], "us", "event_id", 50).select("user_id", "n", "elapsed", r4("per_hour", "per_hour", 15))


@query(
    "progress_rate",
    """WITH c AS (SELECT user_id, event_id, epoch_us(ts) AS us, event_id % 97 AS complete FROM events),
    l AS (SELECT *, lag(complete) OVER (PARTITION BY user_id ORDER BY us, event_id) AS prev FROM c),
    s AS (SELECT *, sum(CASE WHEN prev IS NULL OR complete < prev THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS sess FROM l),
    b AS (SELECT *, first_value(us) OVER w AS t0, first_value(complete) OVER w AS c0 FROM s WINDOW w AS (PARTITION BY user_id, sess ORDER BY us, event_id))
    SELECT event_id, greatest(0, complete - c0) AS gained, round(CASE WHEN us > t0 AND complete > c0 THEN (complete - c0) / (CAST(us AS DOUBLE) - t0) * 3600 ELSE -1 END, 12) AS per_hour,
    CASE WHEN NOT (us > t0 AND complete > c0) THEN 'warming up' WHEN complete - c0 < 5 THEN 'wide' WHEN complete - c0 < 24 THEN 'medium' ELSE 'narrow' END AS confidence FROM b""",
)
def progress_rate(t: Tables):
    rows = t.events.select("user_id", "event_id", "us", (F.col("event_id") % 97).alias("complete"))
    out = W.progress_rate(rows, ["user_id"], "us", "event_id", "complete", 1000)
    return out.select("event_id", "gained", r4(F.coalesce("per_hour", F.lit(-1.0)), "per_hour", 12), "confidence")


@query(
    "stall_flags",
    """SELECT event_id, coalesce(d > CASE WHEN p > 0 THEN greatest(p * 2.25, p + 1800) ELSE 7200.0 END, false) AS stalled FROM
    (SELECT event_id, value * 100 AS d, lag(value * 100) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)""",
)
def stall_flags(t: Tables):
    rows = t.events.select("user_id", "event_id", (F.col("value") * 100).alias("d"))
    return W.stall_flags(rows, ["user_id"], ["event_id"], "d").select("event_id", "stalled")


@query(
    "resolve_collisions",
    "SELECT o_orderkey, k, first_value(o_orderkey) OVER (PARTITION BY k ORDER BY o_custkey, o_orderkey) AS kept, row_number() OVER (PARTITION BY k ORDER BY o_custkey, o_orderkey) = 1 AS is_kept FROM (SELECT *, o_orderkey % 1000 AS k FROM orders)",
)
def resolve_collisions(t: Tables):
    rows = t.orders.select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 1000).alias("k"))
    return W.resolve_collisions(rows, "k", ["o_custkey", "o_orderkey"], "o_orderkey").select("o_orderkey", "k", "kept", "is_kept")
