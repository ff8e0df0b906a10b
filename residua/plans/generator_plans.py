"""Generator-stream plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import candidates as C
from ..functions import generator as G
from ..operators import schedule as D
from ..operators import windows as W
from .base import Tables, lcg_sql, query

SEED = 12345
M, INC, INV = G.MULTIPLIER, G.INCREMENT, G.MULTIPLIER_INVERSE


@query(
    "generator_stream",
    f"""SELECT event_id, CAST(s AS BIGINT) AS state, CAST((s * {M} + {INC}) % 4294967296 AS BIGINT) AS next, CAST((((s - {INC} + 4294967296) % 4294967296) * {INV}) % 4294967296 AS BIGINT) AS previous,
    CAST(s >> 16 AS BIGINT) AS output, event_id AS distance FROM {lcg_sql('events', str(SEED), 'event_id', 24)}""",
)
def generator_stream(t: Tables):
    rows = t.events.select("event_id", G.lcg_at(F.lit(SEED), "event_id").alias("state"))
    return rows.select(
        "event_id", "state", G.lcg_next("state").alias("next"), G.lcg_previous("state").alias("previous"), G.lcg_output("state").alias("output"),
        G.lcg_distance(F.lit(SEED), "state").alias("distance"),
    )


@query("first_occurrence", f"SELECT CAST(s >> 16 AS BIGINT) % 512 AS upper, min(event_id) AS step FROM {lcg_sql('events', str(SEED), 'event_id', 24)} GROUP BY 1")
def first_occurrence(t: Tables):
    stream = t.events.select(F.col("event_id").alias("step"), (G.lcg_output(G.lcg_at(F.lit(SEED), "event_id")) % 512).alias("upper"))
    return W.first_occurrence(stream, ["upper"], ["step"], [])


@query(
    "distance",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN user_id % 40 WHEN event_id % 3 = 1 THEN -(user_id % 40) ELSE user_id END AS full_distance,
    CASE WHEN event_id % 3 = 2 AND user_id > 60 THEN -999 ELSE CASE WHEN event_id % 3 = 0 THEN user_id % 40 WHEN event_id % 3 = 1 THEN -(user_id % 40) ELSE user_id END END AS drift FROM events""",
)
def distance(t: Tables):
    """Drift of a state moved a known number of steps, and whether it lies in the window."""
    k = F.col("event_id")
    moved = F.when(k % 3 == 0, F.col("user_id") % 40).when(k % 3 == 1, -(F.col("user_id") % 40)).otherwise(F.col("user_id"))
    rows = t.events.select("event_id", moved.alias("full_distance"), (k * 2654435 % 4294967296).alias("a"))
    rows = rows.withColumn("b", G.lcg_at("a", F.col("full_distance")))
    return rows.select("event_id", "full_distance", F.coalesce(G.signed_distance("a", "b", 60), F.lit(-999)).alias("drift"))


@query("nearest_seed")
def nearest_seed(t: Tables):
    rows = t.events.select("event_id", (F.col("event_id") * 2654435761 % 4294967296).alias("state"))
    return rows.withColumn("_n", G.nearest_small_state("state", 200000)).select("event_id", "state", "_n.seed", "_n.steps")


def _calibrate_sql() -> str:
    moved = lambda k: "CAST(s * {} + {} AS HUGEINT) % 4294967296 >> 16".format(*G.jump_constants(k))
    hits = ", ".join(f"CASE WHEN ({moved(k)}) = observed THEN {abs(14 + k - 20) * 100 + 14 + k} END" for k in range(13))
    base = "(SELECT event_id, user_id, (event_id * 7919) % 4294967296 AS st, user_id * 2 + 14 AS lo, user_id % 9 + 2 AS extra FROM events)"
    true_at = " ".join(f"WHEN {k} THEN ({moved(k)})" for k in range(2, 11))
    seen = f"(SELECT *, CASE extra {true_at} END AS observed FROM {lcg_sql(base, 'st', 'lo', 16)})"
    return f"SELECT event_id, CAST(least({hits}) % 100 AS INTEGER) AS offset FROM {seen}"


@query("calibrate_offset", _calibrate_sql())
def calibrate_offset(t: Tables):
    """Recover the commit offset of each stream from one observed output."""
    rows = t.events.select("event_id", "user_id", (F.col("event_id") * 7919 % 4294967296).alias("state"), (F.col("user_id") * 2).alias("base"))
    rows = rows.withColumn("observed", G.lcg_output(G.lcg_at("state", F.col("base") + F.col("user_id") % 9 + 16)))
    return G.calibrate_offset(rows, "state", "base", "observed", 20, 6).select("event_id", "offset")


@query(
    "lookahead",
    f"""WITH st AS (SELECT event_id, CAST(s AS BIGINT) AS s FROM {lcg_sql('events', str(SEED), 'event_id', 24)}),
    k AS (SELECT event_id, 1 AS k, (CAST(s AS HUGEINT) * {G.jump_constants(1)[0]} + {G.jump_constants(1)[1]}) % 4294967296 AS x FROM st
    UNION ALL SELECT event_id, 2, (CAST(s AS HUGEINT) * {G.jump_constants(2)[0]} + {G.jump_constants(2)[1]}) % 4294967296 FROM st
    UNION ALL SELECT event_id, 3, (CAST(s AS HUGEINT) * {G.jump_constants(3)[0]} + {G.jump_constants(3)[1]}) % 4294967296 FROM st)
    SELECT event_id, k, p_size AS value FROM k JOIN part ON p_partkey = CAST(x >> 16 AS BIGINT) % (SELECT count(*) FROM part)""",
)
def lookahead(t: Tables):
    """Table value at each of the next three states of a row's generator."""
    rows = t.events.select("event_id", G.lcg_at(F.lit(SEED), "event_id").alias("state"))
    table = t.part.select(F.col("p_partkey").alias("slot"), F.col("p_size").alias("value"))
    slots = t.part.agg(F.count(F.lit(1))).first()[0]
    return C.lookahead_value(rows, "state", 3, table, "slot", slots).select("event_id", "k", "value")


#: The stream of ``SEED`` has shown every 16-bit output before this step (a test counts them), so the twin needs no more.
ALL_SHOWN = 1 << 20


@query(
    "schedule_lead",
    f"""WITH st AS (SELECT i, s FROM {lcg_sql(f'(SELECT CAST(range AS BIGINT) AS i FROM range(5, {ALL_SHOWN}))', str(SEED), 'i', 20)}),
    f AS (SELECT CAST(s >> 16 AS BIGINT) AS upper, min(i) AS step FROM st GROUP BY 1)
    SELECT upper, step, step - 5 AS input_delta FROM (SELECT DISTINCT o_orderkey & 65535 AS upper FROM orders) LEFT JOIN f USING (upper)""",
)
def schedule_lead(t: Tables):
    """First stream step with at least five steps of lead for every order key."""
    targets = t.orders.select(F.col("o_orderkey").bitwiseAND(65535).alias("upper"))
    return D.schedule_with_lead(targets, "upper", SEED, 5).drop("problem")


@query("schedule_frames", "SELECT o_orderkey, o_orderkey + 25 AS step, o_orderkey + 10 AS input_delta FROM orders")
def schedule_frames(t: Tables):
    rows = t.orders.select("o_orderkey", (F.col("o_orderkey") + 30).alias("frame"), (F.col("o_orderkey") + 15).alias("input"))
    return D.schedule_from_frames(rows, "frame", "input", 5).select("o_orderkey", "step", "input_delta")


@query("candidate_table")
def candidate_table(t: Tables):
    """Candidate packed values of every part key under the inheritance rule."""
    states = t.part.select(F.col("p_partkey").alias("upper"), G.lcg_at(F.lit(SEED), "p_partkey").alias("state"))
    classes = C.shifted_classes([1, 2, 4, 5, 6, 7, 8, 9], [("iv", 0), ("inherit", 2)], 2)
    return C.candidate_values(states, "upper", "state", classes, [31, 30, 29, 28, 27, 26], [1, 2, 3, 4, 5, 6], [0, 1, 2, 5, 3, 4])
