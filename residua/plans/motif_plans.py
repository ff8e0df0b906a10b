"""Template matching and hit plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.traits import band_score, strength
from ..functions.vectors import cyclic_roll, dot, l2_norm, mean_centre, unit
from ..operators import motif as M
from .base import Tables, query, r4

UNIT_SQL = "list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / (sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) + 0.000001))"
MATCH_SQL = f"""WITH w AS (SELECT vec_id, {UNIT_SQL} AS v FROM embeddings), t AS (SELECT label, v FROM (SELECT label, vec_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1) JOIN w USING (vec_id)),
 s AS (SELECT w.vec_id, t.label, list_inner_product(w.v, t.v) AS score FROM w, t)"""


def unit_windows(t: Tables):
    return t.embeddings.select("vec_id", "label", unit("embedding").alias("vec"))


def first_templates(t: Tables):
    w = unit_windows(t)
    return w.groupBy("label").agg(F.min_by("vec", "vec_id").alias("vec"))


@query("template_match", MATCH_SQL + " SELECT vec_id, CAST(label AS VARCHAR) AS label, round(score, 6) AS score FROM s WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s.score DESC, label) = 1")
def template_match(t: Tables):
    out = M.template_match(unit_windows(t).drop("label"), first_templates(t), "vec", "label", 0.3)
    return out.select("vec_id", "label", r4("score", "score", 6))


@query("vector_udf", MATCH_SQL + " SELECT vec_id, CAST(arg_max(label, score) AS VARCHAR) AS label FROM s GROUP BY vec_id")
def vector_udf(t: Tables):
    """The same search with a library dealt into blocks, no threshold."""
    out = M.template_match(unit_windows(t).drop("label"), first_templates(t), "vec", "label", None, per_block=3)
    return out.select("vec_id", "label")


@query(
    "vector_math",
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT vec_id, round(sqrt(list_inner_product(v, v)), 6) AS norm, round(v[1] - list_sum(v) / len(v), 6) AS centred, v[63] AS rolled,
    round(list_inner_product(v, list_reverse(v)), 6) AS self_dot FROM e""",
)
def vector_math(t: Tables):
    return t.embeddings.select(
        "vec_id", r4(l2_norm("embedding"), "norm", 6), r4(F.element_at(mean_centre("embedding"), 1), "centred", 6),
        F.element_at(cyclic_roll("embedding", 2), 1).cast("double").alias("rolled"), r4(dot("embedding", F.reverse("embedding")), "self_dot", 6),
    )


@query("spectral")
def spectral(t: Tables):
    """Spectral rows of every embedding read as a short signal."""
    frames = M.frame_signal(t.embeddings, "vec_id", "embedding", 32, 8)
    out = M.spectral_features(frames, ["vec_id"], "idx", "frame", 32, 8, 11025)
    return out.select("vec_id", "idx", "t", F.round(l2_norm("vec"), 3).alias("norm"))


BAND_SQL = """CASE WHEN s <= 0 THEN 0 WHEN s <= 0.6e0 THEN round_even(s / 0.6e0 * 20, 0) WHEN s <= 0.7e0 THEN round_even(20 + (s - 0.6e0) / (0.7e0 - 0.6e0) * 35, 0) WHEN s <= 0.8e0 THEN round_even(55 + (s - 0.7e0) / (0.8e0 - 0.7e0) * 25, 0)
 WHEN s <= 0.9e0 THEN round_even(80 + (s - 0.8e0) / (0.9e0 - 0.8e0) * 15, 0) WHEN s <= 1 THEN round_even(95 + (s - 0.9e0) / (1 - 0.9e0) * 5, 0) ELSE 100 END"""
STRENGTH_SQL = "CASE WHEN s >= 0.9 THEN 'anchor' WHEN s >= 0.8 THEN 'strong' WHEN s >= 0.7 THEN 'clear' ELSE 'echo' END"


def scored_events(t: Tables):
    return t.events.select("event_id", "user_id", "event_type", ((F.col("event_id") * 37 % 1013) / 1000.0).alias("s"), "value")


@query("score_bands", f"SELECT event_id, CAST({BAND_SQL} AS INTEGER) AS confidence, {STRENGTH_SQL} AS strength FROM (SELECT event_id, event_id * 37 % 1013 / 1000e0 AS s FROM events)")
def score_bands(t: Tables):
    return scored_events(t).select("event_id", band_score("s").alias("confidence"), strength("s").alias("strength"))


@query("strength_summary", f"SELECT n.strength, count(e.strength) AS n FROM (SELECT unnest(['anchor', 'strong', 'clear', 'echo']) AS strength) n LEFT JOIN (SELECT {STRENGTH_SQL} AS strength FROM (SELECT event_id * 37 % 1013 / 1000e0 AS s FROM events)) e USING (strength) GROUP BY 1")
def strength_summary(t: Tables):
    return M.strength_summary(scored_events(t).select(strength("s").alias("strength")))


@query(
    "sanitize_hits",
    f"""WITH h AS (SELECT event_id, event_id * 37 % 1013 / 1000e0 AS s, greatest(0, user_id - 20.0) AS st, value AS en, user_id FROM events),
    c AS (SELECT event_id, s, st, CASE WHEN event_id % 9 = 0 THEN st ELSE greatest(st, en) END AS en, user_id FROM h)
    SELECT event_id, round(st, 3) AS start_seconds, round(en, 3) AS end_seconds, CASE WHEN event_id % 4 = 0 THEN 100 ELSE CAST({BAND_SQL} AS INTEGER) END AS confidence, {STRENGTH_SQL} AS strength,
    printf('%02d:%05.2f', CAST(floor(st / 60) AS INTEGER), st - 60 * floor(st / 60)) AS start, CASE WHEN event_id % 5 = 0 THEN '(unknown)' ELSE 'u' || user_id || '.mp3' END AS name FROM c""",
)
def sanitize_hits(t: Tables):
    k = F.col("event_id")
    hits = scored_events(t).select(
        "event_id", F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("/m/u"), F.col("user_id").cast("string"), F.lit(".mp3"))).alias("file"), F.lit(None).cast("string").alias("name"),
        (F.col("user_id") - 20.0).cast("string").alias("start_seconds"), F.when(k % 9 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("end_seconds"),
        F.col("s").alias("score"), F.when(k % 4 == 0, "250").when(k % 4 == 1, "bad").alias("confidence"), F.lit(None).cast("string").alias("strength"),
        F.lit("m").alias("matched_template"), F.lit("inf").alias("duration_seconds"),
    )
    return M.sanitize_hits(hits).select("event_id", "start_seconds", "end_seconds", "confidence", "strength", "start", "name")
