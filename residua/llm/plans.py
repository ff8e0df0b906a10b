"""The queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, language, lines, mixture, near, negatives, pieces, recompress, resample, search, suffixes, tokenfile, urls
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query(
    "op4_exact_dedup",
    r"""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
    g AS (SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS r, count(*) OVER (PARTITION BY text_sha256) AS group_size,
      first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id FROM d)
    SELECT doc_id, keep_id, group_size, r = 1 AS kept, text_sha256 FROM g""",
)
def exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, folder, "documents"))


@query("op7_mixture")
def mixture_plan(spark: SparkSession, folder: str) -> DataFrame:
    sizes = table(spark, folder, "documents").select("doc_id", "source", mixture.words().alias("size"))
    plan = mixture.draw(sizes)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("bigint").alias("taken"), "copies", "shards")


@query("op1_pieces")
def piece_digests(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.token_digests(table(spark, folder, "documents"), pieces.model_bytes(public_tokenizers.path("piece_bpe_32k.model")))


@query(
    "op3_top_k",
    """WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, r.vec_id AS vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(r.v AS DOUBLE[])) AS BIGINT) AS score
      FROM p q JOIN p r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20""",
)
def nearest(spark: SparkSession, folder: str) -> DataFrame:
    return search.top_k(table(spark, folder, "embeddings"))


#: Fixed by the contract of the query.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


@query("op8_url_filter")
def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judged(table(spark, folder, "pages"), URL_RULES)


@query(
    "op9_line_dedup",
    r"""WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
    k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
    f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
    m AS (SELECT k.*, f.last IS NOT NULL AND f.last <> k.doc_id AS gone FROM k LEFT JOIN f USING (key))
    SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INTEGER)) AS BIGINT) AS n_dropped,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id""",
)
def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = lines.drop_repeated_lines(table(spark, folder, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


@query("op2_near_dedup")
def near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near.near_duplicates(table(spark, folder, "documents"))


@query("op5_language")
def languages(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return language.predicted(docs, language.fitted(docs))


@query(
    "op6_substring_dedup",
    r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    s AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 18), lambda p: {'p': p, 'k': array_to_string(ws[p:p + 19], ' ')})) AS x FROM w),
    f AS (SELECT doc_id, x.p AS p, row_number() OVER (PARTITION BY x.k ORDER BY doc_id, x.p) > 1 AS again FROM s),
    g AS (SELECT DISTINCT doc_id, p + unnest(range(0, 20)) AS i FROM f WHERE again),
    x AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS word FROM w),
    k AS (SELECT x.doc_id, count(g.i) AS gone, string_agg(word, ' ' ORDER BY x.i) FILTER (WHERE g.i IS NULL) AS kept FROM x LEFT JOIN g ON x.doc_id = g.doc_id AND x.i = g.i GROUP BY x.doc_id)
    SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)""",
)
def substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = recompress.without_repeated_words(table(spark, folder, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


@query("op10_suffix_dedup")
def suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = suffixes.without_repeated_bytes(table(spark, folder, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: CRC-32 of each distinct word: a table of 256 entries by eight shifts, folded over the word's bytes.
RESAMPLE_SQL = r"""WITH RECURSIVE c(i, k, v) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL
      SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM c WHERE k < 8),
    crc AS (SELECT list(v ORDER BY i) AS tab FROM c WHERE k = 8),
    d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
    b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
    dw AS (SELECT doc_id, unnest(ws) AS w FROM d), bw AS (SELECT unnest(ws) AS w FROM b),
    u AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
    k AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
      lambda a, y: xor(tab[(xor(a, y) & 255) + 1], a >> 8)), 4294967295) % 10000 AS bucket FROM u, crc),
    s AS (SELECT bucket, count(*) AS n FROM dw JOIN k USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM bw JOIN k USING (w) GROUP BY bucket),
    n AS (SELECT coalesce((SELECT sum(n) FROM s), 0) AS s_all, coalesce((SELECT sum(n) FROM t), 0) AS t_all),
    g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((s.n + 1)::DOUBLE * (t_all + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), n),
    m AS (SELECT doc_id, count(*) AS f, sum(gain) AS total FROM dw JOIN k USING (w) JOIN g USING (bucket) GROUP BY doc_id),
    r AS (SELECT d.doc_id, len(ws) AS n_words, CAST(coalesce(f, 0) AS BIGINT) AS n_features, CAST(coalesce(floor(total / f), 0) AS BIGINT) AS weight,
      CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT)::DOUBLE AS h FROM d LEFT JOIN m USING (doc_id)),
    q AS (SELECT doc_id, n_words, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM r)
    SELECT doc_id, n_features, weight, score, CAST(n_words AS BIGINT) AS n_words,
      CASE WHEN n_words >= 20 AND row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) <= 10 * count(*) OVER (PARTITION BY n_words >= 20) // 100
        THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS rank FROM q"""


@query("op13_resample", RESAMPLE_SQL)
def resample_plan(spark: SparkSession, folder: str) -> DataFrame:
    return resample.resampled(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op11_token_files")
def token_files(spark: SparkSession, folder: str) -> DataFrame:
    return tokenfile.digests(table(spark, folder, "documents"), pieces.model_bytes(public_tokenizers.path("byte_bpe_50k.json")))


@query(
    "op12_hard_negatives",
    """WITH p AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS anchor_id, r.vec_id AS vec_id, q.label = r.label AS same, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(r.v AS DOUBLE[])) AS BIGINT) AS score
      FROM p q JOIN p r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id),
    a AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
    n AS (SELECT a.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY a.anchor_id, a.positive_id ORDER BY s.score DESC, s.vec_id) AS r
      FROM a JOIN s ON s.anchor_id = a.anchor_id AND NOT s.same AND 50 * a.positive_score <= 100 * s.score AND 100 * s.score <= 95 * a.positive_score)
    SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE r <= 3""",
)
def hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mined(rows.select("vec_id", "embedding", noisy.alias("label")))
