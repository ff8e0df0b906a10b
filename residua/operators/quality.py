"""Validation rules, findings, counters, digests and verification joins."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import OrderedFrame, first_n_per_group, join_on

# Severity ranks.
SEVERITY_RANK = {"ok": 0, "info": 0, "warning": 1, "critical": 2}


def validate_record(df: DataFrame, rules: Sequence[tuple[str, Column]], out: str = "error") -> DataFrame:
    """First failing rule per row (rules are (code, is_bad) in order); null when all hold."""
    error = None
    for code, bad in rules:
        error = F.when(bad, code) if error is None else error.when(bad, code)
    return df.withColumn(out, error)


def rule_findings(df: DataFrame, rules: Sequence[tuple[str, str, Column]], keep: Sequence[str]) -> DataFrame:
    """One row per finding; rules are (severity, code, holds) and several may fire per row."""
    hits = F.array(*[F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(k).alias("code"))) for s, k, c in rules])
    return df.select(*keep, F.explode(hits).alias("_f")).filter(F.col("_f").isNotNull()).select(*keep, "_f.*")


def severity_rank(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    out = F.lit(0)
    for name, rank in SEVERITY_RANK.items():
        if rank:
            out = F.when(c == name, rank).otherwise(out)
    return out


def worst_severity(df: DataFrame, keys: Sequence[str], severity: str = "severity") -> DataFrame:
    """Highest severity per key; ``ok`` and ``info`` count alike and read ``ok``."""
    top = F.max(severity_rank(severity))
    name = F.when(F.col("_r") == 2, "critical").when(F.col("_r") == 1, "warning").otherwise("ok")
    return df.groupBy(*keys).agg(top.alias("_r")).withColumn("status", name).drop("_r")


def quality_counters(df: DataFrame, code: str, value: str, n: int) -> DataFrame:
    """Count per error code with the ``n`` smallest sample values."""
    bad = df.filter(F.col(code).isNotNull())
    counts = bad.groupBy(code).agg(F.count(F.lit(1)).alias("n"))
    few = first_n_per_group(bad.select(code, value), [code], [value], n)
    few = few.groupBy(code).agg(F.array_sort(F.collect_list(value)).alias("samples"))
    return join_on(counts, few, [code])


def settled_filter(df: DataFrame, size_ok: Column, age_seconds: Column, settle: float) -> DataFrame:
    """Size-mismatched files are ``unsettled`` while young, ``bad-size`` after; the rest ``ok``."""
    state = F.when(size_ok, "ok").when(age_seconds < settle, "unsettled").otherwise("bad-size")
    return df.withColumn("state", state)


def content_digest(df: DataFrame, content: str) -> DataFrame:
    c = F.col(content)
    return df.withColumns({"sha1": F.sha1(c), "sha256": F.sha2(c, 256), "crc32": F.crc32(c)})


def ordered_digest(df: DataFrame, keys: Sequence[str], order: Sequence[str], row_text: Column) -> DataFrame:
    """SHA-256 of ``[row,row,...]`` over a group's row texts in order, whatever the group's size.

    A task streams its sorted rows through the hash and holds one Arrow batch, never a group. The digest of one
    group is sequential by nature; use :func:`digest_tree` where a group is to be hashed in parallel.
    """
    texts = df.select(*keys, *order, row_text.alias("_text"))
    rows = (texts.repartition(*keys) if keys else texts.repartition(1)).sortWithinPartitions(*keys, *order).select(*keys, "_text")
    names = list(keys)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, digest, empty = None, None, True
        for batch in batches:
            done: list[tuple] = []
            columns = [batch.column(i).to_pylist() for i in range(len(names))]
            for *key, text in zip(*columns, batch.column(len(names)).to_pylist(), strict=True):
                if digest is None or key != group:
                    if digest is not None:
                        digest.update(b"]")
                        done.append((*group, digest.hexdigest()))
                    group, digest, empty = key, hashlib.sha256(b"["), True
                if text is not None:
                    digest.update(text.encode() if empty else b"," + text.encode())
                    empty = False
            if done:
                yield _records(done, batch.schema, names)
            schema = batch.schema
        if digest is not None:
            digest.update(b"]")
            yield _records([(*group, digest.hexdigest())], schema, names)

    fields = ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)
    return rows.mapInArrow(hashed, f"{fields}, digest string" if names else "digest string")


def _records(rows: list[tuple], schema: pa.Schema, names: list[str]) -> pa.RecordBatch:
    columns = [pa.array([r[i] for r in rows], schema.field(i).type) for i in range(len(names))]
    return pa.RecordBatch.from_arrays([*columns, pa.array([r[-1] for r in rows], pa.string())], [*names, "digest"])


def digest_tree(df: DataFrame, keys: Sequence[str], order: Sequence[str], row_text: Column, fanout: int = 4096, rows: int | None = None) -> DataFrame:
    """Hash tree over a group's row texts in order: chunks of ``fanout`` positions, then chunks of their digests, until
    one is left. A group's levels follow its own size, so no other group changes its digest.
    """
    texts = df.select(*keys, *order, row_text.alias("_text"))
    level = OrderedFrame.of(texts, keys, order, rows).row_number("_pos").done()
    level = level.select(*keys, (F.col("_pos") - 1).alias("_pos"), "_text")
    biggest = level.agg(F.max("_pos")).first()[0] or 0
    done = None
    while True:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_text"))), lambda r: r["_text"])
        digest = F.sha2(F.concat(F.lit("["), F.concat_ws(",", ordered), F.lit("]")), 256)
        level = level.groupBy(*keys, F.floor(F.col("_pos") / fanout).alias("_chunk")).agg(digest.alias("_text"))
        if biggest < fanout:
            out = level.select(*keys, F.col("_text").alias("digest"))
            return out if done is None else done.unionByName(out)
        level = level.withColumnRenamed("_chunk", "_pos")
        chunks = level.groupBy(*keys).agg(F.count(F.lit(1)).alias("_chunks"))
        sized = join_on(level, chunks, keys) if keys else level.crossJoin(F.broadcast(chunks))
        ready = sized.filter("_chunks = 1").select(*keys, F.col("_text").alias("digest"))
        done = ready if done is None else done.unionByName(ready)
        level = sized.filter("_chunks > 1").drop("_chunks")
        biggest //= fanout


def verify_manifest(manifest: DataFrame, artifacts: DataFrame, key: str) -> DataFrame:
    """Manifest rows checked against artifacts: the first failing check, else ``ok``.

    Manifest: key, path, sha, completed, complete. Artifacts: key, a_path, a_sha, a_count.
    """
    out = manifest.join(artifacts, key, "left")
    done = F.col("completed") == F.col("a_count")
    reason = (
        F.when(F.col("a_path").isNull(), "missing-file")
        .when(F.lower("a_sha") != F.lower("sha"), "hash-mismatch")
        .when(~done, "count-mismatch")
        .when(F.col("complete") != done, "complete-flag-mismatch")
        .when(F.col("a_path") != F.col("path"), "non-canonical-path")
        .otherwise("ok")
    )
    return out.withColumn("reason", reason)


def tree_diff(left: DataFrame, right: DataFrame, path: str, digest: str) -> DataFrame:
    """added / removed / changed / unchanged by path and digest."""
    a = left.select(path, F.col(digest).alias("_a"), F.lit(1).alias("_ia"))
    b = right.select(path, F.col(digest).alias("_b"), F.lit(1).alias("_ib"))
    state = (
        F.when(F.col("_ia").isNull(), "added")
        .when(F.col("_ib").isNull(), "removed")
        .when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged")
        .otherwise("changed")
    )
    return a.join(b, path, "full_outer").select(path, state.alias("state"))


def compare_sequences(a: DataFrame, b: DataFrame, keys: Sequence[str], idx: str, fields: Sequence[str]) -> DataFrame:
    """Per sequence: equal length, and the first index where the compared fields differ."""
    left = a.select(*keys, idx, F.struct(*fields).alias("_a"), F.lit(1).alias("_ia"))
    right = b.select(*keys, idx, F.struct(*fields).alias("_b"), F.lit(1).alias("_ib"))
    both = left.join(right, [*keys, idx], "full_outer")
    differs = F.col("_ia").isNull() | F.col("_ib").isNull() | ~F.col("_a").eqNullSafe(F.col("_b"))
    return (
        both.groupBy(*keys)
        .agg(
            F.count("_ia").alias("left_len"),
            F.count("_ib").alias("right_len"),
            F.min(F.when(differs, F.col(idx))).alias("first_diff"),
        )
        .withColumn("same_length", F.col("left_len") == F.col("right_len"))
        .withColumn("equal", F.col("first_diff").isNull())
    )


def compare_reports(left: DataFrame, right: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Rows present in both reports with the right-minus-left delta of each measure."""
    a = left.select(*keys, *[F.col(m).alias(f"left_{m}") for m in measures])
    b = right.select(*keys, *[F.col(m).alias(f"right_{m}") for m in measures])
    out = a.join(b, list(keys))
    return out.withColumns({f"{m}_delta": F.col(f"right_{m}") - F.col(f"left_{m}") for m in measures})


def compare_facts(left: DataFrame, right: DataFrame, field: str = "field", value: str = "value") -> DataFrame:
    """Full field comparison of two (field, value) text tables; delta where both parse as numbers."""
    out = left.select(field, F.col(value).alias("left")).join(right.select(field, F.col(value).alias("right")), field, "full_outer")
    number = lambda c: F.replace(F.col(c), F.lit(","), F.lit("")).try_cast("double")
    delta = number("right") - number("left")
    return out.select(
        field, F.coalesce("left", F.lit("")).alias("left"), F.coalesce("right", F.lit("")).alias("right"),
        F.when(delta.isNull(), "").otherwise(F.format_string("%.3f", delta)).alias("delta"),
    )


def observation_audit(df: DataFrame, checks: Sequence[tuple[str, Column]]) -> DataFrame:
    """Mismatch counters over observations (null counts as a mismatch)."""
    return df.agg(
        F.count(F.lit(1)).alias("checked"),
        *[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in checks],
    )


def value_histograms(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row counts per value of each listed column, in one pass (null reads ``none``)."""
    rows = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("none")).alias(c) for c in columns])
    agg = rows.groupingSets([[c] for c in columns], *columns).agg(
        F.count(F.lit(1)).alias("n"), *[F.grouping(c).alias(f"_g_{c}") for c in columns]
    )
    name = F.coalesce(*[F.when(F.col(f"_g_{c}") == 0, c) for c in columns])
    value = F.coalesce(*[F.when(F.col(f"_g_{c}") == 0, F.col(c)) for c in columns])
    return agg.select(name.alias("field"), value.alias("value"), "n")


def top_signatures(df: DataFrame, signature: str, n: int) -> DataFrame:
    return (
        df.filter(F.col(signature).isNotNull())
        .groupBy(signature)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), signature)
        .limit(n)
    )


def rename_plan(df: DataFrame, source: str, target: Column, key: str = "target", expected: int | None = None) -> DataFrame:
    """Target per source key, colliding targets marked.

    Collisions are counted by an aggregate and joined back, so a target that draws a third of
    all sources is combined before the shuffle.
    """
    plan = df.select(source).distinct().withColumn(key, target)
    counts = plan.groupBy(key).agg(F.count(F.lit(1)).alias("n_sources"), F.min(source).alias("keeper"))
    out = plan.join(counts, key)
    out = out.withColumns({"collides": F.col("n_sources") > 1, "keeps_name": F.col(source) == F.col("keeper")})
    if expected is not None:
        n = counts.count()
        if n < expected:
            raise ValueError(f"plan covers {n} of {expected} targets")
    return out.drop("keeper")


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """Fail when a key occurs twice."""
    bad = df.groupBy(key).count().filter("count > 1").limit(1).collect()
    if bad:
        raise ValueError(f"duplicate {key}: {bad[0][0]}")
    return df
