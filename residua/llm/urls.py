"""URL filter: rules first, then a character language-model ratio.

Two variable-order Markov models of characters, smoothed by Witten-Bell interpolation, are learned from
all URLs that rules accept and reject. A URL that no rule fits is judged by the difference of its two log-likelihoods divided
by its length, against a threshold calibrated on labelled URLs held out of the counts.

The models are a table with a row for each distinct n-gram of any URL, never gathered in one place. An n-gram's probability comes from
that of its tail, one character shorter, so levels are joined from the shortest up. URLs are judged in batches dealt by hash:
a batch asks for each of its distinct n-grams once, however many of its URLs have it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORDER = 5
ALPHABET = 1 << 16
GRAMS_HELD = 500_000
BATCHES, BATCH_CHARS = 1024, 200_000
START, STOP = "\x02", "\x03"
Rule = tuple[str, str]


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(rules: Sequence[Rule], host: str = "host", path: str = "path") -> Column:
    """The longest rule that fits, else null. A rule is a host, all its subdomains included, and the start of a path."""
    tests = []
    for rule, _ in sorted(rules, key=lambda r: -len(r[0])):
        name, slash, rest = rule.partition("/")
        at_host = (F.col(host) == name) | F.endswith(F.col(host), F.lit("." + name))
        tests.append(F.when(at_host & F.startswith(F.col(path), F.lit(slash + rest)), F.lit(rule)))
    return F.coalesce(*tests, F.lit(None).cast("string"))


def _grams(order: int):
    """Rows (text, good, bad) to n-grams and how often each side has them, 0 where a text only asks for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            sides = [pa.array([n[j] for n in counts.values()], pa.int64()) for j in range(2)]
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *sides], ["gram", "good", "bad"])

        for batch in batches:
            for url, good, bad in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = START + url + STOP
                for i in range(1, len(text)):
                    for n in range(min(order, i) + 1):
                        at = counts.setdefault(text[i - n : i + 1], [0, 0])
                        at[0] += good
                        at[1] += bad
                if len(counts) > GRAMS_HELD:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    return run


def _longest(url: str, order: int) -> list[str]:
    """Each character of a text after as many as the model looks back."""
    text = START + url + STOP
    return [text[max(0, i - order) : i + 1] for i in range(1, len(text))]


def log_ratios(texts: DataFrame, order: int) -> DataFrame:
    """``gram``, ``ratio``: log-likelihood difference of the last character after the others, for all n-grams of ``texts`` that scoring asks for.

    ``texts`` has ``text`` and how often it counts for each side, ``good`` and ``bad``. Witten-Bell: a context gives its unseen
    characters as much weight as it has seen distinct ones, so p(gram) = own + back * p(tail).
    """
    counts = texts.select("text", "good", "bad").mapInArrow(_grams(order), "gram string, good long, bad long")
    counts = checkpointed(counts.groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")))
    counts = counts.withColumn("size", F.char_length("gram")).withColumn("context", F.expr("left(gram, size - 1)"))
    totals = counts.groupBy("context").agg(*[f(side).alias(f"{side}_{name}") for side in ("good", "bad") for name, f in (("all", F.sum), ("seen", lambda c: F.count_if(F.col(c) > 0)))])

    def weights(side: str) -> list[Column]:
        whole = F.col(f"{side}_all") + F.col(f"{side}_seen")
        return [F.when(whole > 0, F.col(side) / whole).otherwise(0.0).alias(f"{side}_own"), F.when(whole > 0, F.col(f"{side}_seen") / whole).otherwise(1.0).alias(f"{side}_back")]

    weighed = checkpointed(counts.join(totals, "context").select("gram", "size", *weights("good"), *weights("bad")))
    p = lambda side, tail: (F.col(f"{side}_own") + F.col(f"{side}_back") * tail).alias(side)
    level = weighed.filter("size = 1").select("gram", "size", *[p(side, F.lit(1 / ALPHABET)) for side in ("good", "bad")])
    levels = level
    for k in range(1, order + 1):
        shorter = level.select(F.col("gram").alias("tail"), F.col("good").alias("good_tail"), F.col("bad").alias("bad_tail"))
        longer = weighed.filter(F.col("size") == k + 1).withColumn("tail", F.substring("gram", 2, k)).join(shorter, "tail")
        level = checkpointed(longer.select("gram", "size", *[p(side, F.col(f"{side}_tail")) for side in ("good", "bad")]))
        levels = levels.unionByName(level)
    asked = levels.filter((F.col("size") == order + 1) | F.startswith("gram", F.lit(START)))
    return asked.select("gram", (F.log("good") - F.log("bad")).alias("ratio"))


def scored(texts: DataFrame, order: int) -> DataFrame:
    """``texts``, each text once, with ``score``: its log-likelihood difference per character."""
    chars = texts.agg(F.sum(F.char_length("text") + 1)).first()[0] or 0
    batches = max(BATCHES, math.ceil(chars / BATCH_CHARS))
    dealt = texts.withColumn("batch", F.pmod(F.xxhash64("text", F.lit("batch")), F.lit(batches)))

    def ask(rows: pa.Table) -> pa.Table:
        grams = list(dict.fromkeys(g for t in rows["text"].to_pylist() for g in _longest(t, order)))
        return pa.table([pa.repeat(rows["batch"][0], len(grams)), pa.array(grams, pa.string())], ["batch", "gram"])

    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        ratio = dict(zip(answers["gram"].to_pylist(), answers["ratio"].to_pylist(), strict=True))
        found = [[ratio[g] for g in _longest(t, order)] for t in rows["text"].to_pylist()]
        return rows.drop_columns(["batch"]).append_column("score", pa.array([sum(x) / len(x) for x in found], pa.float64()))

    asked = dealt.select("batch", "text").groupBy("batch").applyInArrow(ask, "batch long, gram string")
    answers = asked.join(log_ratios(texts, order), "gram").select("batch", "gram", "ratio")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema)
    return dealt.select(*texts.columns, "batch").groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(score, f"{fields}, score double")


def judged(pages: DataFrame, rules: Sequence[Rule], page_id: str = "page_id", url: str = "url", order: int = ORDER) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``score`` of every row.

    The models count all characters of all URLs that rules fit, as often as they occur, but for a fifth of the URLs, chosen by hash, that
    is kept for the threshold: the mean of the two sides' mean scores. A side with so few URLs that one of these two parts
    is empty has all its URLs in that part. A null URL has an empty host and path, and is judged as an empty text.
    With no labelled URL on one side all scores are 0 and all other URLs are allowed. Repeated rows are judged alike.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url")), "text": F.coalesce("url", F.lit(""))}).withColumn("rule", fitting_rule(rules))
    allow = [r for r, verdict in rules if verdict == "allow"]
    texts = rows.groupBy("text").agg(F.count("*").alias("n"), F.min(F.col("rule").isin(allow)).alias("side"))
    texts = checkpointed(texts.withColumn("held", F.pmod(F.xxhash64("text"), F.lit(1 << 30)) % 5 == 0))
    sides = texts.filter("side is not null").groupBy("side").agg(F.count_if("held").alias("held"), F.count_if(~F.col("held")).alias("counted")).collect()
    verdict = F.when(F.col("rule").isin(allow), "allow").when(F.col("rule").isNotNull(), "block")
    if len(sides) < 2:
        return rows.select("page_id", "host", "path", "rule", verdict.otherwise("allow").alias("verdict"), F.lit(0.0).alias("score"))
    whole = lambda part: F.coalesce(F.col("side").isin([r["side"] for r in sides if not r[part]]), F.lit(False))
    counts = ~F.col("held") | whole("counted")
    times = lambda side: F.when(counts & (F.col("side") == side), F.col("n")).otherwise(0)
    judging = texts.select("text", "n", "side", (F.col("held") | whole("held")).alias("calibrates"), times(True).alias("good"), times(False).alias("bad"))
    found = checkpointed(scored(judging, order))
    means = found.filter("calibrates and side is not null").groupBy("side").agg((F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("m")).collect()
    threshold = sum(r["m"] for r in means) / 2
    out = rows.join(found.select("text", "score"), "text")
    return out.select("page_id", "host", "path", "rule", verdict.when(F.col("score") >= threshold, "allow").otherwise("block").alias("verdict"), "score")
