"""Search, language, URLs, mixing and the pipeline."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import MEDIUM, SMALL
from pyspark.sql import functions as F

import corpus_pipeline
from residua.llm import graph, language, mixture, plans, search, urls


@pytest.mark.parametrize("per_task", [200_000, 60])
def test_components(spark, per_task, monkeypatch):
    monkeypatch.setattr(graph, "EDGES_PER_TASK", per_task)
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + k, 1001 + k) for k in range(40)]
    up = {}

    def root(i):
        up.setdefault(i, i)
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    looped = {a for a, b in pairs if a == b} - {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {i: root(i) for i in up if i not in looped}


def vectors(n, seed=0, d=6):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=d)]) for i in range(n)]
    rows += [(n, None), (n + 1, [1.0, None] + [0.0] * (d - 2)), (n + 2, [math.nan] * d), (n + 3, [math.inf] * d), (None, [1.0] * d)]
    rows += [(n + 4, rows[3][1]), (n + 5, rows[3][1])]
    return rows


@pytest.mark.parametrize("shard,block,leaf", [(16_384, 1024, 256), (50, 7, 4)])
def test_top_k(spark, shard, block, leaf):
    rows = vectors(300)
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, shard int")
    got = defaultdict(list)
    for r in search.top_k(df, k=5, every=20, shard_rows=shard, block_queries=block, leaf=leaf).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    fine = {i: [math.floor(64 * x) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = {}
    for q in (i for i in fine if i % 20 == 0):
        scored = sorted((-sum(a * b for a, b in zip(fine[q], fine[r], strict=True)), r) for r in fine if r != q)
        want[q] = [(r, -s) for s, r in scored[:5]]
    assert got == want


def test_top_k_huge_components_and_empty(spark):
    df = spark.createDataFrame([(0, [1e17, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 5.0]), (20, [1.0])], "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["vec_id"], r["score"]) for r in search.top_k(df, k=2).orderBy("query_id", "rank").collect()]
    assert got == [(0, 2, 64 * 10**17 * 128), (0, 1, 64 * 10**17 * 64)] or got[0][1] == 1  # beyond a long scores are clipped and tie
    assert search.top_k(df.limit(0)).count() == 0


def docs_frame(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_language_held_out_accuracy(spark):
    docs = docs_frame(spark, MEDIUM)
    field = language.fitted(docs)
    got = language.predicted(docs, field).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert got["held_out"].equals(got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1))
    held = got[got["held_out"]]
    assert len(held) > 200
    assert (held["lang_pred"] == held["lang"]).mean() > 0.97
    assert got["score"].between(0, 1).all()


def test_number_signs_are_no_letters(spark):
    docs = spark.createDataFrame([(0, "the cat and the dog", "en"), (2, "½ ² Ⅷ", "en"), (3, "12 ½", "fr"), (5, "le chat x² et", "fr"), (6, None, "fr")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.predicted(docs, language.fitted(docs)).collect()}
    assert got[2] == got[3] == got[6] == "und" and got[5] != "und"


@pytest.mark.parametrize("n", [64, 130])
def test_many_languages(n):
    field = language.fit([f"w{chr(97 + k % 26)}{chr(97 + k // 26)}x " * 30 for k in range(n)], [f"l{k:03d}" for k in range(n)], rounds=3)
    assert len(field.languages) == n
    assert set(field.lexicon.values()) <= set(range(1, n + 1))
    assert field.emissions(["wabx", "unseen"]).shape == (2, n)


def test_language_of_mixed_and_odd_texts(spark):
    docs = docs_frame(spark, MEDIUM)
    field = language.fitted(docs)
    by = {r["lang"]: " ".join(r["text"].split()[:40]) for r in docs.filter("lang in ('de', 'fr')").dropDuplicates(["lang"]).collect()}
    rows = [(1, by["de"] + " " + by["fr"], "x"), (2, None, "x"), (3, "123 -- 45", "x"), (None, by["fr"], "x"), (1, by["de"], "x"), (5, "a" * 5000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = language.predicted(df, field).collect()
    assert sorted((r["doc_id"] or 0, r["lang_pred"]) for r in got if r["doc_id"] != 5 and r["doc_id"] != 1) == [(0, "fr"), (2, "und"), (3, "und")]
    labels = language.labelled_words(df.filter("doc_id = 1"), field).collect()
    mixed = max((r["labels"] for r in labels), key=len)
    half = len(mixed) // 2
    assert Counter(mixed[: half - 5]).most_common(1)[0][0] == "de" and Counter(mixed[half + 5 :]).most_common(1)[0][0] == "fr"
    assert language.filtered(df, field).count() == 4
    empty = df.limit(0).withColumn("lang", F.lit("en"))
    assert language.fitted(empty) is None
    assert [r["lang_pred"] for r in language.predicted(df.limit(1), None).collect()] == ["und"]


def test_language_learns_few_long_and_hot_documents(spark, monkeypatch):
    """Pieces are drawn, not documents: no language is lost, and no more than the bound is collected."""
    monkeypatch.setattr(language, "fit", lambda texts, langs: list(zip(langs, texts, strict=True)))
    ids = spark.range(10_000).filter(~language.held_out("id")).withColumn("r", F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 30)) / (1 << 30))
    far = [r["id"] for r in ids.filter("r > 0.5").limit(5).collect()]
    hit = ids.filter("r < 0.05").first()["id"]
    rows = [(i, "long", 60_000, 1) for i in far[:3]] + [(hit, "drawn", 100_000, 1), (far[3], "hot", 1_000, 40), (far[4], "tiny", 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, words int, times int").withColumn("t", F.explode(F.sequence(F.lit(1), "times")))
    docs = df.select("doc_id", "lang", F.array_join(F.transform(F.sequence(F.lit(1), "words"), lambda i: F.concat(F.lit("wörd"), i.cast("string"))), " ").alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(far[0], "solid", "ü" * 400_000)], "doc_id long, lang string, text string"))
    got = language.fitted(docs)
    chars = Counter()
    for lang, text in got:
        chars[lang] += len(text) + 1
    assert set(chars) == {"long", "drawn", "hot", "tiny", "solid"} and max(chars.values()) <= 150_000
    assert min(chars[x] for x in ("long", "drawn", "solid")) > 140_000
    assert chars["hot"] < 10_000 and chars["tiny"] == len("wörd1") + 1
    assert got == language.fitted(docs.repartition(3))


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(4)
    k, lengths = 3, np.array([4, 2, 1])
    scores = rng.normal(size=(4, 3, k))
    move, start = rng.normal(size=(k, k)), rng.normal(size=k)
    got, _, counts = language.forward_backward(scores.copy(), lengths, move, start, pairs=True)
    total = np.zeros((k, k))
    for j, n in enumerate(lengths):
        weights, marginal = 0.0, np.zeros((n, k))
        pair = np.zeros((k, k))
        for path in np.ndindex(*[k] * n):
            w = math.exp(start[path[0]] + sum(scores[t, j, y] for t, y in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
            weights += w
            for t, y in enumerate(path):
                marginal[t, y] += w
            for a, b in zip(path, path[1:]):
                pair[a, b] += w
        assert np.allclose(got[:n, j], marginal / weights)
        total += pair / weights
    assert np.allclose(counts, total)


def url_truth(url):
    url = url or ""
    if "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:at], rest[at:]
    for c in "?#":
        path = path.split(c, 1)[0]
    return host.translate({c: c + 32 for c in range(65, 91)}), path


def test_url_filter(spark):
    odd = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.com", "http://a.Example.COM/EN/x", "http://www.example.com/en/1?q=/x#y", "x://net/es/?a", "http://notnet/es/1", "http://m.www.example.com/en/", "a://b.com#/x", "http://é.com/ü://z", "http://q.net/fr/" + "a" * 5000]
    rows = [(i, u, "h") for i, u in enumerate(odd)] + [(None, odd[5], "h"), (3, odd[3], "h")]
    pages = spark.read.parquet(f"{MEDIUM}/pages.parquet").select("page_id", "url", F.lit("h").alias("host"))
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    both = df.unionByName(pages.withColumn("page_id", F.col("page_id") + 100))
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judged(both, plans.URL_RULES).collect()}
    verdicts = dict(plans.URL_RULES)
    for page_id, url, _ in [*rows, *[(r["page_id"] + 100, r["url"], "h") for r in pages.collect()]]:
        host, path = url_truth(url)
        rule = None
        for r in sorted(verdicts, key=len):
            name, _, rest = r.partition("/")
            if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
                rule = r
        found = [g for g in got if g[:4] == (page_id, host, path, rule)]
        assert found, (page_id, url, host, path, rule)
        if rule:
            assert found[0][4] == verdicts[rule]
        assert found[0][4] in ("allow", "block")
    assert urls.judged(df.limit(0), plans.URL_RULES).count() == 0


def test_url_model_separates_held_out(spark):
    """Learned from half of the labelled URLs, the ratio agrees with the rules on the other half."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    rows = pages.select("page_id", "url").withColumn("odd", F.col("page_id") % 2 == 1)
    learn = rows.filter("not odd")
    probe = rows.filter("odd").withColumn("url", F.concat(F.lit("z"), F.translate("url", ".", "!")))  # no rule fits these
    out = urls.judged(learn.select("page_id", F.translate("url", "", "").alias("url")).unionByName(probe.select("page_id", "url")), plans.URL_RULES)
    real = urls.judged(rows.filter("odd"), plans.URL_RULES).filter("rule is not null").select("page_id", F.col("verdict").alias("truth"))
    both = out.join(real, "page_id").toPandas()
    assert (both["verdict"] == both["truth"]).mean() > 0.8


class BruteModel:
    """Witten-Bell over counted texts, by recursion."""

    def __init__(self, texts, order):
        self.rows = defaultdict(Counter)
        for text, n in texts.items():
            whole = "\x02" + text + "\x03"
            for i in range(1, len(whole)):
                for k in range(min(order, i) + 1):
                    self.rows[whole[i - k : i]][whole[i]] += n

    def p(self, context, c):
        row = self.rows.get(context, {})
        shorter = self.p(context[1:], c) if context else 1 / (1 << 16)
        return (row.get(c, 0) + len(row) * shorter) / (len(row) + sum(row.values())) if row else shorter


def brute_scores(good, bad, texts, order):
    a, b = BruteModel(good, order), BruteModel(bad, order)
    out = {}
    for text in texts:
        whole = "\x02" + text + "\x03"
        at = [(whole[max(0, i - order) : i], whole[i]) for i in range(1, len(whole))]
        out[text] = sum(math.log(a.p(*x)) - math.log(b.p(*x)) for x in at) / len(at)
    return out


def test_url_models_count_every_labelled_url(spark, monkeypatch):
    """More than a million labelled characters a side: scores and verdicts as by brute force over all of them."""
    monkeypatch.setattr(urls, "GRAMS_HELD", 50)
    rules = [("com/", "allow"), ("net/", "block")]
    labels = [(f"http://a{i % 7}.{end}/{word}{i}", 9_000 + i) for i in range(12) for end, word in (("com", "tea"), ("net", "\u00fcx"))]
    open_urls = ["http://q.org/tea5", "http://q.org/\u00fcx5", "", "\u00e9\U0001f600"]
    rows = spark.createDataFrame(labels + [(u, 2) for u in open_urls], "url string, n int")
    pages = rows.select("url", F.explode(F.sequence(F.lit(1), "n")).alias("page_id"))
    held = {r["url"] for r in rows.filter(F.pmod(F.xxhash64("url"), F.lit(1 << 30)) % 5 == 0).collect()}
    sides = [{u: n for u, n in labels if f".{end}/" in u} for end in ("com", "net")]
    assert all(0 < len(held & set(s)) < len(s) and sum(len(u) * n for u, n in s.items()) > 1_000_000 for s in sides)
    want = brute_scores(*[{u: n for u, n in s.items() if u not in held} for s in sides], [u for u, _ in labels] + open_urls, 3)
    mean = lambda s: sum(want[u] * s[u] for u in held & set(s)) / sum(s[u] for u in held & set(s))
    threshold = (mean(sides[0]) + mean(sides[1])) / 2
    got = urls.judged(pages, rules, order=3).groupBy("host", "path", "rule", "verdict", "score").count().toPandas()
    assert got["count"].sum() == sum(n for _, n in labels) + 2 * len(open_urls)
    assert np.allclose(sorted(got["score"]), sorted(want.values()), rtol=1e-9)
    free = {(round(r.score, 9), r.verdict) for r in got[got["rule"].isna()].itertuples()}
    assert free == {(round(want[u], 9), "allow" if want[u] >= threshold else "block") for u in open_urls}


def test_url_sides_of_one_hot_url(spark):
    """One URL a side, repeated beyond any number of characters: it teaches and calibrates its side."""
    hot = [("http://aaaa.com/tea", 40_000), ("http://bbbb.net/xyz", 40_000), ("http://aaaa.org/tea", 1), ("http://bbbb.org/xyz", 1)]
    rows = spark.createDataFrame(hot, "url string, n int").select("url", F.explode(F.sequence(F.lit(1), "n")).alias("page_id"))
    got = urls.judged(rows, [("com/", "allow"), ("net/", "block")]).filter("rule is null").collect()
    assert {r["host"]: r["verdict"] for r in got} == {"aaaa.org": "allow", "bbbb.org": "block"}
    one = urls.judged(rows, [("com/", "allow")]).filter("rule is null").select("verdict", "score").distinct().collect()
    assert [tuple(r) for r in one] == [("allow", 0.0)]


def simple_targets(sizes, weights, budget, cap):
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = budget * sum(sizes.values()), set(names), {}
    while free:
        share = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * share > cap * sizes[s]}
        if not full:
            return out | {s: weight[s] * share for s in free}
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= full
    return out


def test_mixture(spark):
    rng = np.random.default_rng(6)
    sources = ["b", "a", None, "é", "z", "big"]
    rows = [(i, sources[int(rng.integers(0, 6))] if i % 3 else "big", int(rng.integers(0, 90))) for i in range(3000)] + [(5000, "hollow", 0), (None, "a", 5), (7, "a", 5), (7, "a", 5)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixture.draw(df, shards=4).toPandas()
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    want = simple_targets(sizes, (3, 1, 2), 1.5, 2.0)
    assert len(got) == len(rows)
    for s, part in got.groupby("source", dropna=False):
        s = None if not isinstance(s, str) else s
        assert np.allclose(part["target"], want[s]) and (part["source_size"] == sizes[s]).all()
        assert abs((part["size"] * part["copies"]).sum() - want[s]) <= 50
    assert got["copies"].between(0, 2).all()
    assert (got["copies"] == got["shards"].map(len)).all()
    load = Counter(x for row in got["shards"] for x in row)
    assert set(load) == {0, 1, 2, 3} and max(load.values()) < 1.2 * min(load.values())
    again = mixture.draw(df.repartition(5), shards=4).toPandas()
    key = lambda d: sorted(map(str, d[["doc_id", "source", "copies"]].assign(s=d["shards"].map(list)).values.tolist()))
    assert key(got) == key(again)
    assert mixture.draw(df.limit(0)).count() == 0


def test_mixed_is_dealt_by_size_and_keeps_clashing_columns(spark):
    names = ["rank", "h", "b", "inner", "row", "chance", "slot", "shard", "copy", "copies"]
    rows = [(i if i % 7 else None, f"s{i % 3}", "word " * (i % 11), *(i + k for k in range(len(names)))) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, " + ", ".join(f"{c} int" for c in names))
    out = mixture.mixed(df, shards=4, shard_words=100)
    assert out.columns == df.columns
    assert out.rdd.getNumPartitions() >= 40
    whole = Counter(map(tuple, df.collect()))
    got = Counter(map(tuple, out.collect()))
    assert set(got) <= set(whole) and all(n <= 2 * whole[r] for r, n in got.items())
    plan = mixture.draw(df.withColumn("size", mixture.words()), shards=4)
    assert {"rank", "h", "b", "inner"} <= set(plan.columns)
    assert {(r["rank"], r["h"]) for r in plan.collect()} == {(r["rank"], r["h"]) for r in df.collect()}


def test_mixed_keeps_rows(spark):
    rows = [(i, f"word{i} " * (i % 7), ["a", "b"][i % 2], "rank") for i in range(200)] + [(500, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, rank string")
    out = mixture.mixed(df, shards=4)
    assert out.columns == df.columns
    copies = Counter(r["doc_id"] for r in out.collect())
    texts = {i: t for i, t, _, _ in rows}
    taken = sum(len((texts[i] or "").split()) * n for i, n in copies.items())
    total = sum(len((t or "").split()) for t in texts.values())
    assert abs(taken - 1.5 * total) < 20 and max(copies.values()) <= 2


def test_pipeline(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "exact_dedup", "near_dedup", "mixture", "pieces"]
    docs = docs_frame(spark, SMALL)
    extra = spark.createDataFrame([(90001, None, "en", "src0", 0), (90002, "12 34", None, None, 5), (90003, "", "en", None, 0)], docs.schema)
    docs = docs.unionByName(extra).unionByName(docs.filter("doc_id = 3").withColumn("doc_id", F.lit(90004).cast("long")))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = spark.createDataFrame(stage(spark, before, SMALL).collect(), before.schema)
        assert docs.columns == columns, name
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "language":
            assert not ids & {90001, 90002, 90003} and before.count() - docs.count() == 3
        if name == "exact_dedup":
            assert 90004 not in ids or 3 not in ids
            assert docs.count() == before.select(F.regexp_replace("text", r"[\x20\x09-\x0D]", "").alias("t")).distinct().count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == docs.count()


def shingles_of(text, n=5):
    w = text.lower().split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}


@pytest.mark.parametrize("stored", [True, False])
def test_pipeline_repeated_rows_and_null_ids(spark, tmp_path, stored):
    """Every stage decides row by row, whatever the ids, as brute force does."""
    plain = [" ".join(f"w{k}x{i}" for i in range(40)) for k in range(12)]
    near = [[" ".join([*t.split()[:-1], f"end{j}"]) for j in range(4)] for t in plain]
    rows = [(1, plain[0])] * 3 + [(None, plain[0])] * 2 + [(5, plain[0]), (5, plain[1]), (None, plain[2]), (None, plain[2]), (None, plain[3])]
    rows += [(8, near[4][0]), (7, near[4][1]), (None, near[4][2]), (8, plain[5]), (None, near[6][0]), (None, near[6][1]), (9, near[7][0]), (9, near[7][1]), (9, near[7][1]), (10, plain[8]), (3, plain[1] + " ")]
    schema = docs_frame(spark, SMALL).schema
    docs = spark.createDataFrame([(i, t, "en", ["a", "b", None][k % 3], len(t)) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    assert set(docs.columns) == {f.name for f in schema}

    def read(df, name):
        if not stored:
            return spark.createDataFrame(df.collect(), docs.schema)
        df.repartition(3).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    first = lambda group: min(group, key=lambda r: (r[0] is None, r[0] or 0))
    key = lambda found: sorted((i or 0, t) for i, t in found)
    exact = read(stages["exact_dedup"](spark, read(docs, "docs"), ""), "exact")
    same = defaultdict(list)
    for i, t in rows:
        same["".join(t.split())].append((i, t))
    longest = [first([r for r in g if len(r[1]) == max(len(t) for _, t in g)]) for g in same.values()]
    assert key((r["doc_id"], r["text"]) for r in exact.collect()) == key(longest)

    for given in (exact, read(docs, "again")):
        out = stages["near_dedup"](spark, given, "")
        assert out.columns == docs.columns
        left = [(r["doc_id"], r["text"]) for r in given.collect()]
        groups = []
        for r in left:
            linked = [g for g in groups if any(100 * len(shingles_of(r[1]) & shingles_of(o[1])) >= 80 * len(shingles_of(r[1]) | shingles_of(o[1])) for o in g)]
            groups = [g for g in groups if g not in linked] + [sum(linked, []) + [r]]
        got = [(r["doc_id"], r["text"]) for r in out.collect()]
        assert len(got) == len(groups)
        assert all([i for i, t in got if t in {o[1] for o in g}] == [first(g)[0]] for g in groups)

    kept = read(stages["near_dedup"](spark, exact, ""), "near")
    mixed = stages["mixture"](spark, kept, "").collect()
    sizes, taken, alike = Counter(), Counter(), Counter()
    for r in kept.collect():
        sizes[r["source"]] += len(r["text"].split())
        alike[r["doc_id"]] += len(r["text"].split())
    for r in mixed:
        taken[r["source"]] += len(r["text"].split())
    want = simple_targets(sizes, (3, 1, 2), 1.5, 2.0)
    assert all(abs(taken[s] - want[s]) <= max(alike.values()) for s in sizes)
