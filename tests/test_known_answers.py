"""Small cases with known answers, and brute-force twins of the vectorised functions."""

import gzip
import io
import json
import math
import random
import struct
import zipfile
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from residua.functions import candidates as C
from residua.functions import generator as G
from residua.functions import keys as K
from residua.functions import text as X
from residua.functions import traits as A
from residua.operators import catalog, delta, ledger, monitor, motif, quality, residual, schedule, sets, sketches, windows
from residua.sources import artifacts, members, reports, sinks, tables
from residua.streaming import monitor as SM
from residua.streaming import sinks as SK
from residua.streaming import state as SS

PATTERN = r"(?i)^0x([0-9a-f]{4})\.rec\.zip$"
MASK = (1 << 32) - 1


def step(s):
    return (s * G.MULTIPLIER + G.INCREMENT) & MASK


def values(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def col(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_artifact_classes(spark):
    rows = [("0x0000.rec.zip", 2000), ("0x0001.rec.zip", 2000), ("0x0002.rec.zip.tmp", 5), ("0x0004.rec.zip", 0), ("odd.rec.zip", 9), ("readme.txt", 9), ("0X0001.REC.ZIP", 2000), ("0x0003.rec.zip", 10)]
    files = spark.createDataFrame(rows, "name string, size bigint").withColumn("mtime", F.lit(0.0))
    got = artifacts.classify_artifacts(files, PATTERN, ".rec.zip", 1024, 0, 5)
    s = artifacts.artifact_summary(got, 0, 5).first()
    assert (s.valid, s.missing, s.tmp, s.zero, s.bad_name, s.duplicate, s.tiny) == (2, 3, 1, 1, 1, 1, 1)
    assert values(artifacts.missing_artifacts(got, 0, 5), "key") == [(2,), (3,), (4,)]


def test_scope_bounds():
    assert sets.in_scope_bounds(65536) == (0, 65536)
    assert sets.in_scope_bounds(2) == (1, 3)
    assert sets.in_scope_bounds(65535) == (1, 65535)


def test_ranges_text(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (7,), (2,)], "id bigint")
    assert values(sets.compact_ranges(df, "id"), "text") == [("0x0001-0x0003",), ("0x0007",)]
    text = spark.createDataFrame([("0-3, 2 0x10..0x12",)], "t string")
    assert [r.id for r in sets.expand_ranges(text, "t").orderBy("pos", "id").collect()] == [0, 1, 2, 3, 16, 17, 18]
    with pytest.raises(Exception, match="bad range token"):
        sets.expand_ranges(spark.createDataFrame([("5-3",)], "t string"), "t").collect()
    lenient = spark.createDataFrame([("5-3 1",), ("2,4",), ("x",)], "t string")
    assert values(sets.expand_ranges(lenient, "t", lenient=True), "id") == [(2,), (4,)]


def test_merge_known_case(spark):
    schema = "lane int, status string, proof_bytes bigint, verified_at double, finished_at double, claimed_at double"
    src = spark.createDataFrame([(1, "done", 2000, None, 10.0, None), (2, "running", None, None, None, 5.0), (3, "verified", 2000, 20.0, None, None)], schema)
    dst = spark.createDataFrame([(3, "done", 2000, None, 10.0, None), (4, "done", 2000, None, 9.0, None)], schema)
    merged = ledger.merge_best(src, dst, "lane")
    assert values(merged, "lane", "action") == [(1, "added"), (2, "skipped_active"), (3, "replaced"), (4, "untouched")]
    assert values(ledger.merged_rows(merged), "lane", "status") == [(1, "done"), (3, "verified"), (4, "done")]


def test_first_stamp_wins_over_latest(spark):
    df = spark.createDataFrame([(5.0, 99.0)], "verified_at double, updated_at double")
    assert df.select(ledger.best_timestamp(df.columns)).first()[0] == 5.0


def test_summary_ignores_expired_claims(spark):
    df = spark.createDataFrame([(1, "done", None), (2, "running", 50.0), (3, "claimed", 200.0)], "lane int, status string, lease_until double")
    s = ledger.ledger_summary(df, F.lit(100.0), 10).first()
    assert (s.done, s.running, s.claimed, s.expired_claims, s.pending) == (1, 0, 1, 1, 8)


def test_trusted_union(spark):
    rows = spark.createDataFrame([("a", 0, i) for i in range(4)] + [("b", 1, i) for i in range(2, 7)], "device string, pos int, lane bigint")
    local = spark.createDataFrame([(0,)], "lane bigint")
    assert values(ledger.trusted_union(rows, local, "lane", "device", "pos"), "device", "lanes", "unique_lanes", "duplicate_lanes") == [("a", 4, 3, 1), ("b", 5, 3, 2)]
    assert tuple(ledger.grand_total(rows, local, "lane", 5).first()) == (5, 5)


@pytest.mark.parametrize("score,confidence,strength", [(0.0, 0, "echo"), (0.6, 20, "echo"), (0.7, 55, "clear"), (0.8, 80, "strong"), (0.9, 95, "anchor"), (1.2, 100, "anchor"), (-1.0, 0, "echo"), (0.65, 38, "echo")])
def test_bands(spark, score, confidence, strength):
    assert col(spark, A.band_score(F.lit(score))) == confidence
    assert col(spark, A.strength(F.lit(score))) == strength


def test_generator_against_serial(spark):
    s, want = 12345, []
    for _ in range(300):
        s = step(s)
        want.append(s)
    got = spark.range(1, 301).select(G.lcg_at(F.lit(12345), "id").alias("s")).toPandas()["s"].tolist()
    assert got == want
    df = spark.createDataFrame([(i, w) for i, w in enumerate(want, 1)], "n bigint, s bigint")
    back = df.select("n", G.lcg_distance(F.lit(12345), "s").alias("d"), G.lcg_previous(G.lcg_next("s")).alias("p"), "s").collect()
    assert all(r.n == r.d and r.p == r.s for r in back)
    far = df.select(G.signed_distance("s", F.lit(12345), 100).alias("d"), "n").collect()
    assert all(r.d == (-r.n if r.n <= 100 else None) for r in far)


def test_nearest_small_state(spark):
    inverse = lambda s: ((s - G.INCREMENT) * G.MULTIPLIER_INVERSE) & MASK
    rng = random.Random(5)
    states = [7, step(7), inverse(7)] + [rng.randrange(1 << 32) for _ in range(5)]

    def brute(s, limit=60000):
        if s <= 0xFFFF:
            return s, 0
        back = ahead = s
        for n in range(1, limit + 1):
            back, ahead = inverse(back), step(ahead)
            if back <= 0xFFFF:
                return back, -n
            if ahead <= 0xFFFF:
                return ahead, n
        return None, None

    df = spark.createDataFrame([(s,) for s in states], "s bigint").withColumn("r", G.nearest_small_state("s", 60000))
    for r in df.collect():
        assert (r.r.seed, r.r.steps) == brute(r.s)


def test_first_occurrence_covers_and_fails(spark):
    stream = spark.range(1, 2000).select(F.col("id").alias("n"), (G.lcg_output(G.lcg_at(F.lit(1), "id")) % 64).alias("u"))
    found = windows.first_occurrence(stream, ["u"], ["n"], [])
    first, s = {}, 1
    for n in range(1, 2000):
        s = step(s)
        first.setdefault((s >> 16) % 64, n)
    assert dict(values(found, "u", "n")) == first
    with pytest.raises(ValueError, match="covered"):
        windows.require_covered(found, "u", 65)


def test_schedule_with_lead(spark):
    s, first = 99, {}
    for n in range(1, 400):
        s = step(s)
        if n >= 10:
            first.setdefault(s >> 16, n)
    targets = spark.createDataFrame([(u,) for u in list(first)[:50]], "u bigint")
    got = schedule.schedule_with_lead(targets, "u", 99, 10, 399)
    assert values(got, "u", "step", "input_delta") == sorted((u, first[u], first[u] - 10) for u in list(first)[:50])
    with pytest.raises(ValueError, match="uncovered"):
        schedule.schedule_with_lead(targets.union(spark.createDataFrame([(70000,)], "u bigint")), "u", 99, 10, 399)


def test_schedule_finds_every_output(spark, monkeypatch):
    """All 65,536 outputs over several ranges; what no output can be is a row with a reason."""
    from residua.plans import generator_plans as P

    monkeypatch.setattr(schedule, "FIRST_STEPS", 1 << 12)
    s, first = P.SEED, {}
    for n in range(1, P.ALL_SHOWN):
        s = step(s)
        if n >= 5:
            first.setdefault(s >> 16, n)
    assert len(first) == 1 << 16
    targets = spark.range(-1, (1 << 16) + 1).select(F.col("id").alias("u")).union(spark.createDataFrame([(7,), (None,)], "u bigint"))
    got = schedule.schedule_with_lead(targets, "u", P.SEED, 5, strict=False).collect()
    assert {r.u: r.step for r in got if r.problem is None} == first
    assert sorted((r.u, r.step, r.problem) for r in got if r.problem) == [(-1, None, "out-of-range"), (1 << 16, None, "out-of-range")]
    assert schedule.schedule_with_lead(targets.filter("u = 3"), "u", P.SEED, 5, 6, strict=False).first().problem == "not-reached"
    assert schedule.schedule_with_lead(targets.limit(0), "u", P.SEED, 5).count() == 0


def test_acceptable_ids(spark):
    ids = col(spark, K.acceptable_ids(F.lit(0x1234), F.lit(77)))
    assert len(set(ids)) == 8 and all((0x1234 ^ i) >> 3 == 77 for i in ids)


def test_trait_scores_against_scalar(spark):
    rng = random.Random(11)
    pids = [rng.randrange(1 << 32) for _ in range(40)]
    df = spark.createDataFrame([(p,) for p in pids], "k bigint")
    rows = df.select("k", *[c.alias(n) for n, c in A.trait_scores("k", rounded=False).items()]).collect()
    close = lambda d, m: round(max(0.0, 100 - d / m * 100), 3)
    for r in rows:
        n = [(r.k >> 4 * i) & 15 for i in range(8)]
        p = [(x + n[2 * i], y + n[2 * i + 1]) for i, (x, y) in enumerate(A.SPOT_CENTRES)]
        d = lambda a, b: math.hypot(a[0] - b[0], a[1] - b[1])
        pair = sum(d(p[i], p[j]) for i in range(4) for j in range(i + 1, 4)) / 6
        assert abs(r.cluster - close(pair, 32)) < 1e-9
        assert abs(r.spread - min(100, pair / 28 * 100)) < 1e-9
        assert abs(r.eye_cover - (close(d(p[0], (19.5, 24)), 18) + close(d(p[1], (38, 24.5)), 18)) / 2) < 1e-9
        mirror = lambda a, b: close(math.hypot(abs(a[0] - 26 + b[0] - 26), a[1] - b[1]), 24)
        assert abs(r.vertical_symmetry - (mirror(p[0], p[1]) + mirror(p[2], p[3])) / 2) < 1e-9


def test_candidate_table_against_list_removal(spark):
    base = [1, 2, 4, 5, 6, 7, 8, 9]
    classes = C.shifted_classes(base, [("a", 0), ("b", 2), ("c", 5)], 2)
    a, b, order = [31, 30, 29, 28, 27, 26], [1, 2, 3, 4, 5, 6], [0, 1, 2, 5, 3, 4]
    states = spark.range(200).select(F.col("id").alias("u"), (F.col("id") * 40503 * 65537 % (1 << 32)).alias("s"))
    got = {(r.class_id, r.u): r.value for r in C.candidate_values(states, "u", "s", classes, a, b, order).collect()}
    for r in states.collect():
        words, s = [0], r.s
        for _ in range(20):
            s = step(s)
            words.append(s >> 16)
        for cid, _, pos in classes:
            w = [words[p] for p in pos]
            f = [w[0] & 31, (w[0] >> 5) & 31, (w[0] >> 10) & 31, (w[1] >> 5) & 31, (w[1] >> 10) & 31, w[1] & 31]
            left = list(range(6))
            for draw, (size, par) in enumerate(((6, w[5]), (5, w[6]), (4, w[7]))):
                stat = left[w[2 + draw] % size]
                f[order[stat]] = (b if par % 2 else a)[order[stat]]
                for i in range(stat, size - 1):
                    left[i] = left[i + 1]
            value = 1 << 30
            for x, shift in zip(f, K.FIELD_SHIFTS):
                value |= x << shift
            assert got[cid, r.u] == value


def test_bitmap_block_explode(spark):
    present = [0, 1, 9, 63, 64, 127]
    bits = bytearray(16)
    for i in present:
        bits[i // 8] |= 1 << i % 8
    block = b"".join(struct.pack("<I", i * 3) for i in range(128))
    df = spark.createDataFrame([(5, bytes(bits), block)], "lane int, bitmap binary, block binary")
    out = artifacts.explode_fixed_width(df, "lane", "block", "bitmap", 4, 128)
    assert [(r.upper, struct.unpack("<I", r.record)[0]) for r in out.orderBy("upper").collect()] == [(i, i * 3) for i in present]
    assert col(spark, K.bit_test(F.lit(bytes(bits)), F.lit(9))) and not col(spark, K.bit_test(F.lit(bytes(bits)), F.lit(10)))


def test_decode_record_roundtrip(spark):
    rng = random.Random(3)
    orders = list(permutations(range(4)))
    rows = []
    for i in range(60):
        key, owner = rng.randrange(1 << 32), rng.randrange(1 << 32)
        blocks = [bytes(rng.randrange(256) for _ in range(12)) for _ in range(4)]
        plain = b"".join(blocks)
        check = sum(struct.unpack("<24H", plain)) & 0xFFFF
        head = struct.pack("<II", key, owner) + bytes(20) + struct.pack("<H", check) + bytes(2)
        shuffled = b"".join(blocks[b] for b in orders[key % 24])
        coded = b"".join(struct.pack("<I", w ^ key ^ owner) for w in struct.unpack("<12I", shuffled))
        rows.append((i, head + (plain if i % 3 == 0 else coded), struct.unpack("<H", plain[:2])[0], struct.unpack("<I", plain[40:44])[0], i % 3 != 0))
    rows.append((99, b"short", None, None, None))
    df = spark.createDataFrame(rows, "i int, rec binary, species int, packed bigint, coded boolean").withColumn("r", artifacts.decode_record("rec"))
    for r in df.collect():
        if r.i == 99:
            assert r.r.key is None
        else:
            assert r.r.checksum_ok and (r.r.species, r.r.packed, r.r.was_encrypted) == (r.species, r.packed, r.coded)


def test_archives(spark):
    def container(entries):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, body in entries:
                z.writestr(name, body)
        return out.getvalue()

    body = lambda pid: struct.pack("<I", pid) + bytes(76)
    good = container([("0x00010005.rec", body(0x00010005)), ("0x00020005.rec", body(0x00020005)), ("bad.rec", b"x"), ("0x00030006.rec", body(7)), ("0x00020005.rec", body(0x00020005))])
    files = spark.createDataFrame([("a/0x0005.zip", good), ("b/0x0006.zip", b"nope")], "path string, content binary")
    rows = artifacts.explode_archives(files, 2).withColumn("lane", F.conv(F.regexp_extract("path", "0x([0-9A-F]{4})", 1), 16, 10).cast("bigint"))
    checked = artifacts.entry_errors(rows, "lane", r"^0x([0-9A-F]{8})\.rec$", 80, [0, 8])
    codes = {(r.name, tuple(r.codes)) for r in checked.filter("lane = 5").collect()}
    assert codes == {("0x00010005.rec", ()), ("0x00020005.rec", ()), ("bad.rec", ("bad_names", "bad_sizes")), ("0x00030006.rec", ("bad_lower", "bad_content_key"))}
    broken = checked.filter("lane = 6").first()
    assert broken.error.startswith("bad_archive") and broken.name is None
    cover = artifacts.upper_coverage(checked.filter("lane = 5"), "lane", 3).first()
    assert (cover.duplicate_names, cover.duplicate_uppers, cover.uppers, cover.complete) == (1, 1, 3, True)


def test_files_and_csv_sources(spark, tmp_path):
    (tmp_path / "s").mkdir()
    header = ",".join(tables.SCHEDULE_COLUMNS)
    (tmp_path / "s" / "a.csv").write_text(f"{header}\n0x1,50,0x0001,0,701,t-0,0xABCDEF01\n1,50,2,0,701,T-0,5\n1,50,2,0,683,t-18,9\n")
    rows = tables.read_schedule_csv(spark, str(tmp_path / "s"), expected=2)
    assert values(rows, "target_half_16bit", "rng_seed") == [(1, 0xABCDEF01), (2, 5)]
    with pytest.raises(ValueError, match="covers 2 of 3"):
        tables.read_schedule_csv(spark, str(tmp_path / "s"), expected=3)
    with pytest.raises(ValueError, match="missing required"):
        tables.require_columns(rows, ["nope"])
    listed = artifacts.list_files(spark, str(tmp_path / "s"))
    scanned = listed._jdf.queryExecution().executedPlan().toString().split("ReadSchema: ")[1]
    assert "length" in scanned and "content" not in scanned
    assert listed.first().name == "a.csv"


def test_ledger_file(spark, tmp_path):
    text = '﻿{"records":{"0x0001":{"status":" DONE ","zip_size":5000,"finished_at_unix":7.5},"0002":{"status":"running","zip_size":"bad"},"zz":{"status":"done"},"0x0003":4,"0x12345":{"status":"done"}}}'
    (tmp_path / "l.json").write_text(text, encoding="utf-8")
    rows, errors = tables.read_ledger_json(spark, str(tmp_path / "l.json"))
    assert values(rows, "lane", "status", "proof_bytes")[0] == (1, "done", 5000)
    assert [tuple(r) for r in rows.orderBy("lane").select("lane", "proof_bytes").collect()] == [(1, 5000), (2, None)]
    assert values(errors, "key") == [("0x0003",), ("0x12345",), ("zz",)]


def _json_value(rng, depth):
    kind = rng.random()
    if depth <= 0 or kind < 0.5:
        return rng.choice([1, None, True, 'a"b', "\\", "{[,]}", 'x\\"', 'é,"', '\\\\"', ""])
    if kind < 0.75:
        return [_json_value(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["records", 'a"', "k\\", "{z", "q,"]): _json_value(rng, depth - 1) for _ in range(rng.randrange(4))}


def _members_by_ranges(data, field, kind, step):
    file, rows = pa.BufferReader(data), []
    for start in range(0, len(data), step):
        effects = [members._effect(file, start, data[start : start + step], state) for state in range(members.STATES)]
        rows.append({"path": "f", "start": start, "end": start + step, "effect": json.dumps(effects)})
    states = members._with_states(pd.DataFrame(rows).sample(frac=1, random_state=0))
    return [m for row in states.to_dict("records") for m in members._members_of(file, row, field, kind)]


@pytest.mark.parametrize("step", [1, 2, 3, 5, 7, 11, 37, 10_000])
def test_members_do_not_depend_on_where_ranges_begin(step):
    rng = random.Random(step)
    for _ in range(60):
        docs = []
        for _ in range(rng.randrange(1, 3)):
            records = {str(i) + rng.choice(["", '"', "\\", "}"]): _json_value(rng, 2) for i in range(rng.randrange(5))}
            records = records if rng.random() < 0.7 else [_json_value(rng, 2) for _ in range(rng.randrange(4))]
            docs.append({"version": _json_value(rng, 2), "records": records, "other": _json_value(rng, 3)})
        data = ("﻿" + "\n".join(json.dumps(d, ensure_ascii=False, indent=rng.choice([None, 1])) for d in docs)).encode()
        for kind, held in (("{", dict), ("[", list)):
            want = []
            for records in (d["records"] for d in docs):
                if isinstance(records, held) and records:
                    want += enumerate(records.items() if held is dict else records)
                else:
                    want.append((None, None))
            parse = (lambda s: next(iter(json.loads("{" + s + "}").items()))) if held is dict else json.loads
            got = [(m["idx"], m["text"] and parse(m["text"])) for m in _members_by_ranges(data, "records", kind, step)]
            assert got == want


def test_large_files_are_read_by_ranges(spark, tmp_path):
    records = {f"0x{i:04X}": {"status": "done", "zip_size": i, "note": 'a"{,\\'} for i in range(500)}
    (tmp_path / "a.json").write_text(json.dumps({"note": [1, {"records": {"0x0001": 1}}], "records": records}))
    (tmp_path / "b.json.gz").write_bytes(gzip.compress(json.dumps({"records": {"0x1000": {"status": "failed"}}}).encode()))
    (tmp_path / "c.json").write_text('{"version": 1}')
    (tmp_path / "d.json").write_text("")
    (tmp_path / "e.json").write_text('{"records": {"0x2000": {"status": "done"}, "0x2001": {"stat')
    rows, errors = tables.read_ledger_json(spark, str(tmp_path), range_bytes=1000)
    assert rows.rdd.getNumPartitions() > 20
    assert values(rows, "lane", "proof_bytes") == [(i, i) for i in range(500)] + [(0x1000, None), (0x2000, None)]
    assert [r.error for r in errors.collect()] == ["ledger records field is missing or not an object"] * 2  # c and e; Spark passes over empty files
    assert members.read_members(spark, str(tmp_path / "a.json"), None, "{", 100).select("idx").orderBy("idx").collect() == [(0,), (1,)]


def test_a_trace_counts_over_ranges(spark, tmp_path):
    samples = [{"frame_index": 7 * i, "applied_mask": i, "values": {"x": i}} for i in range(300)]
    (tmp_path / "a.json").write_text(json.dumps({"samples": samples}) + "\n" + json.dumps({"samples": samples[:5]}))
    (tmp_path / "b.json").write_text('{"samples": []}')
    (tmp_path / "c.json").write_text("{}")
    got = tables.read_traces(spark, str(tmp_path), 256)
    first = got.filter("path LIKE '%a.json'").orderBy("container", "idx").select("idx", "frame_index", F.col("values")["x"]).collect()
    assert [tuple(r) for r in first] == [(i, 7 * i, i) for i in [*range(300), *range(5)]]
    assert [r.frame_index for r in got.filter("path NOT LIKE '%a.json'").collect()] == [None, None]


def test_findings_are_rows(spark):
    rows = spark.createDataFrame([(0,), (2,), (2,), (None,), (None,)], "target_half_16bit int")
    got = tables.schedule_findings(rows, 4).withColumn("t", F.coalesce("target_half_16bit", F.lit(-1)))
    assert values(got, "t", "problem") == [(-1, "unreadable"), (1, "missing"), (2, "listed-twice"), (3, "missing")]
    assert tables.schedule_findings(rows.limit(0)).count() == 0
    shards = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (1, 1), (5, 0), (None, 3)], "lane int, shard int")
    got = sinks.shard_findings(shards, "lane", "shard", 0, 4).withColumn("lane", F.coalesce("lane", F.lit(-1)))
    assert values(got, "lane", "shard", "problem") == [(-1, 3, "no-lane"), (1, 0, "in-two-shards"), (1, 1, "in-two-shards"), (5, 0, "wrong-shard")]
    frames = [(1, "a", "p", 5), (1, "b", "p", 9), (2, "a", "p", 5), (2, "b", None, 9), (3, "a", None, 1), (3, "b", None, 4), (4, "b", "p", 1), (5, "a", "p", 1), (6, "c", "p", 1)]
    got = windows.frame_deltas(spark.createDataFrame(frames, "k int, l string, p string, v int"), ["k"], "l", "a", "b", "v", "p")
    assert [tuple(r) for r in got.orderBy("k").collect()] == [(1, 4, None), (2, None, "other-partition"), (3, 3, None), (4, None, "first-missing"), (5, None, "last-missing")]


def test_sketches_unite(spark):
    rows = [("a" if i % 3 else "b", i % 5, i % 700, float(i)) for i in range(9000)] + [("c", 0, None, None), ("c", 1, 1, math.nan), (None, 0, 1, 2.0)]
    df = spark.createDataFrame(rows, "g string, part int, k int, v double")
    kept = sketches.profile_sketches(df, ["g", "part"], ["k"], "v")
    united = sketches.unite(sketches.unite(kept, ["g", "part"]), ["g"])
    whole = sketches.profile_sketches(df, ["g"], ["k"], "v")
    # distinct sketches of parts unite to that of the whole, whatever the parts
    counts = [values(sketches.estimates(p, ["g"]).withColumn("g", F.coalesce("g", F.lit("-"))), "g", "n", "n_values", "n_distinct") for p in (united, whole)]
    assert counts[0] == counts[1]
    assert [c[:3] for c in counts[0]] == [("-", 1, 1), ("a", 6000, 6000), ("b", 3000, 3000), ("c", 2, 0)]
    got = {r.g: r for r in sketches.checked(df, sketches.estimates(united, ["g"]), ["g"], ["k"], "v").collect()}
    assert [got[g].exact_distinct for g in ("a", "b", "c", None)] == [700, 700, 2, 1]
    assert all(got[g][f"{n}_ok"] for g in ("a", "b", None) for n in ("distinct", "p01", "p05", "median", "p95", "p99"))
    assert got["c"].distinct_ok and got["c"].median_ok is None
    assert sketches.estimates(united, ["g"]).filter("g = 'c'").select("median", "mean").first() == (None, None)
    wrong = sketches.estimates(united, ["g"]).withColumns({"median": F.col("p95"), "n_distinct": F.lit(900)})
    assert [(r.median_ok, r.distinct_ok) for r in sketches.checked(df, wrong, ["g"], ["k"], "v").filter("g = 'a'").collect()] == [(False, False)]


def test_report_rows(spark):
    audit = '{"level":3,"lanes":[{"lane":"0x1","entry_count":4,"errors":["a","b"],"timings_ms":7,"audit_failed":true},{"lane":"0x2"},"text",null]}'
    texts = [audit, '{"lanes":[{"lane":5,"codec":null,"stream_size":"x"},[1]]}', '{"lanes":{}}', "[]", "no json", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = reports.lane_rows(df, "t", ["i"])
    columns = ["i", "kind", "lane", "entry_count", "first_error", "total_ms", "audit_failed", "level", "codec", "stream_size"]
    assert [tuple(r) for r in got.select(*columns).orderBy("i").collect()] == [
        (0, "audit", "0x1", 4, "a", 0.0, "true", None, None, None), (1, "inspect", "5", None, None, None, None, "", "", 0),
    ]
    facts = spark.createDataFrame([(0, '{"a":{"b":1.5,"c":""},"ok":false,"lanes":[1,2],"outputs":5}'), (1, '{"a":3,"ok":null}'), (2, "x"), (3, None)], "i int, t string")
    got = reports.fact_rows(facts, "t", {"b": "a.b", "c": "a.c", "ok": "ok", "a": "a"}, ["i"], ["c"])
    assert values(got, "i", "place", "field", "value") == [(0, 0, "b", "1.5"), (0, 1, "c", ""), (0, 2, "ok", "false"), (0, 4, "lane table rows", "2"), (1, 3, "a", "3")]
    steps = [("pack", '{"ok":true,"build_ms":4,"gpu_rebuild":5}'), ("gpu_cache", "{}"), ("cpu_verify", '{"total_ms":1,"cpu_decode_profile":{"used":false},"gpu_rebuild":{"used":true,"total_ms":6,"mismatched_lanes":0}}'), (None, "{}"), ("x", "[")]
    got = reports.step_rows(spark.createDataFrame(steps, "l string, t string"), "t", "l")
    assert [tuple(r) for r in got.orderBy("step").select("step", "ok", "mismatches", "report_ms", "path_ms").collect()] == [
        (None, "", "", None, None), ("cpu verify", "", "0", 1.0, 6.0), ("pack", "true", "", 4.0, None),
    ]


def test_manifest_files(spark, tmp_path):
    (tmp_path / "0x0001.manifest.json").write_text('{"key":"0x0001","path":"p","sha1":"s","completed":3,"complete":true}')
    (tmp_path / "0x0002.manifest.json").write_text('{"key":"0x0009","path":"p"}')
    got = tables.read_manifests(spark, str(tmp_path), r"^0x([0-9A-F]{4})\.manifest\.json$")
    assert values(got.withColumn("p", F.coalesce("problem", F.lit(""))), "key", "p") == [(1, ""), (2, "key-mismatch")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i // 2, i, f"a|{i}") for i in range(20)], "lane int, u int, s string")
    got = sinks.write_shards(df, str(tmp_path / "sh"), "lane", 0, 10, 4, ["u"])
    assert values(got, "shard", "from", "to", "count") == [(0, 0, 3, 8), (1, 4, 7, 8), (2, 8, 9, 4)]
    assert got.filter("bytes <= 0").count() == 0
    twice = df.withColumn("shard", F.when(F.col("u") == 1, 1).otherwise(0))
    with pytest.raises(ValueError, match="more than one shard"):
        sinks.consolidate_shards(twice, "lane", "shard")
    with pytest.raises(ValueError, match="no lanes"):
        sinks.consolidate_shards(twice.limit(0), "lane", "shard")
    with pytest.raises(ValueError, match="differ in s"):
        sinks.consolidate_shards(df.withColumn("shard", F.lit(0)), "lane", "shard", model="s")
    sinks.write_report(df.limit(1), str(tmp_path / "md"), "markdown")
    assert spark.read.text(str(tmp_path / "md")).first()[0] == "| 0 | 0 | a\\|0 |"
    sinks.write_current(df, str(tmp_path / "cur"))
    sinks.write_current(df.limit(3), str(tmp_path / "cur"))
    assert sinks.read_current(spark, str(tmp_path / "cur")).count() == 3


def test_current_table_outlives_a_killed_write(spark, tmp_path):
    path = str(tmp_path / "cur")
    with pytest.raises(FileNotFoundError):
        sinks.read_current(spark, path)
    for n in (5, 4, 3):
        sinks.write_current(spark.range(n), path)
    assert sinks.versions(spark, path) == [1, 2]
    (tmp_path / "cur" / "v000000000003").mkdir()  # begun, never committed
    assert sinks.read_current(spark, path).count() == 3
    with pytest.raises(Exception, match="broken"):
        sinks.write_current(spark.range(9).select(F.raise_error(F.lit("broken")).cast("string").alias("id")), path)
    assert sinks.read_current(spark, path).count() == 3
    sinks.write_current(sinks.read_current(spark, path).filter("id > 0"), path)
    assert sinks.read_current(spark, path).count() == 2


def test_bucketed_table_rewrites_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "ledger")
    initial = spark.range(200).select(F.col("id").alias("lane"), F.lit(0).alias("n"))
    table = SK.BucketedTable(spark, path, initial, "lane", buckets=16)

    def change(old, batch):
        counts = batch.groupBy("lane").agg(F.count(F.lit(1)).cast("int").alias("more"))
        return old.join(counts, "lane", "full_outer").select("lane", (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n"))

    def broken(old, batch):
        return change(old, batch).withColumn("n", F.raise_error(F.lit("broken")).cast("int"))

    batch = spark.createDataFrame([(3,), (3,), (900,)], "lane int")  # 900 is new; another integer type than the table's
    with pytest.raises(Exception, match="broken"):
        table.update(0, batch, broken)
    assert table.read().agg(F.sum("n")).first()[0] == 0 and table.read().count() == 200
    table.update(0, batch, change)
    table.update(0, batch, change)  # repeated after its commit
    assert {r["lane"]: r["n"] for r in table.read().filter("n > 0").collect()} == {3: 2, 900: 1}
    assert table.read().count() == 201
    assert 1 <= sum(v == 1 for v in table._list(1).values()) <= 2
    table.update(1, batch.limit(0), change)
    table.update(2, batch.limit(1), change)
    table.update(3, batch.filter("lane = 900"), change)
    assert {r["lane"]: r["n"] for r in table.read().filter("n > 0").collect()} == {3: 3, 900: 2}
    assert sinks.versions(spark, path, "list-") == [3, 4]
    assert table._rows(table._list(3)).count() == 201  # the version before is whole
    again = SK.BucketedTable(spark, path, initial, "lane", buckets=16)
    assert again.read().count() == 201


def test_two_stage_conflict_is_an_error(spark):
    fact = spark.createDataFrame([(0, 0, (1 << 30) + 5), (0, 1, (1 << 30) + 7)], "lane int, upper int, actual bigint")
    model = spark.createDataFrame([(0, 1 << 30), (1, 1 << 30)], "upper int, predicted bigint")
    cand = spark.createDataFrame([(u, c, (1 << 30) + v) for u in (0, 1) for c, v in ((0, 9), (1, 5))], "upper int, class_id int, value bigint")
    t = delta.encode_two_stage(fact, model, cand, "lane", "upper")
    assert values(t.shift, "upper", "class_id") == [(0, 1)] and values(t.explicit, "upper", "mask") == [(1, 1)]
    back = delta.decode_two_stage(fact, t, model, cand, "lane", "upper")
    assert delta.verify_roundtrip(fact, back, "lane", "upper").first().mismatches == 0
    both = delta.TwoStage(t.shift, t.explicit.withColumn("upper", F.lit(0)), t.misses)
    with pytest.raises(Exception, match="both as shift and as explicit"):
        delta.decode_two_stage(fact, both, model, cand, "lane", "upper").collect()
    off = fact.withColumn("actual", F.col("actual") + (F.col("upper") == 1).cast("int"))
    r = delta.verify_roundtrip(fact, off, "lane", "upper").first()
    assert (r.mismatches, r.first_mismatch) == (1, 1)


def test_majority_ties_go_to_zero(spark):
    lanes = spark.range(4).withColumnRenamed("id", "lane")
    miss = spark.createDataFrame([(0, 7), (1, 7), (0, 8), (1, 8), (2, 8)], "lane bigint, item int")
    rules = residual.majority_rule(miss, lanes, "lane", "item", F.lit(0))
    assert values(rules, "item", "rule", "errors") == [(7, False, 2), (8, True, 1)]


def test_key_group_count(spark):
    groups = spark.range(65536).select(residual.rule_group("id").alias("g")).distinct().count()
    assert groups == 768


def test_touching_intervals_merge(spark):
    df = spark.createDataFrame([("a", 0, 5, 0), ("a", 5, 7, 1), ("a", 8, 9, 2), ("a", 1, 2, 3)], "f string, s int, e int, id int")
    assert values(windows.merge_intervals(df, ["f"], "s", "e", "id"), "s", "e", "n") == [(0, 7, 3), (8, 9, 1)]


def test_sliding_vectors_equal_single_segment(spark):
    rng = np.random.default_rng(2)
    x = rng.random((12, 3))
    df = spark.createDataFrame([("f", i, row.tolist()) for i, row in enumerate(x)], "f string, i bigint, v array<double>")
    for r in windows.sliding_vectors(df, ["f"], "i", "v", 4, 3).collect():
        seg = x[r.i : r.i + 4].reshape(-1)
        seg = seg - seg.mean()
        assert np.allclose(r.window, seg / (np.linalg.norm(seg) + 1e-6))


def test_spectral_rows_against_numpy(spark):
    rng = np.random.default_rng(4)
    signal = rng.standard_normal(400)
    size, hop, rate = 128, 32, 11025
    frames = motif.frame_signal(spark.createDataFrame([("f", signal.tolist()), ("s", [1.0] * 5)], "f string, x array<double>"), "f", "x", size, hop)
    got = motif.spectral_features(frames, ["f"], "idx", "frame", size, hop, rate).orderBy("idx").toPandas()
    audio = signal / np.abs(signal).max()
    members = motif.pitch_classes(size, rate)
    rows = []
    for i in range(1 + (len(audio) - size) // hop):
        spec = np.abs(np.fft.rfft(audio[i * hop : i * hop + size] * np.hanning(size)))
        c = np.log1p([np.log1p(spec[ks]).sum() for ks in members])
        c -= c.mean()
        rows.append(c / (np.linalg.norm(c) + 1e-6))
    padded = np.pad(np.array(rows), ((2, 2), (0, 0)), mode="edge")
    smooth = np.array([padded[i : i + 5].mean(axis=0) for i in range(len(rows))])
    smooth /= np.linalg.norm(smooth, axis=1, keepdims=True) + 1e-6
    assert len(got) == len(rows) and np.allclose(np.stack(got["vec"]), smooth)
    assert abs(got["t"][1] - (hop + size / 2) / rate) < 1e-12


def test_templates_in_passes(spark):
    rng = np.random.default_rng(9)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    w, t = unit(rng.standard_normal((50, 6))), unit(rng.standard_normal((11, 6)))
    t[7] = t[2]
    windows_df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(w)], "i int, v array<double>")
    temp = spark.createDataFrame([(f"t{i:02d}", v.tolist()) for i, v in enumerate(t)], "label string, v array<double>")
    best = (w @ t.T).argmax(axis=1)
    for per_pass in (3, 100):
        got = motif.template_match(windows_df, temp, "v", "label", None, per_pass).orderBy("i").toPandas()
        assert got["label"].tolist() == [f"t{i:02d}" for i in best]
    assert motif.template_match(windows_df, temp, "v", "label", 0.5).count() == int(((w @ t.T).max(axis=1) >= 0.5).sum())


def test_large_template_library(spark):
    """A library of many blocks against brute force; block pairs below the threshold are left out."""
    rng = np.random.default_rng(4)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    w, t = unit(rng.standard_normal((400, 8))), unit(rng.standard_normal((30_000, 8)))
    windows_df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(w)], "i int, v array<double>, label int").drop("label")
    temp = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(t)], "label int, v array<double>")
    got = motif.template_match(windows_df, temp, "v", "label", 0.9, windows_per_block=150).toPandas()
    scores = w @ t.T
    assert {r.i: int(r.label) for r in got.itertuples()} == {i: int(k) for i, k in enumerate(scores.argmax(axis=1)) if scores[i, k] >= 0.9}
    assert motif.template_match(windows_df, temp, "v", "label", 1.1, windows_per_block=150).count() == 0


def test_log_takes_a_repeated_batch_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "n int, status string")
    for epoch, batch in ((0, rows), (1, rows.filter("n = 1")), (1, rows.filter("n = 1"))):  # the second batch is repeated after a failure
        SK.log_epoch(batch, epoch, str(tmp_path / "log"))
    assert values(SK.read_log(spark, str(tmp_path / "log"), rows.schema), "epoch", "n", "status") == [(0, 1, "a"), (0, 2, "b"), (1, 1, "a")]


def test_split_write_with_an_empty_side(spark, tmp_path):
    rows = spark.createDataFrame([(1,), (2,)], "n int")
    for k, (limit, sizes) in enumerate(((0, (2, 0)), (5, (0, 2)), (1, (1, 1)))):
        folders = sinks.split_write(rows, str(tmp_path / f"s{k}"), F.col("n") > limit)
        assert tuple(spark.read.parquet(f).count() for f in folders) == sizes
    folders = sinks.split_write(rows.limit(0), str(tmp_path / "none"), F.col("n") > 0)
    assert [spark.read.parquet(f).count() for f in folders] == [0, 0]


@pytest.mark.parametrize("text,want", [("90", 90.0), ("1:30", 90.0), ("1:00:01.5", 3601.5), ("1:60", None), ("", None), ("x", None), ("-5", None), ("inf", None)])
def test_timestamps(spark, text, want):
    assert col(spark, X.parse_timestamp_text(F.lit(text))) == want


def test_text_helpers(spark):
    assert col(spark, X.format_timestamp(F.lit(3661.5))) == "01:01:01.50"
    assert col(spark, X.duration_text(F.lit(90061.0))) == "1d 1h 1m"
    assert col(spark, X.duration_text(F.lit(None).cast("double"))) == "unknown"
    assert col(spark, X.safe_file_name(F.lit("con.txt"))) == "con_report.txt"
    assert col(spark, X.safe_file_name(F.lit("a/b:c  d. "))) == "a_b_c d"
    assert col(spark, X.safe_file_name(F.lit("..."))) == "report"
    assert col(spark, X.markdown_text(F.lit("a`b|\n c"), table_cell=True)) == "a'b\\| c"
    assert col(spark, monitor.item_count_from_text(F.lit("0001..0004"))) == 4
    assert col(spark, monitor.item_count_from_text(F.lit("a, b"))) == 2
    assert col(spark, X.parse_paired_name(F.lit("TSV-0001-sid-00009.sav"))).valid


def test_guesses():
    assert catalog.guesses("300", None) == [(300, 2, 1), (30, 1, 10), (3, 1, 100), (768, 2, 1), (48, 1, 16), (3, 1, 256)]


def test_text_scan_overlaps(spark):
    df = spark.createDataFrame([(100, "aaaa"), (200, "bab"), (300, None)], "addr bigint, text string")
    assert values(catalog.text_scan(df, "aa"), "addr") == [(100,), (101,), (102,)]


def test_match_falls_back_to_lowest(spark):
    bank = spark.createDataFrame([(4, "a"), (9, "b")], "k int, n string")
    rows = spark.createDataFrame([(4,), (3,), (8,), (9,)], "v bigint")
    got = schedule.assign_match_and_nonmatch(rows, bank, "v", "k", ["n"])
    assert [(r.v, r.match.k if r.match else None, r.nonmatch.k, r.issue) for r in got.orderBy("v").collect()] == [
        (3, None, 4, "missing_matching_row"), (4, 4, 9, None), (8, None, 9, "missing_matching_row"), (9, 9, 4, None)
    ]
    alone = schedule.assign_match_and_nonmatch(rows.filter("v = 4"), bank.filter("k = 4"), "v", "k", ["n"]).first()
    assert alone.nonmatch is None and alone.issue == "missing_nonmatching_row"


def lease(state, kind, ts, who="d", **kw):
    event = {"event": kind, "ts": ts, "device": who, "lease_seconds": 100, "proof_bytes": 5000, "item_count": 65536, "retryable": True, **kw}
    return SS.lease_step(state, event)


def test_lease_transitions():
    s, ok = lease(("", None, 0.0, 0), "claim", 0.0)
    assert ok and s == ("claimed", "d", 100.0, 1)
    assert lease(s, "claim", 50.0, "e") == (s, False)
    assert lease(s, "heartbeat", 50.0, "e") == (s, False)
    s, _ = lease(s, "heartbeat", 50.0)
    assert s == ("running", "d", 150.0, 1)
    assert lease(s, "import", 20.0)[0][2] == 150.0
    assert lease(s, "finish", 60.0, item_count=65535) == (s, False)
    assert lease(s, "finish", 60.0, proof_bytes=10) == (s, False)
    done, ok = lease(s, "finish", 60.0)
    assert ok and done[0] == "done"
    assert lease(done, "claim", 999.0, "e") == (done, False)
    assert lease(done, "fail", 70.0)[0][0] == "failed"
    assert lease(s, "fail", 70.0, retryable=False)[0][0] == "quarantined"
    assert lease(s, "release", 70.0)[0][0] == "released"
    again, ok = lease(s, "claim", 200.0, "e")
    assert ok and again == ("claimed", "e", 300.0, 2)


def test_lease_stream_with_expiry(spark, tmp_path):
    schema = "lane bigint, event string, ts double, device string, lease_seconds int, proof_bytes bigint, item_count bigint, retryable boolean"
    first = [(1, "claim", 10.0, "d", 100, None, None, None), (2, "claim", 10.0, "d", 100, None, None, None), (2, "finish", 50.0, "d", 0, 5000, 65536, None)]
    later = [(3, "claim", 5000.0, "e", 100, None, None, None)]
    last = [(1, "claim", 6000.0, "e", 100, None, None, None)]
    for i, rows in enumerate((first, later, last)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = SK.file_stream(spark, str(tmp_path / "in"), "*.parquet", 1).withColumn("event_time", F.timestamp_seconds("ts"))
    out = SK.run_to_end(spark, stream, SS.ledger_state, "event_time", F.timestamp_seconds(F.lit(6000)), "0 seconds")
    rows = values(out, "lane", "event", "accepted", "status")
    assert (1, "expire", True, "expired_claims") in rows
    assert (2, "expire", True, "expired_claims") not in rows
    assert (1, "claim", True, "claimed") in rows and (2, "finish", True, "done") in rows
    assert out.filter("lane = 1 and event = 'claim'").agg(F.max("attempts")).first()[0] == 2


def test_health_rules(spark):
    schema = "id int, age double, full boolean, slots array<struct<s: double>>"
    df = spark.createDataFrame([(1, 1.0, False, []), (2, 130.0, None, [(5.0,)]), (3, 700.0, True, [(99.0,), (None,), (80.0,)]), (4, None, None, None)], schema)
    slow = F.coalesce(SM.slow_slots("slots", "s", 60.0), F.array().cast("array<struct<severity:string,code:string>>"))
    rules = [*SM.graded(F.col("age"), 120, 600, "stale"), ("warning", "full", F.col("full"))]
    got = {r.id: (r.status, r.codes) for r in SM.health_checks(df, ["id"], rules, [slow]).collect()}
    assert got == {1: ("ok", ""), 2: ("warning", "stale"), 3: ("critical", "full,stale,worker_slow,worker_slow"), 4: ("ok", "")}


def test_stale_sidecar_lanes(spark):
    frame = lambda lanes, d="h": spark.createDataFrame([(d, i) for i in lanes] or [("none", -1)], "device string, lane int").filter("lane >= 0")
    keep = lambda w, s, p, d: [r.lane for r in SM.surviving_ranges(frame(w), frame(s), frame(p), frame(d), "lane", "device").orderBy("lane").collect()]
    assert keep([1, 2, 3], [1, 2, 3], [], []) == []
    assert keep([1, 2, 3], [1, 2], [], []) == [3]
    assert keep([1, 2, 3], [1, 2, 3], [2], []) == [2]
    assert keep([1, 2, 3], [1, 2, 3], [], [1]) == [2, 3]
    assert keep([1, 2, 3], [], [], []) == [1, 2, 3]


def test_remote_reports_fold_in_device_order(spark):
    led = spark.createDataFrame([(1, "done", "x", 0.0, 1.0), (2, "running", "x", 500.0, None), (3, "running", "a", 900.0, None)], "lane int, status string, device string, lease_until double, finished_at double")
    rep = spark.createDataFrame([(1, "a", 0, "active"), (2, "a", 0, "done"), (2, "x", 1, "done"), (3, "a", 0, "active"), (4, "a", 0, "active"), (4, "b", 1, "done"), (5, "b", 1, "done")], "lane int, device string, pos bigint, kind string")
    got = ledger.reconcile_remote(led, rep, "lane", F.lit(100.0), 50.0)
    assert values(got, "lane", "status", "device", "lease_until", "conflicts") == [
        (1, "done", "x", 0.0, 0), (2, "done", "x", 500.0, 1), (3, "running", "a", 900.0, 0), (4, "running", "a", 150.0, 1), (5, "done", "b", 0.0, 0)
    ]


def test_compare_facts_delta(spark):
    a = spark.createDataFrame([("x", "1,000"), ("y", "abc"), ("z", "2")], "field string, value string")
    b = spark.createDataFrame([("x", "1500.5"), ("y", "3"), ("w", "1")], "field string, value string")
    assert values(quality.compare_facts(a, b), "field", "delta") == [("w", ""), ("x", "500.500"), ("y", ""), ("z", "")]


def test_files_promote(spark):
    led = spark.createDataFrame([(1, "running", "a", None, None), (2, "done", "b", 3.0, 9000)], "lane int, status string, device string, finished_at double, proof_bytes bigint")
    files = spark.createDataFrame([(1, 2000), (2, 3000), (3, 5000), (4, 10)], "lane int, size bigint")
    assert values(ledger.reconcile_files(led, files, "lane", F.lit(50.0)), "lane", "status", "device", "promoted") == [
        (1, "done", "a", True), (2, "done", "b", False), (3, "done", "folder-reconcile", True)
    ]


def test_append_log(spark, tmp_path):
    spark.createDataFrame([(1, "warning"), (2, "ok")], "n int, status string").write.parquet(str(tmp_path / "in"))
    stream = SK.file_stream(spark, str(tmp_path / "in"), "*.parquet")
    SK.finish(SK.append_events(stream, str(tmp_path / "log")))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_slots_use_first_usable_number(spark):
    run = spark.createDataFrame([(1, "a", "running", None, 0.0, 7.0, 9.0)], "slot int, item string, status string, active_elapsed double, elapsed double, outer_elapsed double, bundle_elapsed double")
    done = spark.createDataFrame([(1, 1, "x", "complete", 5.0, 6.0, 1), (1, 2, "y", "complete", 0.0, 6.0, 1), (2, 1, "z", "failed", 3.0, 3.0, 1)], "slot int, seq bigint, item string, status string, outer_elapsed double, elapsed double, complete_items int")
    got = {r.slot: r for r in monitor.slot_rows(run, done).collect()}
    assert (got[1].current_seconds, got[1].last_item, got[1].last_seconds) == (7.0, "y", 6.0)
    assert got[2].current_item is None and got[2].last_item == "z"


def test_pair_events_strict(spark):
    rows = [(1, "t-18", 5, 0, 77), (1, "t-0", 5, 18, None)]
    s = 77
    for _ in range(18):
        s = step(s)
    rows[1] = (1, "t-0", 5, 18, s)
    schema = "target int, label string, seed int, frame int, state bigint"
    ok = schedule.pair_events(spark.createDataFrame(rows, schema), "target", "label", "t-18", "t-0", ["seed"], "frame", "state", delay=18)
    assert ok.first().delay == 18
    with pytest.raises(Exception, match="missing-row"):
        schedule.pair_events(spark.createDataFrame(rows[:1], schema), "target", "label", "t-18", "t-0", ["seed"], "frame", "state", delay=18).collect()


def test_library_root_gone(spark):
    known = spark.createDataFrame([("a",), ("b",)], "path string")
    assert values(artifacts.refresh_library(known, known.limit(0), root_exists=False), "action") == [("delete",), ("delete",)]


def test_package_travels_to_tasks(spark):
    df = pd.DataFrame({"x": [1, 2]})
    out = spark.createDataFrame(df).select(G.lcg_at(F.lit(1), "x").alias("s")).count()
    assert out == 2


def test_streams_do_not_depend_on_the_batches(spark, tmp_path):
    """The same rows from one file as from unordered files, one per batch."""
    from residua.plans.stream_plans import lease_events

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("event_time", F.col("ts").cast("timestamp")).withColumn("us", F.unix_micros("event_time")).drop("ts")
    events.coalesce(1).write.parquet(str(tmp_path / "one"))
    events.repartition(3, F.xxhash64("event_id")).write.parquet(str(tmp_path / "many"))
    end = F.timestamp_micros(F.lit(events.agg(F.max("us")).first()[0]))
    found = {}
    for name in ("one", "many"):
        raw = SK.file_stream(spark, str(tmp_path / name), "*.parquet", 1)
        change = raw.select("user_id", "us", "event_time", F.when(F.col("value") > 60, "warning").otherwise("ok").alias("status"), F.col("event_type").alias("signature"))
        runs = [
            (lease_events(raw), lambda df: SS.ledger_state(df, "400 days"), ("lane", "ts", "event", "accepted", "status", "attempts")),
            (change, lambda df: SS.emit_on_change(df, "user_id", "us", "status", "signature", "event_time", "400 days"), ("user_id", "us", "status", "signature")),
        ]
        found[name] = [sorted(values(SK.run_to_end(spark, s, build, "event_time", end, "400 days"), *columns)) for s, build, columns in runs]
    assert found["one"] == found["many"]
    assert len(found["one"][0]) >= events.count()
