"""Headline queries, timed; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from residua.plans import QUERIES  # noqa: E402
from residua.session import build_session  # noqa: E402

HEADLINE = [
    "residual_by_mod", "class_report", "offset_coverage", "nearest_candidate", "select_baseline", "majority_rule", "rule_residual",
    "marginals", "band_split", "rate_by_feature", "rate_matrix", "changed_histogram", "residual_keys", "best_layout",
    "encode_exceptions", "decode", "two_stage", "roundtrip", "template_factor", "quantiles", "concentration", "lorenz", "share_running",
    "rank_curve", "variance_explained", "transitions", "frequent_keys", "unique_outcomes", "coverage", "pair_completeness", "missing_samples",
    "compact_ranges", "duplicates", "rle", "merge_intervals", "suppress_overlaps", "moving_average_repeat", "sliding_vectors", "progress_rate",
    "stall_flags", "merge_best", "ledger_summary", "row_status", "trusted_union", "ownership", "pair_events", "resume_scan", "match_nonmatch",
    "traits", "top_k_scores", "generator_stream", "first_occurrence", "lookahead", "template_match", "verify_digest", "ordered_digest", "digest_tree", "text_scan",
    "compare_sequences", "classify_artifacts", "parse_ledgers", "flatten_reports", "stream_progress", "stream_change", "stream_lease", "stream_dedupe",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = build_session(
        f"local[{cpus}]",
        "bench",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.local.dir": scratch,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["residual_by_mod"](spark, folder).write.format("noop").mode("overwrite").save()  # warm up, not timed
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    cells = spark.read.parquet(os.path.join(folder, "lineitem.parquet")).count()
    line = {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")), "lineitem_rows": cells}
    spark.stop()
    print(json.dumps(line))


if __name__ == "__main__":
    main()
