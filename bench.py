"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the data (default sf0.1), BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = [
    "rule_score", "keyword_filter", "decode_scan", "periodic_repeat", "drift_score", "detect",
    "cascade_potential_asof", "suspicion_history", "reachable_agents", "edge_aggregate",
    "normalise_source", "blend_sources", "split_ratio", "dataset_statistics", "build_corpus",
    "tfidf", "word_ngrams", "score_classifier", "auc_roc", "ablation", "baseline_comparison",
    "score_distribution", "histogram", "quarantine_summary", "halt_downstream",
    "guard_last_message", "stream_score", "stream_quarantine",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("parapet-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="parapet-bench-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from checks import catalog
    from checks.catalog import QUERIES

    catalog.PIECES = int(cpus)

    chosen = sys.argv[1:] or HEADLINE
    QUERIES["type_histogram"](spark, folder).collect()  # start the workers
    times = {}
    for name in chosen:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    warm = None
    if "rule_score" in times:  # once more, now that everything is compiled; not in the total
        start = time.perf_counter()
        QUERIES["rule_score"](spark, folder).write.format("noop").mode("overwrite").save()
        warm = time.perf_counter() - start
    messages = spark.read.parquet(f"{folder}/documents.parquet").count()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "rule_filter_ms_per_message": round(times["rule_score"] * 1000 / messages, 4)
        if "rule_score" in times else None,
        "rule_filter_warm_ms_per_message": round(warm * 1000 / messages, 4) if warm else None,
        "detect_ms_per_message": round(times["detect"] * 1000 / messages, 4)
        if "detect" in times else None,
    }))


if __name__ == "__main__":
    main()
