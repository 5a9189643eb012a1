"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from triage.plans.queries import QUERIES  # noqa: E402

HEADLINE = (
    "file_facts", "source_files", "symbol_ranges", "import_edges", "graph_stats", "graph_neighborhood",
    "graph_cycles3", "chunk_text", "hashed_vectors", "knn_cosine", "trace_summary", "anchor_symbols",
    "ranked_files", "top_files", "compressed_documents", "token_counts", "context_pack", "assembled_contexts",
    "run_outcomes", "loop_results", "patch_changes", "apply_patches", "snapshot_diff", "counter_deltas",
    "usage_dashboard",
)


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("triage-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        # a few MB per table still mean seconds of work: split by size, not by file count
        .config("spark.sql.files.openCostInBytes", "65536")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="triage-bench-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    QUERIES["file_facts"](spark, sf_dir).limit(1).collect()  # start-up is not measured
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        begin = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - begin, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    stages = spark.conf.get("spark.checkpoint.dir")
    spark.stop()
    shutil.rmtree(stages)


if __name__ == "__main__":
    main()
