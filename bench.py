"""Benchmark: seconds per headline query (second run), as one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES
(comma-separated names, or ``all``), BENCH_RUNS (default 2).
"""

import json
import os
import time

from nlsql_spark.session import local_session
from workload import QUERIES

HEADLINE = [
    "job_01_retrieval_documents",
    "job_02_ground_truth_links",
    "join_03_link_by_tokens",
    "join_03_link_by_tokens_texts",
    "join_03_link_by_edit_distance",
    "srt_01_knn",
    "join_04_link_by_embedding",
    "join_07_repair_links",
    "job_05_schema_prompts",
    "aug_03_build_retry_dataset",
    "aug_01_corrupt_multiple_all",
    "win_01_probe_contexts",
    "udf_04_build_vocab",
    "udf_04_encode",
    "job_07_training_batches",
    "job_08_probe_dataset",
    "job_09_generate_sql",
    "job_10_execution_report",
    "job_11_link_scoring",
    "job_12_marker_report",
    "agg_04_top_values",
    "agg_10_link_metrics",
    "agg_11_valid_efficiency_score",
    "aug_07_train_val_split",
    "win_06_pad_batches_right",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else [n for n in wanted.split(",") if n] or HEADLINE
    spark = local_session(cores=cpus, shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in names:
        for _ in range(int(os.environ.get("BENCH_RUNS", "2"))):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
