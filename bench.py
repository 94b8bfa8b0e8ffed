"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from reelwise.plans.catalog import QUERIES
from reelwise.session import build_session

# The stages of the offline run: statistics, recall channels, fusion, candidates, reranking, evaluation.
HEADLINE = [
    "history_stats_asof",
    "popular_recall_large",
    "popular_window",
    "popular_decayed",
    "itemcf_topk",
    "itemcf_topk_large",
    "itemcf_multifeedback",
    "category_recall",
    "text_recall",
    "embedding_topk",
    "embedding_neighbours",
    "quota_fusion",
    "candidate_features",
    "pit_history",
    "mmr_rerank_panel",
    "logistic_scores",
    "ranking_metrics",
    "dense_panel_eval",
    "log_profile_large",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"), "spark.sql.shuffle.partitions": str(2 * int(cpus)), "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    only = os.environ.get("BENCH_ONLY")
    names = only.split(",") if only else HEADLINE
    QUERIES["split_counts"](spark, folder).collect()  # session warm-up
    timings = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
