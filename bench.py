"""Wall time of the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from tuneloom.plans import REGISTRY
from tuneloom.session import local_session

HEADLINE = (
    "leaderboard", "structure_results", "reindex_runs", "run_summary", "export_history", "race_round", "successive_halving",
    "task_statistics", "average_rank", "wilcoxon", "edge_frequency", "node_statistics", "uct_score", "asof_raster",
    "best_so_far", "weighted_f1", "log_loss", "roc_auc", "roc_auc_ovr", "stratified_split", "soft_vote", "score_library",
    "greedy_selection", "good_bad_split", "kde_density", "marginal_means", "nearest_neighbour", "column_profile",
    "merge_configs", "random_forest", "stream_incumbent",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    REGISTRY["run_summary"].run(spark, folder).collect()  # start the session
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    first, median = {}, {}
    for name in HEADLINE:
        spent = []
        for _ in range(runs):
            begin = time.perf_counter()
            REGISTRY[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            spent.append(time.perf_counter() - begin)
        first[name] = round(spent[0], 3)
        median[name] = round(sorted(spent)[len(spent) // 2], 3)
    print(json.dumps({
        "metric": "headline_queries_wall_time", "value": round(sum(median.values()), 3), "unit": "sec",
        "queries": median, "first_run": first, "runs": runs, "sf": Path(folder).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
