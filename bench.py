"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the folder (default /root/testdata/sf0.1), BENCH_CPUS the cores of local[n].
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tabeval.queries import QUERIES  # noqa: E402
from tabeval.session import local_session  # noqa: E402

HEADLINE = [
    "e11_metrics_many_models", "e11_metrics_row", "e7_roc_points_all", "e8_precision_recall_points",
    "c2_medians_large", "c5_moments_large", "c6_scaler_apply", "x1_stratified_split", "x4_shuffled_batches",
    "j4_search_grid", "m5_nearest_neighbour_votes", "m6_gaussian_naive_bayes", "z2_batched_scoring",
    "a1_type_statistics", "a2_axis_statistics", "a9_correlation", "a11_box_by_event", "w1_rank_summary",
    "w7_running_best", "w8_early_stopping", "g5_family_comparison", "g4_search_analysis", "k1_write_summary",
    "k2_write_combined", "k3_write_runs_csv", "k5_text_report", "m1_logistic_regression", "m7_decision_tree",
    "m9_perceptron", "g2_network_evaluation",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "bench")
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    # The first queries of a session pay for starting the engine and its Python workers.
    for name in ("e11_metrics_row", "z2_batched_scoring"):
        run(name)
    queries = {name: round(run(name), 3) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(queries.values()), 3),
                "unit": "sec",
                "queries": queries,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
