"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the local cores, ``BENCH_RUNS`` the timed
runs per query (the median counts). Each query runs once untimed, and every row of its result is
produced by the noop sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from tallyforge.plans.catalog import QUERIES
from tallyforge.session import local_session

HEADLINE = (
    "ent_aggregate", "prof_cardinality", "prof_corr_matrix", "prof_box_by_class", "select_numeric_features",
    "impute_median", "scale_standard", "encode_ordinal", "split_stratified", "feat_row_stats",
    "feat_timeseries", "m_f1_macro", "m_roc_auc", "roc_curve", "threshold_sweep", "m_median_ae",
    "item_top_n", "drift_report", "anomaly_importance", "iforest_score", "lof_score", "clu_dbscan",
    "clu_kmeans", "cls_knn", "reg_forest", "cls_gaussian_nb",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    keys = sys.argv[1:] or HEADLINE
    start = time.time()
    spark = local_session(cores, shuffle_partitions=8 if cores == "*" else int(cores))
    spark.range(1).count()
    cold = time.time() - start
    times = {}
    for key in keys:
        taken = []
        for i in range(runs + 1):
            begin = time.time()
            QUERIES[key](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.time() - begin)
        times[key] = round(statistics.median(taken[1:]), 3)
    print(json.dumps({
        "metric": "total seconds of the headline queries, warm", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cores": cores, "session_start_sec": round(cold, 3)}))
    spark.stop()


if __name__ == "__main__":
    main()
