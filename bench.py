"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from grainfold.plans import QUERIES
from grainfold.session import build_session

HEADLINE = (
    "ans_top_n", "agg_quantile", "agg_rollup_path", "agg_duplicates", "win_ffill", "win_index", "win_keep", "stm_window_hits",
    "prf_columns", "prf_corr", "prf_top_values", "prf_quality", "cln_replay", "cln_out_iqr_remove", "eda_hist", "eda_heatmap",
    "viz_bar", "viz_treemap", "viz_kde", "map_grid", "ans_trend", "txt_intent", "sig_leak_pair", "met_clf", "win_roc", "ts_baselines",
    "ml_forest_clf", "sig_scan", "ml_knn", "clu_dbscan", "ssl_propagate", "stm_admission", "cln_label",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    work = os.environ.get("BENCH_WORK_DIR") or tempfile.mkdtemp(prefix="bench-")
    spark = build_session("bench", cores, **{"spark.sql.shuffle.partitions": cores, "spark.driver.memory": "16g", "spark.checkpoint.dir": work})
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["agg_group_sum"](spark, folder).write.format("noop").mode("overwrite").save()  # start-up and first compilation are not part of any query
    taken = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        taken[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(taken.values()), 3), "unit": "sec",
        "queries": taken, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
