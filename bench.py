"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from tabloom.catalog import QUERIES
from tabloom.session import local_session

HEADLINE = [
    "group_mean_cv",
    "missing_counts",
    "feature_values",
    "unseen_category_rows",
    "select_kbest",
    "impute_median",
    "impute_mode",
    "encode_onehot",
    "encode_target",
    "encode_hashing",
    "encode_text_minhash",
    "encode_date_cyclical",
    "preprocess_chain",
    "scale_standard",
    "spline_basis",
    "repeated_kfold",
    "knn_classifier",
    "gbt_regressor",
    "rf_classifier",
    "score_rmse",
    "score_medae",
    "score_auc",
    "score_ngini",
    "bag",
    "bag_ranks",
    "blend",
    "apply_blend",
    "trial_means",
    "select_within_sigma",
    "rank_best_trials",
    "random_trials",
    "pair_search_with_blend",
    "patience_stop",
    "blend_by_jobs",
    "bag_then_blend",
    "train_folds",
    "search",
    "impute_num_model",
    "impute_cat_model",
    "kernel_svm_classifier",
    "setup_and_start",
    "race",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    # untimed, so that no query carries the start of the JVM
    QUERIES["group_mean_cv"](spark, sf_dir).collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        df = QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
