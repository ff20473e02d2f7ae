"""Time the registered queries and print one JSON line.

Reads BENCH_SF_DIR (tables), BENCH_CPUS (cores) and BENCH_QUERIES (a comma-separated
choice; all headline queries if unset). Each query runs once to warm up and then
BENCH_RUNS times; the median counts. Results go to Spark's no-op sink, so every
column is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from corpuslab.plans import QUERIES
from corpuslab.session import local_session, scratch_scope

HEADLINE = [
    # sources and sinks
    "csv_roundtrip", "text_line_split", "libsvm_roundtrip",
    # cleaning and sampling
    "clean_pages", "remove_accents", "null_audit", "clean_class_counts", "share_sample", "hash_split",
    # profiling
    "class_counts_desc", "class_size_tiers", "rows_in_tier", "moving_avg",
    # text
    "tokenize", "regex_tokenize", "remove_stop_words", "ngrams_3", "hashing_tf", "term_counts",
    "vocabulary_size", "idf", "tf_idf", "tf_idf_top_terms",
    # vectors
    "string_index", "vector_index_slots", "vector_index_values", "standard_scale",
    # models
    "nb_term_loglik", "nb_predict", "nb_tfidf_predict", "nb_hashed_tfidf_predict",
    "nb_counted_tfidf_ml_predict", "nb_hashed_ml_predict", "random_forest_predict",
    "entropy_forest_predict", "decision_tree_predict", "logistic_predict",
    "logistic_lbfgs_predict", "nb_class_terms_predict", "nb_dictionary_tfidf_predict", "cv_naive_bayes_metrics",
    "term_dictionary", "count_vectors", "text_kmeans_assign", "kmeans_assign", "kmeans_update", "kmeans_fit",
    "text_kmeans_fit", "cv_grid_metrics",
    # evaluation
    "metric_weighted", "nb_metric_weighted",
]


def run(spark, plan, sf_dir: str) -> float:
    start = time.perf_counter()
    with scratch_scope(spark):
        plan(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    chosen = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark = local_session("bench", cores, scratch=tempfile.mkdtemp(prefix="bench-"))
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in chosen:
        plan = QUERIES[name].plan
        run(spark, plan, sf_dir)
        times[name] = round(statistics.median(run(spark, plan, sf_dir) for _ in range(runs)), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
