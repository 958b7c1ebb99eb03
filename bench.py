"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from postweave.plans.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "top_tags_skip_first",
    "tag_share_by_dataset",
    "tags_per_post_stats",
    "tag_edges_weighted",
    "date_filter_range",
    "class_balance",
    "nested_stratified_folds",
    "static_meta_features",
    "static_account_features",
    "phrase_flags",
    "lexicon_scores",
    "text_clean",
    "tokens_no_stop",
    "stemmed_vocab",
    "dictionary_filter",
    "bow_counts",
    "term_odds",
    "impute_scale",
    "cv_metrics_pooled",
    "mcnemar_tests",
    "ols_coefficients",
    "tag_communities",
]
# Queries slower than this in the warm-up are timed once, others three times.
SLOW = 6.0


def run(spark: SparkSession, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        warm = run(spark, name, sf_dir)
        rounds = 1 if warm > SLOW else 3
        times[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(rounds)), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
