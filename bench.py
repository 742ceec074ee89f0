"""Time the headline queries end to end: one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the cores.  Every query runs twice.  Stored inputs
(cleaned tokens, lexicon, master table, ...) are built by the first query that needs them, inside
its time.  ``value`` is the sum of the first runs; ``queries`` holds the first and ``again`` the
second time of every query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "tokenize_text", "clean_pipeline", "lemmatize_lookup", "term_counts", "doc_frequency", "topn_terms",
    "dictionary_build", "tag_topics", "join_lexicon", "union_distinct_master", "join_predictions",
    "topic_group_stats", "top_words_per_group", "top_tfidf_per_group", "tfidf_features", "tfidf_log2",
    "lexicon_sentiment", "lexicon_sentiment_by_topic", "mean_with_ci", "sample_n", "sample_large_per_source",
    "stratified_split", "random_split", "binary_metrics", "train_logreg", "grid_search_cv", "lda_topics",
    "embedding_classifier",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from vocalis.plans.queries import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("vocalis-bench")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    first, again = {}, {}
    for name in sys.argv[1:] or HEADLINE:
        for into in (first, again):
            start = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            into[name] = round(time.time() - start, 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_end_to_end", "value": round(sum(first.values()), 3), "unit": "sec",
        "queries": first, "again": again, "sf": float(scale.group(1)) if scale else sf_dir, "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
