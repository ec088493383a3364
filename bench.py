"""Times the headline queries on `$BENCH_SF_DIR` with `local[$BENCH_CPUS]`; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from narrascope.catalog.queries import all_queries  # noqa: E402
from narrascope.session import local_session  # noqa: E402

HEADLINE = (
    "symbol_summary", "symbol_match", "symbol_counts", "hybrid_score", "sentiment_distribution",
    "topic_emotion", "term_stats", "bag_of_words", "vocabulary", "topic_keywords", "topic_summary",
    "ngrams", "feature_hash", "embed_encoder", "pca_coords", "pca_by_group", "kmeans_by_group",
    "kmeans_assign", "local_map", "axis_extremes", "intruder_rounds", "lda_assign", "accuracy",
    "graded_answers", "sample_n", "median_split", "scatter_bins", "scatter_sample",
)


def run(spark, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    all_queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    wanted = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {name: round(min(run(spark, sf_dir, name) for _ in range(repeats)), 3) for name in wanted}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries, best run each",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
