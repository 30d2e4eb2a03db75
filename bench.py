"""Times the headline queries: median of three warm runs each, results written to a noop sink."""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from shelfwise.registry import QUERIES
from shelfwise.session import build_session

HEADLINE = (
    "popularity_score", "review_weight", "frequency_score_join", "behavior_product_join",
    "products_by_category", "rating_distribution", "user_behavior_analysis", "kpi_totals", "latency_summary",
    "top_products", "product_reviews", "top_n_per_user", "latest_snapshot", "search_products",
    "build_inverted_index", "tfidf", "similar_products", "user_similarity", "customer_similarity",
    "hybrid_all_users", "als_recommend_all", "live_interactions", "svd_recommend", "knn_sweep", "ranking_metrics",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or list(HEADLINE)
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
           "spark.checkpoint.dir": os.environ.get("BENCH_CHECKPOINTS") or tempfile.mkdtemp(prefix="bench-")},
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    timings = {}
    for name in only:
        once(name)
        timings[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
