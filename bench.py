"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
Each query is fully materialized (a no-op write of every row) and timed
after one warm-up of the session.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tessera.plans import catalog  # noqa: E402
from tessera.session import get_session  # noqa: E402

HEADLINE = [
    "curate_comments", "stratified_exact", "quantile_buckets", "corpus_union",
    "hash_embedding", "hash_search", "vector_topk_batch", "near_duplicate_pairs",
    "query_match", "news_for_query", "ranked_scores", "diverse_news",
    "rag_context", "attempt_resolution", "parse_dates",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(cpus),
                        extra={"spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    # Warm-up (reported separately): JVM, Python workers, parquet footers.
    t0 = time.time()
    catalog.QUERIES["profile_shape"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    catalog.QUERIES["hash_search"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    warmup = round(time.time() - t0, 3)
    times = {}
    for n in names:
        t0 = time.time()
        catalog.QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_headline_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else None,
        "cpus": int(cpus),
        "warmup_sec": warmup,
    }))


if __name__ == "__main__":
    main()
