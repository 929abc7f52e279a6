"""Bench: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed to completion with the ``noop`` sink (every row is
produced, nothing is collected). Every query first runs once, untimed, on
sf0.001 to warm the JIT and the Python workers. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from lumenrank.operators.plan import release_checked  # noqa: E402
from lumenrank.session import local_session  # noqa: E402
from lumenrank.plans.catalog import queries  # noqa: E402

HEADLINE = [
    "postings",          # BM25 index build (R3)
    "bm25_topk",         # BM25 search (R4)
    "encode_hash",       # dense index build (D1)
    "dense_text_topk",   # exact dense search (R1)
    "knn_exact",         # exact kNN on given vectors (R1)
    "rrf_fusion",        # R5
    "pointwise_rerank",  # R7
    "listwise_rerank",   # R8
    "hit_at_k",          # V1-V3
    "mine_backfilled",   # N1-N8
    "composed_full",     # R11
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    extra = {}
    log_dir = os.environ.get("BENCH_EVENT_LOG_DIR")  # stage / task times for later reading
    if log_dir:
        extra = {"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir}
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")), extra=extra)
    qs = queries()
    # warm the JIT and the Python workers once on the smallest tables (not timed)
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        for n in names:
            qs[n](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        t0 = time.time()
        qs[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
        release_checked()
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "headline_total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf,
    }))


if __name__ == "__main__":
    main()
