"""Time the headline queries; prints one JSON line.

Reads BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).
``BENCH_QUERIES`` may name a comma-separated subset, or ``all``.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.queries import REGISTERED  # noqa: E402
from vitrina.session import build_session  # noqa: E402

HEADLINE = [
    "hybrid_search", "lexical_search", "bm25_search", "vector_search", "rrf_fusion", "analyze_text", "normalize_text",
    "catalog_filter", "csv_source", "embed_backfill", "merge_embeddings", "knn_join", "ann_knn", "hybrid_recall",
    "filter_separation", "label_consistency", "silhouette", "ari", "pair_separation", "pair_stats",
    "retrieval_metrics", "text_pair_retrieval", "by_group", "near_duplicates",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(REGISTERED) if wanted == "all" else [n for n in wanted.split(",") if n] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", {
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.extraJavaOptions": "-Dlog4j2.level=ERROR",
    })
    spark.sparkContext.setLogLevel("ERROR")
    # One untimed run starts the JVM code paths and the Python workers.
    REGISTERED["normalize_text"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.time()
        REGISTERED[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
