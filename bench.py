"""Time the headline queries and print one JSON line.

BENCH_SF_DIR picks the data folder and BENCH_CPUS the cores. Every query runs to the end through the
no-op sink; one untimed small query warms the JVM and the Python workers first.
"""

from __future__ import annotations

import json
import os
import time

from paperlode import build_session
from paperlode.plans import QUERIES, Tables
from paperlode.plans.retrieval import stored_index

HEADLINE = [
    "hybrid_search",
    "hybrid_reranked",
    "bm25_top_k",
    "bm25_stored_index",
    "dense_top_k",
    "term_statistics",
    "timeline",
    "lineage",
    "content_groups",
    "byte_chunks",
    "verify_altered_log",
    "merkle_root",
    "carried_purchase",
    "purchase_after_click",
    "entity_spans",
    "masked_documents",
    "page_sections",
    "similar_name_pairs",
    "coverage_counts",
    "visible_documents",
    "supplier_conflicts",
    "streamed_events",
]


def main() -> None:
    base = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="12g",
        # The default of 64 MB would put this small data into one write task.
        spark__sql__adaptive__advisoryPartitionSizeInBytes="4m",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["canonical_props"](spark, base).write.format("noop").mode("overwrite").save()
    seconds = {}
    # building the index and looking it up are timed apart
    began = time.perf_counter()
    stored_index(Tables(spark, base))
    seconds["index_build"] = round(time.perf_counter() - began, 3)
    for name in os.environ.get("BENCH_QUERIES", "").split() or HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, base).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(base.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
