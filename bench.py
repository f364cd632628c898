"""Time the headline queries: one JSON line on standard output.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3).
Each query runs once to warm up, then BENCH_RUNS times; the median counts. Results go to the
no-op sink: every row and column is computed, none is collected. BENCH_REPORT=1 adds rows in,
rows out, exchanges and spilled bytes per query.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = {  # query: table whose rows it reads
    "gated_label_change": "events", "run_spans": "events", "circuit_breaker": "events", "nearest_distance": "events",
    "sliding_windows": "events", "knowledge_document": "events", "events_in_spans": "lineitem", "assign_by_overlap": "lineitem",
    "timeline_totals": "lineitem", "chunk_by_gap": "conversations", "regroup_speech": "conversations",
    "merge_segments": "conversations", "merge_round": "embeddings", "master_index": "documents", "cross_references": "documents",
}


def main() -> None:
    from mediatimeline.plans.catalog import QUERIES
    from mediatimeline.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or list(HEADLINES)
    spark = build_session(cpus, shuffle_partitions=8, memory=os.environ.get("BENCH_MEMORY", "12g"))

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds, report = {}, {}
    for name in names:
        run(name)
        seconds[name] = round(statistics.median(run(name) for _ in range(runs)), 3)
        if os.environ.get("BENCH_REPORT"):
            df = QUERIES[name](spark, folder)
            plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
            rows_in = spark.read.parquet(f"{folder}/{HEADLINES.get(name, 'events')}.parquet").count()
            report[name] = {"rows_in": rows_in, "rows_out": df.count(), "exchanges": plan.count("Exchange hashpartitioning"),
                            "rows_per_sec": round(rows_in / seconds[name])}
    line = {"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
            "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}
    if report:
        line["report"] = report
    print(json.dumps(line), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
