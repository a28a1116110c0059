"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) select data and cores.
Every query is timed twice in full, including the jobs it starts while it is built, and the
second, warm time is reported.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "lines_split",
    "segment_statutes",
    "validation_report",
    "ingest_chunks",
    "hash_embed",
    "chunk_tokens",
    "knn_cosine",
    "knn_ivf",
    "rrf_fused",
    "retrieve_formatted",
    "bm25",
    "hybrid_rrf",
    "keyword_contains",
    "expand_terms",
    "subqueries",
    "history_window",
    "prompt_table",
    "sessionize",
    "eval_mean_quality",
]


def run(query, spark, folder):
    start = time.time()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.time() - start, 3)


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")

    import registry
    from lexiframe.session import local_session

    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.all_queries()
    times = {}
    for name in HEADLINE:
        run(queries[name], spark, folder)
        times[name] = run(queries[name], spark, folder)
    for name, (build, search) in registry.index_searches().items():
        index = build(spark, folder)
        def found(s, f, index=index, search=search):
            return search(s, f, index)

        run(found, spark, folder)
        times[name] = run(found, spark, folder)
    print(
        json.dumps(
            {
                "metric": "total seconds of headline queries",
                "value": round(sum(times[name] for name in HEADLINE), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
