"""Wall times of the headline queries. Prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose data and cores; BENCH_QUERIES=all or a comma list chooses the queries.
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "build_threads", "ancestor_closure", "debate_clusters", "debate_chains", "community_metrics", "nlp_annotate", "vector_topk", "near_duplicates", "search",
    "audience_overlap", "co_occurrence", "pagerank", "clustering_betweenness", "communities", "upload_cadence", "break_spikes", "energy_curve", "highlights",
    "suppress_nearby", "align", "linguistic_style", "meta_quality", "recrawl_diff", "reuse", "entity_propagation", "linguistic_profile", "chart_data", "event_rate",
]


def main() -> None:
    from reeltide.plans import catalog
    from reeltide.session import build_session
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(queries) if chosen == "all" else (chosen.split(",") if chosen else HEADLINE)
    queries["feedback_stats"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the JVM paths
    times: dict[str, float] = {}
    for name in names:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(f"{times[name]:8.2f} {name}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total wall time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
