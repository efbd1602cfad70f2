"""Headline queries: wall-clock seconds per query, one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 4).  Each query runs to a sink that discards
rows; the first run of a small query warms the JVM up and is not counted.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "jn1_scope", "jn1_many_rules", "jn3_network_inclusion", "jn8_overall", "jn11_longest_prefix", "jn12_as_of_range", "ag16_enrichment_sets",
    "fn7_url", "wn3_previous_state", "chg2_http", "chg5_endpoints", "mrg4_upsert_edges", "set4_kev_sync", "jn14_neighbours", "jn19_policy_match",
    "nt3_rate_limit", "wn1_full_rank", "wn2_fair_share_admit", "wn5_nested_terms", "snk2_latest_docs", "job2_guards", "ob3_dns_states",
    "ob12_correlation_changes", "pn1_overview", "pn7_operations", "st2_once_per_fact",
]


def main() -> None:
    from palisade import catalogue
    from palisade.session import build_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = build_session(
        f"local[{cpus}]", "bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalogue.queries()
    only = sys.argv[1:] or HEADLINE

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("jn10_url_exclusions")
    run("ag2_job_counts")
    times = {}
    for name in only:
        times[name] = round(run(name), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    extra = {}
    if "jn1_many_rules" in times:
        targets = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_partkey").distinct().count()
        rules = spark.read.parquet(f"{sf}/orders.parquet").count()
        warm = min(run("jn1_many_rules") for _ in range(2))
        extra = {
            "scope_decisions_per_sec": round(targets / times["jn1_many_rules"]), "scope_decisions_per_sec_warm": round(targets / warm),
            "scope_targets": targets, "scope_rules": rules,
        }
    print(json.dumps({
        "metric": "total_seconds_headline_queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"), "cpus": int(cpus), **extra,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
