"""Headline timings: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import time

from lanecost.plans.catalog import QUERIES
from lanecost.session import session_builder

HEADLINE = (
    "weekly_route_metrics", "candidate_rule", "compile_notes", "structured_recall", "decide_verdict",
    "final_output", "mix_rate_decomposition", "operational_leads", "tfidf_sparse", "dense_cosine",
    "rank_fusion", "grounding_validation", "analysis_summary", "weekly_reconciliation", "dq_report",
    "list_anomalies", "review_evidence",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        session_builder("lanecost-bench").master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    names = os.environ.get("BENCH_QUERIES", "")
    chosen = [n for n in names.split(",") if n] or list(HEADLINE)
    # neither the session nor the first compilation of large expressions is what is measured
    QUERIES["analysis_summary"](spark, os.environ.get("BENCH_WARM_DIR", sf_dir)).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in chosen:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
