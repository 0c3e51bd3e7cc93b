"""Time the headline pipelines; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from chronotape.plans import catalog  # noqa: E402
from chronotape.session import build_session  # noqa: E402

HEADLINE = {
    "q1_grid": "grid_cells",
    "q2_validation": "validation_provenance",
    "q3_collection": "collection_accounting",
    "q4_reconstruction": "timelines",
    "q5_knowledge": "knowledge_summary",
    "q6_audit": "audit_report",
    "q7_news_archive": "news_dedup",
    "q8_feature_gate": "pit_gate",
    "q9_integrity": "integrity_checks",
    "asof_regime": "asof_regime",
    "scd2_versions": "scd2_versions",
    "barrier_outcomes": "barrier_outcomes",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or list(HEADLINE)
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "20g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    # Class loading and code generation are not what is measured: run everything once on the smallest data.
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        for name in names:
            catalog.QUERIES[HEADLINE[name]](spark, small).write.format("noop").mode("overwrite").save()
    took = {}
    for name in names:
        start = time.time()
        catalog.QUERIES[HEADLINE[name]](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "pipelines_total_seconds", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
