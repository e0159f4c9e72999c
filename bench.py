"""Time the headline queries; prints one JSON line.

Every query runs twice and the second run counts. Queries over entries read a staged journal, so its staging is an entry of its own.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tallywright.functions.tables import release_held
from tallywright.plans import entry_queries, registry
from tests.session import local_session

HEADLINE = [
    "J00_scored_journal", "J21_run_summary", "Q01_sequence_missing", "S01_fixed_width_scan", "S19_export_results",
    "E00_stage_journal", "E10_duplicate_entries", "E20_quick_reversals", "E23_all_anomalies", "E27_result_as_evidence",
    "D05_classify_documents", "V03_section_status",
]


def run(build, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session()
    queries = registry.queries() | {"E00_stage_journal": entry_queries.restaged}
    chosen = sys.argv[1:] or HEADLINE
    times = {}
    for name in chosen:
        run(queries[name], spark, sf_dir)
        release_held(spark)  # tables that document queries share are made anew
        times[name] = round(run(queries[name], spark, sf_dir), 3)
    print(json.dumps({
        "metric": "headline queries, warm, total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
