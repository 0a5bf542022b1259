"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

# The whole audit comes first, so its time includes starting up.
HEADLINE = [
    "findings_all", "audit_from_bytes", "severity_counts", "rule_scan", "rule_S1", "rule_D8", "rule_O1",
    "rls_missing", "env_undocumented", "orphan_modules", "clone_blocks",
    "clone_blocks_documents", "comment_runs", "registry_missing", "typosquat", "run_diff",
    "finding_dedup", "blocking_top", "audit_table", "check_prevalence", "corpus_summary",
    "segment_report", "stratified_sample", "ingest_files", "file_cap", "stream_rule_scan",
]
# The published rate of a whole audit by the tool whose checks these are.
PUBLISHED_FILES_PER_SEC = 366


def main() -> None:
    from corpuswarden.registry import QUERIES
    from corpuswarden.session import Workspace, build_session
    from corpuswarden.sources import corpora

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(cores)
    spark.sparkContext.setLogLevel("ERROR")

    files, characters = corpora.all_files(spark, sf_dir).selectExpr(
        "count(*)", "sum(length(text))").first()
    took: dict[str, float] = {}
    for name in HEADLINE:
        with Workspace(spark):
            start = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - start, 3)
    rate = round(files / took["findings_all"], 1)
    print(json.dumps({
        "metric": "total wall time of the headline queries",
        "value": round(sum(took.values()), 3),
        "unit": "sec",
        "queries": took,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "files": files,
        "megabytes": round(characters / 1e6, 1),
        "whole_audit_files_per_sec": rate,
        "whole_audit_over_published": round(rate / PUBLISHED_FILES_PER_SEC, 2),
        "audit_note": "all checks over all files, in place as a table; the published rate includes cloning",
    }))
    spark.stop()


if __name__ == "__main__":
    main()
