"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the input folder, BENCH_CPUS the local cores, BENCH_QUERIES an
optional comma list. Stored fixtures (signed ledger, devices, files, hash lists) are written
before the clock starts, as a ledger would be stored already, and three queries run
at the smallest scale to warm the session up. Each query then runs once; its whole
result is computed and discarded.
"""

import json
import os
import sys
import time

from chainwitness.catalog import registry
from chainwitness.session import build_session
from chainwitness.testing import fixtures

HEADLINES = (
    "chain_hash_check", "chain_build_fold", "link_check", "signature_check", "session_audit",
    "global_verdict", "file_verdicts", "session_report", "manifest_verify", "file_hash_lookup",
    "seq_gaps", "compact_ranges", "ledger_quarantine", "idempotent_ingest", "snapshot_drift",
    "journey_index", "newest_300", "purge_survivors", "cache_retention", "incident_locks",
    "backoff_ladder", "outbox_pending", "ahash", "phash", "whash", "hamming_join",
    "vector_distances", "threshold_sweep", "ssdeep_digest", "tlsh_digest", "tlsh_distance",
    "metric_comparison", "tamper_bytes", "stream_links", "stream_rollup",
)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    asked = os.environ.get("BENCH_QUERIES")
    names = asked.split(",") if asked else HEADLINES
    spark = build_session(
        "bench", f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__sql__adaptive__coalescePartitions__minPartitionSize="64k",
    )
    spark.sparkContext.setLogLevel("ERROR")
    for make in (fixtures.conv_ledger, fixtures.devices, fixtures.conv_files, fixtures.conv_manifests):
        make(spark, sf_dir).count()
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(small):  # start the Python workers and let the JVM compile
        for name in ("session_audit", "global_verdict", "hash_comparison"):
            registry.QUERIES[name](spark, small).write.format("noop").mode("overwrite").save()
    times, failed = {}, {}
    for name in names:
        start = time.perf_counter()
        try:
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        except Exception as error:  # a failing query must not hide the others
            failed[name] = str(error)[:200]
        print(name, times.get(name, "failed"), file=sys.stderr, flush=True)
    result = {
        "metric": "total seconds of headline queries", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus),
    }
    if failed:
        result["failed"] = failed
    print(json.dumps(result))


if __name__ == "__main__":
    main()
