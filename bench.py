"""Headline-query timings: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) pick
the data and local parallelism. Each query is materialised with a noop
write (full execution, no driver collect) and timed after one warm-up of
the session.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vigil.plans.catalog import QUERIES  # noqa: E402
from vigil.session import build_session  # noqa: E402

HEADLINE = [
    # data assurance
    "assurance_profile", "clean_accounts", "zscore_transform", "dedupe_keep_first", "dataset_fingerprint",
    # label audit, sampling
    "label_report", "stratified_folds", "upsample", "curriculum_batches",
    # scoring and governance
    "governance_report", "escalations", "policy_results", "top_drivers",
    # audit trail and lineage
    "scored_with_latest_model", "event_timeline", "graph_stats", "question_answers", "hash_chain",
    # reports
    "classification_metrics", "latency_alert", "article_lookup",
]
MODEL = ["curriculum_train", "tree_attribution", "smote"]
OPTIONAL: list[str] = []


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(8, cpus * 2), app_name="vigil-bench",
                          extra={"spark.driver.memory": "16g",
                                 "spark.checkpoint.dir": tempfile.mkdtemp(prefix="vigil-bench-ckpt-")})
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in HEADLINE + MODEL + OPTIONAL if n in QUERIES]
    only = os.environ.get("BENCH_QUERIES")
    if only:
        names = [n for n in only.split(",") if n in QUERIES]
    QUERIES["scan_accounts"](spark, sf).write.format("noop").mode("overwrite").save()  # warm-up
    timings = {}
    for name in names:
        t0 = time.time()
        try:
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            timings[name] = round(time.time() - t0, 3)
        except Exception as e:  # keep going; report the failure
            print(f"{name} failed: {type(e).__name__}: {str(e)[:200]}", file=sys.stderr)
    total = round(sum(timings.values()), 3)
    sf_label = os.path.basename(sf.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": timings,
                      "sf": float(sf_label) if sf_label.replace(".", "").isdigit() else sf_label}))
    spark.stop()


if __name__ == "__main__":
    main()
