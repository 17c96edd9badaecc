"""Job wrapper: a failure is recorded as an ERROR event before it surfaces."""

import os
import tempfile

import pytest

from vigil.plans.jobs import SUMMARY_CHARS, AuditTrail, assurance_job


def test_failed_run_appends_error_event(spark):
    out = tempfile.mkdtemp(prefix="vigil-job-")
    with pytest.raises(Exception):
        assurance_job(spark, os.path.join(out, "no-such-folder"), out)
    ev = spark.read.parquet(os.path.join(out, "audit", "audit_event")).collect()
    assert [r.event_type for r in ev] == ["ERROR"]
    assert len(ev[0].summary) <= SUMMARY_CHARS and ev[0].phase == "Phase1_DataAssurance"


def test_trail_ids_are_deterministic(spark):
    a = AuditTrail(spark, "/unused", "TXN-1", "t", "agent", "2024-01-01 00:00:00")
    b = AuditTrail(spark, "/unused", "TXN-1", "t", "agent", "2024-01-01 00:00:00")
    assert a.event("p", "X", "s", {"k": 1}) == b.event("p", "X", "s", {"k": 1})
    assert a.artifact("evidence_pointer", {"kind": "K"}, "evidence_id") == b.artifact("evidence_pointer", {"kind": "K"}, "evidence_id")
