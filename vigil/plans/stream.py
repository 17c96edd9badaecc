"""Hash chain and streaming-ingest queries over the audit table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import chain as CH
from ..session import scratch_path
from ..sources import views
from ..streaming import audit_stream as ST
from .registry import query

AE = ("audit_event",)
_EV_HASH = ("sha256(concat_ws('|', coalesce(event_id, '\\N'), coalesce(CAST(epoch_us(created_at) AS VARCHAR), '\\N'), "
            "coalesce(agent_name, '\\N'), coalesce(phase, '\\N'), coalesce(event_type, '\\N'), coalesce(extra_payload, '\\N')))")
CHAIN_SQL = f"""r AS (SELECT client_transaction_id, event_id, {_EV_HASH} AS h,
  row_number() OVER (PARTITION BY client_transaction_id ORDER BY created_at, event_id) AS position
  FROM audit_event),
b AS (SELECT client_transaction_id, (position - 1) // {CH.BLOCK} AS block, sha256(string_agg(h, '' ORDER BY position)) AS bh,
  count(*) AS n FROM r GROUP BY 1, 2),
g AS (SELECT client_transaction_id, block // {CH.BLOCK} AS segment, sha256(string_agg(bh, '' ORDER BY block)) AS sh,
  sum(n) AS n, count(*) AS n_blocks FROM b GROUP BY 1, 2),
heads AS (SELECT client_transaction_id,
  list_reduce(list(sh ORDER BY segment), lambda acc, x: sha256(acc || x), sha256('genesis-' || coalesce(client_transaction_id, '\\N'))) AS chain_head,
  CAST(sum(n) AS BIGINT) AS n_events, CAST(sum(n_blocks) AS BIGINT) AS n_blocks FROM g GROUP BY 1)"""


@query("hash_chain", f"WITH {CHAIN_SQL}\nSELECT * FROM heads", AE)
def hash_chain(spark, sf):
    """C5 build: chain head per transaction over hashed event blocks."""
    return CH.build_chain(views.audit_event(spark, sf))[1]


@query("hash_chain_verify", f"""WITH {CHAIN_SQL},
t AS (SELECT client_transaction_id, bool_or(event_id LIKE '%77') AS touched FROM audit_event GROUP BY 1)
SELECT h.client_transaction_id, h.n_events, NOT t.touched AS valid
FROM heads h JOIN t ON h.client_transaction_id IS NOT DISTINCT FROM t.client_transaction_id""", AE)
def hash_chain_verify(spark, sf):
    """C5 verify: stored chain heads (written, read back) against the events after a change to the payload of those whose id ends in 77."""
    ev = views.audit_event(spark, sf)
    path = scratch_path(spark, f"chain-{uuid.uuid4().hex}")
    CH.build_chain(ev)[1].write.mode("overwrite").parquet(path)
    changed = F.concat(F.coalesce("extra_payload", F.lit("")), F.lit(" "))
    tampered = ev.withColumn("extra_payload", F.when(F.col("event_id").endswith("77"), changed).otherwise(F.col("extra_payload")))
    return CH.verify_chain(spark.read.parquet(path), tampered)


def _stream(spark, sf):
    """The folder of a stream drained over this data."""
    run = scratch_path(spark, f"stream-{uuid.uuid4().hex}")
    ev = views.audit_event(spark, sf)
    # Three deliveries, each drained by a restarted stream: the later half of the time range, the earlier half, all again.
    first, last = ev.agg(F.min("created_at"), F.max("created_at")).first()
    later = F.col("created_at") > F.lit(first + (last - first) / 2 if first else None)
    for part in (ev.where(later), ev.where(~later), ev):
        part.write.mode("append").parquet(f"{run}/source")
        ST.run(spark, f"{run}/source", ev.schema, f"{run}/events", f"{run}/escalations", f"{run}/checkpoint")
    return run


@query("audit_stream", "SELECT * FROM audit_event", AE)
def audit_stream(spark, sf):
    """Streamed events (out of order, each delivered twice) after de-duplication, equal to the batch table."""
    base = _stream(spark, sf)
    schema = views.audit_event(spark, sf).schema
    return ST.stored(spark, f"{base}/events", schema).select(*schema.names)


@query("stream_escalations", """SELECT 'ESC-' || client_transaction_id || '-' || strftime(created_at, '%Y%m%d%H%M%S') AS escalation_id,
  event_id, client_transaction_id, CAST(json_extract_string(extra_payload, '$.k') AS DOUBLE) / 100 AS confidence,
  'Human review required' AS action, created_at AS escalated_at
FROM audit_event WHERE event_type = 'POLICY_EVALUATION_COMPLETED'
  AND CAST(json_extract_string(extra_payload, '$.k') AS DOUBLE) / 100 < CAST(0.7 AS DOUBLE)""", AE)
def stream_escalations(spark, sf):
    """Escalations emitted by the stream."""
    base = _stream(spark, sf)
    schema = ST.escalations_from_events(views.audit_event(spark, sf)).schema
    return spark.read.schema(schema).parquet(f"{base}/escalations").drop("batch")
