"""Streaming queries, run over everything available and read back."""

from __future__ import annotations

from paperloom.plans.catalog import query
from paperloom.plans.fixtures import audit_rows, change_rows, describe
from paperloom.plans.sql import with_parts
from paperloom.streaming import jobs


@query(
    "stream_daily_usage",
    """SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS uses FROM events GROUP BY 1""",
)
def stream_daily_usage(t):
    return jobs.run_daily_usage(audit_rows(t.stream("events")))


@query("stream_ingest", with_parts("SELECT doc_id, file_path, checksum, size_bytes, creation_date FROM meta"))
def stream_ingest(t):
    """Every document arrives twice and is ingested once."""
    arriving = describe(t.stream("documents")).select("doc_id", "file_path", "checksum", "size_bytes", "creation_date")
    again = describe(t.stream("documents")).select("doc_id", "file_path", "checksum", "size_bytes", "creation_date")
    return jobs.run_ingest(arriving.unionByName(again))


@query(
    "stream_cache_upsert",
    with_parts(
        """SELECT key, action || '/' || document_id AS value, "timestamp" AS written_at, event_id AS seq FROM audit
           QUALIFY row_number() OVER (PARTITION BY key ORDER BY "timestamp" DESC, event_id DESC) = 1"""
    ),
)
def stream_cache_upsert(t):
    return jobs.run_cache_upserts(change_rows(audit_rows(t.stream("events"))))


@query(
    "stream_user_totals",
    """SELECT user_id, count(*) AS actions, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY 1""",
)
def stream_user_totals(t):
    return jobs.run_user_totals(audit_rows(t.stream("events")))


@query(
    "stream_latency_ewma",
    with_parts(
        """SELECT action AS key, any_value(total) AS n, round(sum(latency_ms * power(0.5, n)), 6) AS ewma_ms FROM (
             SELECT action, latency_ms, count(*) OVER (PARTITION BY action) AS total,
                    row_number() OVER (PARTITION BY action ORDER BY "timestamp" DESC, event_id DESC) AS n FROM audit)
           GROUP BY 1"""
    ),
)
def stream_latency_ewma(t):
    return jobs.run_latency_ewma(audit_rows(t.stream("events")), "action")
