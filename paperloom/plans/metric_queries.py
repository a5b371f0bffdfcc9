"""Usage and performance queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from paperloom.operators import metrics as ops
from paperloom.operators.metadata import with_status
from paperloom.plans.catalog import query
from paperloom.plans.fixtures import HANDLERS
from paperloom.plans.sql import with_parts
from paperloom.storage import materialize

ERRORS = "SELECT 'query_' || document_id || '_error' AS error_key FROM audit WHERE action = 'error'"


@query(
    "query_kpis",
    with_parts(
        """SELECT count(*) AS total_queries, round(avg(mean), 6) AS avg_confidence, (SELECT count(*) FROM documents) AS documents_processed
           FROM (SELECT document_id, avg(latency_ms / 500) AS mean FROM audit GROUP BY 1)"""
    ),
)
def query_kpis(t):
    return ops.query_kpis(t.history, t.documents)


@query(
    "confidence_history",
    with_parts(
        """SELECT document_id AS query, date_trunc('second', min("timestamp")) AS "timestamp", round(avg(latency_ms / 500), 6) AS avg_confidence
           FROM audit GROUP BY 1"""
    ),
)
def confidence_history(t):
    return ops.confidence_history(t.history)


@query("error_counts", with_parts("SELECT error_key, count(*) AS errors FROM failures GROUP BY 1", failures=ERRORS))
def error_counts(t):
    return ops.error_counts(t.errors)


@query(
    "error_distribution",
    with_parts(
        "SELECT error_key, round(count(*) / (SELECT count(*) FROM failures), 6) AS share FROM failures GROUP BY 1",
        failures=ERRORS,
    ),
)
def error_distribution(t):
    return ops.error_distribution(t.errors)


@query(
    "provider_time",
    with_parts(
        """SELECT provider, round(sum(latency_ms), 6) AS total_ms, arg_max(latency_ms, event_id) AS last_ms
           FROM audit GROUP BY 1"""
    ),
)
def provider_time(t):
    return ops.provider_time(t.audit)


@query("type_distribution", "SELECT lang AS file_type, count(*) AS documents FROM documents GROUP BY 1")
def type_distribution(t):
    return ops.type_distribution(t.documents.select(F.col("lang").alias("file_type")))


@query("daily_usage", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS uses FROM events GROUP BY 1")
def daily_usage(t):
    return ops.daily_usage(t.audit)


@query("throughput_by_hour", "SELECT date_trunc('hour', ts) AS hour, count(*) AS items FROM events GROUP BY 1")
def throughput_by_hour(t):
    return ops.throughput_by_hour(t.audit)


@query(
    "latency_percentiles",
    """SELECT event_type AS action, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95,
              round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1""",
)
def latency_percentiles(t):
    return ops.latency_percentiles(t.audit, "action")


@query(
    "latency_sketch_percentiles",
    """SELECT event_type AS action, count(value) AS n, CAST(p.p AS DOUBLE) AS p, true AS within_bound
       FROM events CROSS JOIN (VALUES (0.5), (0.95), (0.99)) p(p) GROUP BY ALL""",
)
def latency_sketch_percentiles(t):
    """Percentiles of the whole period from stored daily sketches, judged by the true ranks of all values."""
    stored = materialize(ops.latency_sketches(t.audit, ["action"]), "sketches")
    estimates = ops.sketched_percentiles(stored, ["action"], date(1970, 1, 1), date(9999, 12, 31))
    found = ops.rank_errors(t.audit, materialize(estimates, "estimates"), "action")
    return found.select("action", "n", "p", (F.col("error") <= 0.02).alias("within_bound"))


@query("feedback_average", "SELECT count(quality) AS ratings, round(avg(quality), 6) AS avg_feedback FROM labels")
def feedback_average(t):
    return ops.feedback_average(t.labels.select(F.col("quality").alias("score")))


@query(
    "processing_summary",
    """SELECT count(*) FILTER (WHERE lang IN ('en', 'de', 'fr')) AS docs_processed, count(*) FILTER (WHERE lang NOT IN ('en', 'de', 'fr')) AS docs_failed,
              round(avg(n_chars / 1000), 6) AS average_processing_time, CAST(sum(octet_length(encode(text))) AS BIGINT) AS storage_usage
       FROM documents""",
)
def processing_summary(t):
    """A document's processing time is taken as one millisecond per character, in seconds."""
    results = with_status(
        t.documents.select(
            F.col("lang").alias("file_type"),
            (F.col("n_chars") / 1000).alias("latency_ms"),
            F.octet_length("text").alias("size_bytes"),
        ),
        HANDLERS,
    )
    return ops.processing_summary(results)


@query(
    "llm_routing_effect",
    with_parts(
        """SELECT task, count(*) AS requests, round(avg(CAST(first_ok AS INTEGER)), 6) AS first_choice_rate,
                  round(avg(CASE WHEN tries > 1 THEN 1 ELSE 0 END), 6) AS fallback_rate, round(avg(CAST(solved AS INTEGER)), 6) AS solved_rate
           FROM (SELECT key, document_id % 4 AS task, arg_min(action <> 'error', event_id) AS first_ok,
                        bool_or(action <> 'error') AS solved, count(*) AS tries FROM audit GROUP BY 1, 2) GROUP BY 1"""
    ),
)
def routing_effect(t):
    return ops.routing_effect(t.attempts)
