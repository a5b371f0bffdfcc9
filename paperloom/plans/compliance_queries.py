"""Policy check and audit report queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from paperloom.config import ComplianceConfig
from paperloom.operators import compliance as ops
from paperloom.plans.catalog import query
from paperloom.plans.fixtures import ACTIONS, AS_OF
from paperloom.plans.sql import AS_OF as NOW
from paperloom.plans.sql import PII, PII_COUNTS, with_parts

START, END = datetime(2024, 1, 5), datetime(2024, 1, 25)
PERIOD = "\"timestamp\" BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'"


def checked(t):
    return ops.verify_compliance(t.meta_with_pii, AS_OF)


@query("pii_scan", with_parts(f"SELECT doc_id, email_count, ip_count, card_count, phone_count, has_pii FROM pii"))
def pii_scan(t):
    return ops.pii_scan(t.documents)


@query("pii_redact", f"SELECT doc_id, {PII['DONE']} AS text FROM documents")
def pii_redact(t):
    return ops.pii_redact(t.documents.select("doc_id", "text"))


@query("check_retention", with_parts("SELECT doc_id, retention_policy AS ok FROM checked"))
def check_retention(t):
    return t.meta.select("doc_id", ops.retention_ok(AS_OF).alias("ok"))


@query("check_classification", with_parts("SELECT doc_id, classification_ok AS ok FROM checked"))
def check_classification(t):
    return t.meta.select("doc_id", ops.classification_ok(ComplianceConfig()).alias("ok"))


@query("check_access", with_parts("SELECT doc_id, access_controls AS ok FROM checked"))
def check_access(t):
    return t.meta_with_pii.select("doc_id", ops.access_ok(ComplianceConfig()).alias("ok"))


@query("check_sensitive", with_parts("SELECT doc_id, NOT has_pii AS ok FROM pii"))
def check_sensitive(t):
    return ops.pii_scan(t.documents).select("doc_id", ops.sensitive_ok().alias("ok"))


@query(
    "verify_compliance",
    with_parts(
        f"""SELECT *, retention_policy AND classification_ok AND access_controls AND encryption AND sensitive_data AS compliant,
                   {NOW} AS "timestamp" FROM checked"""
    ),
)
def verify_compliance(t):
    return checked(t)


@query(
    "audit_append",
    with_parts(
        """SELECT "timestamp", CAST(user_id AS VARCHAR) AS user_id, action, CAST(document_id AS VARCHAR) AS document_id,
                  printf('%.2f', latency_ms) AS latency_ms, '' AS ip_address, '' AS session_id, status, strftime("timestamp", '%Y-%m-%d') AS day
           FROM audit"""
    ),
)
def audit_append(t):
    from paperloom.sources.sinks import audit_append as append
    from paperloom.storage import scratch_path

    path = scratch_path(t.spark, "audit")
    append(ops.audit_entries(t.audit), path)
    return t.spark.read.parquet(path).select(
        "timestamp",
        "user_id",
        "action",
        "document_id",
        F.col("details")["latency_ms"].alias("latency_ms"),
        "ip_address",
        "session_id",
        "status",
        F.col("day").cast("string").alias("day"),
    )


@query("report_access_logs", with_parts(f"SELECT action, count(*) AS entries FROM audit WHERE {PERIOD} GROUP BY 1"))
def report_access_logs(t):
    return ops.report_access_logs(t.audit, START, END)


@query(
    "report_operations",
    with_parts(f"SELECT document_id, action, count(*) AS operations FROM audit WHERE {PERIOD} GROUP BY 1, 2"),
)
def report_operations(t):
    return ops.report_operations(t.audit, START, END)


@query(
    "report_operations_pivot",
    with_parts(
        "SELECT document_id, "
        + ", ".join(f"count(*) FILTER (WHERE action = '{a}') AS {a}" for a in ACTIONS)
        + f" FROM audit WHERE {PERIOD} GROUP BY 1"
    ),
)
def report_operations_pivot(t):
    return ops.pivot_operations(ops.report_operations(t.audit, START, END), ACTIONS)


@query(
    "report_user_activity",
    with_parts(
        f"""SELECT user_id, count(*) AS actions, count(DISTINCT document_id) AS documents, min("timestamp") AS first_seen, max("timestamp") AS last_seen
            FROM audit WHERE {PERIOD} GROUP BY 1"""
    ),
)
def report_user_activity(t):
    return ops.report_user_activity(t.audit, START, END)


@query(
    "report_security_events",
    with_parts(f'SELECT event_id, "timestamp", user_id, document_id, status FROM audit WHERE {PERIOD} AND status <> \'success\''),
)
def report_security_events(t):
    return ops.report_security_events(t.audit, START, END).select("event_id", "timestamp", "user_id", "document_id", "status")


VIOLATED = " UNION ALL ".join(
    f"SELECT doc_id, '{c}' AS \"check\" FROM checked WHERE NOT {c}" for c in ops.CHECKS
)


@query("report_violations", with_parts(VIOLATED))
def report_violations(t):
    return ops.report_violations(checked(t))


def outcome_section(section: str, check: str) -> str:
    return f"SELECT '{section}', CASE WHEN {check} THEN 'passed' ELSE 'failed' END, count(*) FROM checked GROUP BY 2"


@query(
    "compliance_report",
    with_parts(
        f"""SELECT 'access_logs' AS section, action AS key, count(*) AS value FROM audit WHERE {PERIOD} GROUP BY 2
            UNION ALL SELECT 'document_operations', action, count(*) FROM audit WHERE {PERIOD} GROUP BY 2
            UNION ALL SELECT 'user_activity', CAST(user_id AS VARCHAR), count(*) FROM audit WHERE {PERIOD} GROUP BY 2
            UNION ALL SELECT 'security_events', action, count(*) FROM audit WHERE {PERIOD} AND status <> 'success' GROUP BY 2
            UNION ALL SELECT 'compliance_violations', "check", count(*) FROM ({VIOLATED}) GROUP BY 2
            UNION ALL {outcome_section('data_retention', 'retention_policy')}
            UNION ALL {outcome_section('access_control', 'access_controls')}
            UNION ALL {outcome_section('encryption_status', 'encryption')}"""
    ),
)
def compliance_report(t):
    return ops.compliance_report(t.audit, checked(t), START, END)


@query(
    "document_permissions",
    with_parts(
        """SELECT g.role, doc_id, file_path, access_level FROM meta JOIN (
             SELECT DISTINCT role, CASE WHEN role = 'user' THEN 'public' ELSE 'internal' END AS access_level FROM conversations
             UNION SELECT DISTINCT role, 'public' FROM conversations) g USING (access_level)"""
    ),
)
def document_permissions(t):
    """Everyone in a conversation may see public documents, all but users also internal ones."""
    roles = t.read("conversations").select("role").distinct()
    own = F.when(F.col("role") == "user", "public").otherwise("internal")
    levels = roles.select("role", F.explode(F.array_distinct(F.array(own, F.lit("public")))).alias("access_level"))
    return ops.document_permissions(t.meta, levels).select("role", "doc_id", "file_path", "access_level")


@query(
    "inherited_permissions",
    with_parts(
        """SELECT DISTINCT r.role, doc_id, file_path, access_level FROM meta JOIN (
             WITH RECURSIVE reach AS (
               SELECT DISTINCT role, role AS ancestor FROM conversations
               UNION SELECT r.role, CASE WHEN r.ancestor = 'user' THEN 'guest' ELSE 'user' END FROM reach r WHERE r.ancestor <> 'guest')
             SELECT role, CASE WHEN ancestor = 'guest' THEN 'public' ELSE 'internal' END AS access_level FROM reach WHERE ancestor <> 'user') r USING (access_level)
           WHERE r.role <> 'user' OR access_level = 'public'"""
    ),
)
def inherited_permissions(t):
    """Guests see public documents; users inherit from guests, all others from users, with internal documents of their own."""
    roles = t.read("conversations").select("role").distinct()
    grants = roles.where("role <> 'user'").select("role", F.lit("internal").alias("access_level"))
    grants = grants.unionByName(roles.sparkSession.sql("SELECT 'guest' AS role, 'public' AS access_level"))
    inherits = roles.select("role", F.when(F.col("role") == "user", "guest").otherwise("user").alias("parent"))
    found = ops.inherited_permissions(t.meta, grants, inherits).where("role <> 'guest'")
    return found.select("role", "doc_id", "file_path", "access_level")
