"""Policy checks on documents and reports over the audit log."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.config import ComplianceConfig
from paperloom.functions.text import PII_PATTERNS, masked_texts, pattern_count
from paperloom.operators.cache import at
from paperloom.storage import materialize

# Check names and the sections of a full report, as their readers expect them.
FULL_SECTIONS = {"data_retention": "retention_policy", "access_control": "access_controls", "encryption_status": "encryption"}
CHECKS = ("retention_policy", "classification_ok", "access_controls", "encryption", "sensitive_data")


def with_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with counts per kind and ``has_pii``, in the row; no join.

    A card number is not counted again as a phone number.
    """
    masked, seen_by = masked_texts(docs)
    counts = {f"{k.lower()}_count": pattern_count(F.col(seen_by[k]), p) for k, p in PII_PATTERNS.items()}
    counted = masked.select(*docs.columns, *(c.alias(n) for n, c in counts.items()))
    return counted.withColumn("has_pii", reduce(lambda a, b: a | b, (F.col(n) > 0 for n in counts)))


def pii_scan(docs: DataFrame) -> DataFrame:
    """Matches per kind of every document."""
    return with_pii(docs.select("doc_id", "text")).drop("text")


def pii_redact(docs: DataFrame) -> DataFrame:
    """Texts with every match replaced by its kind."""
    masked, seen_by = masked_texts(docs)
    return masked.select("doc_id", F.col(seen_by["REST"]).alias("text"))


def retention_ok(as_of: datetime) -> Column:
    """Kept for ever when the period is 0, else until creation + period days."""
    ends = F.col("creation_date") + F.make_dt_interval(days=F.col("retention_period").cast("int"))
    return (F.col("retention_period") == 0) | (ends >= at(as_of))


def classification_ok(config: ComplianceConfig) -> Column:
    return F.coalesce(F.col("classification").isin(*config.classifications), F.lit(False))


def access_ok(config: ComplianceConfig) -> Column:
    """A known level, and no personal data in a public document."""
    known = F.coalesce(F.col("access_level").isin(*config.access_levels), F.lit(False))
    return known & ~((F.col("access_level") == "public") & F.col("has_pii"))


def sensitive_ok() -> Column:
    return ~F.col("has_pii")


def verify_compliance(meta: DataFrame, as_of: datetime, config: ComplianceConfig = ComplianceConfig()) -> DataFrame:
    """Five checks per document and their conjunction.

    ``meta`` carries ``has_pii`` and the caller's ``encrypted`` flag.
    """
    checks = {
        "retention_policy": retention_ok(as_of),
        "classification_ok": classification_ok(config),
        "access_controls": access_ok(config),
        "encryption": F.col("encrypted"),
        "sensitive_data": sensitive_ok(),
    }
    checked = meta.select("doc_id", *(c.alias(n) for n, c in checks.items()))
    every = reduce(lambda a, b: a & b, (F.col(n) for n in CHECKS))
    return checked.withColumn("compliant", every).withColumn("timestamp", at(as_of))


def audit_entries(log: DataFrame) -> DataFrame:
    """Full audit records from access-log rows. Reading changes nothing; its latency is a detail."""
    details = F.create_map(F.lit("latency_ms"), F.format_string("%.2f", "latency_ms"))
    none = F.create_map().cast("map<string,string>")
    return log.select(
        "timestamp",
        F.col("user_id").cast("string").alias("user_id"),
        "action",
        F.col("document_id").cast("string").alias("document_id"),
        none.alias("changes"),
        details.alias("details"),
        F.lit("").alias("ip_address"),
        F.lit("").alias("session_id"),
        "status",
        F.to_date("timestamp").alias("day"),
    )


def in_period(log: DataFrame, start: datetime, end: datetime) -> DataFrame:
    return log.where(F.col("timestamp").between(at(start), at(end)))


def report_access_logs(log: DataFrame, start: datetime, end: datetime) -> DataFrame:
    return in_period(log, start, end).groupBy("action").agg(F.count("*").alias("entries"))


def report_operations(log: DataFrame, start: datetime, end: datetime) -> DataFrame:
    return in_period(log, start, end).groupBy("document_id", "action").agg(F.count("*").alias("operations"))


def pivot_operations(operations: DataFrame, actions: list[str]) -> DataFrame:
    """One row per document, one column per named action."""
    return operations.groupBy("document_id").pivot("action", actions).agg(F.sum("operations")).na.fill(0)


def report_user_activity(log: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Per user: actions, distinct documents, first and last time.

    Counted per user and document first, so a very active user is merged in parts.
    """
    per_document = in_period(log, start, end).groupBy("user_id", "document_id").agg(
        F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")
    )
    return per_document.groupBy("user_id").agg(
        F.sum("n").alias("actions"),
        F.count("document_id").alias("documents"),
        F.min("first").alias("first_seen"),
        F.max("last").alias("last_seen"),
    )


def report_security_events(log: DataFrame, start: datetime, end: datetime) -> DataFrame:
    return in_period(log, start, end).where(F.col("status") != "success")


def report_violations(checked: DataFrame) -> DataFrame:
    """One row per failed check."""
    return checked.unpivot(["doc_id"], list(CHECKS), "check", "passed").where(~F.col("passed")).drop("passed")


def compliance_report(
    log: DataFrame, checked: DataFrame, start: datetime, end: datetime, report_type: str = "full"
) -> DataFrame:
    """Long-form ``(section, key, value)`` report; ``full`` adds three document sections.

    The log is counted once by action, user and status, and all check outcomes of the
    documents are counted in one row; the sections are cut from these two.
    """
    counted = in_period(log, start, end).groupBy("action", "user_id", "status").agg(F.count("*").alias("n"))
    rows = [("access_logs", F.col("action")), ("document_operations", F.col("action")), ("user_activity", F.col("user_id").cast("string"))]
    entries = [F.struct(F.lit(s).alias("section"), k.alias("key")) for s, k in rows]
    failed = F.when(F.col("status") != "success", F.struct(F.lit("security_events").alias("section"), F.col("action").alias("key")))
    exploded = counted.select("n", F.explode(F.array(*entries, failed)).alias("_s")).where(F.col("_s").isNotNull())
    logged = exploded.groupBy("_s.section", "_s.key").agg(F.sum("n").alias("value"))
    cells = [("compliance_violations", c, ~F.col(c)) for c in CHECKS]
    if report_type == "full":
        for section, check in FULL_SECTIONS.items():
            passed = F.coalesce(F.col(check), F.lit(False))
            cells += [(section, "passed", passed), (section, "failed", ~passed)]
    totals = checked.agg(*(F.count_if(c).alias(f"c{i}") for i, (_, _, c) in enumerate(cells)))
    listed = [F.struct(F.lit(s).alias("section"), F.lit(k).alias("key"), F.col(f"c{i}").alias("value")) for i, (s, k, _) in enumerate(cells)]
    documents = totals.select(F.explode(F.array(*listed)).alias("_c")).select("_c.*").where("value > 0")
    return logged.unionByName(documents)


def document_permissions(meta: DataFrame, grants: DataFrame) -> DataFrame:
    """``(role, document)`` rows a role may see, from a table ``grants(role, access_level)``."""
    return meta.join(grants.select("role", "access_level").distinct(), "access_level")


def inherited_roles(inherits: DataFrame) -> DataFrame:
    """``role, ancestor`` for every role and all it inherits from, itself included.

    ``inherits(role, parent)`` may hold cycles: rounds join what is known with itself, which
    doubles the reach, until nothing is new.
    """
    names = inherits.select("role").unionByName(inherits.select(F.col("parent").alias("role"))).where("role is not null").distinct()
    links = inherits.where("role is not null and parent is not null").select("role", F.col("parent").alias("ancestor"))
    known = materialize(names.select("role", F.col("role").alias("ancestor")).unionByName(links).distinct(), "roles")
    count = known.count()
    while True:
        further = known.select(F.col("role").alias("ancestor"), F.col("ancestor").alias("_far"))
        known = materialize(known.join(further, "ancestor").select("role", F.col("_far").alias("ancestor")).distinct(), "roles")
        found = known.count()
        if found == count:
            return known
        count = found


def inherited_permissions(meta: DataFrame, grants: DataFrame, inherits: DataFrame) -> DataFrame:
    """``(role, document)`` rows a role may see by its own grants or those of a role it inherits from.

    A role without a grant of its own or of an ancestor sees nothing.
    """
    reach = inherited_roles(inherits)
    own = grants.select("role", F.col("role").alias("ancestor"))
    passed = reach.unionByName(own).distinct().join(grants.select(F.col("role").alias("ancestor"), "access_level"), "ancestor")
    return document_permissions(meta, passed.select("role", "access_level"))
