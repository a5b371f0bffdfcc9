"""Physical plans that matter at scale."""

import contextlib
import io
from datetime import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from paperloom.operators import enrich, metrics, retrieval, skew

SMALL = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_top_k_is_cut_before_the_exchange(spark, tables):
    text = plan(skew.top_rows(tables.audit, ["user_id"], [F.desc("latency_ms")], 3))
    assert text.count("WindowGroupLimit") >= 2


def test_global_top_k_needs_no_full_sort(spark, tables):
    hits = tables.vectors.select(F.lit("q").alias("query_id"), "id", F.lit(1.0).alias("score"))
    assert "TakeOrderedAndProject" in plan(retrieval.topk_global(hits, 5))


def test_filters_and_columns_reach_the_scan(spark, tables):
    text = plan(tables.read("events").where("event_type = 'error'").select("user_id"))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)]" in text
    assert "ReadSchema: struct<user_id:bigint,event_type:string>" in text
    text = plan(metrics.type_distribution(tables.meta.select("file_type")))
    assert "text:string" not in text


def test_document_filter_on_types_is_pushed(spark, tables):
    kept = retrieval.payload_filter(tables.meta, None, (datetime(2024, 1, 1), datetime(2024, 1, 9)), ["src1"], ["en", "de"])
    assert "In(lang, [de,en])" in plan(kept.select("doc_id")) or "In(lang, [en,de])" in plan(kept.select("doc_id"))


def test_no_text_is_exchanged_for_languages(spark, tables):
    counts, totals = enrich.language_model(tables.documents.select("text", "lang"))
    text = plan(enrich.detect_language(tables.documents, counts, totals))
    assert "BroadcastHashJoin" in text
    exchanged = [line for line in text.split("\n") if line.startswith("Arguments: hashpartitioning(")]
    assert exchanged and all("hashpartitioning(doc_id" in line for line in exchanged)


def test_policy_checks_scan_the_documents_once(spark, tables):
    text = plan(entry.queries()["verify_compliance"](spark, SMALL))
    assert sum("documents.parquet" in line for line in text.split("\n") if "Location" in line) == 1


@pytest.mark.parametrize(
    "name", ["cache_hit_split", "verify_compliance", "compliance_report", "key_phrases", "query_kpis", "hybrid_search"]
)
def test_no_cross_joins(spark, name):
    text = plan(entry.queries()[name](spark, SMALL))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
