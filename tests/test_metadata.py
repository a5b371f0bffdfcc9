from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from paperloom.config import IngestConfig
from paperloom.operators import compliance, metadata, metrics, retrieval

NOW = datetime(2024, 1, 31)


def test_required_fields(spark):
    rows = [("a", "t", NOW, "x"), ("", "t", NOW, "x"), ("a", None, NOW, "x"), ("a", "t", None, "x")]
    df = spark.createDataFrame(rows, "file_path string, file_type string, creation_date timestamp, author string")
    assert [r["valid"] for r in metadata.validate_required(df).collect()] == [True, False, False, False]


def test_json_drops_unknown_keys_and_keeps_types(spark):
    text = '{"file_path": "a", "size_bytes": 3, "tags": ["x"], "no_such": 1, "creation_date": "2024-01-02T03:04:05"}'
    df = spark.createDataFrame([(1, text)], "id int, metadata string")
    row = metadata.metadata_from_json(df, "metadata", metadata.METADATA).head()
    assert (row["size_bytes"], row["tags"], row["creation_date"]) == (3, ["x"], datetime(2024, 1, 2, 3, 4, 5))
    assert "no_such" not in row.asDict() and row["author"] is None


def test_defaults_fill_and_add(spark):
    df = spark.createDataFrame([(1, None)], "id int, access_level string")
    row = metadata.metadata_defaults(df).head()
    assert (row["access_level"], row["page_count"], row["checksum"]) == ("public", 0, "")


def test_batches_are_consecutive_and_bounded(spark):
    config = IngestConfig()
    df = spark.range(200).select(F.col("id"), F.when(F.col("id") % 4 == 0, ".msg").otherwise(".txt").alias("file_type"))
    got = metadata.assign_batches(df, config.handlers, config.batch_size, "file_type", "id")
    sizes = {r["batch_no"]: r["count"] for r in got.groupBy("batch_no").count().collect()}
    assert sizes == {0: 64, 1: 64, 2: 22}


def test_failures_lose_no_row(spark):
    df = spark.createDataFrame([(1, ".txt"), (2, ".pdf"), (3, None)], "id int, file_type string")
    good, bad = metadata.split_failures(metadata.with_status(df, IngestConfig().handlers))
    assert sorted(r["id"] for r in good.collect()) == [1]
    assert sorted(r["id"] for r in bad.collect()) == [2, 3]


def test_strict_rerank_threshold_and_order(spark):
    rows = [("q", 1, 0.9, 0.7), ("q", 2, 0.8, 0.71), ("q", 3, 0.2, 0.9)]
    df = spark.createDataFrame(rows, "query_id string, id bigint, score double, rerank_score double")
    got = {r["id"]: r["score"] for r in retrieval.score_combine(df, 0.7).collect()}
    assert got == {2: 0.773, 3: 0.41}


def test_empty_filter_parts_are_no_constraint(tables):
    assert retrieval.payload_filter(tables.meta, {}, None, [], []).count() == tables.documents.count()


def test_mean_of_means(spark):
    history = spark.createDataFrame([(1, 1.0), (1, 0.0), (2, 1.0)], "query int, score double")
    row = metrics.query_kpis(history, spark.range(4)).head()
    assert tuple(row) == (2, 0.75, 4)


def test_percentiles_of_a_large_and_a_tiny_group(spark):
    import numpy as np

    values = [float((i * 7919) % 1000) for i in range(2000)]
    rows = [("big", v) for v in values] + [("one", 5.0)]
    got = {r["k"]: r for r in metrics.latency_percentiles(spark.createDataFrame(rows, "k string, latency_ms double"), "k").collect()}
    for name, p in (("p50", 50), ("p95", 95), ("p99", 99)):
        assert abs(got["big"][name] - np.percentile(values, p)) < 1e-6
        assert got["one"][name] == 5.0


def test_first_choice_and_fallback(spark):
    rows = [("a", 0, 1, False), ("a", 0, 2, True), ("b", 0, 3, True), ("c", 0, 4, False)]
    df = spark.createDataFrame(rows, "request_id string, task int, attempt int, success boolean")
    row = metrics.routing_effect(df).head()
    assert (row["requests"], row["first_choice_rate"], row["fallback_rate"], row["solved_rate"]) == (3, 0.333333, 0.333333, 0.666667)


def test_public_documents_must_not_hold_personal_data(spark):
    rows = [("public", True), ("public", False), ("internal", True), ("secret", False)]
    df = spark.createDataFrame(rows, "access_level string, has_pii boolean")
    got = [r[0] for r in df.select(compliance.access_ok(compliance.ComplianceConfig())).collect()]
    assert got == [False, True, True, False]


def test_percentiles_keep_null_keys_and_groups_without_values(spark):
    rows = [(None, 1.0), (None, 3.0), ("a", None), ("b", 2.0)]
    got = {r["k"]: tuple(r)[1:] for r in metrics.latency_percentiles(spark.createDataFrame(rows, "k string, latency_ms double"), "k").collect()}
    assert got == {None: (2.0, 2.9, 2.98), "a": (None, None, None), "b": (2.0, 2.0, 2.0)}


def test_sync_knows_rows_without_a_time(spark):
    from datetime import datetime

    from paperloom.sources.listings import incremental_sync

    kind = "k bigint, m timestamp_ntz"
    old, new = datetime(2024, 1, 1), datetime(2024, 1, 2)
    source = spark.createDataFrame([(1, new), (2, new), (3, new), (4, old), (5, None)], kind)
    target = spark.createDataFrame([(1, None), (2, old), (2, new), (4, new), (5, None)], kind)
    assert {r["k"]: r["change"] for r in incremental_sync(source, target, "k", "m").collect()} == {1: "changed", 3: "new"}


def test_percentiles_when_one_value_has_most_rows(spark):
    rows = [("a", 7.0)] * 900 + [("a", float(i)) for i in range(100)] + [("b", 1.0), ("b", 2.0)]
    got = {r["k"]: tuple(r)[1:] for r in metrics.latency_percentiles(spark.createDataFrame(rows, "k string, latency_ms double").repartition(3), "k").collect()}
    values = [v for k, v in rows if k == "a"]
    assert got["a"] == tuple(round(float(np.percentile(values, p)), 6) for p in (50, 95, 99))
    assert got["b"] == (1.5, 1.95, 1.99)


def test_daily_sketches_merge_to_any_period(spark):
    from datetime import date

    rng = np.random.default_rng(1)
    values = rng.lognormal(3, 1, 30_000)
    rows = [(f"k{i % 2}", datetime(2024, 1, 1 + i % 5), float(v)) for i, v in enumerate(values)]
    log = spark.createDataFrame(rows, "k string, timestamp timestamp_ntz, latency_ms double").repartition(7)
    stored = metrics.latency_sketches(log, ["k"])
    assert stored.count() == 10 and stored.selectExpr("max(length(sketch))").head()[0] < 20_000
    for first, last in ((date(2024, 1, 1), date(2024, 1, 5)), (date(2024, 1, 2), date(2024, 1, 3))):
        part = log.where(F.to_date("timestamp").between(first, last))
        found = metrics.rank_errors(part, metrics.sketched_percentiles(stored, ["k"], first, last), "k").collect()
        assert len(found) == 6 and max(r["error"] for r in found) < 0.02
        assert {(r["k"], r["n"]) for r in found} == {(r["k"], r["count"]) for r in part.groupBy("k").count().collect()}
