"""Changes found by digests, and the versions they leave."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from paperloom.sources import listings, sync

KIND = "k bigint, a string, b double"
OLD = [(1, "x", 1.0), (2, None, 2.0), (3, "z", None), (4, "same", 4.0), (None, "n", 0.0), (7, "twice", 1.0), (7, "twice", 1.0)]
NEW = [(1, "x", 1.5), (2, "", 2.0), (4, "same", 4.0), (5, "new", 5.0), (None, "n", 0.5), (7, "twice", 1.0)]


@pytest.mark.parametrize("buckets", [1, 4, 64])
def test_new_changed_and_deleted_without_times(spark, buckets):
    source, target = spark.createDataFrame(NEW, KIND), spark.createDataFrame(OLD, KIND)
    expected = {(1, "changed"), (2, "changed"), (3, "deleted"), (5, "new"), (None, "changed"), (7, "changed")}
    assert set(map(tuple, sync.digest_changes(source, target, "k", ["a", "b"], buckets).collect())) == expected
    known = sync.bucket_digests(target, "k", ["a", "b"], buckets)
    assert set(map(tuple, sync.digest_changes(source, target, "k", ["a", "b"], buckets, known).collect())) == expected
    assert sync.digest_changes(target, target, "k", ["a", "b"], buckets).count() == 0
    assert sync.digest_changes(target.where("false"), target, "k", ["a", "b"], buckets).where("change = 'deleted'").count() == 6


def test_only_unequal_buckets_are_compared(spark):
    target = spark.range(5000).select(F.col("id").alias("k"), F.lit("a").alias("a"), F.lit(1.0).alias("b"))
    source = target.withColumn("b", F.when(F.col("k") == 77, 2.0).otherwise(1.0))
    buckets = sync.bucket_count(5000)
    digests = [sync.bucket_digests(df, "k", ["a", "b"], buckets) for df in (source, target)]
    assert buckets >= 4 and sync.unequal_buckets(*digests).count() == 1
    assert [tuple(r) for r in sync.digest_changes(source, target, "k", ["a", "b"]).collect()] == [(77, "changed")]


def test_versions_can_be_read_at_any_time(spark):
    first, second = datetime(2024, 1, 2), datetime(2024, 1, 3)
    kind = f"{KIND}, valid_from timestamp_ntz, valid_to timestamp_ntz"
    moment = lambda m: F.lit(m).cast("timestamp_ntz")
    rows = [r for r in dict.fromkeys(OLD)]
    one = sync.synced_versions(spark.createDataFrame([], kind), spark.createDataFrame(rows, KIND), "k", ["a", "b"], moment(first))
    two = sync.synced_versions(one, spark.createDataFrame(NEW, KIND), "k", ["a", "b"], moment(second)).collect()
    assert {tuple(r)[:3] for r in two if r["valid_from"] == first} == set(rows)
    assert {tuple(r)[:3] for r in two if r["valid_to"] is None} == set(NEW)
    assert {r["k"] for r in two if r["valid_to"] == second} == {1, 2, 3, None}


@pytest.mark.parametrize(
    ("kind", "old", "new"),
    [("int", 4, 5), ("date", date(2024, 1, 1), date(2024, 1, 2)), ("timestamp", datetime(2024, 1, 1), datetime(2024, 1, 2)),
     ("timestamp_ntz", datetime(2024, 1, 1), datetime(2024, 1, 2)), ("string", "a", "b")],
)
def test_times_of_any_type(spark, kind, old, new):
    source = spark.createDataFrame([(1, new), (2, new), (3, new), (4, old), (5, None), (6, None)], f"k int, m {kind}")
    target = spark.createDataFrame([(1, None), (2, old), (4, new), (5, None), (6, old)], f"k int, m {kind}")
    assert {r["k"]: r["change"] for r in listings.incremental_sync(source, target, "k", "m").collect()} == {1: "changed", 2: "changed", 3: "new"}
