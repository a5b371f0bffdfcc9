from datetime import datetime, timedelta

import pytest

from paperloom.config import CacheConfig
from paperloom.operators import cache as ops

NOW = datetime(2024, 1, 31)
SCHEMA = (
    "key string, size_bytes bigint, access_count bigint, last_accessed timestamp_ntz, "
    "expires_at timestamp_ntz, created_at timestamp_ntz"
)


def entries(spark, n, size=100, expires=NOW):
    rows = [(f"k{i:03}", size, 0, NOW - timedelta(hours=n - i), expires, NOW - timedelta(days=i)) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def keys(df):
    return sorted(r["key"] for r in df.collect())


def test_expiry_edges(spark):
    rows = [("none", 1, 0, NOW, None, NOW), ("now", 1, 0, NOW, NOW, NOW)]
    rows += [("later", 1, 0, NOW, NOW + timedelta(seconds=1), NOW), ("past", 1, 0, NOW, NOW - timedelta(seconds=1), NOW)]
    cache = spark.createDataFrame(rows, SCHEMA)
    assert keys(ops.live_entries(cache, NOW)) == ["later"]
    assert keys(ops.purge_expired(cache, NOW)) == ["later", "none", "now"]


@pytest.mark.parametrize("n,limit,left", [(9, 0, 9), (10, 0, 9), (39, 0, 36), (20, 2000, 20), (20, 1999, 18)])
def test_eviction_counts(spark, n, limit, left):
    kept = ops.evict_lru(entries(spark, n), CacheConfig(max_size_bytes=limit))
    assert keys(kept) == [f"k{i:03}" for i in range(n - left, n)]


def test_eviction_takes_never_used_first_and_shrinks(spark):
    cache = entries(spark, 10).unionByName(spark.createDataFrame([("zz", 100, 0, None, NOW, NOW)], SCHEMA))
    once = ops.evict_lru(cache, CacheConfig(max_size_bytes=0))
    assert "zz" not in keys(once)
    assert set(keys(ops.evict_lru(once, CacheConfig(max_size_bytes=0)))) <= set(keys(once))


def test_empty_cache(spark):
    empty = entries(spark, 1).where("false")
    row = ops.cache_totals(empty, 0).head()
    assert (row["total_bytes"], row["item_count"], row["space_utilization"]) == (0, 0, 0.0)
    lookups = spark.createDataFrame([], "hit boolean")
    assert tuple(ops.cache_hit_rate(lookups).head()) == (0, 0, 0.0)


def test_null_size_is_in_the_last_bucket(spark):
    rows = [("a", None), ("b", 1023), ("c", 1024), ("d", 1048576)]
    found = ops.cache_size_buckets(spark.createDataFrame(rows, "key string, size_bytes bigint")).collect()
    assert {r["size_category"]: r["count"] for r in found} == {"< 1KB": 1, "< 1MB": 1, "≥ 1MB": 2}


def test_ewma_follows_log_order(spark):
    values = [float((i * 37) % 101) for i in range(1500)]
    log = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "key string, seq int, ms double")
    average = 0.0
    for v in values:
        average = (average + v) / 2
    assert ops.latency_ewma(log, ["key"], ["seq"], "ms").head()["ewma_ms"] == pytest.approx(average, abs=1e-6)


def test_upsert_resets_counters(spark):
    rows = [("k", "old", datetime(2024, 1, 1), 1), ("k", "new", datetime(2024, 1, 1), 2), ("j", "é", datetime(2024, 1, 2), 3)]
    changes = spark.createDataFrame(rows, "key string, value string, written_at timestamp_ntz, seq bigint")
    stored = {r["key"]: r for r in ops.cached_query_rows(ops.upsert_latest(changes, ["key"], ["written_at", "seq"])).collect()}
    assert stored["k"]["value"] == "new" and stored["k"]["access_count"] == 0
    assert stored["j"]["size_bytes"] == 2
    assert stored["j"]["expires_at"] - stored["j"]["created_at"] == timedelta(hours=1)


def test_ewma_has_no_depth_and_keeps_what_is_not_finite(spark):
    rows = [("a", i, 1.0 + i % 7) for i in range(3000)] + [("b", 0, float("inf"))] + [("b", i, 1.0) for i in range(1, 2000)]
    log = spark.createDataFrame(rows, "key string, seq bigint, ms double")
    got = {r["key"]: r["ewma_ms"] for r in ops.latency_ewma(log, ["key"], ["seq"], "ms").collect()}
    average = 0.0
    for _, _, ms in rows[:3000]:
        average = (average + ms) / 2
    assert got["a"] == pytest.approx(average, abs=1e-6) and got["b"] == float("inf")


def test_a_read_cache_loses_dead_entries_and_counts_reads(spark):
    from datetime import datetime

    day = lambda d: datetime(2024, 1, d)
    cache = spark.createDataFrame(
        [("a", 1, day(2), day(9)), ("b", 5, day(3), day(9)), ("dead", 7, day(1), day(2)), ("never", 0, day(1), None)],
        "key string, access_count bigint, last_accessed timestamp_ntz, expires_at timestamp_ntz",
    )
    reads = spark.createDataFrame([("a", day(4)), ("a", day(3)), ("b", day(1)), ("dead", day(4)), ("other", day(4))], "key string, requested_at timestamp_ntz")
    got = sorted(tuple(r)[:3] for r in ops.cache_touch(reads, cache, day(5)).collect())
    assert got == [("a", 3, day(4)), ("b", 6, day(3))]
