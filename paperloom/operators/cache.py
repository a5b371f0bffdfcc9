"""Result-cache tables: look-ups, expiry, eviction, analytics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.config import CacheConfig
from paperloom.operators.skew import number_rows, row_lookup, top_rows

SIZE_LABELS = ("< 1KB", "< 1MB", "≥ 1MB")
AGE_LABELS = ("< 1 day", "< 1 week", "≥ 1 week")
DAY_MICROS = 86_400_000_000


def at(moment: datetime) -> Column:
    return F.lit(moment).cast("timestamp_ntz")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def live_entries(cache: DataFrame, as_of: datetime) -> DataFrame:
    """Readable entries: expiry strictly later. No expiry means dead."""
    return cache.where(F.col("expires_at") > at(as_of))


def purge_expired(cache: DataFrame, as_of: datetime) -> DataFrame:
    """What stays after a purge: no expiry, or expiry not earlier than ``as_of``."""
    return cache.where(F.col("expires_at").isNull() | (F.col("expires_at") >= at(as_of)))


def evict_lru(cache: DataFrame, config: CacheConfig = CacheConfig()) -> DataFrame:
    """What stays after eviction: above the size limit, the least recent tenth goes.

    The count to evict uses whole-number division, so fewer than ten entries lose none.
    Entries are counted per hour of last access; whole hours go or stay, and only the hour
    that holds the cut is sorted. An entry never accessed is the least recent.
    """
    hour = F.date_trunc("hour", "last_accessed")
    counts = cache.groupBy(hour.alias("hour")).agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))
    hours = sorted((tuple(r) for r in counts.collect()), key=lambda r: (r[0] is not None, r[0]))  # one row an hour
    entries = sum(n for _, n, _ in hours)
    over = entries * config.evict_percent // 100 if sum(b or 0 for *_, b in hours) > config.max_size_bytes else 0
    gone = 0
    for moment, n, _ in hours:
        if gone + n > over:
            break
        gone += n
    if over == 0 or not hours:
        return cache
    marked = cache.withColumn("_hour", hour)
    cut = F.lit(moment).cast("timestamp")
    later = F.col("_hour").isNotNull() if moment is None else F.col("_hour") > cut
    numbered = number_rows(marked.where(F.col("_hour").eqNullSafe(cut)), [], [F.asc_nulls_first("last_accessed"), F.asc("key")], "_lru")
    kept = numbered.where(F.col("_lru") > over - gone).drop("_lru")
    return marked.where(later).unionByName(kept).drop("_hour")


def upsert_latest(changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Insert-or-replace: the last change of each key wins and the whole row is replaced."""
    return top_rows(changes, keys, [F.desc(c) for c in order], 1, "_age").drop("_age")


def cached_query_rows(results: DataFrame, ttl_seconds: int = CacheConfig.ttl_seconds) -> DataFrame:
    """Rows to store for ``(key, value, written_at, seq)``: counters start over on a write."""
    return results.select(
        "key",
        "value",
        F.octet_length("value").cast("bigint").alias("size_bytes"),
        F.lit(0).cast("bigint").alias("access_count"),
        F.col("written_at").alias("last_accessed"),
        (F.col("written_at") + F.make_dt_interval(secs=F.lit(ttl_seconds))).alias("expires_at"),
        F.col("written_at").alias("created_at"),
        "seq",
    )


def cache_hit_split(requests: DataFrame, cache: DataFrame, as_of: datetime) -> DataFrame:
    """Every request row with ``hit``: whether a live entry answers it."""
    live = live_entries(cache, as_of).select("key", "size_bytes", F.lit(True).alias("found"))
    joined = row_lookup(requests, live, "key", F.col("request_id"))
    return joined.withColumn("hit", F.coalesce("found", F.lit(False))).drop("found")


def cache_touch(requests: DataFrame, cache: DataFrame, as_of: datetime) -> DataFrame:
    """The cache after ``requests(key, requested_at)`` were read from it.

    Dead entries go. A live entry's counter grows by its requests and its last access moves
    to the latest one. Requests are counted per key before they meet the cache.
    """
    read = requests.groupBy("key").agg(F.count("*").alias("_reads"), F.max("requested_at").alias("_latest"))
    touched = live_entries(cache, as_of).join(read, "key", "left")
    return touched.withColumns(
        {
            "access_count": F.col("access_count") + F.coalesce("_reads", F.lit(0)),
            "last_accessed": F.greatest("last_accessed", "_latest"),
        }
    ).drop("_reads", "_latest")


def cache_totals(cache: DataFrame, max_size_bytes: int) -> DataFrame:
    used = F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("bigint")
    share = F.col("total_bytes") / F.lit(max_size_bytes) * 100 if max_size_bytes > 0 else F.lit(0.0)
    return cache.agg(used.alias("total_bytes"), F.count("*").alias("item_count")).select(
        "total_bytes",
        F.round(F.col("total_bytes") / F.lit(1024 * 1024), 6).alias("total_size_mb"),
        "item_count",
        F.round(share, 6).alias("space_utilization"),
    )


def cache_hit_rate(lookups: DataFrame) -> DataFrame:
    """Hits, misses and hits / (hits + misses), which is 0 when there were none."""
    hits = F.count_if(F.col("hit"))
    return lookups.agg(
        hits.alias("hits"),
        F.count_if(~F.col("hit")).alias("misses"),
        F.round(F.coalesce(F.try_divide(hits, F.count("*")), F.lit(0.0)), 6).alias("hit_rate"),
    )


def cache_size_buckets(cache: DataFrame) -> DataFrame:
    label = (
        F.when(F.col("size_bytes") < 1024, SIZE_LABELS[0])
        .when(F.col("size_bytes") < 1024 * 1024, SIZE_LABELS[1])
        .otherwise(SIZE_LABELS[2])
    )
    return cache.groupBy(label.alias("size_category")).agg(F.count("*").alias("count"))


def cache_age_buckets(cache: DataFrame, as_of: datetime) -> DataFrame:
    days = (micros(at(as_of)) - micros(F.col("created_at"))) / F.lit(DAY_MICROS)
    label = F.when(days < 1, AGE_LABELS[0]).when(days < 7, AGE_LABELS[1]).otherwise(AGE_LABELS[2])
    return cache.groupBy(label.alias("age_category")).agg(F.count("*").alias("count"))


def latency_ewma(
    log: DataFrame, keys: list[str], order: list[str], value: str, digits: int | None = 6
) -> DataFrame:
    """Running ``avg = (avg + x) / 2`` from 0, in log order.

    The n-th newest value weighs 2^-n. Rows are numbered by a distributed sort, so one key
    may hold any share of them; sums are partial. A value that is not finite stays so
    however old it is.
    """
    newest = number_rows(log.select(*keys, *order, value), keys, [F.desc(c) for c in order], "_n")
    weight = F.pow(F.lit(0.5), F.col("_n"))
    endless = F.isnan(value) | (F.abs(value) == float("inf"))
    average = F.sum(F.when(endless, F.col(value)).otherwise(F.col(value) * weight))
    return newest.groupBy(*keys).agg((average if digits is None else F.round(average, digits)).alias("ewma_ms"))


def stats_snapshot(cache: DataFrame, lookups: DataFrame, as_of: datetime, evictions: int = 0) -> DataFrame:
    """One row for the append-only statistics table."""
    totals = cache.agg(
        F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("bigint").alias("total_size_bytes"),
        F.count("*").alias("queries_cached"),
    )
    # One look-up pass gives both numbers.
    rate = cache_hit_rate(lookups).select(F.struct("hits", "misses").alias("both")).scalar()
    return totals.select(
        at(as_of).alias("timestamp"),
        rate["hits"].alias("hits"),
        rate["misses"].alias("misses"),
        "total_size_bytes",
        "queries_cached",
        F.lit(evictions).cast("bigint").alias("evictions"),
    )
