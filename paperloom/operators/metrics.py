"""Usage, latency, error and throughput analytics over logs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators.skew import running_totals
from paperloom.storage import materialize


def query_kpis(history: DataFrame, docs: DataFrame) -> DataFrame:
    """Query count, mean of the per-query mean confidences, documents processed."""
    per_query = history.groupBy("query").agg(F.avg("score").alias("mean"))
    processed = docs.agg(F.count("*").alias("n"))
    return per_query.agg(
        F.count("*").alias("total_queries"), F.round(F.avg("mean"), 6).alias("avg_confidence")
    ).withColumn("documents_processed", processed.scalar())


def confidence_history(history: DataFrame) -> DataFrame:
    """Per query: first time in whole seconds and mean confidence, in time order."""
    seconds = F.floor(F.unix_micros(F.min("timestamp").cast("timestamp")) / 1_000_000)
    return (
        history.groupBy("query")
        .agg(
            F.timestamp_seconds(seconds).cast("timestamp_ntz").alias("timestamp"),
            F.round(F.avg("score"), 6).alias("avg_confidence"),
        )
        .orderBy("timestamp", "query")
    )


def error_counts(errors: DataFrame) -> DataFrame:
    return errors.groupBy("error_key").agg(F.count("*").alias("errors"))


def error_distribution(errors: DataFrame) -> DataFrame:
    """Share of each error kind."""
    counts = error_counts(errors)
    total = errors.agg(F.count("*").alias("n")).scalar()
    return counts.select("error_key", F.round(F.col("errors") / total, 6).alias("share"))


def provider_time(log: DataFrame) -> DataFrame:
    """Total and last time per provider."""
    return log.groupBy("provider").agg(
        F.round(F.sum("latency_ms"), 6).alias("total_ms"),
        F.max_by("latency_ms", F.struct("timestamp", "event_id")).alias("last_ms"),
    )


def type_distribution(meta: DataFrame) -> DataFrame:
    return meta.groupBy("file_type").agg(F.count("*").alias("documents"))


def daily_usage(log: DataFrame) -> DataFrame:
    return log.groupBy(F.date_trunc("day", "timestamp").cast("timestamp_ntz").alias("day")).agg(
        F.count("*").alias("uses")
    )


def throughput_by_hour(log: DataFrame) -> DataFrame:
    return (
        log.groupBy(F.window("timestamp", "1 hour").alias("w"))
        .agg(F.count("*").alias("items"))
        .select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "items")
    )


def latency_percentiles(log: DataFrame, key: str, points: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Exact interpolated percentiles per key.

    Rows are counted by (key, value) first, so a value that very many rows share is one row,
    and the distinct values get running counts by a distributed sort; no task holds a group. Of
    these only the ones at a wanted position are kept. A null key is a group, and a group
    without values has null percentiles.
    """
    counted = log.groupBy(key, "latency_ms").agg(F.count("latency_ms").alias("_n"))
    counted = materialize(counted, "value-counts")
    sizes = materialize(counted.groupBy(key).agg(F.sum("_n").alias("_size")), "sizes")
    totals = running_totals(counted.where(F.col("latency_ms").isNotNull()), [key], [F.asc("latency_ms")], "_n", "_upto")
    named = sizes.select(F.col(key).alias("_key"), "_size")
    position = F.transform(F.array(*(F.lit(p) for p in points)), lambda p: F.struct(p.alias("_p"), (p * (F.col("_size") - 1) + 1).alias("_pos")))
    edges = F.flatten(F.transform(position, lambda e: F.transform(F.array_distinct(F.array(F.floor(e["_pos"]), F.ceil(e["_pos"]))), lambda rn: F.struct(e["_p"].alias("_p"), e["_pos"].alias("_pos"), rn.alias("rn")))))
    held = F.filter(edges, lambda e: (e["rn"] > F.col("_upto") - F.col("_n")) & (e["rn"] <= F.col("_upto")))
    near = totals.join(named, F.col(key).eqNullSafe(F.col("_key"))).select(key, "latency_ms", F.explode(held).alias("e")).select(key, "latency_ms", "e.*")
    low = F.min_by("latency_ms", "rn")
    high = F.max_by("latency_ms", "rn")
    value = near.groupBy(key, "_p").agg(
        (low + (high - low) * F.max(F.col("_pos") - F.floor("_pos"))).alias("v")
    )
    names = {p: f"p{round(p * 100)}" for p in points}
    found = value.groupBy(F.col(key).alias("_key")).agg(
        *(F.round(F.max(F.when(F.col("_p") == p, F.col("v"))), 6).alias(n) for p, n in names.items())
    )
    # Groups of nulls only have no value, but stay.
    return sizes.join(found, sizes[key].eqNullSafe(found["_key"]), "left").select(key, *names.values())


def feedback_average(feedback: DataFrame) -> DataFrame:
    return feedback.agg(
        F.count("score").alias("ratings"), F.round(F.avg("score"), 6).alias("avg_feedback")
    )


def processing_summary(results: DataFrame) -> DataFrame:
    """Totals per run. Failed documents are counted here and listed by ``split_failures``."""
    return results.agg(
        F.count_if(F.col("status") == "success").alias("docs_processed"),
        F.count_if(F.col("status") != "success").alias("docs_failed"),
        F.round(F.avg("latency_ms"), 6).alias("average_processing_time"),
        F.sum("size_bytes").cast("bigint").alias("storage_usage"),
    )


def routing_effect(attempts: DataFrame) -> DataFrame:
    """Per task: requests, share solved at the first choice, share that fell back.

    One aggregate per request finds the first attempt, so a request with very many
    attempts is merged in parts.
    """
    request = attempts.groupBy("request_id", "task").agg(
        F.min_by("success", "attempt").alias("first_ok"),
        F.max("success").alias("solved"),
        F.count("*").alias("tries"),
    )
    return request.groupBy("task").agg(
        F.count("*").alias("requests"),
        F.round(F.avg(F.col("first_ok").cast("int")), 6).alias("first_choice_rate"),
        F.round(F.avg((F.col("tries") > 1).cast("int")), 6).alias("fallback_rate"),
        F.round(F.avg(F.col("solved").cast("int")), 6).alias("solved_rate"),
    )


def latency_sketches(log: DataFrame, keys: list[str], size: int = 200) -> DataFrame:
    """A mergeable quantile sketch (KLL) per day and ``keys``, to be stored; ``n`` values each.

    A sketch has a bounded size whatever it has seen, and is merged in parts before the
    exchange. The rank error is about 1.7 / ``size`` at 99 % confidence.
    """
    day = F.to_date("timestamp").alias("day")
    return log.where(F.col("latency_ms").isNotNull()).groupBy(day, *keys).agg(
        F.count("*").alias("n"), F.kll_sketch_agg_double("latency_ms", F.lit(size)).alias("sketch")
    )


def sketched_percentiles(sketches: DataFrame, keys: list[str], first: date, last: date, points: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """``keys, n, p, value`` of any period of whole days, from stored sketches alone."""
    chosen = sketches.where(F.col("day").between(F.lit(first), F.lit(last)))
    merged = chosen.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    values = [F.struct(F.lit(p).alias("p"), F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias("value")) for p in points]
    return merged.select(*keys, "n", F.explode(F.array(*values)).alias("_v")).select(*keys, "n", "_v.*")


def rank_errors(log: DataFrame, estimates: DataFrame, key: str) -> DataFrame:
    """``key, n, p, error``: how far the true ranks of estimated percentiles are from the wanted ones.

    The share of values below the estimate and the share up to it enclose the ranks it
    stands for; within them the error is 0.
    """
    counted = log.where(F.col("latency_ms").isNotNull()).groupBy(key, "latency_ms").agg(F.count("*").alias("c"))
    named = estimates.select(F.col(key).alias("_key"), "n", "p", "value")
    both = counted.join(F.broadcast(named), F.col(key).eqNullSafe(F.col("_key")))
    shares = both.groupBy(key, "n", "p", "value").agg(
        F.sum(F.when(F.col("latency_ms") < F.col("value"), F.col("c")).otherwise(0)).alias("below"),
        F.sum(F.when(F.col("latency_ms") <= F.col("value"), F.col("c")).otherwise(0)).alias("upto"),
    )
    error = F.greatest(F.col("below") / F.col("n") - F.col("p"), F.col("p") - F.col("upto") / F.col("n"), F.lit(0.0))
    return shares.select(key, "n", "p", error.alias("error"))
