"""Structured Streaming forms of ingest, cache upkeep and usage analytics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from paperloom.operators.cache import latency_ewma, upsert_latest
from paperloom.storage import materialize, scratch_path


def read_table_stream(spark: SparkSession, folder: str, table: str, schema: T.StructType, files_per_batch: int = 64) -> DataFrame:
    """New Parquet files of one table in ``folder``, as a stream; a table is files or a folder of files named for it."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(f"{folder.rstrip('/')}/{table}*.parquet")
    )


def run_to_batches(stream: DataFrame, name: str, prepare, mode: str = "append", path: str | None = None) -> DataFrame:
    """Process everything available through ``foreachBatch`` and read all batches back.

    A batch is written to a folder of its own number, so a repeated batch replaces itself.
    ``prepare`` gets a batch alone; what earlier ones left is in the state store. With a
    ``path`` of the caller's, a later call resumes where an earlier one stopped or failed.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        prepare(batch).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", f"{path}/_progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{path}/rows")


def daily_usage(log: DataFrame) -> DataFrame:
    """Running uses per day, for update mode; the state is one row a day, and no row is late."""
    return log.groupBy(F.date_trunc("day", "timestamp").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("uses"))


def run_daily_usage(log: DataFrame, name: str = "daily-usage", path: str | None = None) -> DataFrame:
    """Uses of every day, the open one included; counts only grow, so the largest is the newest."""
    updates = run_to_batches(daily_usage(log), name, lambda batch: batch, "update", path)
    return updates.groupBy("day").agg(F.max("uses").alias("uses"))


def first_seen(docs: DataFrame) -> DataFrame:
    """Per id the newest row of its first batch, for update mode; a later batch changes the arrival range.

    The state holds one row an id. ``_since`` and ``_until`` are the times of the first and the last
    batch that had the id, which are equal in the batch that brings it.
    """
    arrived = docs.withColumn("_arrived", F.current_timestamp())
    newest = F.max_by(F.struct(*docs.columns), F.struct("creation_date", "checksum"))
    return arrived.groupBy("doc_id").agg(newest.alias("_row"), F.min("_arrived").alias("_since"), F.max("_arrived").alias("_until"))


def run_ingest(docs: DataFrame, name: str = "ingest", path: str | None = None) -> DataFrame:
    """Each document once, however often and in whatever order it arrives.

    Known ids are in the state store, by key, so a batch reads what it touches and never the
    rows that are stored. No date decides over a document. Of one id in a batch the newest stays.
    """

    def fresh(batch: DataFrame) -> DataFrame:
        return batch.where("_since = _until").select("_row.*")

    return run_to_batches(first_seen(docs), name, fresh, "update", path).drop("batch")


def cache_change_log(changes: DataFrame, name: str = "cache-changes", path: str | None = None) -> DataFrame:
    """Stored changes, already cut to the last one per key inside each batch."""
    return run_to_batches(changes, name, lambda batch: upsert_latest(batch, ["key"], ["written_at", "seq"]), path=path)


def current_cache(change_log: DataFrame) -> DataFrame:
    """The cache table a change log stands for."""
    return upsert_latest(change_log.drop("batch"), ["key"], ["written_at", "seq"])


def _bucket_versions(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """The newest batch that wrote each bucket; at most one row a bucket."""
    written = spark.read.schema("bucket int, batch bigint").parquet(f"{path}/touched")
    if before is not None:
        written = written.where(F.col("batch") < before)
    return {r["bucket"]: r["batch"] for r in written.groupBy("bucket").agg(F.max("batch").alias("batch")).collect()}


def cache_snapshot(spark: SparkSession, path: str, schema: T.StructType, versions: dict[int, int]) -> DataFrame:
    """The cache rows of these buckets at these batches; no other file is read."""
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{path}/rows/batch={n}/bucket={b}" for b, n in sorted(versions.items())))


def run_cache_upserts(changes: DataFrame, name: str = "cache", path: str | None = None, buckets: int = 64) -> DataFrame:
    """The cache that a stream of changes ``key, written_at, seq, ...`` leaves, kept as a table of key buckets.

    A batch is cut to the last change of each key, and only the buckets of its keys are read,
    merged and written under its number; the others stay at their older batch. A repeated
    batch reads what came before it and replaces its own folders. With a ``path`` of the
    caller's, a later call resumes. ``buckets`` stays the same for one path.
    """
    spark, order = changes.sparkSession, ["written_at", "seq"]
    path = path or scratch_path(spark, name)
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        last = materialize(upsert_latest(batch, ["key"], order).withColumn("bucket", bucket), f"{name}-batch")
        touched = materialize(last.select("bucket").distinct(), f"{name}-touched")
        wanted = {r["bucket"] for r in touched.collect()}  # at most ``buckets`` rows
        held = {b: n for b, n in (_bucket_versions(session, path, number) if number else {}).items() if b in wanted}
        known = cache_snapshot(session, path, changes.schema, held).withColumn("bucket", bucket)
        merged = upsert_latest(last.unionByName(known), ["key"], order)
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/batch={number}")
        touched.coalesce(1).write.mode("overwrite").parquet(f"{path}/touched/batch={number}")

    query = (
        changes.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{path}/_progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return cache_snapshot(spark, path, changes.schema, _bucket_versions(spark, path))


def user_totals(log: DataFrame) -> DataFrame:
    """Running totals per user, for update mode."""
    return log.groupBy("user_id").agg(
        F.count("*").alias("actions"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen")
    )


def run_user_totals(log: DataFrame, name: str = "user-totals") -> DataFrame:
    """Keep the newest total of every user; counts only grow, so the largest is the newest."""
    updates = run_to_batches(user_totals(log), name, lambda batch: batch, "update")
    return upsert_latest(updates.drop("batch"), ["user_id"], ["actions"])


#: Newer rows after which an older finite one weighs nothing: 2^-1100 of the largest double is below any digit.
KEEP = 1100
#: A key's rows are spread over so many states, so that one key may hold any share of a log.
PARTS = 16
KEPT = "n bigint, endless double, at array<bigint>, id array<bigint>, x array<double>, none array<boolean>"


def newest_rows(log: DataFrame, parts: int = PARTS) -> DataFrame:
    """Keyed state of a latency log ``key, timestamp, event_id, latency_ms``, for update mode.

    Per key and part: the number of rows, the ``KEEP`` newest of them, and the sum of older
    values that are not finite, which stay for ever. Rows may come in any order: a late one
    is put in its place, or is older than all that matters.
    """

    def keep(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, endless, *kept = state.get if state.exists else (0, 0.0, [], [], [], [])
        held = pd.DataFrame(dict(zip(("at", "id", "x", "none"), kept, strict=True)))
        for batch in batches:
            n += len(batch)
            held = pd.concat([held, batch[["at", "id", "x", "none"]]]) if len(held) else batch[["at", "id", "x", "none"]]
            held = held.sort_values(["at", "id"], ascending=False, kind="stable")
            older = held.iloc[KEEP:]
            older = older[~older["none"].astype(bool)]["x"]
            endless += float(older[~np.isfinite(older)].sum(skipna=False)) if len(older) else 0.0
            held = held.iloc[:KEEP]
        columns = [held[c].tolist() for c in ("at", "id", "x", "none")]
        columns[3] = [bool(v) for v in columns[3]]
        state.update((n, endless, *columns))
        yield pd.DataFrame({"key": [group[0]], "part": [group[1]], "n": [n], "endless": [endless], **dict(zip(("at", "id", "x", "none"), ([c] for c in columns), strict=True))})

    rows = log.select(
        "key",
        F.pmod(F.xxhash64("event_id"), F.lit(parts)).cast("int").alias("part"),
        F.coalesce(F.unix_micros(F.col("timestamp").cast("timestamp")), F.lit(-(2**63))).alias("at"),
        F.coalesce(F.col("event_id").cast("bigint"), F.lit(-1)).alias("id"),
        F.coalesce("latency_ms", F.lit(0.0)).cast("double").alias("x"),
        F.col("latency_ms").isNull().alias("none"),
    )
    kind = log.schema["key"].dataType.simpleString()
    return rows.groupBy("key", "part").applyInPandasWithState(keep, f"key {kind}, part int, {KEPT}", KEPT, "update", GroupStateTimeout.NoTimeout)


def run_latency_ewma(log: DataFrame, key: str, name: str = "latency-ewma", path: str | None = None, parts: int = PARTS) -> DataFrame:
    """Running latency average per key, whatever the order in which batches arrive.

    The newest rows of every key are keyed state; the average is taken over those alone, so no
    stored log is sorted again.
    """
    rows = log.select(F.col(key).alias("key"), "timestamp", "event_id", "latency_ms")
    updates = run_to_batches(newest_rows(rows, parts), name, lambda batch: batch, "update", path)
    last = updates.groupBy("key", "part").agg(F.max_by(F.struct("n", "endless", "at", "id", "x", "none"), "n").alias("s")).select("key", "s.*")
    kept = last.select("key", F.explode(F.arrays_zip("at", "id", "x", "none")).alias("r")).select(
        "key", "r.at", "r.id", F.when(~F.col("r.none"), F.col("r.x")).alias("latency_ms")
    )
    averages = latency_ewma(kept, ["key"], ["at", "id"], "latency_ms", None).withColumnRenamed("key", "_key")
    totals = last.groupBy("key").agg(F.sum("n").alias("n"), F.sum("endless").alias("_endless"))
    average = F.round(F.col("ewma_ms") + F.col("_endless"), 6)
    return totals.join(averages, F.col("key").eqNullSafe(F.col("_key"))).select("key", "n", average.alias("ewma_ms"))
