"""Sync by digests: what is new, changed or deleted, without trusting any time, and its versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.storage import materialize

#: Rows a bucket should have; a bucket is the unit that is compared as a whole.
BUCKET_ROWS = 1000


def _digests(columns: list[str]) -> list[Column]:
    """Two 64-bit digests of a row; nulls differ from every value."""
    fields = [part for c in columns for part in (F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(F.lit(seed), *fields).cast("decimal(20,0)").alias(f"_d{seed}") for seed in (1, 2)]


def bucket_count(rows: int) -> int:
    """A power of two, so that growing tables keep their digests for long."""
    return 1 << max(0, (max(rows, 1) // BUCKET_ROWS).bit_length())


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def bucket_digests(rows: DataFrame, key: str, columns: list[str], buckets: int) -> DataFrame:
    """``bucket, n, a, b``: rows and added-up row digests of each bucket of keys, whatever their order.

    Keep it with a table to tell later what to read of it.
    """
    one, two = _digests([key, *columns])
    marked = rows.select(bucket_of(key, buckets).alias("bucket"), one, two)
    wide = "decimal(38,0)"
    return marked.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("_d1").cast(wide).alias("a"), F.sum("_d2").cast(wide).alias("b"))


def unequal_buckets(left: DataFrame, right: DataFrame) -> DataFrame:
    """Buckets whose digests differ or that only one side has."""
    return left.exceptAll(right).unionByName(right.exceptAll(left)).select("bucket").distinct()


def digest_changes(source: DataFrame, target: DataFrame, key: str, columns: list[str], buckets: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """``key, change`` of the keys that are new, changed or deleted in ``source``.

    Bucket digests of both sides are compared first; only rows of unequal buckets are grouped
    by key and joined. ``known`` are stored digests of the target, which is then read in unequal
    buckets only. Rows that repeat a key count together; a null key is a key.
    """
    buckets = buckets or bucket_count(target.count())
    known = known if known is not None else bucket_digests(target, key, columns, buckets)
    unequal = materialize(unequal_buckets(bucket_digests(source, key, columns, buckets), known), "unequal-buckets")

    def grouped(rows: DataFrame, name: str) -> DataFrame:
        own = rows.withColumn("_bucket", bucket_of(key, buckets))
        kept = own.join(unequal.withColumnRenamed("bucket", "_bucket"), "_bucket", "left_semi")
        one, two = _digests(columns)
        return kept.select(F.col(key).alias(name), one, two).groupBy(name).agg(
            F.struct(F.count("*"), F.sum("_d1"), F.sum("_d2")).alias(f"{name}_digest")
        )

    new, old = grouped(source, "_new"), grouped(target, "_old")
    joined = new.join(old, F.col("_new").eqNullSafe(F.col("_old")), "full")
    change = (
        F.when(F.col("_old_digest").isNull(), "new").when(F.col("_new_digest").isNull(), "deleted").when(F.col("_new_digest") != F.col("_old_digest"), "changed")
    )
    named = F.when(F.col("_new_digest").isNotNull(), F.col("_new")).otherwise(F.col("_old"))
    return joined.select(named.alias(key), change.alias("change")).where("change is not null")


def synced_versions(history: DataFrame, source: DataFrame, key: str, columns: list[str], as_of: Column, buckets: int | None = None) -> DataFrame:
    """``history`` after a sync: its rows ``key, columns, valid_from, valid_to`` (null while valid).

    Versions of changed and deleted keys end at ``as_of``; new and changed keys begin one there.
    Ended versions are never touched, so the past can be read at any time.
    """
    valid = history.where("valid_to is null")
    changes = materialize(digest_changes(source, valid.select(key, *columns), key, columns, buckets), "changes")
    marks = changes.select(F.col(key).alias("_key"), "change")
    ended = history.join(marks.where("change <> 'new'"), F.col("valid_to").isNull() & F.col(key).eqNullSafe(F.col("_key")), "left")
    closed = ended.withColumn("valid_to", F.when(F.col("change").isNotNull(), as_of).otherwise(F.col("valid_to"))).drop("_key", "change")
    begun = source.join(marks.where("change <> 'deleted'"), F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    opened = begun.select(key, *columns, as_of.alias("valid_from"), F.lit(None).cast(history.schema["valid_to"].dataType).alias("valid_to"))
    return closed.select(key, *columns, "valid_from", "valid_to").unionByName(opened)
