"""Remote listings landed as tables: normalise, select fields, find what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def normalize_listing(items: DataFrame) -> DataFrame:
    """``url`` and nested ``metadata`` of the items that name a file."""
    return items.where(F.col("FileRef").isNotNull() & (F.col("FileRef") != "")).select(
        F.col("FileRef").alias("url"),
        F.struct(
            F.col("Created").alias("created"),
            F.col("Modified").alias("modified"),
            F.col("Author").alias("author"),
            F.col("Size").alias("size"),
        ).alias("metadata"),
    )


def select_fields(table: DataFrame, fields: list[str]) -> DataFrame:
    """Fields chosen at run time, checked against the schema."""
    unknown = [f for f in fields if f not in table.columns]
    if unknown:
        raise ValueError(f"unknown fields: {unknown}")
    return table.select(*fields)


def incremental_sync(source: DataFrame, target: DataFrame, key: str, modified: str) -> DataFrame:
    """Source rows that are new or newer than the target's, with ``change``.

    The target's newest row of a key counts. A known row without a time is older than any
    source row that has one.
    """
    seen = target.groupBy(key).agg(F.max(modified).alias("_seen"), F.lit(True).alias("_known"))
    joined = source.join(seen, key, "left")
    later = (F.col("_seen").isNull() & F.col(modified).isNotNull()) | (F.col(modified) > F.col("_seen"))
    change = F.when(F.col("_known").isNull(), "new").when(later, "changed")
    return joined.withColumn("change", change).where(F.col("change").isNotNull()).drop("_seen", "_known")
