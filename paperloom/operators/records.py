"""Schemaless records: JSON columns as variants, whose fields may differ from row to row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kind_of(value: Column) -> Column:
    """``number``, ``text``, ``boolean``, ``object``, ``array``, ``none`` or another type's own name."""
    name = F.regexp_extract(F.schema_of_variant(value), "^[A-Z_]+", 0)
    return (
        F.when(name.isin("BIGINT", "DOUBLE", "FLOAT", "DECIMAL"), "number").when(name == "STRING", "text").when(name == "VOID", "none")
        .otherwise(F.lower(name))
    )


def record_fields(rows: DataFrame, key: str, column: str) -> DataFrame:
    """``key, field, kind, value`` of every top-level field of a JSON column; one row for what has none.

    Text that is not JSON is a row of kind ``malformed`` with the text as value, a null is one of
    kind ``missing``, and a record that is no object is one without a field name.
    """
    parsed = rows.select(key, F.col(column).alias("_text"), F.try_parse_json(column).alias("_v"))
    is_object = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
    exploded = parsed.where(is_object).lateralJoin(parsed.sparkSession.tvf.variant_explode(F.col("_v").outer()))
    fields = exploded.select(key, F.col("key").alias("field"), kind_of(F.col("value")).alias("kind"), F.col("value").cast("string").alias("value"))
    kind = F.when(F.col("_text").isNull(), "missing").when(F.col("_v").isNull(), "malformed").otherwise(kind_of(F.col("_v")))
    value = F.coalesce(F.col("_v").cast("string"), F.col("_text"))
    rest = parsed.where(~is_object).select(key, F.lit(None).cast("string").alias("field"), kind.alias("kind"), value.alias("value"))
    return fields.unionByName(rest)


def field_kinds(fields: DataFrame) -> DataFrame:
    """Per field and kind: rows, and distinct values; a field of several kinds changes its type between rows."""
    counted = fields.groupBy("field", "kind", "value").agg(F.count("*").alias("n"))
    return counted.groupBy("field", "kind").agg(F.sum("n").alias("rows"), F.count("value").alias("values"))


def merged_schema(rows: DataFrame, column: str) -> DataFrame:
    """One row: the schema that holds every record of a JSON column."""
    return rows.select(F.try_parse_json(column).alias("_v")).agg(F.schema_of_variant_agg("_v").alias("schema"))


def typed_field(column: str, path: str, kind: str) -> Column:
    """A field as ``kind``; null where it is missing or does not fit."""
    return F.try_variant_get(F.try_parse_json(column), path, kind)
