"""Document metadata records: check, parse, patch, fill, look up, group, batch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.operators.skew import number_rows, row_lookup

METADATA = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("file_type", T.StringType()),
        T.StructField("creation_date", T.TimestampNTZType()),
        T.StructField("last_modified", T.TimestampNTZType()),
        T.StructField("author", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("department", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("language", T.StringType()),
        T.StructField("confidence_score", T.DoubleType()),
        T.StructField("processing_status", T.StringType()),
        T.StructField("document_id", T.StringType()),
        T.StructField("checksum", T.StringType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("page_count", T.LongType()),
        T.StructField("classification", T.StringType()),
        T.StructField("retention_period", T.LongType()),
        T.StructField("access_level", T.StringType()),
        T.StructField("last_accessed", T.TimestampNTZType()),
        T.StructField("processing_history", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
    ]
)
REQUIRED = ("file_path", "file_type", "creation_date", "author")
# What a missing field is filled with.
DEFAULTS = {
    "checksum": "",
    "size_bytes": 0,
    "page_count": 0,
    "classification": "",
    "retention_period": 0,
    "access_level": "public",
}


def _given(df: DataFrame, name: str) -> Column:
    """Present and, for text, not empty."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.coalesce(F.col(name) != "", F.lit(False))
    return F.col(name).isNotNull()


def validate_required(meta: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    ok = reduce(lambda a, b: a & b, (_given(meta, name) for name in required))
    return meta.withColumn("valid", ok)


def metadata_from_json(rows: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """Typed fields of a JSON column; keys outside the schema are dropped."""
    keep = [c for c in rows.columns if c != column]
    return rows.withColumn("_m", F.from_json(column, schema)).select(*keep, "_m.*")


def metadata_to_json(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, F.to_json(F.struct(*rows.columns)).alias("metadata"))


def metadata_patch(meta: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Set known fields from ``patch``; fields the record does not have are ignored."""
    known = [c for c in patch.columns if c in meta.columns and c != key]
    changed = patch.select(key, *(F.col(c).alias(f"_new_{c}") for c in known))
    return meta.join(changed, key, "left").select(
        *(F.coalesce(f"_new_{c}", c).alias(c) if c in known else F.col(c) for c in meta.columns)
    )


def metadata_defaults(meta: DataFrame, defaults: dict = DEFAULTS) -> DataFrame:
    """Fill missing fields; fields the table lacks altogether are added."""
    filled = {
        name: F.coalesce(F.col(name), F.lit(value)) if name in meta.columns else F.lit(value)
        for name, value in defaults.items()
    }
    return meta.withColumns({n: c.cast(METADATA[n].dataType) for n, c in filled.items()})


def metadata_lookup(requests: DataFrame, meta: DataFrame, key: str, request_id: str) -> DataFrame:
    """Metadata of each requested document, null where there is none."""
    return row_lookup(requests, meta, key, F.col(request_id))


def group_by_type(files: DataFrame, handlers: dict[str, str], type_col: str = "file_type") -> DataFrame:
    """Count, size and handler per file type; a null handler means the type is skipped."""
    handler = F.element_at(F.create_map(*(F.lit(x) for pair in handlers.items() for x in pair)), F.col(type_col))
    return (
        files.groupBy(type_col)
        .agg(F.count("*").alias("files"), F.sum("size_bytes").alias("size_bytes"))
        .withColumn("handler", handler)
    )


def assign_batches(files: DataFrame, handlers: dict[str, str], batch_size: int, type_col: str, order: str) -> DataFrame:
    """Consecutive batches inside each supported type."""
    supported = files.where(F.col(type_col).isin(*handlers))
    numbered = number_rows(supported, [type_col], [F.asc(order)], "_n")
    return numbered.withColumn("batch_no", F.floor((F.col("_n") - 1) / batch_size)).drop("_n")


def skip_processed(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files not yet processed in their present content."""
    return files.join(done.select("file_path", "checksum"), ["file_path", "checksum"], "left_anti")


def with_status(files: DataFrame, handlers: dict[str, str], type_col: str = "file_type") -> DataFrame:
    """Outcome columns: a file without a handler fails with a reason, no row is lost."""
    known = F.col(type_col).isin(*handlers)
    return files.withColumns(
        {
            "status": F.when(known, "success").otherwise("failed"),
            "error": F.when(~known, F.concat(F.lit("unsupported type: "), F.col(type_col))),
        }
    )


def split_failures(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and failed rows of a result with ``status``."""
    failed = F.coalesce(F.col("status") != "success", F.lit(True))
    return results.where(~failed), results.where(failed)


def union_batches(batches: list[DataFrame]) -> DataFrame:
    """All batch results together; equal rows are all kept."""
    return reduce(lambda a, b: a.unionByName(b), batches)
