"""File listings, plain text, and tabular inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions.text import file_suffix


def scan_by_extension(spark: SparkSession, folder: str, allowed: list[str]) -> DataFrame:
    """Files whose suffix is allowed. Contents are not read: only listing columns are selected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return (
        files.select("path", "modificationTime", "length")
        .withColumn("suffix", file_suffix(F.col("path")))
        .where(F.col("suffix").isin(*allowed))
    )


def keep_suffixes(rows: DataFrame, path: str, allowed: list[str]) -> DataFrame:
    """Rows of a landed listing whose path ends in an allowed suffix, with ``suffix``."""
    return rows.withColumn("suffix", file_suffix(F.col(path))).where(F.col("suffix").isin(*allowed))


def read_binary(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """``(path, content)`` of the files with one suffix."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", f"*{suffix}")
        .load(folder)
        .select("path", "content")
    )


def read_text(spark: SparkSession, folder: str) -> DataFrame:
    """One row per text file; partition columns of the folder layout are kept."""
    return spark.read.text(folder, wholetext=True).withColumnRenamed("value", "text")


def read_csv(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    return spark.read.csv(folder, schema=schema, header=True, multiLine=False)


def read_json(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    return spark.read.json(folder, schema=schema)


def read_xml(spark: SparkSession, folder: str, schema: T.StructType, row_tag: str) -> DataFrame:
    return spark.read.xml(folder, schema=schema, rowTag=row_tag)
