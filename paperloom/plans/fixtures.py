"""How the given tables stand for documents, logs, caches, questions and listings."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from datetime import datetime
from email.message import EmailMessage
from functools import cached_property
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions.hashing import content_id, query_key
from paperloom.operators.vectors import embed_hashing
from paperloom.storage import spread_rows

AS_OF = datetime(2024, 1, 31)
EPOCH = datetime(2024, 1, 1)
HANDLERS = {"en": "latin", "de": "latin", "fr": "latin"}
ACTIONS = ["click", "error", "purchase", "signup", "view"]
FILE_SCHEMA = "path string, content binary"


class Tables:
    """The tables of one folder and the records bound to them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        return spread_rows(self.read("documents"))

    @cached_property
    def pages(self) -> DataFrame:
        return spread_rows(self.read("pages"))

    @cached_property
    def labels(self) -> DataFrame:
        return self.read("labels")

    @cached_property
    def meta(self) -> DataFrame:
        """Document metadata records."""
        return self._labelled(describe(self.documents))

    @cached_property
    def meta_with_pii(self) -> DataFrame:
        """Metadata with ``has_pii``, from one scan of the documents."""
        from paperloom.operators.compliance import with_pii

        return self._labelled(describe(with_pii(self.documents), "has_pii"))

    def _labelled(self, described: DataFrame) -> DataFrame:
        described = described.join(self.labels, "doc_id", "left")
        return described.withColumns(
            {
                "author": F.when(F.col("quality").isNotNull(), "curator").otherwise(""),
                "classification": F.when(F.col("toxic") == 1, "restricted")
                .when(F.col("quality") == 1, "approved")
                .otherwise(""),
            }
        ).drop("quality", "toxic")

    @cached_property
    def audit(self) -> DataFrame:
        return audit_rows(self.read("events"))

    @cached_property
    def cache(self) -> DataFrame:
        """One entry per (user, k): its requests are the events of that pair."""
        cents = F.round(F.col("latency_ms") * 100).cast("bigint")
        return self.audit.groupBy("key").agg(
            F.floor(F.sum(cents * cents) / 1000).alias("size_bytes"),
            (F.count("*") - 1).alias("access_count"),
            F.max("timestamp").alias("last_accessed"),
            (F.max("timestamp") + F.make_dt_interval(days=F.lit(1))).alias("expires_at"),
            F.min("timestamp").alias("created_at"),
        )

    @cached_property
    def history(self) -> DataFrame:
        """Answered questions with a confidence."""
        return self.audit.select(
            F.col("document_id").alias("query"), "timestamp", (F.col("latency_ms") / 500).alias("score")
        )

    @cached_property
    def errors(self) -> DataFrame:
        return self.audit.where(F.col("action") == "error").select(
            F.concat(F.lit("query_"), F.col("document_id"), F.lit("_error")).alias("error_key")
        )

    @cached_property
    def attempts(self) -> DataFrame:
        return self.audit.select(
            F.col("key").alias("request_id"),
            (F.col("document_id") % 4).alias("task"),
            F.col("event_id").alias("attempt"),
            (F.col("action") != "error").alias("success"),
        )

    @cached_property
    def changes(self) -> DataFrame:
        """Cache writes, one per event."""
        return change_rows(self.audit)

    @cached_property
    def questions(self) -> DataFrame:
        """Everything users asked."""
        turns = spread_rows(self.read("conversations"))
        return turns.where(F.col("role") == "user").select(
            F.concat_ws(":", "conv_id", "turn").alias("query_id"), F.col("text").alias("query_text")
        )

    @cached_property
    def question_vectors(self) -> DataFrame:
        """Questions with the vector of their text; one that has no word cannot be asked."""
        vectors = embed_hashing(self.questions, "query_id", "query_text", unit=False)
        spoken = vectors.where(F.exists("embedding", lambda x: x != 0))
        return self.questions.join(spoken, "query_id").withColumnRenamed("embedding", "query_vec")

    @cached_property
    def text_vectors(self) -> DataFrame:
        """Document vectors by the same embedder; a text without words has no direction to be found by."""
        vectors = embed_hashing(self.documents, "doc_id", "text", unit=False).withColumnRenamed("doc_id", "id")
        return vectors.where(F.exists("embedding", lambda x: x != 0))

    @cached_property
    def vectors(self) -> DataFrame:
        """Stored vectors; odd labels form the ``code`` collection."""
        collection = F.when(F.col("label") % 2 == 1, "code").otherwise("default")
        return self.read("embeddings").select(F.col("vec_id").alias("id"), "embedding", "label", collection.alias("collection"))

    @cached_property
    def vector_queries(self) -> DataFrame:
        """Every twentieth stored vector asks; all are searched."""
        asking = self.vectors.where(F.col("id") % 20 == 0)
        return asking.select(F.col("id").alias("query_id"), "label", "collection", F.col("embedding").alias("query_vec"))

    @cached_property
    def listing(self) -> DataFrame:
        """A landed library listing; a link to a place inside a page names no file."""
        return self.pages.select(
            "page_id",
            F.when(F.contains("url", F.lit("#")), "").otherwise(F.col("url")).alias("FileRef"),
            (F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("page_id").cast("int"))).alias("Created"),
            (F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("page_id").cast("int"))).alias("Modified"),
            F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("Author"),
            F.octet_length("html").cast("bigint").alias("Size"),
        )

    def stream(self, name: str) -> DataFrame:
        from paperloom.streaming.jobs import read_table_stream

        return read_table_stream(self.spark, self.folder, name, self.read(name).schema)


def describe(docs: DataFrame, *more: str) -> DataFrame:
    """Metadata that follows from a document alone, and further columns of it."""
    doc_id = F.col("doc_id")
    return docs.select(
        "doc_id",
        *more,
        content_id(F.col("text")).alias("document_id"),
        F.concat(F.col("source"), F.lit("/"), doc_id, F.lit("."), F.col("lang")).alias("file_path"),
        F.col("lang").alias("file_type"),
        F.col("source").alias("department"),
        F.col("lang").alias("language"),
        (F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(hours=doc_id.cast("int"))).alias("creation_date"),
        F.md5("text").alias("checksum"),
        F.octet_length("text").cast("bigint").alias("size_bytes"),
        F.when(doc_id % 2 == 1, "internal").otherwise("public").alias("access_level"),
        ((doc_id % 4) * 10).alias("retention_period"),
        (F.col("lang") != "es").alias("encrypted"),
    )


def audit_rows(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return events.select(
        "event_id",
        F.col("ts").alias("timestamp"),
        "user_id",
        F.col("event_type").alias("action"),
        F.col("event_type").alias("provider"),
        k.alias("document_id"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"),
        F.col("value").alias("latency_ms"),
        query_key(F.concat_ws("_", "user_id", k)).alias("key"),
    )


def change_rows(audit: DataFrame) -> DataFrame:
    return audit.select(
        "key",
        F.concat_ws("/", "action", "document_id").alias("value"),
        F.col("timestamp").alias("written_at"),
        F.col("event_id").alias("seq"),
    )


def _archive(parts: dict[str, str]) -> bytes:
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, xml in parts.items():
            archive.writestr(name, xml)
    return packed.getvalue()


def _files(rows: DataFrame, pack) -> DataFrame:
    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([pack(row) for row in part.itertuples()], columns=["path", "content"])

    return rows.mapInPandas(batches, FILE_SCHEMA)


def _paragraph_xml(text: str, space: str) -> str:
    return "".join(f"<{space}:p><{space}:r><{space}:t>{escape(line)}</{space}:t></{space}:r></{space}:p>" for line in text.split("\n"))


def docx_files(docs: DataFrame) -> DataFrame:
    """Documents as word files, one paragraph per line."""

    def pack(row):
        xml = f'<w:document xmlns:w="urn:w"><w:body>{_paragraph_xml(row.text, "w")}</w:body></w:document>'
        return f"{row.doc_id}.docx", _archive({"word/document.xml": xml})

    return _files(docs.select("doc_id", "text"), pack)


def pptx_files(docs: DataFrame) -> DataFrame:
    """Documents as decks, one slide with a paragraph per line."""

    def pack(row):
        xml = f'<p:sld xmlns:p="urn:p" xmlns:a="urn:a">{_paragraph_xml(row.text, "a")}</p:sld>'
        return f"{row.doc_id}.pptx", _archive({"ppt/slides/slide1.xml": xml})

    return _files(docs.select("doc_id", "text"), pack)


def xlsx_files(parts: DataFrame) -> DataFrame:
    """Parts as workbooks with one named sheet: shared, inline and number cells."""

    def pack(row):
        sheet = (
            '<worksheet xmlns="urn:x"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c>'
            f'<c r="B1" t="inlineStr"><is><t>{escape(row.p_brand)}</t></is></c><c r="C1"><v>{row.p_size}</v></c>'
            "</row></sheetData></worksheet>"
        )
        book = (
            '<workbook xmlns="urn:x" xmlns:r="urn:r"><sheets><sheet name="parts" sheetId="1" r:id="rId1"/></sheets></workbook>'
        )
        links = '<Relationships xmlns="urn:l"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>'
        shared = f'<sst xmlns="urn:x"><si><t>{escape(row.p_name)}</t></si></sst>'
        return f"{row.p_partkey}.xlsx", _archive(
            {
                "xl/workbook.xml": book,
                "xl/_rels/workbook.xml.rels": links,
                "xl/sharedStrings.xml": shared,
                "xl/worksheets/sheet1.xml": sheet,
            }
        )

    return _files(parts.select("p_partkey", "p_name", "p_brand", "p_size"), pack)


def mail_files(turns: DataFrame) -> DataFrame:
    """Conversation turns as mails."""

    def pack(row):
        message = EmailMessage()
        message["From"] = f"{row.role}@example.com"
        message["To"] = "archive@example.com"
        message["Subject"] = f"conversation {row.conv_id} turn {row.turn}"
        message["Date"] = "Mon, 01 Jan 2024 00:00:00 +0000"
        message.set_content(row.text)
        return f"{row.conv_id}-{row.turn}.eml", message.as_bytes()

    return _files(turns.select("conv_id", "turn", "role", "text"), pack)


CUSTOMER = T.StructType(
    [
        T.StructField("c_custkey", T.LongType()),
        T.StructField("c_name", T.StringType()),
        T.StructField("c_nationkey", T.IntegerType()),
        T.StructField("c_acctbal", T.DoubleType()),
        T.StructField("c_mktsegment", T.StringType()),
    ]
)
