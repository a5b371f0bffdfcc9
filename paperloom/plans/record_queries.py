"""Schemaless records and content handlers."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import text as tx
from paperloom.operators import records as ops
from paperloom.plans.catalog import query
from paperloom.plans.sql import inner_text
from paperloom.sources import handlers

KIND = """CASE json_type(props, '$."' || key || '"') WHEN 'VARCHAR' THEN 'text' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array'
               WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'none' ELSE 'number' END"""
FIELDS = f"""SELECT event_id, key AS field, {KIND} AS kind, json_extract_string(props, '$."' || key || '"') AS value
             FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)"""


@query("record_fields", FIELDS)
def record_fields(t):
    """Every field of every event's properties with its kind."""
    return ops.record_fields(t.read("events"), "event_id", "props")


@query("field_kinds", f"SELECT field, kind, count(*) AS rows, count(DISTINCT value) AS values FROM ({FIELDS}) GROUP BY 1, 2")
def field_kinds(t):
    return ops.field_kinds(ops.record_fields(t.read("events"), "event_id", "props"))


@query(
    "handled_content",
    f"""SELECT 'd' || doc_id AS id, 'line ' || (o - 1) AS part, line AS value, 'success' AS status
        FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY u(line, o) WHERE lang IN ('en', 'de', 'fr') AND line <> ''
        UNION ALL SELECT 'd' || doc_id, NULL, NULL, 'failed' FROM documents WHERE lang NOT IN ('en', 'de', 'fr')
        UNION ALL SELECT 'p' || page_id, 'title', {inner_text("title")}, 'success'
        FROM (SELECT page_id, unnest(regexp_extract_all(html, '{tx.TITLE}', 1)) AS title FROM pages)""",
)
def handled_content(t):
    """Documents and pages by the handler of their type; a type without one is a failed row."""
    docs = t.documents.select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("lang").alias("type"), F.col("text").alias("content"))
    pages = t.pages.select(F.concat(F.lit("p"), "page_id").alias("id"), F.lit("html").alias("type"), F.col("html").alias("content"))
    registry = {"en": handlers.Lines, "de": handlers.Lines, "fr": handlers.Lines, "html": handlers.Titles}
    return handlers.handled(docs.unionByName(pages), registry).select("id", "part", "value", "status")
