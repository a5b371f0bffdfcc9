"""Listing, parsing, sync and export queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.plans.catalog import query
from paperloom.plans.fixtures import AS_OF, CUSTOMER, EPOCH, docx_files, mail_files, pptx_files, xlsx_files
from paperloom.plans.sql import with_parts
from paperloom.sources import files, listings, parsers, sinks, sync
from paperloom.storage import scratch_path, spread_rows

LINES = """SELECT d.doc_id || '{suffix}' AS path, o2 AS position, line AS value FROM (
             SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS INTEGER) AS o2, line
             FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY u(line, o) WHERE line <> '') d"""


SUFFIX = r"regexp_extract(path, '(\.[^./]+)$', 1)"


@query(
    "scan_by_extension",
    with_parts(
        f"""SELECT path, {SUFFIX} AS suffix, bytes FROM (
              SELECT file_path AS path, size_bytes AS bytes FROM meta
              UNION ALL SELECT url AS path, octet_length(encode(html)) AS bytes FROM pages)
            WHERE {SUFFIX} IN ('.en', '.fr', '.html')"""
    ),
)
def scan_by_extension(t):
    """Listed document files and pages whose suffix is allowed."""
    listed = t.meta.select(F.col("file_path").alias("path"), F.col("size_bytes").alias("bytes"))
    pages = t.pages.select(F.col("url").alias("path"), F.octet_length("html").cast("bigint").alias("bytes"))
    return files.keep_suffixes(listed.unionByName(pages), "path", [".en", ".fr", ".html"]).select("path", "suffix", "bytes")


@query("read_text", "SELECT CAST(item_id AS INTEGER) AS item_id, text || chr(10) AS text FROM benchmark")
def read_text(t):
    path = scratch_path(t.spark, "texts")
    t.read("benchmark").select("item_id", "text").write.partitionBy("item_id").text(path)
    return files.read_text(t.spark, path).select("item_id", "text")


@query("read_csv_json_xml", """SELECT f.format, c.* FROM customer c CROSS JOIN (VALUES ('csv'), ('json'), ('xml')) f(format)""")
def read_csv_json_xml(t):
    path = scratch_path(t.spark, "tabular")
    rows = t.read("customer")
    rows.write.csv(f"{path}/csv", header=True)
    rows.write.json(f"{path}/json")
    rows.write.xml(f"{path}/xml", rowTag="customer", rootTag="customers")
    read = {
        "csv": files.read_csv(t.spark, f"{path}/csv", CUSTOMER),
        "json": files.read_json(t.spark, f"{path}/json", CUSTOMER),
        "xml": files.read_xml(t.spark, f"{path}/xml", CUSTOMER, "customer"),
    }
    parts = [df.withColumn("format", F.lit(name)) for name, df in read.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("parse_docx", LINES.format(suffix=".docx"))
def parse_docx(t):
    return parsers.parse_office(docx_files(t.documents)).where("part = 'body'").select("path", "position", "value")


@query("parse_pptx", LINES.format(suffix=".pptx"))
def parse_pptx(t):
    return parsers.parse_office(pptx_files(t.documents)).where("part = 'slide1'").select("path", "position", "value")


@query(
    "parse_xlsx",
    """SELECT p_partkey || '.xlsx' AS path, 'parts' AS sheet, CAST(1 AS INTEGER) AS row, c.col, c.value
       FROM part, unnest([{'col': 'A', 'value': p_name}, {'col': 'B', 'value': p_brand}, {'col': 'C', 'value': CAST(p_size AS VARCHAR)}]) u(c)""",
)
def parse_xlsx(t):
    return parsers.parse_office(xlsx_files(spread_rows(t.read("part")))).select("path", "sheet", "row", "col", "value")


@query(
    "parse_email",
    """SELECT conv_id || '-' || turn || '.eml' AS path, role || '@example.com' AS sender, 'archive@example.com' AS recipient,
              'conversation ' || conv_id || ' turn ' || turn AS subject, text || chr(10) AS body, 'success' AS status FROM conversations""",
)
def parse_email(t):
    return parsers.parse_email(mail_files(spread_rows(t.read("conversations")))).select(
        "path", "sender", "recipient", "subject", "body", "status"
    )


@query(
    "normalize_listing",
    """SELECT url, TIMESTAMP '2024-01-01' + to_minutes(page_id) AS created, TIMESTAMP '2024-01-01' + to_hours(page_id) AS modified,
              regexp_extract(url, '^https?://([^/]+)', 1) AS author, octet_length(encode(html)) AS size
       FROM pages WHERE NOT contains(url, '#')""",
)
def normalize_listing(t):
    return listings.normalize_listing(t.listing).select("url", "metadata.*")


@query("select_fields", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def select_fields(t):
    return listings.select_fields(t.read("customer"), ["c_custkey", "c_name", "c_mktsegment"])


@query(
    "incremental_sync",
    """SELECT o_orderkey, o_orderdate, CASE WHEN o_orderstatus = 'P' THEN 'new' ELSE 'changed' END AS change
       FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority = '1-URGENT'""",
)
def incremental_sync(t):
    """The target lacks the pending orders and holds an older version of the urgent ones."""
    orders = t.read("orders")
    age = F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)
    held = orders.where(F.col("o_orderstatus") != "P").select(
        "o_orderkey", (F.col("o_orderdate") - F.make_dt_interval(days=age)).alias("o_orderdate")
    )
    return listings.incremental_sync(orders.select("o_orderkey", "o_orderdate"), held, "o_orderkey", "o_orderdate")


KEPT_ORDERS = ["o_orderstatus", "o_totalprice", "o_orderpriority"]


def landed_orders(t):
    """The source lacks the open orders; the target held all but the pending ones, the urgent ones at another price."""
    orders = t.read("orders").select("o_orderkey", *KEPT_ORDERS)
    price = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    return orders.where("o_orderstatus <> 'O'"), orders.where("o_orderstatus <> 'P'").withColumn("o_totalprice", price)


CHANGES = """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'deleted' WHEN o_orderstatus = 'P' THEN 'new' ELSE 'changed' END AS change
             FROM orders WHERE o_orderstatus IN ('O', 'P') OR o_orderpriority = '1-URGENT'"""


@query("digest_sync", CHANGES)
def digest_sync(t):
    """New, changed and deleted orders, found by digests of buckets of keys."""
    return sync.digest_changes(*landed_orders(t), "o_orderkey", KEPT_ORDERS)


@query(
    "sync_versions",
    """WITH held AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
                            o_orderpriority, o_orderstatus = 'O' OR o_orderpriority = '1-URGENT' AS ends FROM orders WHERE o_orderstatus <> 'P')
       SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority, TIMESTAMP '2024-01-01' AS valid_from,
              CASE WHEN ends THEN TIMESTAMP '2024-01-31' END AS valid_to FROM held
       UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority, TIMESTAMP '2024-01-31', NULL FROM orders
       WHERE o_orderstatus = 'P' OR o_orderstatus <> 'O' AND o_orderpriority = '1-URGENT'""",
)
def sync_versions(t):
    """The versions of all orders after that sync."""
    source, held = landed_orders(t)
    since, none = F.lit(EPOCH).cast("timestamp_ntz"), F.lit(None).cast("timestamp_ntz")
    history = held.withColumns({"valid_from": since, "valid_to": none})
    return sync.synced_versions(history, source, "o_orderkey", KEPT_ORDERS, F.lit(AS_OF).cast("timestamp_ntz"))


ADDED = """SELECT doc_id, quality, CAST(-1 AS INTEGER) AS toxic FROM labels
           UNION ALL SELECT doc_id, quality, toxic FROM labels"""


@query("export_ndjson", ADDED)
def export_ndjson(t):
    path = scratch_path(t.spark, "ndjson")
    sinks.export_ndjson(t.labels.select("doc_id", "quality"), path)
    sinks.export_ndjson(t.labels, path)
    return sinks.read_ndjson(t.spark, path, t.labels.schema).na.fill(-1, ["toxic"])


@query("export_parquet_evolved", ADDED)
def export_parquet_evolved(t):
    path = scratch_path(t.spark, "evolved")
    sinks.export_parquet(t.labels.select("doc_id", "quality"), path)
    sinks.export_parquet(t.labels, path)
    return sinks.read_evolved(t.spark, path).select("doc_id", "quality", "toxic").na.fill(-1, ["toxic"])
