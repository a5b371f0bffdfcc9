"""Reference linking: which page a link leads to, and how pages are linked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import text as tx
from paperloom.functions import urls
from paperloom.operators.skew import row_lookup


def resolved_links(pages: DataFrame) -> DataFrame:
    """``page_id, position, link, target, fragment`` of every ``href``, in order.

    ``target`` is the canonical address the link leads to from its page. A link to a place in
    its own page has the page itself as target.
    """
    found = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(tx.HREF), 1)).alias("position", "link"))
    target = urls.resolve(F.col("url"), F.trim(tx.decode_entities(F.col("link"))))
    return found.select("page_id", F.col("position").cast("bigint").alias("position"), "link", target.alias("_to")).select(
        "page_id", "position", "link", urls.canonical(F.col("_to")).alias("target"), F.substr(urls.parts(F.col("_to"))["fragment"], F.lit(2)).alias("fragment")
    )


def link_table(pages: DataFrame) -> DataFrame:
    """Resolved links with ``target_page_id`` and ``kind``: page, outside, or other (not a web address).

    Of pages with one canonical address the smallest id is meant. Targets that very many
    links share are looked up in salted parts.
    """
    known = pages.groupBy(urls.canonical(F.col("url")).alias("target")).agg(F.min("page_id").alias("target_page_id"))
    linked = row_lookup(resolved_links(pages), known, "target", F.struct("page_id", "position"))
    web = F.col("target").startswith("http:") | F.col("target").startswith("https:")
    kind = F.when(F.col("target_page_id").isNotNull(), "page").when(web, "outside").otherwise("other")
    return linked.withColumn("kind", kind).select("page_id", "position", "link", "target", "fragment", "target_page_id", "kind")


def link_degrees(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Per page: links out and distinct targets, links in and distinct linking pages.

    Links are first counted by (page, target), so a target of very many links is added up in
    parts. A page without links has zeros; its links to itself count both ways.
    """
    counted = links.groupBy("page_id", "target", "target_page_id").agg(F.count("*").alias("n"))
    out = counted.groupBy("page_id").agg(F.sum("n").alias("out_links"), F.count("*").alias("out_targets"))
    into = counted.where("target_page_id is not null").groupBy(F.col("target_page_id").alias("page_id")).agg(
        F.sum("n").alias("in_links"), F.count("*").alias("in_pages")
    )
    return pages.select("page_id").join(out, "page_id", "left").join(into, "page_id", "left").na.fill(0)


def target_hosts(links: DataFrame) -> DataFrame:
    """Links and linking pages per host that is linked to."""
    host = F.lower(F.substr(urls.parts(F.col("target"))["authority"], F.lit(3)))
    counted = links.groupBy(host.alias("host"), "page_id").agg(F.count("*").alias("n"))
    return counted.groupBy("host").agg(F.sum("n").alias("links"), F.count("*").alias("pages"))
