"""How good a search is: against relevance judgements, and against exact search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = 6


def search_quality(hits: DataFrame, queries: DataFrame, judged: DataFrame, k: int, skip_self: bool = False) -> DataFrame:
    """Per label: queries, and their mean precision@k, recall@k (of at most k), reciprocal rank and nDCG.

    ``hits(query_id, id, rank)`` are ranked from 1; a hit is relevant if ``judged(id, label)`` has the label of
    ``queries(query_id, label)``. With ``skip_self`` a query is a judged row that is not
    counted. A query without any relevant row says nothing and is left out; one without hits has zeros.
    """
    sizes = judged.groupBy("label").agg((F.count("*") - int(skip_self)).alias("relevant")).where("relevant > 0")
    gains = F.transform(F.sequence(F.lit(1), F.least("relevant", F.lit(k)).cast("int")), lambda i: 1 / F.log2(i + 1))
    ideal = sizes.withColumn("ideal", F.aggregate(gains, F.lit(0.0), lambda total, x: total + x))
    asked = queries.join(F.broadcast(ideal), "label")
    rows = hits.where(F.col("rank") <= k).select("query_id", "id", "rank").join(judged.withColumnRenamed("label", "_found"), "id")
    right = F.col("_found") == F.col("label")
    per_query = (
        asked.join(rows, "query_id", "left").groupBy("query_id", "label", "relevant", "ideal").agg(
            F.count_if(right).alias("found"),
            F.min(F.when(right, F.col("rank"))).alias("first"),
            F.sum(F.when(right, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("gain"),
        )
    )
    return per_query.groupBy("label").agg(
        F.count("*").alias("queries"),
        F.round(F.avg(F.col("found") / k), DIGITS).alias("precision_at_k"),
        F.round(F.avg(F.col("found") / F.least("relevant", F.lit(k))), DIGITS).alias("recall_at_k"),
        F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), DIGITS).alias("mrr"),
        F.round(F.avg(F.col("gain") / F.col("ideal")), DIGITS).alias("ndcg"),
    )


def search_recall(exact: DataFrame, found: DataFrame, scored: DataFrame, queries: DataFrame, by: list[str], rows: int) -> DataFrame:
    """Per ``by``: queries, the share of exact hits that were found, and the share of pairs that were scored.

    Hits and scored pairs have ``query_id, id``; ``rows`` is the size of the corpus.
    """
    right = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    hits = right.groupBy("query_id").agg(F.count("*").alias("wanted"), F.count("hit").alias("hit"))
    pairs = scored.groupBy("query_id").agg(F.count("*").alias("scored"))
    both = queries.join(hits, "query_id", "left").join(pairs, "query_id", "left")
    return both.groupBy(*by).agg(
        F.count("*").alias("queries"),
        F.round(F.sum("hit") / F.sum("wanted"), DIGITS).alias("recall"),
        F.round(F.sum("scored") / (F.count("*") * rows), DIGITS).alias("scored_share"),
    )
