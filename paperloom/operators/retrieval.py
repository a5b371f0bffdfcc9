"""From questions to ready-to-use context: filter, retrieve, re-rank, cut, assemble."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.config import SearchConfig
from paperloom.functions.hashing import query_key
from paperloom.functions.text import tokens
from paperloom.operators.enrich import postings, term_lists
from paperloom.operators.skew import row_lookup, top_rows
from paperloom.operators.vectors import SCORE_DIGITS, vector_search
from paperloom.storage import materialize, text_batches

# Both scores have six digits, so their weighted sum has at most seven and is kept exact.
COMBINED_DIGITS = 7
MEAN_DIGITS = 9
BM25_K1 = 1.2
BM25_B = 0.75


def payload_filter(
    docs: DataFrame,
    filters: dict | None = None,
    date_range: tuple[datetime, datetime] | None = None,
    departments: list[str] | None = None,
    document_types: list[str] | None = None,
) -> DataFrame:
    """AND of the given parts; an empty part is no constraint. Applied before ranking."""
    for name, value in (filters or {}).items():
        docs = docs.where(F.col(name) == F.lit(value))
    if date_range:
        docs = docs.where(F.col("creation_date").between(*(F.lit(d).cast("timestamp_ntz") for d in date_range)))
    if departments:
        docs = docs.where(F.col("department").isin(*departments))
    if document_types:
        docs = docs.where(F.col("file_type").isin(*document_types))
    return docs


def topk_per_query(hits: DataFrame, k: int, score: str = "score") -> DataFrame:
    return top_rows(hits.drop("rank"), ["query_id"], [F.desc(score), F.asc("id")], k)


def topk_global(hits: DataFrame, k: int) -> DataFrame:
    """Best k of one list; plans as a per-task top-k and one merge of k rows each."""
    return hits.orderBy(F.desc("score"), F.asc("id")).limit(k)


def confidence_filter(top: DataFrame, min_confidence: float = 0.7) -> DataFrame:
    """Applied after the top-k cut, so fewer than k rows may stay."""
    return top.where(F.col("score") >= min_confidence)


def pair_scores(hits: DataFrame, reranked: DataFrame) -> DataFrame:
    """Hits with their re-rank score, matched on keys and never by position."""
    return hits.join(reranked.select("query_id", "id", "rerank_score"), ["query_id", "id"])


def rerank_threshold(paired: DataFrame, threshold: float = 0.7) -> DataFrame:
    return paired.where(F.col("rerank_score") > threshold)


def combined_score(config: SearchConfig = SearchConfig()) -> Column:
    return F.round(
        F.col("score") * config.vector_weight + F.col("rerank_score") * config.rerank_weight,
        COMBINED_DIGITS,
    )


def score_combine(paired: DataFrame, threshold: float, config: SearchConfig = SearchConfig()) -> DataFrame:
    """Strict re-rank threshold, then the weighted sum of both scores."""
    return rerank_threshold(paired, threshold).withColumn("score", combined_score(config))


def rerank_lexical(hits: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """BM25 of every hit over the distinct query terms, scaled to [0, 1] per query.

    ``docs(doc_id, text)`` is the whole collection: document count, mean length and term
    document frequencies come from all of it. It is split into words once, and only counts per
    term and the words of hits are exchanged.
    """
    query_terms = queries.select(
        "query_id", F.explode(F.array_distinct(tokens(F.col("query_text")))).alias("term")
    )
    asked = materialize(query_terms.groupBy("term").agg(F.count("*").alias("asked")), "asked")
    with text_batches(docs.sparkSession):
        lists = materialize(term_lists(docs), "terms")
    lengths = lists.agg(F.count("*").alias("n"), F.coalesce(F.avg("len"), F.lit(1.0)).alias("avg_len")).head()
    n, avg_len = F.lit(lengths["n"]), F.lit(lengths["avg_len"])
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    uses = postings(lists).groupBy("term").agg(F.count("*").alias("df"))
    weights = uses.join(asked.select("term"), "term").select("term", idf.alias("idf"))
    query_weights = row_lookup(query_terms, materialize(weights, "weights"), "term", F.col("query_id"), "inner")
    norm = BM25_K1 * (1 - BM25_B + BM25_B * F.col("len") / avg_len)
    # Terms are listed only of documents that are hits; hits number at most k per query.
    found = materialize(lists.join(hits.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi"), "hit-terms")
    counts = postings(found).join(asked.select("term"), "term", "left_semi")
    matched = (
        hits.select("query_id", F.col("id").alias("doc_id"))
        .join(query_weights, "query_id")
        .join(counts, ["doc_id", "term"])
        .withColumn("part", F.col("idf") * F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + norm))
        .groupBy("query_id", F.col("doc_id").alias("id"))
        .agg(F.sum("part").alias("bm25"))
    )
    # A query has at most k hits, so this window is small.
    best = F.max("bm25").over(Window.partitionBy("query_id"))
    scaled = matched.select("query_id", "id", F.round(F.col("bm25") / best, SCORE_DIGITS).alias("_r"))
    return (
        hits.select("query_id", "id")
        .join(scaled, ["query_id", "id"], "left")
        .select("query_id", "id", F.coalesce("_r", F.lit(0.0)).alias("rerank_score"))
    )


def _for_hits(top: DataFrame, rows: DataFrame) -> DataFrame:
    """Join per-document ``rows`` to hits, of which one document may hold very many."""
    wanted = top.select(F.col("id").alias("doc_id")).distinct()
    found = rows.join(wanted, "doc_id", "left_semi").withColumnRenamed("doc_id", "id")
    return row_lookup(top, found, "id", F.col("query_id"))


def lookup_text(top: DataFrame, docs: DataFrame) -> DataFrame:
    """Texts of the surviving hits; joined after the cut so that only those texts move."""
    return _for_hits(top, docs.select("doc_id", "text"))


def results_metadata(top: DataFrame, meta: DataFrame, columns: list[str]) -> DataFrame:
    """Document metadata of the hits."""
    return _for_hits(top, meta.select("doc_id", *columns))


def hybrid_search(
    queries: DataFrame,
    corpus: DataFrame,
    docs: DataFrame,
    top_k: int = 5,
    threshold: float = 0.7,
    rerank: bool = True,
    config: SearchConfig = SearchConfig(),
    metric: str = "cosine",
    meta: DataFrame | None = None,
    scorer: Callable[[DataFrame, DataFrame, DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Retrieve 2k by vector, re-rank by text, combine both scores, keep k with content.

    ``metric`` is the collection's own, ``scorer`` another re-ranker with the arguments and
    result columns of ``rerank_lexical``, ``meta(doc_id, ...)`` adds a struct ``metadata``.
    """
    hits = materialize(vector_search(queries, corpus, top_k * 2, metric).drop("rank"))
    if rerank:
        paired = pair_scores(hits, (scorer or rerank_lexical)(hits, queries, docs))
        top = materialize(topk_per_query(score_combine(paired, threshold, config), top_k).drop("rerank_score"))
    else:
        top = topk_per_query(hits, top_k)
    found = lookup_text(top, docs).withColumnRenamed("text", "content")
    if meta is None:
        return found
    columns = [c for c in meta.columns if c != "doc_id"]
    return _for_hits(found, meta.select("doc_id", F.struct(*columns).alias("metadata")))


def ranked_answers(
    queries: DataFrame,
    corpus: DataFrame,
    docs: DataFrame,
    min_confidence: float = 0.7,
    config: SearchConfig = SearchConfig(),
) -> DataFrame:
    """Over-fetch, re-rank by the combined score, cut to k, then drop low confidence."""
    fetched = config.initial_results_multiplier * config.top_k
    hits = materialize(vector_search(queries, corpus, fetched).drop("rank"))
    paired = pair_scores(hits, rerank_lexical(hits, queries, docs))
    top = topk_per_query(paired.withColumn("score", combined_score(config)), config.top_k)
    return materialize(confidence_filter(top, min_confidence).drop("rerank_score"))


def build_context(top: DataFrame, docs: DataFrame) -> DataFrame:
    """Whole texts of a query's hits in rank order, parted by a blank line. At most k each."""
    rows = lookup_text(top, docs).groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("_h")
    )
    return rows.select("query_id", F.array_join(F.col("_h.text"), "\n\n").alias("context"))


def rag_query(
    queries: DataFrame,
    corpus: DataFrame,
    docs: DataFrame,
    meta: DataFrame,
    min_confidence: float = 0.7,
    config: SearchConfig = SearchConfig(),
) -> DataFrame:
    """One row per question: context, source paths and confidences in rank order."""
    top = ranked_answers(queries, corpus, docs, min_confidence, config)
    described = meta.select("doc_id", "file_path").join(docs.select("doc_id", "text"), "doc_id")
    sourced = _for_hits(top, described)
    answers = sourced.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "file_path", "score", "text"))).alias("_h")
    )
    none = F.array().cast("array<string>")
    return queries.select("query_id", "query_text").join(answers, "query_id", "left").select(
        "query_id",
        "query_text",
        F.coalesce(F.array_join(F.col("_h.text"), "\n\n"), F.lit("")).alias("context"),
        F.coalesce(F.col("_h.file_path"), none).alias("sources"),
        F.coalesce(F.col("_h.score"), F.array().cast("array<double>")).alias("confidence_scores"),
    )


def answer_pipeline(
    questions: DataFrame,
    queries: DataFrame,
    cache: DataFrame,
    corpus: DataFrame,
    docs: DataFrame,
    meta: DataFrame,
    min_confidence: float = 0.7,
    config: SearchConfig = SearchConfig(),
) -> DataFrame:
    """``query_id, origin, answer``: from ``cache(key, value)`` if it has the question, else searched.

    Only questions that miss the cache reach the search. ``queries`` are the questions with
    vectors; one that has none and is not cached has no answer.
    """
    keyed = questions.select("query_id", query_key(F.col("query_text")).alias("key"))
    split = materialize(row_lookup(keyed, cache.select("key", "value"), "key", F.col("query_id")), "split")
    cached = split.where("value is not null").select("query_id", F.lit("cache").alias("origin"), F.col("value").alias("answer"))
    missed = queries.join(split.where("value is null").select("query_id"), "query_id", "left_semi")
    searched = rag_query(missed, corpus, docs, meta, min_confidence, config)
    return cached.unionByName(searched.select("query_id", F.lit("search").alias("origin"), F.col("context").alias("answer")))


def prompt_assembly(answers: DataFrame) -> DataFrame:
    """One prompt per question, ready for an offline model job."""
    return answers.select(
        "query_id",
        F.concat(F.lit("Context: "), F.col("context"), F.lit("\nQuery: "), F.col("query_text")).alias("prompt"),
    )


def facet_results(top: DataFrame, meta: DataFrame, field: str) -> DataFrame:
    """Per query and value of ``field``: hit count, best and mean score."""
    return (
        results_metadata(top, meta, [field])
        .groupBy("query_id", field)
        .agg(
            F.count("*").alias("hits"),
            F.max("score").alias("max_score"),
            F.round(F.avg("score"), MEAN_DIGITS).alias("avg_score"),
        )
    )


def result_rows(answers: DataFrame) -> DataFrame:
    """``(query_id, Source, Confidence)`` rows of the answers, for export."""
    return answers.select(
        "query_id", F.posexplode(F.arrays_zip("sources", "confidence_scores")).alias("rank", "_z")
    ).select(
        "query_id",
        (F.col("rank") + 1).alias("rank"),
        F.col("_z.sources").alias("Source"),
        F.col("_z.confidence_scores").alias("Confidence"),
    )
