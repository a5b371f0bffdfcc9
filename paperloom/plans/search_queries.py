"""Vector search, re-ranking and answer assembly queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from paperloom.functions.hashing import query_key
from paperloom.operators import quality
from paperloom.operators import retrieval as ops
from paperloom.operators import vectors as vec
from paperloom.plans.catalog import query
from paperloom.plans.sql import ranked, with_parts
from paperloom.storage import materialize

K = 5
FETCH = 15
CONFIDENCE = 0.7
THRESHOLD = 0.1
TYPES = ["en", "de", "fr"]
NEAR = "SELECT query_id, id, score FROM row_scores"
TYPED = "SELECT c.* FROM cosines c JOIN meta m ON m.doc_id = c.id WHERE m.file_type IN ('en', 'de', 'fr')"
HITS = f"SELECT query_id, id, score FROM ({ranked('SELECT * FROM cosines', 2 * K)})"
HITS_WIDE = f"SELECT query_id, id, score FROM ({ranked('SELECT * FROM cosines', FETCH)})"
HITS_TYPED = f"SELECT query_id, id, score FROM ({ranked(TYPED, FETCH)})"
MIXED = "SELECT query_id, id, round(score * 0.7 + rerank_score * 0.3, 7) AS score FROM paired"
ANSWERED = f"SELECT * FROM ({ranked(MIXED, K)}) WHERE score >= {CONFIDENCE}"
CONTEXT = """SELECT a.query_id, string_agg(d.text, chr(10) || chr(10) ORDER BY rank) AS context,
                    string_agg(m.file_path, '|' ORDER BY rank) AS sources,
                    string_agg(printf('%.7f', a.score), '|' ORDER BY rank) AS confidence_scores
             FROM answered a JOIN documents d ON d.doc_id = a.id JOIN meta m ON m.doc_id = a.id GROUP BY 1"""


def row_hits(t, k):
    return vec.vector_search(t.vector_queries, t.vectors, k)


def typed_vectors(t):
    """Filter on metadata before ranking."""
    kept = ops.payload_filter(t.meta, document_types=TYPES).select(F.col("doc_id").alias("id"))
    return t.text_vectors.join(kept, "id", "left_semi")


def answered(t):
    return ops.ranked_answers(t.question_vectors, t.text_vectors, t.documents, CONFIDENCE)


def answers(t):
    """Answers from the documents of some types only."""
    return ops.rag_query(t.question_vectors, typed_vectors(t), t.documents, t.meta, CONFIDENCE)


def wide_answers(t):
    """Answers from all documents."""
    return ops.rag_query(t.question_vectors, t.text_vectors, t.documents, t.meta, CONFIDENCE)


@query("vector_search", with_parts(f"SELECT query_id, id, score, rank FROM ({ranked(NEAR, FETCH)})"))
def vector_search(t):
    return row_hits(t, FETCH)


@query("vector_search_ann")
def vector_search_ann(t):
    return vec.vector_search_ann(t.vector_queries, t.vectors, 10)


@query("ann_recall")
def ann_recall(t):
    """Per label, the share of the exact ten best that the approximate search finds, and of the pairs it scores."""
    graph = vec.neighbour_graph(t.vectors)
    seen = materialize(vec.beam_search(t.vector_queries, graph), "seen")
    found = vec.top_rows(seen, ["query_id"], [F.desc("score"), F.asc("id")], 10)
    return quality.search_recall(row_hits(t, 10), found, seen, t.vector_queries.select("query_id", "label"), ["label"], graph.nodes.count())


GAINS = "sum(CASE WHEN label = query_label THEN 1 / log2(rank + 1) ELSE 0 END)"


@query(
    "search_quality",
    with_parts(
        f"""SELECT query_label AS label, count(*) AS queries, round(avg(hits / 10.0), 6) AS precision_at_k, round(avg(hits / least(relevant, 10)), 6) AS recall_at_k,
                   round(avg(coalesce(1.0 / first, 0)), 6) AS mrr, round(avg(gain / ideal), 6) AS ndcg
            FROM (SELECT query_id, query_label, CAST(sum(CASE WHEN label = query_label THEN 1 ELSE 0 END) AS DOUBLE) AS hits,
                         min(CASE WHEN label = query_label THEN rank END) AS first, {GAINS} AS gain
                  FROM ({ranked('SELECT * FROM row_scores WHERE id <> query_id', 10)}) GROUP BY 1, 2)
            JOIN (SELECT label AS query_label, count(*) - 1 AS relevant, list_sum(list_transform(range(1, least(count(*) - 1, 10) + 1), lambda i: 1 / log2(i + 1))) AS ideal
                  FROM embeddings GROUP BY 1 HAVING count(*) > 1) USING (query_label) GROUP BY 1"""
    ),
)
def search_quality(t):
    """How well the ten nearest others of a vector have its label."""
    hits = row_hits(t, 11).where("id <> query_id").drop("rank")
    judged = t.vectors.select("id", "label")
    return quality.search_quality(ops.topk_per_query(hits, 10), t.vector_queries.select("query_id", "label"), judged, 10, skip_self=True)


@query("topk_per_query", with_parts(f"SELECT query_id, id, score, rank FROM ({ranked(NEAR, K)})"))
def topk_per_query(t):
    return ops.topk_per_query(row_hits(t, FETCH), K)


@query(
    "topk_global",
    with_parts(f"SELECT query_id, id, score FROM ({ranked(NEAR, 100)}) ORDER BY score DESC, id LIMIT 100"),
)
def topk_global(t):
    return ops.topk_global(row_hits(t, 100).drop("rank"), 100)


@query("confidence_filter", with_parts(f"SELECT query_id, id, score, rank FROM ({ranked(NEAR, FETCH)}) WHERE score >= 0.4"))
def confidence_filter(t):
    return ops.confidence_filter(row_hits(t, FETCH), 0.4)


@query(
    "payload_filter",
    with_parts(
        """SELECT doc_id, department, file_type, creation_date FROM meta
           WHERE access_level = 'internal' AND creation_date BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-02-05'
             AND department IN ('src1', 'src3', 'src5', 'src7') AND file_type IN ('en', 'de', 'fr')"""
    ),
)
def payload_filter(t):
    return ops.payload_filter(
        t.meta,
        {"access_level": "internal"},
        (datetime(2024, 1, 2), datetime(2024, 2, 5)),
        ["src1", "src3", "src5", "src7"],
        TYPES,
    ).select("doc_id", "department", "file_type", "creation_date")


@query(
    "multi_collection_search",
    with_parts(
        f"SELECT query_id, id, score, rank, collection FROM ({ranked('SELECT * FROM both_scores', K)})",
        both_scores="""SELECT q.vec_id AS query_id, q.collection, e.vec_id AS id,
            round(CASE WHEN q.collection = 'code' THEN list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))
                       ELSE list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) END, 6) AS score
            FROM (SELECT *, CASE WHEN label % 2 = 1 THEN 'code' ELSE 'default' END AS collection FROM embeddings WHERE vec_id % 20 = 0) q
            JOIN embeddings e ON (CASE WHEN e.label % 2 = 1 THEN 'code' ELSE 'default' END) = q.collection""",
    ),
)
def multi_collection_search(t):
    return vec.search_collections(t.vector_queries, t.vectors, {"default": "cosine", "code": "dot"}, K)


@query("embed_hashing", with_parts(
    """SELECT c.id AS doc_id, CAST(c.b AS INTEGER) AS dim, round(w / sqrt(n), 6) AS value
       FROM doc_cells c JOIN (SELECT id, CAST(sum(w * w) AS DOUBLE) AS n FROM doc_cells GROUP BY 1) s ON s.id = c.id WHERE w <> 0"""
))
def embed_hashing(t):
    rows = vec.embed_hashing(t.documents, "doc_id", "text").select("doc_id", F.posexplode("embedding").alias("dim", "value"))
    return rows.where("value <> 0").withColumn("value", F.round("value", 6))


def question_hits(t, k):
    return materialize(vec.vector_search(t.question_vectors, t.text_vectors, k).drop("rank"), "hits")


@query("rerank_lexical", with_parts("SELECT query_id, id, rerank_score FROM paired", hits=HITS))
def rerank_lexical(t):
    return ops.rerank_lexical(question_hits(t, 2 * K), t.questions, t.documents)


@query("pair_scores", with_parts("SELECT query_id, id, score, rerank_score FROM paired", hits=HITS))
def pair_scores(t):
    hits = question_hits(t, 2 * K)
    return ops.pair_scores(hits, ops.rerank_lexical(hits, t.questions, t.documents))


@query(
    "rerank_threshold",
    with_parts(f"SELECT query_id, id, score, rerank_score FROM paired WHERE rerank_score > {THRESHOLD}", hits=HITS),
)
def rerank_threshold(t):
    return ops.rerank_threshold(pair_scores(t), THRESHOLD)


@query(
    "score_combine",
    with_parts(
        f"SELECT query_id, id, rerank_score, round(score * 0.7 + rerank_score * 0.3, 7) AS score FROM paired WHERE rerank_score > {THRESHOLD}",
        hits=HITS,
    ),
)
def score_combine(t):
    return ops.score_combine(pair_scores(t), THRESHOLD)


@query(
    "hybrid_search",
    with_parts(
        f"""SELECT r.query_id, r.id, r.score, r.rank, d.text AS content
            FROM ({ranked(MIXED + f' WHERE rerank_score > {THRESHOLD}', K)}) r JOIN documents d ON d.doc_id = r.id""",
        hits=HITS,
    ),
)
def hybrid_search(t):
    return ops.hybrid_search(t.question_vectors, t.text_vectors, t.documents, K, THRESHOLD)


@query(
    "hybrid_search_metadata",
    with_parts(
        f"""SELECT r.query_id, r.id, r.score, r.rank, d.text AS content, m.file_path, m.department
            FROM ({ranked(MIXED + f' WHERE rerank_score > {THRESHOLD}', K)}) r JOIN documents d ON d.doc_id = r.id JOIN meta m ON m.doc_id = r.id""",
        hits=HITS,
    ),
)
def hybrid_search_metadata(t):
    """Hits carry metadata of their documents."""
    found = ops.hybrid_search(t.question_vectors, t.text_vectors, t.documents, K, THRESHOLD, meta=t.meta.select("doc_id", "file_path", "department"))
    return found.select("query_id", "id", "score", "rank", "content", "metadata.*")


@query(
    "answer_pipeline",
    with_parts(
        """SELECT q.query_id, CASE WHEN r.reply IS NULL THEN 'search' ELSE 'cache' END AS origin, coalesce(r.reply, c.context, '') AS answer
           FROM questions q LEFT JOIN replies r ON r.key = 'query_' || md5(q.query_text) LEFT JOIN contexts c ON c.query_id = q.query_id
           WHERE r.reply IS NOT NULL OR q.query_id IN (SELECT query_id FROM question_cells)""",
        hits=HITS_WIDE,
        answered=ANSWERED,
        contexts=CONTEXT,
        replies="""SELECT 'query_' || md5(u.text) AS key, min(a.text) AS reply FROM conversations u
                   JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
                   WHERE u.role = 'user' AND u.conv_id % 2 = 0 GROUP BY 1""",
    ),
)
def answer_pipeline(t):
    """Replies in every second conversation are the cache; all other questions are searched."""
    turns = t.read("conversations")
    asked = turns.where("role = 'user' and conv_id % 2 = 0").select("conv_id", (F.col("turn") + 1).alias("turn"), query_key(F.col("text")).alias("key"))
    replies = turns.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("value"))
    cache = asked.join(replies, ["conv_id", "turn"]).groupBy("key").agg(F.min("value").alias("value"))
    return ops.answer_pipeline(t.questions, t.question_vectors, cache, t.text_vectors, t.documents, t.meta, CONFIDENCE)


@query(
    "lookup_text",
    with_parts(f"SELECT r.query_id, r.id, r.score, r.rank, d.text FROM ({ranked('SELECT * FROM cosines', K)}) r JOIN documents d ON d.doc_id = r.id"),
)
def lookup_text(t):
    return ops.lookup_text(ops.topk_per_query(question_hits(t, K), K), t.documents)


@query(
    "results_metadata",
    with_parts(
        f"""SELECT r.query_id, r.id, r.score, r.rank, m.file_path, m.file_type, m.access_level
            FROM ({ranked('SELECT * FROM cosines', K)}) r JOIN meta m ON m.doc_id = r.id"""
    ),
)
def results_metadata(t):
    top = ops.topk_per_query(question_hits(t, K), K)
    return ops.results_metadata(top, t.meta, ["file_path", "file_type", "access_level"])


@query(
    "rag_query",
    with_parts(
        """SELECT q.query_id, q.query_text, coalesce(c.context, '') AS context, coalesce(c.sources, '') AS sources,
                  coalesce(c.confidence_scores, '') AS confidence_scores
           FROM questions q LEFT JOIN contexts c ON c.query_id = q.query_id
           WHERE q.query_id IN (SELECT query_id FROM question_cells)""",
        hits=HITS_TYPED,
        answered=ANSWERED,
        contexts=CONTEXT,
    ),
)
def rag_query(t):
    scores = F.transform("confidence_scores", lambda s: F.format_string("%.7f", s))
    return answers(t).select(
        "query_id",
        "query_text",
        "context",
        F.array_join("sources", "|").alias("sources"),
        F.array_join(scores, "|").alias("confidence_scores"),
    )


@query(
    "build_context",
    with_parts("SELECT query_id, context FROM contexts", hits=HITS_WIDE, answered=ANSWERED, contexts=CONTEXT),
)
def build_context(t):
    return ops.build_context(answered(t), t.documents)


@query(
    "prompt_assembly",
    with_parts(
        """SELECT q.query_id, 'Context: ' || coalesce(c.context, '') || chr(10) || 'Query: ' || q.query_text AS prompt
           FROM questions q LEFT JOIN contexts c ON c.query_id = q.query_id
           WHERE q.query_id IN (SELECT query_id FROM question_cells)""",
        hits=HITS_WIDE,
        answered=ANSWERED,
        contexts=CONTEXT,
    ),
)
def prompt_assembly(t):
    return ops.prompt_assembly(wide_answers(t))


@query(
    "facet_results",
    with_parts(
        """SELECT a.query_id, m.department, count(*) AS hits, max(a.score) AS max_score, round(avg(a.score), 9) AS avg_score
           FROM answered a JOIN meta m ON m.doc_id = a.id GROUP BY 1, 2""",
        hits=HITS_WIDE,
        answered=ANSWERED,
    ),
)
def facet_results(t):
    return ops.facet_results(answered(t), t.meta, "department")


@query(
    "export_results_csv",
    with_parts(
        """SELECT m.file_path AS "Source", a.score AS "Confidence" FROM answered a JOIN meta m ON m.doc_id = a.id""",
        hits=HITS_WIDE,
        answered=ANSWERED,
    ),
)
def export_results_csv(t):
    from paperloom.sources.sinks import export_results_csv as export
    from paperloom.storage import scratch_path

    path = scratch_path(t.spark, "results")
    export(ops.result_rows(wide_answers(t)), path)
    return t.spark.read.csv(path, header=True, schema="Source string, Confidence double")
