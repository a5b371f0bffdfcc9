"""Shared parts of the reference SQL (DuckDB dialect) for the bound records."""

from __future__ import annotations

import re

from paperloom.functions import text as tx

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


def words(column: str) -> str:
    return f"list_filter(string_split_regex(lower({column}), '{tx.NOT_WORD}'), lambda t: t <> '')"


def count_of(column: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({column}, '{pattern}')) AS BIGINT)"


def replaced(column: str, pattern: str, by: str) -> str:
    return f"regexp_replace({column}, '{pattern}', '{by}', 'g')"


def entities_decoded(column: str) -> str:
    for entity, char in tx.ENTITIES:
        column = "replace({}, '{}', '{}')".format(column, entity, char.replace("'", "''"))
    return column


def spaces_collapsed(column: str) -> str:
    return f"trim({replaced(column, '[ \\t\\r\\n]+', ' ')})"


def html_text(column: str) -> str:
    for block in tx.MARKUP_BLOCKS:
        column = replaced(column, block, " ")
    return spaces_collapsed(entities_decoded(column))


def inner_text(column: str) -> str:
    return spaces_collapsed(entities_decoded(replaced(column, tx.MARKUP_BLOCKS[-1], "")))


def pii_steps(column: str) -> dict[str, str]:
    """Text as each pattern sees it: earlier kinds are already replaced."""
    steps = {}
    for kind, pattern in tx.PII_PATTERNS.items():
        steps[kind] = column
        column = replaced(column, pattern, f"<{kind}>")
    steps["DONE"] = column
    return steps


PII = pii_steps("text")
PII_COUNTS = ", ".join(f"{count_of(PII[k], p)} AS {k.lower()}_count" for k, p in tx.PII_PATTERNS.items())
HAS_PII = " OR ".join(f"{k.lower()}_count > 0" for k in tx.PII_PATTERNS)

PARTS = {
    "meta": f"""
        SELECT d.doc_id, sha256(d.text) AS document_id,
               d.source || '/' || d.doc_id || '.' || d.lang AS file_path,
               d.lang AS file_type, d.source AS department, d.lang AS language,
               TIMESTAMP '2024-01-01' + to_hours(d.doc_id) AS creation_date,
               md5(d.text) AS checksum, octet_length(encode(d.text)) AS size_bytes,
               CASE WHEN d.doc_id % 2 = 1 THEN 'internal' ELSE 'public' END AS access_level,
               (d.doc_id % 4) * 10 AS retention_period, d.lang <> 'es' AS encrypted,
               CASE WHEN l.doc_id IS NOT NULL THEN 'curator' ELSE '' END AS author,
               CASE WHEN l.toxic = 1 THEN 'restricted' WHEN l.quality = 1 THEN 'approved' ELSE '' END AS classification
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "audit": """
        SELECT event_id, ts AS "timestamp", user_id, event_type AS action, event_type AS provider,
               CAST(props->>'$.k' AS BIGINT) AS document_id,
               CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status, value AS latency_ms,
               'query_' || md5(user_id || '_' || (props->>'$.k')) AS key
        FROM events""",
    "cache": """
        SELECT key, CAST(sum(CAST(round(latency_ms * 100) AS BIGINT) * CAST(round(latency_ms * 100) AS BIGINT)) AS BIGINT) // 1000 AS size_bytes,
               count(*) - 1 AS access_count, max("timestamp") AS last_accessed,
               max("timestamp") + INTERVAL 1 DAY AS expires_at, min("timestamp") AS created_at
        FROM audit GROUP BY key""",
    "pii": f"SELECT *, {HAS_PII} AS has_pii FROM (SELECT doc_id, {PII_COUNTS} FROM documents)",
    "checked": f"""
        SELECT m.doc_id,
               retention_period = 0 OR creation_date + to_days(CAST(retention_period AS INTEGER)) >= {AS_OF} AS retention_policy,
               classification IN ('approved', 'restricted') AS classification_ok,
               access_level IN ('public', 'internal') AND NOT (access_level = 'public' AND has_pii) AS access_controls,
               encrypted AS encryption, NOT has_pii AS sensitive_data
        FROM meta m JOIN pii USING (doc_id)""",
    "questions": """
        SELECT conv_id || ':' || turn AS query_id, text AS query_text FROM conversations WHERE role = 'user'""",
    "doc_cells": f"""
        SELECT doc_id AS id, b, sum(s) AS w FROM (
          SELECT doc_id, ('0x' || substr(h, 1, 4))::BIGINT % 64 AS b,
                 CASE WHEN ('0x' || substr(h, 1, 4))::BIGINT // 64 % 2 = 1 THEN -1 ELSE 1 END AS s
          FROM (SELECT doc_id, md5(unnest({words('text')})) AS h FROM documents)) GROUP BY ALL""",
    "question_cells": f"""
        SELECT query_id, b, sum(s) AS w FROM (
          SELECT query_id, ('0x' || substr(h, 1, 4))::BIGINT % 64 AS b,
                 CASE WHEN ('0x' || substr(h, 1, 4))::BIGINT // 64 % 2 = 1 THEN -1 ELSE 1 END AS s
          FROM (SELECT query_id, md5(unnest({words('query_text')})) AS h FROM questions)) GROUP BY ALL""",
    "cosines": """
        SELECT q.query_id, d.id,
               round(CASE WHEN q.n > 0 AND d.n > 0 THEN coalesce(p.dot, 0) / sqrt(q.n * d.n) ELSE 0 END, 6) AS score
        FROM (SELECT query_id, CAST(sum(w * w) AS DOUBLE) AS n FROM question_cells GROUP BY 1) q
        CROSS JOIN (SELECT id, CAST(sum(w * w) AS DOUBLE) AS n FROM doc_cells GROUP BY 1) d
        LEFT JOIN (SELECT query_id, id, CAST(sum(a.w * b.w) AS DOUBLE) AS dot
                   FROM question_cells a JOIN doc_cells b ON a.b = b.b GROUP BY 1, 2) p
          ON p.query_id = q.query_id AND p.id = d.id""",
    "doc_terms": f"""
        SELECT doc_id, len, term, count(*) AS tf FROM (
          SELECT doc_id, len(w) AS len, unnest(w) AS term FROM (SELECT doc_id, {words('text')} AS w FROM documents))
        GROUP BY ALL""",
    "term_df": "SELECT term, count(*) AS df FROM doc_terms GROUP BY 1",
    "doc_stats": f"SELECT count(*) AS n, avg(len({words('text')})) AS avg_len FROM documents",
    "question_terms": f"""
        SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest({words('query_text')}) AS term FROM questions)""",
    "bm25": """
        SELECT h.query_id, h.id,
               sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) AS bm25
        FROM hits h JOIN question_terms q ON q.query_id = h.query_id
        JOIN doc_terms t ON t.doc_id = h.id AND t.term = q.term
        JOIN term_df f ON f.term = q.term CROSS JOIN doc_stats
        GROUP BY 1, 2""",
    "paired": """
        SELECT h.query_id, h.id, h.score,
               coalesce(round(bm25 / max(bm25) OVER (PARTITION BY h.query_id), 6), 0) AS rerank_score
        FROM hits h LEFT JOIN bm25 b ON b.query_id = h.query_id AND b.id = h.id""",
    "row_scores": """
        SELECT q.vec_id AS query_id, e.vec_id AS id, q.label AS query_label, e.label,
               round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score
        FROM embeddings q CROSS JOIN embeddings e WHERE q.vec_id % 20 = 0""",
}


def ranked(source: str, k: int, name: str = "rank") -> str:
    """Rows of ``source`` with an integer rank up to ``k`` per query."""
    return f"""
        SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS {name}
                       FROM ({source})) WHERE {name} <= {k}"""


def with_parts(body: str, **own: str) -> str:
    """``body`` preceded by every part it mentions, and what those are built on."""
    parts = {**PARTS, **own}
    done: dict[str, str] = {}

    def add(text: str, name: str | None = None) -> None:
        for word in re.findall(r"\b[a-z_0-9]+\b", text):
            if word in parts and word != name and word not in done:
                add(parts[word], word)
                done[word] = parts[word]

    add(body)
    if not done:
        return body
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({q})" for n, q in done.items()) + "\n" + body
