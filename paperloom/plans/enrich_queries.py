"""Text enrichment and duplicate queries."""

from __future__ import annotations

from paperloom.functions import text as tx
from paperloom.operators import duplicates as dup
from paperloom.operators import enrich as ops
from paperloom.plans.catalog import SQL, query
from paperloom.plans.sql import PII, count_of, html_text, inner_text, with_parts, words

SENTENCE_TERMS = f"""SELECT doc_id, o - 1 AS position, trim(s) AS sentence, unnest({words('s')}) AS term
                     FROM documents, unnest(string_split_regex(text, '{tx.SENTENCE_END}')) WITH ORDINALITY u(s, o)"""
ENTITY_SQL = " UNION ALL ".join(
    f"SELECT doc_id, unnest(regexp_extract_all({PII.get(label, PII['DONE'])}, '{pattern}')) AS text, '{label}' AS label FROM documents"
    for label, pattern in ops.ENTITY_PATTERNS.items()
)
GRAMS = f"""SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g
            FROM (SELECT doc_id, {words('text')} AS w FROM documents) WHERE len(w) >= 3"""
NEAR = """SELECT doc_id, min(other) AS duplicate_of, arg_min(round(jaccard, 6), other) AS jaccard FROM (
            SELECT p.doc_id, p.other, p.c / (a.n + b.n - p.c) AS jaccard
            FROM (SELECT x.doc_id, y.doc_id AS other, count(*) AS c FROM grams x JOIN grams y ON x.g = y.g AND y.doc_id < x.doc_id GROUP BY 1, 2) p
            JOIN gram_sizes a ON a.doc_id = p.doc_id JOIN gram_sizes b ON b.doc_id = p.other)
          WHERE jaccard >= 0.8 GROUP BY 1"""
SIZES = "SELECT doc_id, count(*) AS n FROM grams GROUP BY 1"


@query("html_to_text", f"SELECT page_id, url, {html_text('html')} AS text FROM pages")
def html_to_text(t):
    return ops.html_to_text(t.pages)


@query(
    "html_title_headings",
    f"""SELECT page_id, o - 1 AS position, CAST(h.level AS INTEGER) AS level, {inner_text('h.body')} AS heading
        FROM (SELECT page_id, list_concat(
                list_transform(regexp_extract_all(html, '{tx.TITLE}', 1), lambda b: {{'level': '0', 'body': b}}),
                list_transform(list_zip(regexp_extract_all(html, '{tx.HEADING}', 1), regexp_extract_all(html, '{tx.HEADING}', 2)),
                               lambda z: {{'level': z[1], 'body': z[2]}})) AS hs FROM pages),
             unnest(hs) WITH ORDINALITY u(h, o)""",
)
def html_title_headings(t):
    return ops.html_title_headings(t.pages)


@query(
    "html_links",
    f"""SELECT page_id, o - 1 AS position, link FROM pages, unnest(regexp_extract_all(html, '{tx.HREF}', 1)) WITH ORDINALITY u(link, o)""",
)
def html_links(t):
    return ops.html_links(t.pages)


@query(
    "html_lists",
    f"""SELECT page_id, o - 1 AS position, {inner_text('i')} AS item
        FROM pages, unnest(regexp_extract_all(html, '{tx.LIST_ITEM}', 1)) WITH ORDINALITY u(i, o)""",
)
def html_lists(t):
    return ops.html_lists(t.pages)


@query(
    "extract_citations",
    f"""SELECT doc_id, {count_of('text', tx.CITE_NUMBER)} AS numbered, {count_of('text', tx.CITE_AUTHOR)} AS author_year,
               {count_of('text', tx.CITE_DOI)} AS doi FROM documents""",
)
def extract_citations(t):
    return ops.extract_citations(t.documents)


@query("extract_entities", ENTITY_SQL)
def extract_entities(t):
    return ops.extract_entities(t.documents)


@query(
    "key_phrases",
    with_parts(
        """SELECT doc_id, term, score, rank FROM (
             SELECT doc_id, term, score, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS INTEGER) AS rank FROM (
               SELECT doc_id, d.term, round(tf * ln((SELECT count(*) FROM documents) / df), 6) AS score
               FROM doc_terms d JOIN term_df f ON f.term = d.term))
           WHERE rank <= 5"""
    ),
)
def key_phrases(t):
    return ops.key_phrases(t.documents)


@query(
    "summarize_extractive",
    with_parts(
        """SELECT d.doc_id, x.summary FROM documents d LEFT JOIN (
           SELECT doc_id, string_agg(sentence, '. ' ORDER BY position) AS summary FROM (
             SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, position) AS r FROM (
               SELECT s.doc_id, s.position, s.sentence, round(sum(tf) / count(*), 6) AS score
               FROM sentence_terms s JOIN doc_terms d ON d.doc_id = s.doc_id AND d.term = s.term GROUP BY 1, 2, 3))
           WHERE r <= 3 GROUP BY 1) x ON x.doc_id = d.doc_id""",
        sentence_terms=SENTENCE_TERMS,
    ),
)
def summarize_extractive(t):
    return ops.summarize_extractive(t.documents)


@query(
    "detect_language",
    with_parts(
        """SELECT d.doc_id, x.language FROM documents d LEFT JOIN (
           SELECT doc_id, arg_min(lang, (cost, lang)) AS language FROM (
             SELECT g.doc_id, l.lang, -round(sum(g.tf * ln(coalesce(m.c, 0) + 1)) - sum(g.tf) * any_value(ln(l.total + v.n)), 6) AS cost
             FROM doc_grams g CROSS JOIN lang_totals l CROSS JOIN (SELECT count(DISTINCT gram) AS n FROM lang_grams) v
             LEFT JOIN lang_grams m ON m.lang = l.lang AND m.gram = g.gram GROUP BY 1, 2)
           GROUP BY 1) x ON x.doc_id = d.doc_id""",
        word_use=f"SELECT doc_id, lang, w, count(*) AS n FROM (SELECT doc_id, lang, unnest({words('text')}) AS w FROM documents) GROUP BY ALL",
        doc_grams="""SELECT doc_id, lang, gram, sum(n) AS tf FROM (
            SELECT doc_id, lang, n, unnest(list_transform(range(1, length(w) + 1), lambda i: substr(' ' || w || ' ', i, 3))) AS gram FROM word_use)
            GROUP BY ALL""",
        lang_grams="SELECT lang, gram, sum(tf) AS c FROM doc_grams GROUP BY ALL",
        lang_totals="SELECT lang, sum(c) AS total FROM lang_grams GROUP BY 1",
    ),
)
def detect_language(t):
    counts, totals = ops.language_model(t.documents.select("text", "lang"))
    return ops.detect_language(t.documents, counts, totals)


@query(
    "enhance_documents",
    with_parts(
        f"""SELECT d.doc_id, c.numbered, c.author_year, c.doi, coalesce(e.entities, 0) AS entities, x.copies
            FROM documents d
            JOIN (SELECT doc_id, {count_of('text', tx.CITE_NUMBER)} AS numbered, {count_of('text', tx.CITE_AUTHOR)} AS author_year,
                         {count_of('text', tx.CITE_DOI)} AS doi FROM documents) c USING (doc_id)
            LEFT JOIN (SELECT doc_id, count(*) AS entities FROM ({ENTITY_SQL}) GROUP BY 1) e USING (doc_id)
            JOIN (SELECT md5(text) AS checksum, count(*) AS copies FROM documents GROUP BY 1) x ON x.checksum = md5(d.text)"""
    ),
)
def enhance_documents(t):
    return ops.enhance(t.documents, {"citations", "entities", "copies"})


@query(
    "enhance_all",
    f"""SELECT e.*, l.language, s.summary, n.duplicate_of FROM ({SQL['enhance_documents']}) e
        LEFT JOIN ({SQL['detect_language']}) l USING (doc_id) LEFT JOIN ({SQL['summarize_extractive']}) s USING (doc_id)
        LEFT JOIN ({with_parts("SELECT * FROM near_pairs", near_pairs=NEAR, grams=GRAMS, gram_sizes=SIZES)}) n USING (doc_id)""",
)
def enhance_all(t):
    """Every enrichment in one row a document."""
    return ops.enhance(t.documents, set(ops.SWITCHES))


LINE_MENTIONS = " UNION ALL ".join(
    f"SELECT doc_id, line, unnest(regexp_extract_all({PII.get(label, PII['DONE'])}, '{pattern}')) AS entity FROM lines"
    for label, pattern in ops.ENTITY_PATTERNS.items()
)


@query(
    "entity_relations",
    f"""WITH lines AS MATERIALIZED (SELECT doc_id, o AS line, text FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), unnest(parts) WITH ORDINALITY u(text, o)),
        seen AS MATERIALIZED (SELECT DISTINCT * FROM ({LINE_MENTIONS})),
        uses AS (SELECT entity, count(*) AS n FROM seen GROUP BY 1),
        total AS (SELECT count(*) AS n FROM (SELECT DISTINCT doc_id, line FROM seen))
        SELECT first, second, p.lines, round(ln(p.lines * CAST((SELECT n FROM total) AS DOUBLE) / (a.n * b.n)), 6) AS pmi
        FROM (SELECT x.entity AS first, y.entity AS second, count(*) AS lines FROM seen x JOIN seen y ON x.doc_id = y.doc_id AND x.line = y.line AND x.entity < y.entity
              GROUP BY 1, 2 HAVING count(*) >= 2) p JOIN uses a ON a.entity = p.first JOIN uses b ON b.entity = p.second""",
)
def entity_relations(t):
    """Entities that stand together in at least two lines."""
    return ops.entity_relations(t.documents, 2)


@query(
    "citation_mentions",
    " UNION ALL ".join(
        f"SELECT doc_id, unnest(regexp_extract_all(text, '{p}')) AS mention, '{f}' AS form FROM documents" for f, p in ops.CITE_FORMS.items()
    ),
)
def citation_mentions(t):
    return ops.citation_mentions(t.documents)


@query(
    "exact_duplicates",
    "SELECT md5(text) AS checksum, min(doc_id) AS canonical, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1",
)
def exact_duplicates(t):
    return dup.exact_duplicates(t.documents)


@query("near_duplicates", with_parts("SELECT * FROM near_pairs", near_pairs=NEAR, grams=GRAMS, gram_sizes=SIZES))
def near_duplicates(t):
    return dup.near_duplicates(t.documents)


LINKS = """SELECT p.doc_id, p.other FROM (
             SELECT x.doc_id, y.doc_id AS other, count(*) AS c FROM grams x JOIN grams y ON x.g = y.g AND y.doc_id <> x.doc_id GROUP BY 1, 2) p
           JOIN gram_sizes a ON a.doc_id = p.doc_id JOIN gram_sizes b ON b.doc_id = p.other WHERE p.c / (a.n + b.n - p.c) >= 0.8"""


@query(
    "duplicate_clusters",
    f"""WITH RECURSIVE grams AS MATERIALIZED ({GRAMS}), gram_sizes AS MATERIALIZED ({SIZES}), links AS MATERIALIZED ({LINKS}),
        reach AS (SELECT doc_id, other FROM links UNION SELECT r.doc_id, l.other FROM reach r JOIN links l ON r.other = l.doc_id)
        SELECT doc_id, min(least(doc_id, other)) AS cluster_id FROM reach GROUP BY 1""",
)
def duplicate_clusters(t):
    return dup.duplicate_clusters(t.documents)
