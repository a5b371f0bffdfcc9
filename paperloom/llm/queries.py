"""The queries of the subpackage by name, with reference SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ITEM_WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
WHITE_WORDS = rf"regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+')"

CONTAMINATION = f"""
WITH item_words AS (SELECT item_id, {ITEM_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS run
  FROM (SELECT item_id, w, least(len(w), 13) AS k, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM item_words WHERE len(w) > 0)),
doc_words AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {ITEM_WORDS} AS w FROM documents),
runs AS (
  SELECT r, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS run
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc_words, (SELECT DISTINCT k FROM windows))),
found AS MATERIALIZED (SELECT r, i, k, item_id FROM runs JOIN windows USING (k, run)),
hit AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + k)) FROM found) GROUP BY 1),
named AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
          FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN hit USING (r) LEFT JOIN named USING (r)"""

COMPONENTS = f"""
WITH RECURSIVE doc_words AS MATERIALIZED (SELECT doc_id, {WHITE_WORDS} AS w FROM documents),
grams AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(len(w), 4) - 1), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 4) + 2)) AS i FROM doc_words WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
links AS MATERIALIZED (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN sizes m ON m.doc_id = p.a JOIN sizes n ON n.doc_id = p.b WHERE 100 * p.c >= 85 * (m.n + n.n - p.c)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY 1) c USING (doc_id)"""

EXACT = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""

CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST({} AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"""

TRIE = f"""
WITH turns AS MATERIALIZED (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
         sha256(length(coalesce(role, '')) || '|' || coalesce(role, '') || '|' || coalesce(text, '')) AS k, length(coalesce(text, '')) AS w
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % 100 AS base, {CRC32.format('conv_id')} % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
made AS (
  SELECT c.conv_id, 0 AS own, t.i, t.k, t.w FROM convs c JOIN turns t ON t.conv_id = c.base AND t.i <= c.h
  UNION ALL SELECT c.conv_id, 1, t.i, t.k, t.w FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.i > c.h),
members AS MATERIALIZED (
  SELECT conv_id, row_number() OVER path AS d, sha256(string_agg(k, '') OVER path) AS key, w FROM made WINDOW path AS (PARTITION BY conv_id ORDER BY own, i)
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
chained AS MATERIALIZED (SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY d) AS up, d = max(d) OVER (PARTITION BY conv_id) AS ends FROM members),
nodes AS MATERIALIZED (
  SELECT key, any_value(d) AS d, any_value(up) AS up, any_value(w) AS w, min(conv_id) AS conv_id, count(*) AS n,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS ended FROM chained GROUP BY 1),
kids AS (SELECT up AS key, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY 1),
below AS (
  SELECT a.key, sum(CASE WHEN c.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum((x.n - 1) * x.w) AS saved
  FROM nodes x JOIN members a ON a.conv_id = x.conv_id AND a.d <= x.d LEFT JOIN kids c ON c.key = x.key GROUP BY 1)
SELECT x.conv_id, x.d AS depth, p.conv_id AS parent_conv_id, x.n AS n_convs, coalesce(c.n, 0) AS n_children,
       CAST(b.leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(x.ended) AS ends_sha256
FROM nodes x LEFT JOIN nodes p ON p.key = x.up LEFT JOIN kids c ON c.key = x.key JOIN below b ON b.key = x.key"""

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    from paperloom.llm.token_counts import token_counts

    return token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op8_decontamination", CONTAMINATION)
def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    from paperloom.llm.decontaminate import contamination

    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op10_language_id")
def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    from paperloom.llm.language_id import identify

    return identify(table(spark, folder, "documents"))


@query("op4_packing")
def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    from paperloom.llm.packing import pack_documents

    return pack_documents(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op2_quality")
def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    from paperloom.llm.quality import quality_scores

    return quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op7_secrets")
def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    from paperloom.llm.secrets import secret_spans

    return secret_spans(table(spark, folder, "documents"))


@query("op5_ngram_join", COMPONENTS)
def op5_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    from paperloom.llm.ngram_join import joined_documents

    return joined_documents(table(spark, folder, "documents"))


@query("op6_class_lm")
def op6_class_lm(spark: SparkSession, folder: str) -> DataFrame:
    from paperloom.llm.class_lm import class_scores

    return class_scores(table(spark, folder, "documents"))


@query("op3_spot_signatures")
def op3_spot_signatures(spark: SparkSession, folder: str) -> DataFrame:
    from paperloom.llm.spot_signatures import fingerprints

    return fingerprints(table(spark, folder, "documents"))


@query("op9_licenses")
def op9_licenses(spark: SparkSession, folder: str) -> DataFrame:
    from paperloom.llm.licenses import license_scan

    return license_scan(table(spark, folder, "documents"))


@query("op12_exact_dedup", EXACT)
def op12_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from paperloom.llm.exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, folder, "documents"))


@query("op13_prefix_trie", TRIE)
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    from paperloom.llm.prefix_trie import prefix_trie

    return prefix_trie(table(spark, folder, "conversations"))


@query("op11_spelling_variants")
def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    from paperloom.llm.spelling_variants import spelling_variants

    return spelling_variants(table(spark, folder, "documents"))
