"""Records without a schema, handlers and embedders by type, roles that inherit."""

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

from paperloom.operators import compliance, records, retrieval
from paperloom.operators.vectors import embed_hashing
from paperloom.sources import handlers

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # as a notebook's own classes are

ROWS = [
    (1, '{"k": 1, "a": {"b": [1, 2]}}'), (2, '{"k": "x"}'), (3, "{bad"), (4, None), (5, '{"k": 1.5, "z": null, "t": true}'), (6, "[1]"), (7, "{}"), (8, '{"k": [1]}'),
]


def test_fields_change_their_type_between_rows(spark):
    rows = spark.createDataFrame(ROWS, "id int, props string")
    got = sorted((tuple(r) for r in records.record_fields(rows, "id", "props").collect()), key=str)
    assert got == sorted(
        [
            (1, "a", "object", '{"b":[1,2]}'), (1, "k", "number", "1"), (2, "k", "text", "x"), (3, None, "malformed", "{bad"), (4, None, "missing", None),
            (5, "k", "number", "1.5"), (5, "z", "none", None), (5, "t", "boolean", "true"), (6, None, "array", "[1]"), (8, "k", "array", "[1]"),
        ],
        key=str,
    )
    kinds = {(r["field"], r["kind"]): (r["rows"], r["values"]) for r in records.field_kinds(records.record_fields(rows, "id", "props")).collect()}
    assert kinds["k", "number"] == (2, 2) and kinds["k", "text"] == (1, 1) and kinds["z", "none"] == (1, 0)
    assert "k: VARIANT" in records.merged_schema(rows.where("id <> 6"), "props").head()["schema"]
    typed = rows.select("id", records.typed_field("props", "$.k", "bigint").alias("k")).collect()
    assert {r["id"]: r["k"] for r in typed} == {1: 1, 2: None, 3: None, 4: None, 5: 1, 6: None, 7: None, 8: None}


class Words(handlers.Handler):
    def parts(self, content):
        if content == "boom":
            raise ValueError("cannot read")
        return (("word", w) for w in content.split())


def test_own_handlers_unknown_types_and_faults(spark):
    rows = spark.createDataFrame([(1, "w", "a b"), (2, "w", "boom"), (3, "l", "x\n\ny"), (4, "?", "z"), (5, None, "z"), (6, "w", None)], "id int, type string, content string")
    got = sorted((tuple(r) for r in handlers.handled(rows, {"w": Words, "l": handlers.Lines}).collect()), key=str)
    assert got == sorted(
        [
            ("1", "word", "a", "success", None), ("1", "word", "b", "success", None), ("2", None, None, "failed", "ValueError: cannot read"),
            ("3", "line 0", "x", "success", None), ("3", "line 2", "y", "success", None), ("4", None, None, "failed", "no handler for ?"),
            ("5", None, None, "failed", "no handler for no type"),
        ],
        key=str,
    )


def test_own_embedder_and_own_scorer(spark):
    def lengths(rows, key, text):
        return rows.select(key, F.array(F.length(text).cast("double")).alias("embedding"))

    rows = spark.createDataFrame([(1, "a", "xyz"), (2, "b", "one two"), (3, "c", "?")], "id bigint, type string, content string")
    got = {r["id"]: r["embedding"] for r in handlers.embedded(rows, {"a": lengths, "b": embed_hashing}).collect()}
    assert got[1] == [3.0] and len(got[2]) == 64 and got[3] is None

    def shorter_first(hits, queries, docs):
        sized = docs.select(F.col("doc_id").alias("id"), (1 / F.length("text")).alias("rerank_score"))
        return hits.join(sized, "id").select("query_id", "id", "rerank_score")

    docs = spark.createDataFrame([(1, "aa bb"), (2, "aa"), (3, "aa bb cc dd")], "doc_id bigint, text string")
    queries = spark.createDataFrame([("q", "aa", [1.0, 0.0])], "query_id string, query_text string, query_vec array<double>")
    corpus = spark.createDataFrame([(i, [1.0, 0.0]) for i in (1, 2, 3)], "id bigint, embedding array<double>")
    found = retrieval.hybrid_search(queries, corpus, docs, 2, 0.0, scorer=shorter_first)
    assert [(r["rank"], r["id"]) for r in found.orderBy("rank").collect()] == [(1, 2), (2, 1)]


def test_roles_inherit_also_in_a_circle(spark):
    inherits = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("e", None), ("f", "g")], "role string, parent string")
    reach = {}
    for r in compliance.inherited_roles(inherits).collect():
        reach.setdefault(r["role"], set()).add(r["ancestor"])
    circle = {"a", "b", "c"}
    assert reach == {"a": circle, "b": circle, "c": circle, "d": {"d"} | circle, "e": {"e"}, "f": {"f", "g"}, "g": {"g"}}
    meta = spark.createDataFrame([(1, "public"), (2, "internal"), (3, "secret")], "doc_id int, access_level string")
    grants = spark.createDataFrame([("c", "public"), ("d", "internal"), ("lone", "secret")], "role string, access_level string")
    seen = {(r["role"], r["doc_id"]) for r in compliance.inherited_permissions(meta, grants, inherits).collect()}
    assert seen == {("a", 1), ("b", 1), ("c", 1), ("d", 1), ("d", 2), ("lone", 3)}


def test_a_handler_passes_rows_on_in_bounded_tables():
    rows = pa.record_batch({"id": [str(i) for i in range(300)], "content": ["x\n" * 100] * 299 + [None]})
    tables = list(handlers.Lines().eval(rows))
    assert sum(t.num_rows for t in tables) == 29_900 and max(t.num_rows for t in tables) <= handlers.ROWS_PER_TABLE + 100
