import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from paperloom.operators import neighbours, pivots, quality, retrieval
from paperloom.operators import vectors as vec
from paperloom.plans import search_queries


def frame(spark, names, matrix, id_col, vec_col, kind):
    rows = [(n, [float(x) for x in v]) for n, v in zip(names, matrix)]
    return spark.createDataFrame(rows, f"{id_col} {kind}, {vec_col} array<double>")


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(3)
    corpus = rng.standard_normal((900, 16))
    corpus[300:600] = corpus[0]
    queries = rng.standard_normal((30, 16))
    queries[0] = corpus[0]
    return (
        queries,
        corpus,
        frame(spark, [f"q{i}" for i in range(30)], queries, "query_id", "query_vec", "string"),
        frame(spark, range(900), corpus, "id", "embedding", "bigint").repartition(5),
    )


def brute(queries, corpus, k, metric):
    scores = queries @ corpus.T
    if metric == "cosine":
        scores = scores / np.sqrt(np.outer((queries**2).sum(1), (corpus**2).sum(1)))
    scores = np.round(scores, 6)
    return {f"q{q}": sorted(range(len(corpus)), key=lambda i: (-scores[q][i], i))[:k] for q in range(len(queries))}


def by_query(found):
    result = {}
    for r in found.orderBy("query_id", "rank").collect():
        result.setdefault(r["query_id"], []).append(r["id"])
    return result


@pytest.mark.parametrize("metric", ["cosine", "dot"])
@pytest.mark.parametrize("limits", [(256, 20_000, 20_000), (5, 40, 7)])
def test_exact_search_in_whole_and_cut_pieces(sample, monkeypatch, metric, limits):
    queries, corpus, q, c = sample
    for name, value in zip(("LEAST_PIVOTS", "PIECE_ROWS", "QUERY_ROWS"), limits, strict=True):
        monkeypatch.setattr(pivots, name, value)
    found = vec.vector_search(q, c, 6, metric)
    assert by_query(found) == brute(queries, corpus, 6, metric)


@pytest.mark.parametrize("metric", ["cosine", "dot"])
def test_zeros_lengths_and_short_collections(spark, metric):
    rng = np.random.default_rng(4)
    corpus = rng.standard_normal((200, 8)) * rng.choice([0.01, 1.0, 30.0], (200, 1))
    corpus[::9], corpus[5] = 0.0, -corpus[6]
    queries = np.vstack([rng.standard_normal((10, 8)), np.zeros((1, 8)), corpus[6:8]])
    q = frame(spark, [f"q{i}" for i in range(len(queries))], queries, "query_id", "query_vec", "string")
    c = frame(spark, range(200), corpus, "id", "embedding", "bigint")
    found = by_query(vec.vector_search(q, c, 25, metric, 7))
    with np.errstate(invalid="ignore"):
        raw = queries @ corpus.T
        if metric == "cosine":
            raw = np.nan_to_num(raw / np.sqrt(np.outer((queries**2).sum(1), (corpus**2).sum(1))))
    scores = pivots.rounded(raw)
    assert found == {f"q{i}": sorted(range(200), key=lambda j: (-scores[i][j], j))[:25] for i in range(len(queries))}
    assert vec.vector_search(q, c.limit(3), 25, metric).count() == 3 * len(queries)


def test_bounds_leave_clustered_rows_alone(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((40, 16))
    corpus = np.repeat(centres, 50, axis=0) + 0.1 * rng.standard_normal((2000, 16))
    c = frame(spark, range(2000), corpus, "id", "embedding", "bigint")
    q = frame(spark, [f"q{i}" for i in range(40)], corpus[::50], "query_id", "query_vec", "string")
    one = F.lit("all").alias("collection")
    work = pivots.search_work(q.select("*", one), c.select("*", one), 10, {"all": "cosine"}, 100).agg(F.sum("rows_scored"), F.sum("rows")).head()
    assert work[0] < 0.25 * work[1]


def test_equal_scores_go_by_id_and_top_k_is_monotone(sample):
    _, _, q, c = sample
    five, ten = by_query(vec.vector_search(q, c, 5)), by_query(vec.vector_search(q, c, 10))
    assert ten["q0"] == [0, 300, 301, 302, 303, 304, 305, 306, 307, 308]
    assert all(ten[name][:5] == ids for name, ids in five.items())


def test_no_queries_and_no_corpus(sample):
    _, _, q, c = sample
    assert vec.vector_search(q.where("false"), c, 5).count() == 0
    assert vec.vector_search(q, c.where("false"), 5).count() == 0


def test_lengths_must_agree(spark, sample):
    _, _, q, _ = sample
    other = frame(spark, [1], np.ones((1, 4)), "id", "embedding", "bigint")
    with pytest.raises(Exception, match="differ in length"):
        vec.vector_search(q, other, 5).collect()


def test_unknown_collection_is_an_error(sample):
    _, _, q, c = sample
    asked = q.withColumn("collection", F.lit("multilingual"))
    with pytest.raises(KeyError):
        vec.search_collections(asked, c.withColumn("collection", F.lit("default")), {"default": "cosine"}, 3)


def test_approximate_search_finds_planted_neighbours(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((20, 64))
    corpus = np.repeat(centres, 10, axis=0) + 0.3 * rng.standard_normal((200, 64))
    q = frame(spark, [f"q{i}" for i in range(20)], centres, "query_id", "query_vec", "string")
    c = frame(spark, range(200), corpus, "id", "embedding", "bigint")
    exact, near = by_query(vec.vector_search(q, c, 10)), by_query(vec.vector_search_ann(q, c, 10))
    hits = sum(len(set(exact[n]) & set(near.get(n, []))) for n in exact)
    assert hits / 200 >= 0.9


def recall(exact, near):
    return sum(len(set(exact[n]) & set(near.get(n, []))) for n in exact) / sum(map(len, exact.values()))


def test_graph_finds_neighbours_of_clustered_vectors(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((25, 32))
    corpus = np.repeat(centres, 40, axis=0) + 0.2 * rng.standard_normal((1000, 32))
    corpus[900:] = corpus[899]
    q = frame(spark, [f"q{i}" for i in range(25)], centres, "query_id", "query_vec", "string")
    c = frame(spark, range(1000), corpus, "id", "embedding", "bigint")
    near = vec.vector_search_ann(q, c, 10)
    assert recall(by_query(vec.vector_search(q, c, 10)), by_query(near)) >= 0.95


def test_graph_recall_on_the_stored_vectors(spark, tables):
    rows = search_queries.ann_recall(tables).collect()
    assert sum(r["recall"] * r["queries"] for r in rows) / sum(r["queries"] for r in rows) >= 0.9
    assert all(r["scored_share"] < 0.9 for r in rows)
    assert sum(r["queries"] for r in rows) == tables.vectors.where("id % 20 = 0").count()


def test_graph_of_few_or_no_vectors(spark, tables):
    few = vec.vector_search_ann(tables.vector_queries, tables.vectors.limit(1), 3)
    assert few.count() == tables.vector_queries.count()
    assert vec.vector_search_ann(tables.vector_queries, tables.vectors.where("false"), 3).count() == 0
    zeros = frame(spark, [1, 2], [[0.0] * 64, [1.0] * 64], "id", "embedding", "bigint")
    assert {r["id"] for r in vec.vector_search_ann(tables.vector_queries, zeros, 3).collect()} == {2}


def test_groups_of_sorted_batches():
    table = pa.table({"k": [1, 1, 2, 2, 2, 3], "v": list(range(6))})
    batches = [b for part in (table.slice(0, 1), table.slice(1, 3), table.slice(4)) for b in part.to_batches()]
    assert [t.column("v").to_pylist() for t in neighbours.groups(iter(batches), ["k"])] == [[0, 1], [2, 3, 4], [5]]


def test_quality_counts_queries_without_hits(spark):
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 1)], "query_id int, id int, rank int")
    queries = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (4, 9)], "query_id int, label int")
    judged = spark.createDataFrame([(10, 1), (11, 0), (12, 1), (13, 0)], "id int, label int")
    rows = {r["label"]: tuple(r)[1:] for r in quality.search_quality(hits, queries, judged, 2).collect()}
    assert rows[0] == (2, 0.25, 0.25, 0.25, round((1 / math.log2(3)) / (1 + 1 / math.log2(3)) / 2, 6))
    assert rows[1] == (1, 0.5, 0.5, 1.0, round(1 / (1 + 1 / math.log2(3)), 6)) and set(rows) == {0, 1}


def test_embeddings_are_unit_or_whole(spark):
    docs = spark.createDataFrame([(1, "One two two three"), (2, "...")], "doc_id bigint, text string")
    unit = vec.embed_hashing(docs, "doc_id", "text").collect()
    assert [r["doc_id"] for r in unit] == [1, 2]
    assert sum(x * x for x in unit[0]["embedding"]) == pytest.approx(1.0)
    whole = vec.embed_hashing(docs, "doc_id", "text", unit=False).head()["embedding"]
    assert all(x == int(x) for x in whole)


def test_a_text_without_words_has_a_vector_of_zeros(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "..."), (3, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["embedding"] for r in vec.embed_hashing(df, "doc_id", "text", 8).collect()}
    assert sum(x * x for x in got[1]) == pytest.approx(1.0) and got[2] == got[3] == [0.0] * 8
    assert "Exchange" not in vec.embed_hashing(df, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()


class Given:
    """Stands for a DataFrame of queries, and keeps the function its batches go through."""

    schema = StructType().add("query_id", "string").add("collection", "string").add("query_vec", ArrayType(DoubleType())).add("least", "double")

    def select(self, *columns):
        return self

    def mapInArrow(self, function, schema):
        self.function = function
        return self


def test_visits_of_many_pieces_come_in_bounded_batches():
    rng = np.random.default_rng(9)
    n, dims = 400, 64
    bounds = pivots.sharded(pd.DataFrame(
        {"piece": range(n), "collection": "all", "cell": range(n), "low": 0.0, "high": 3.0, "short": 1.0, "long": 9.0, "rows": 2000}
    ))
    shared = type("Shared", (), {"value": (pivots.unit(rng.standard_normal((n, dims)))[0], bounds, {"all": "cosine"})})
    queries = pa.record_batch({
        "query_id": [f"q{i}" for i in range(2000)], "collection": ["all"] * 2000,
        "query_vec": rng.standard_normal((2000, dims)).tolist(), "least": [0.1] * 2000,
    })
    given = Given()
    pivots.visiting(given, shared, 10, True)
    batches = list(given.function(iter([queries])))
    assert max(b.nbytes for b in batches) < 32 << 20
    assert sum(len(p) for b in batches for p in b.column("pieces").to_pylist()) == 2000 * (n - 1)
    assert sum(b.num_rows for b in batches) <= 2000 * (pivots.SHARDS + 2)


@pytest.mark.parametrize("metric", ["cosine", "dot"])
def test_a_query_keeps_k_hits_of_all_pieces_it_visits_in_a_shard(metric):
    rng = np.random.default_rng(10)
    queries, vectors = rng.integers(-3, 4, (50, 8)).astype(float), rng.integers(-3, 4, (600, 8)).astype(float)
    queries[3], vectors[::50], vectors[100:160] = 0.0, 0.0, vectors[101]
    piece, ids = np.repeat(np.arange(12), 50), rng.permutation(600)
    guest, host = np.repeat(np.arange(50), 12), np.tile(np.arange(12), 50)
    scores = pivots.block_scores(queries, vectors, metric)
    least = np.where(np.arange(50) % 2 == 0, -np.inf, np.sort(scores, axis=1)[:, -20])
    row, near, value = pivots.best_of_pieces(queries, guest, host, least, vectors, ids, piece, metric, 7)
    assert len(row) == 50 * 7
    for q in range(50):
        best = sorted(zip(-scores[q], ids, strict=True))[:7]
        assert list(zip(-value[row == q], near[row == q], strict=True)) == best


def test_rerank_lists_terms_of_hits_only(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"common word{i} common") for i in range(300)] + [(300, None)], "doc_id bigint, text string")
    questions = spark.createDataFrame([("q", "Common word7 none")], "query_id string, query_text string")
    hits = spark.createDataFrame([("q", 7, 0.9), ("q", 8, 0.8)], "query_id string, id bigint, score double")
    stored, keep = {}, retrieval.materialize
    monkeypatch.setattr(retrieval, "materialize", lambda df, name="stage": stored.setdefault(name, keep(df, name)))
    found = {r["id"]: r["rerank_score"] for r in retrieval.rerank_lexical(hits, questions, docs).collect()}
    common, own = math.log(1 + (301 - 300 + 0.5) / 300.5), math.log(1 + (301 - 1 + 0.5) / 1.5)
    norm = 1.2 * (1 - 0.75 + 0.75 * 3 / 3)
    part = common * 2 * 2.2 / (2 + norm)
    assert found == {7: 1.0, 8: pytest.approx(part / (part + own * 2.2 / (1 + norm)), abs=1e-6)}
    assert max(df.count() for name, df in stored.items() if name != "terms") < 300


def test_visits_are_passed_in_small_batches():
    rng = np.random.default_rng(12)
    bounds = pivots.sharded(pd.DataFrame(
        {"piece": range(40), "collection": "all", "cell": range(40), "low": 0.0, "high": 3.0, "short": 1.0, "long": 9.0, "rows": 2000}
    ))
    shared = type("Shared", (), {"value": (pivots.unit(rng.standard_normal((40, 64)))[0], bounds, {"all": "cosine"})})
    queries = pa.record_batch({
        "query_id": [f"q{i}" for i in range(2000)], "collection": ["all"] * 2000,
        "query_vec": rng.standard_normal((2000, 64)).tolist(), "least": [0.1] * 2000,
    })
    given = Given()
    pivots.visiting(given, shared, 10, True)
    batches = list(given.function(iter([queries])))
    assert max(b.nbytes for b in batches) < 4 << 20
    assert sum(len(p) for b in batches for p in b.column("pieces").to_pylist()) == 2000 * 39


def checked(df, most):
    """``df`` by a function that fails if it is given more rows at a time."""

    def check(batches):
        for batch in batches:
            if batch.num_rows > most:
                raise ValueError(f"{batch.num_rows} rows in a batch")
            yield batch

    return df.mapInArrow(check, df.schema)


def test_search_and_rerank_take_texts_in_small_batches(spark):
    docs = spark.range(2500, numPartitions=1).select(F.col("id").alias("doc_id"), F.concat(F.lit("common w"), F.col("id") % 7).alias("text"))
    corpus = checked(vec.embed_hashing(docs, "doc_id", "text", unit=False).withColumnRenamed("doc_id", "id"), 1000)
    asked = docs.select(F.concat(F.lit("q"), "doc_id").alias("query_id"), F.col("text").alias("query_text"))
    queries = checked(vec.embed_hashing(asked, "query_id", "query_text", unit=False).withColumnRenamed("embedding", "query_vec"), 1000)
    hits = retrieval.materialize(vec.vector_search(queries, corpus, 2).drop("rank"))
    assert hits.count() == 5000 and hits.agg(F.min("score")).head()[0] == 1.0
    assert retrieval.rerank_lexical(hits, asked, checked(docs, 1000)).where("rerank_score = 1").count() == 5000


def test_shards_need_no_python(sample):
    _, corpus, _, c = sample
    rows = pivots.placed(c.withColumn("collection", F.lit("all")), pivots.unit(corpus[:20])[0])
    pieced, _ = pivots.in_pieces(pivots.materialize(rows))
    plan = pieced._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" in plan and "ExistingRDD" not in plan and pieced.count() == 900


def test_edges_around_hubs_are_the_best_that_reach_a_bound():
    rng = np.random.default_rng(13)
    hub = np.sort(rng.integers(0, 60, 700))
    hub[:120] = -1  # one large hub
    ids, vectors = rng.integers(0, 90, 700), pivots.unit(rng.standard_normal((700, 8)))[0]
    vectors[50:90] = vectors[50]
    least = np.where(rng.random(700) < 0.3, -np.inf, rng.uniform(-0.5, 0.9, 700))
    found = [np.concatenate(c) for c in zip(*neighbours.edges_around(hub, ids, vectors, least, 5), strict=True)]
    expected = []
    for one in np.unique(hub):
        mine = np.flatnonzero(hub == one)
        for i in mine:
            scores = {j: pivots.rounded(vectors[i] @ vectors[j]) for j in mine if ids[j] != ids[i]}
            best = sorted((-x, ids[j]) for j, x in scores.items())[:5]
            expected += [(ids[i], near, -x) for x, near in best if -x >= least[i]]
    assert sorted(zip(*found, strict=True)) == sorted(expected)


def test_batches_are_cut_between_hubs():
    table = pa.table({"k": [1, 1, 2, 2, 2, 2, 3, 4], "v": list(range(8))})
    batches = [b for first, n in ((0, 1), (1, 2), (3, 0), (3, 1), (4, 3), (7, 1)) for b in (table.slice(first, n).to_batches() or [table.to_batches()[0].slice(0, 0)])]
    assert [t.column("v").to_pylist() for t in neighbours.whole_groups(iter(batches), "k")] == [[0, 1], [2, 3, 4, 5], [6], [7]]


def test_a_round_passes_on_edges_that_can_be_among_the_best(spark):
    rng = np.random.default_rng(14)
    nodes = neighbours.nodes_of(frame(spark, range(300), rng.standard_normal((300, 8)), "id", "embedding", "bigint"))
    hubs = nodes.select(F.lit(1).cast("bigint").alias("hub"), "id", "vector")
    all_edges = neighbours.hub_edges(hubs.withColumn("least", F.lit(None).cast("double")), 4)
    edges = neighbours.best_edges(all_edges.withColumn("fresh", F.lit(1)), 4).localCheckpoint()
    assert edges.count() == 1200
    again = neighbours.hub_edges(neighbours.with_least(hubs, edges, 3), 300)
    at_most = neighbours.hub_edges(neighbours.with_least(hubs, edges.where("id <> 7"), 4), 300)
    assert again.join(edges.select("id", "near"), ["id", "near"], "left_anti").count() == 0
    assert at_most.where("id = 7").count() == 299 and at_most.where("id <> 7").count() < 1300
    plan = neighbours.best_edges(edges, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("Exchange") == 1 and "hashpartitioning(id#" in plan


def test_rows_meet_many_pivots_in_slices(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PIVOT_SCORES", 35)
    batch = pa.record_batch({"id": list(range(12))})
    parts = list(neighbours.row_slices(iter([batch, batch.slice(0, 0)]), 7))
    assert [p.column("id").to_pylist() for p in parts] == [[0, 1, 2, 3, 4], [5, 6, 7, 8, 9], [10, 11]]
    rng = np.random.default_rng(15)
    vectors, known = rng.standard_normal((40, 8)), pivots.unit(rng.standard_normal((7, 8)))[0]
    nodes = neighbours.nodes_of(frame(spark, range(40), vectors, "id", "embedding", "bigint").coalesce(1))
    placed = {(r["id"], r["cell"]): r["vector"] for r in neighbours.in_cells(nodes, known, 2).collect()}
    near = np.argsort(-(vectors @ known.T), axis=1)[:, :2]
    assert set(placed) == {(i, c) for i in range(40) for c in near[i].tolist()}
    assert all(np.allclose(v, pivots.unit(vectors[i : i + 1])[0][0]) for (i, _), v in placed.items())


@pytest.mark.parametrize("metric", ["cosine", "dot"])
@pytest.mark.parametrize("dense", [0, 16])
def test_single_precision_loses_no_hit(monkeypatch, metric, dense):
    monkeypatch.setattr(pivots, "DENSE", dense)
    monkeypatch.setattr(pivots, "WAITING", 100)
    rng = np.random.default_rng(14)
    queries, vectors = rng.standard_normal((700, 96)), rng.standard_normal((3000, 96))
    # Near copies differ by less than single precision holds, and lengths by many powers of ten.
    vectors[1000:1400] = vectors[1] + 1e-7 * rng.standard_normal((400, 96))
    queries[:50] = vectors[1] + 0.1 * rng.standard_normal((50, 96))
    vectors *= 10.0 ** rng.integers(-3, 4, (3000, 1))
    queries *= 10.0 ** rng.integers(-9, 9, (700, 1))
    queries[60], vectors[70:90] = 0.0, 0.0
    piece, ids = np.repeat(np.arange(4), 750), rng.permutation(3000)
    scores = pivots.block_scores(queries, vectors, metric)
    kth = np.sort(scores, axis=1)[:, -9]
    least = np.where(np.arange(700) % 3 > 0, -np.inf, kth - 1e-12 * np.abs(kth))
    guest, host = np.repeat(np.arange(700), 4), np.tile(np.arange(4), 700)
    row, near, value = pivots.best_of_pieces(queries, guest, host, least, vectors, ids, piece, metric, 9)
    for q in range(700):
        np.testing.assert_allclose(value[row == q], np.sort(scores[q])[::-1][:9], rtol=1e-12, atol=1e-6)
        sure = set(ids[scores[q] > kth[q] + 1.5e-6 + 1e-12 * abs(kth[q])])
        assert sure <= set(near[row == q])


def test_few_pairs_are_scored_in_double_precision(monkeypatch):
    rng = np.random.default_rng(15)
    queries, vectors = rng.standard_normal((1000, 64)), rng.standard_normal((6000, 64))
    scored, whole = [], pivots.block_scores
    monkeypatch.setattr(pivots, "block_scores", lambda q, v, m: scored.append(len(q) * len(v)) or whole(q, v, m))
    single = pivots.single_scores
    monkeypatch.setattr(pivots, "single_scores", lambda q, v, row, column, m: scored.append(len(row)) or single(q, v, row, column, m))
    guest, host = np.repeat(np.arange(1000), 6), np.tile(np.arange(6), 1000)
    pivots.best_of_pieces(queries, guest, host, np.full(1000, -np.inf), vectors, np.arange(6000), np.repeat(np.arange(6), 1000), "cosine", 10)
    assert 0 < sum(scored) < 0.12 * 1000 * 6000
