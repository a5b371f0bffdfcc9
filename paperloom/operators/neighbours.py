"""Approximate nearest neighbours by a neighbour graph: built by local joins, searched by beam.

The graph starts from overlapping cells: every vector is compared with the bounded pieces of its
``OVERLAP`` nearest pivots' cells. Rounds of NN-descent (Dong et al. 2011) then join every node's
neighbours and reverse neighbours with each other, since a neighbour's neighbour is likely
one's own; the reverse ones of a hub are sampled down to the degree. Rounds end when few edges
change. An edge below a node's ``DEGREE``-th best is dropped where it is computed, since it can't
be kept. A search starts at the best pivots, which are nodes, and follows the edges of the best
candidates for a bounded number of hops. Every step is a join on ids; tasks hold one piece or
one node's neighbours at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.operators.pivots import CELLS, SLACK, as_matrix, best_of, best_rows, rounded, unit
from paperloom.operators.skew import top_rows
from paperloom.storage import materialize

DEGREE = 16
OVERLAP = 3
#: Larger cells are cut into pieces.
CELL_ROWS = 1000
#: Pivots grow with the root of the corpus and are broadcast, so they are bounded.
LEAST_PIVOTS, MOST_PIVOTS = 64, 2048
ROUNDS = 4
CHANGED = 0.02
BEAM, KEPT, HOPS = 16, 64, 4
#: Scores of rows with pivots that a task holds at a time.
PIVOT_SCORES = 1 << 20


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, of batches that come sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = np.zeros(batch.num_rows, bool)
        for key in keys:
            values = batch.column(key).to_numpy(zero_copy_only=False)
            changed[1:] |= values[1:] != values[:-1]
            if held and held[-1].column(key)[-1] != batch.column(key)[0]:
                changed[0] = True
        starts = np.flatnonzero(changed).tolist()
        first = 0
        for start in starts:
            if start > first:
                held.append(batch.slice(first, start - first))
            if held:
                yield pa.Table.from_batches(held)
            held, first = [], start
        held.append(batch.slice(first))
    if held:
        yield pa.Table.from_batches(held)


def row_slices(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their rows by ``columns`` are at most ``PIVOT_SCORES`` cells, or one row."""
    most = max(1, PIVOT_SCORES // max(1, columns))
    for batch in batches:
        for first in range(0, batch.num_rows, most):
            yield batch.slice(first, most)


def _edges(ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's k best others of the same table."""
    scores = rounded(vectors @ vectors.T)
    scores[ids[:, None] == ids[None, :]] = -np.inf
    row, column = best_of(scores, ids, k)
    some = scores[row, column] > -np.inf
    row, column = row[some], column[some]
    return ids[row], ids[column], scores[row, column]


def local_edges(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """``id, near, score``: the best others of every row (``id, vector``) within its ``keys``."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def batch() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "near", "score"])

        for one in groups(batches, keys):
            vectors = as_matrix(one.column("vector").combine_chunks())
            held.append(_edges(one.column("id").to_numpy(), vectors, k))
            if sum(len(h[0]) for h in held) > 50_000:
                yield batch()
                held.clear()
        if held:
            yield batch()

    dealt = rows.select(*keys, "id", "vector").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(compare, "id bigint, near bigint, score double")


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Batches that come sorted by ``key``, cut between keys, so that no key is in two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy()
        last = int(np.searchsorted(values, values[-1]))
        if held and (last or held[-1].column(key)[-1].as_py() != values[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        elif last:
            yield pa.Table.from_batches([batch.slice(0, last)])
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def edges_around(
    hub: np.ndarray, ids: np.ndarray, vectors: np.ndarray, least: np.ndarray, k: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Id, other id and score of each row's k best others with the same ``hub`` that reach the row's ``least``.

    Rows come sorted by ``hub``. Hubs of like size are compared in one product, padded to the largest.
    """
    starts = np.flatnonzero(np.concatenate([[True], hub[1:] != hub[:-1]]))
    sizes = np.diff(np.append(starts, len(hub)))
    order, first = np.argsort(-sizes, kind="stable"), 0
    while first < len(order):
        most = int(sizes[order[first]])
        some = order[first : first + max(1, CELLS // most**2)]
        first += len(some)
        real = np.arange(most) < sizes[some, None]
        place = np.where(real, starts[some, None] + np.arange(most), starts[some, None])
        own, named = vectors[place], ids[place]
        raw = own @ own.transpose(0, 2, 1)
        reached = (raw >= (least[place] - SLACK)[:, :, None]) & real[:, :, None] & real[:, None, :] & (named[:, :, None] != named[:, None, :])
        group, row, column = np.nonzero(reached)
        score, row, near = rounded(raw[group, row, column]), group * most + row, named[group, column]
        held = score >= least[place].ravel()[row]
        row, near, score = row[held], near[held], score[held]
        if len(row) and np.bincount(row).max() > k:
            row, near, score = best_rows(row, near, score, k)
        yield named.ravel()[row], near, score


def hub_edges(rows: DataFrame, k: int) -> DataFrame:
    """``id, near, score``: the k best others of every row (``hub, id, vector, least``) around its hub, without those below its ``least``."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, "hub"):
            vectors = as_matrix(part.column("vector").combine_chunks())
            least = part.column("least").fill_null(-np.inf).to_numpy()
            found = list(edges_around(part.column("hub").to_numpy(), part.column("id").to_numpy(), vectors, least, k))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["id", "near", "score"])

    dealt = rows.select("hub", "id", "vector", "least").where("hub is not null").repartition("hub").sortWithinPartitions("hub")
    return dealt.mapInArrow(compare, "id bigint, near bigint, score double")


def best_edges(edges: DataFrame, k: int) -> DataFrame:
    """The k best distinct edges of every node; ``fresh`` if no earlier round had an edge. Edges are exchanged once."""
    once = edges.repartition("id").groupBy("id", "near", "score").agg(F.min("fresh").alias("fresh"))
    return top_rows(once, ["id"], [F.desc("score"), F.asc("near")], k).drop("rank")


def with_least(nodes: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """Nodes with ``least``, the score of the k-th best edge: one below it can't be among the k best. Null with fewer edges."""
    kth = F.when(F.count("*") >= k, F.min("score")).alias("least")
    return nodes.join(edges.groupBy("id").agg(kth), "id", "left")


def hashed(*columns: Column) -> Column:
    return F.xxhash64(*columns)


def nodes_of(corpus: DataFrame) -> DataFrame:
    """``id, vector``: directions of the vectors that have one."""

    def directions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, _ = unit(as_matrix(batch.column("embedding")))
            flat = pa.ListArray.from_arrays(np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1], pa.array(vectors.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), flat], ["id", "vector"])

    spoken = corpus.where(F.exists("embedding", lambda x: x != 0)).select(F.col("id").cast("bigint").alias("id"), "embedding")
    return spoken.mapInArrow(directions, "id bigint, vector array<double>")


def pivots_of(nodes: DataFrame, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and directions of ``count`` nodes, taken evenly by a hash of the id."""
    rows = nodes.orderBy(F.xxhash64("id"), "id").limit(count).collect()
    ids = np.array([r["id"] for r in rows], np.int64)
    return ids, np.array([r["vector"] for r in rows], np.float64)


def in_cells(nodes: DataFrame, pivots: np.ndarray, overlap: int) -> DataFrame:
    """``cell, id, vector``: every node in the cells of its ``overlap`` nearest pivots."""
    shared = nodes.sparkSession.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in row_slices(batches, len(known)):
            scores = as_matrix(batch.column("vector"), known.shape[1]) @ known.T
            cells = np.argsort(-scores, axis=1, kind="stable")[:, :overlap]
            chosen = batch.take(pa.array(np.repeat(np.arange(len(scores)), cells.shape[1])))
            yield pa.RecordBatch.from_arrays([pa.array(cells.ravel().astype(np.int64)), *chosen.columns], ["cell", "id", "vector"])

    return nodes.select("id", "vector").mapInArrow(place, "cell bigint, id bigint, vector array<double>")


class Graph:
    """Stored ``nodes(id, vector)`` and ``edges(id, near, score)``, and the pivots a search starts at."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.nodes, self.edges, self.ids, self.vectors = nodes, edges, ids, vectors


def neighbour_graph(corpus: DataFrame, degree: int = DEGREE, rounds: int = ROUNDS) -> Graph:
    """The approximate ``degree`` nearest neighbours of every ``corpus(id, embedding)`` row by angle.

    Vectors of zeros have no direction and are left out. Equal vectors are neighbours like others;
    a cell full of them is cut into hashed pieces.
    """
    nodes = materialize(nodes_of(corpus), "nodes")
    size = nodes.count()
    ids, pivots = pivots_of(nodes, min(MOST_PIVOTS, max(LEAST_PIVOTS, math.ceil(2 * math.sqrt(size)))))
    if not size:
        return Graph(nodes, nodes.sparkSession.createDataFrame([], "id bigint, near bigint, score double"), ids, pivots)
    placed = materialize(in_cells(nodes, pivots, OVERLAP), "graph-cells")
    parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("parts"))
    cut = placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    edges = materialize(best_edges(local_edges(cut, ["cell", "part"], degree).withColumn("fresh", F.lit(1)), degree), "edges")
    for _ in range(rounds):
        # Neighbours of a node meet around it; reverse ones are sampled down to the degree.
        out = edges.select(F.col("id").alias("hub"), F.col("near").alias("id"))
        back = edges.select(F.col("near").alias("hub"), "id")
        back = top_rows(back, ["hub"], [hashed(F.col("hub"), F.col("id")), F.asc("id")], degree).drop("rank")
        around = out.unionByName(back).repartition("id").distinct().join(with_least(nodes, edges, degree), "id")
        found = hub_edges(around, degree).withColumn("fresh", F.lit(1))
        edges = materialize(best_edges(edges.withColumn("fresh", F.lit(0)).unionByName(found), degree), "edges")
        if (edges.agg(F.avg("fresh")).head()[0] or 0.0) < CHANGED:
            break
    return Graph(nodes, edges.select("id", "near", "score"), ids, pivots)


def _scored_pairs(pairs: DataFrame, kind: str) -> DataFrame:
    """``query_id, id, score`` of rows with a query's and a node's direction."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = rounded((as_matrix(batch.column("asked")) * as_matrix(batch.column("vector"))).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("id"), pa.array(scores)], ["query_id", "id", "score"])

    return pairs.select("query_id", "id", "asked", "vector").mapInArrow(score, f"query_id {kind}, id bigint, score double")


def beam_search(queries: DataFrame, graph: Graph, beam: int = BEAM, kept: int = KEPT, hops: int = HOPS) -> DataFrame:
    """``query_id, id, score``: every node that was scored for ``queries(query_id, query_vec)``.

    ``hops`` times the ``beam`` best candidates not opened yet, among the ``kept`` best, are
    opened; their neighbours not seen yet are scored. Queries of zeros have no direction.
    """
    kind = queries.schema["query_id"].dataType.simpleString()
    spoken = queries.where(F.exists("query_vec", lambda x: x != 0)).select("query_id", "query_vec")
    shared = queries.sparkSession.sparkContext.broadcast((graph.ids, graph.vectors))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = shared.value
        for batch in row_slices(batches, len(ids)):
            asked, _ = unit(as_matrix(batch.column("query_vec")))
            scores = rounded(asked @ vectors.T) if len(ids) else np.zeros((len(asked), 0))
            row, column = best_of(scores, ids, kept)
            flat = pa.ListArray.from_arrays(np.arange(len(asked) + 1, dtype=np.int32) * asked.shape[1], pa.array(asked.ravel()))
            chosen = batch.column("query_id").take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [chosen, pa.array(ids[column]), pa.array(scores[row, column]), flat.take(pa.array(row))], ["query_id", "id", "score", "asked"]
            )

    started = materialize(spoken.mapInArrow(begin, f"query_id {kind}, id bigint, score double, asked array<double>"), "started")
    asked = materialize(top_rows(started, ["query_id"], [F.desc("score"), F.asc("id")], 1).select("query_id", "asked"), "asked")
    seen = started.select("query_id", "id", "score", F.lit(False).alias("opened"))
    for _ in range(hops):
        best = top_rows(seen, ["query_id"], [F.desc("score"), F.asc("id")], kept).where("not opened")
        opened = materialize(top_rows(best.drop("rank"), ["query_id"], [F.desc("score"), F.asc("id")], beam).select("query_id", "id"), "opened")
        reached = opened.join(graph.edges.select("id", "near"), "id").select("query_id", F.col("near").alias("id")).distinct()
        fresh = reached.join(seen.select("query_id", "id"), ["query_id", "id"], "left_anti")
        pairs = fresh.join(graph.nodes, "id").join(asked, "query_id")
        found = _scored_pairs(pairs, kind).withColumn("opened", F.lit(False))
        now = seen.join(opened.withColumn("_now", F.lit(True)), ["query_id", "id"], "left")
        now = now.select("query_id", "id", "score", (F.col("opened") | F.coalesce("_now", F.lit(False))).alias("opened"))
        seen = materialize(now.unionByName(found), "seen")
    return seen.select("query_id", "id", "score")
