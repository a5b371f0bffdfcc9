"""Exact nearest neighbours for any number of queries: a join by pivots with distance bounds.

Corpus vectors belong to the cell of their nearest pivot (by angle), and a large cell is cut
into rings by angle to its pivot and these into bounded pieces. Each piece has the range of
its angles and lengths. As angles obey the triangle inequality, that bounds the score that any
row of the piece can have with a query. A query is first scored against its most promising
pieces, which gives a k-th best score; after that it visits only the pieces whose bound is not
below it. Neighbouring pieces form shards, and a query goes once to a shard, with the numbers of
the pieces it visits there. What is shuffled are these visits and the rows of visited shards; a
shard with very many visits is repeated for bounded parts of them, so every task is bounded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.storage import materialize, text_batches

#: Pivots are corpus rows; their number is bounded, so they are broadcast.
LEAST_PIVOTS, PIVOTS, CELL_ROWS = 16, 256, 500
RINGS = 64
PIECE_ROWS = 20_000
#: Piece bounds (some 50 bytes each) are broadcast; beyond this many, pieces get larger.
MOST_PIECES = 200_000
QUERY_ROWS = 50_000
#: Hits that a group of queries may find, so a larger k has fewer queries in a group; and queries that are scored at a time.
HITS, ASKED_ROWS = 500_000, 1 << 14
#: Partitions for the groups of queries and shards; beyond this many, a task has several.
GROUPS = 2000
#: A shard has so many rows (one piece at least), and less in a small corpus, so that there are some ``SHARDS``.
SHARD_ROWS, SHARDS = 50_000, 32
#: Scores have six digits, so a bound that is lower by less than a rounding step may still tie.
SLACK = 2e-6
ANGLE_SLACK = 1e-6
#: Cells of a task's matrices: a block of scores stays in the cache of a core.
CELLS = 1 << 18
#: Queries and rows of a block; pairs that wait to be merged with the hits; and the share of pairs (one in so many) above which all are scored.
BLOCK, WAITING, DENSE = 512, 1 << 14, 16
#: Values in one batch of visits, which both sides hold: 2 MB.
VISIT_VALUES = 1 << 18


def as_matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Vectors as rows; all must have one length."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        sizes = np.diff(column.offsets.to_numpy())
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    else:
        raise TypeError("vectors must be arrays")
    expected = width if width is not None else int(sizes[0]) if len(sizes) else 0
    if (sizes != expected).any():
        raise ValueError("query and corpus vectors differ in length")
    return flat.reshape(len(sizes), expected)


def unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions and lengths; a vector of zeros has no direction and stays."""
    length = np.sqrt((vectors * vectors).sum(axis=1))
    return vectors / np.where(length > 0, length, 1.0)[:, None], length


def rounded(x: np.ndarray) -> np.ndarray:
    """Six digits, halves away from zero."""
    return np.copysign(np.floor(np.abs(x) * 1e6 + 0.5) / 1e6, x) + 0.0


def block_scores(queries: np.ndarray, vectors: np.ndarray, metric: str) -> np.ndarray:
    raw = queries @ vectors.T
    if metric == "dot":
        return rounded(raw)
    squares = np.outer((queries * queries).sum(1), (vectors * vectors).sum(1))
    with np.errstate(divide="ignore", invalid="ignore"):
        return rounded(np.where(squares > 0, raw / np.sqrt(squares), 0.0))


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the columns of the k best by (score descending, id ascending), as row and column index."""
    rows, columns = scores.shape
    if columns <= k:
        return np.repeat(np.arange(rows), columns), np.tile(np.arange(columns), rows)
    kth = np.partition(scores, columns - k, axis=1)[:, columns - k]
    row, column = np.nonzero(scores >= kth[:, None])
    order = np.lexsort((ids[column], -scores[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


class Bounds:
    """Pivots and, per piece, collection, cell, and ranges of angle and length."""

    def __init__(self, pivots: np.ndarray, pieces: pd.DataFrame, metrics: dict[str, str]) -> None:
        self.pivots, self.metrics = pivots, metrics
        pieces = pieces.sort_values("piece")
        self.piece, self.rows = pieces["piece"].to_numpy(np.int64), pieces["rows"].to_numpy(np.int64)
        self.collection, self.cell = pieces["collection"].to_numpy(object), pieces["cell"].to_numpy(np.int64)
        self.low, self.high, self.short, self.long = (pieces[c].to_numpy(np.float64) for c in ("low", "high", "short", "long"))
        self.shard = pieces["shard"].to_numpy(np.int64)

    def best_scores(self, queries: np.ndarray, collections: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The highest score each piece can have with each query, and the angle to its pivot."""
        directions, length = unit(queries)
        angles = np.arccos(np.clip(directions @ self.pivots.T, -1.0, 1.0)) if len(self.pivots) else np.zeros((len(queries), 1))
        to_pivot = angles[:, np.maximum(self.cell, 0)]
        apart = np.maximum(to_pivot - self.high, self.low - to_pivot) - ANGLE_SLACK
        highest = np.cos(np.clip(apart, 0.0, math.pi))
        dots = np.array([self.metrics[c] == "dot" for c in self.collection])
        if dots.any():
            scaled = length[:, None] * np.where(highest[:, dots] >= 0, self.long[dots], self.short[dots]) * highest[:, dots]
            highest[:, dots] = scaled + 1e-9 * np.abs(scaled)
        highest[:, self.cell < 0] = 0.0
        highest[length == 0] = 0.0
        highest[collections[:, None] != self.collection[None, :]] = -np.inf
        return highest, to_pivot

    def visits(
        self, queries: np.ndarray, collections: np.ndarray, least: np.ndarray | None, k: int
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Query and place of the piece, by query, for some queries at a time: the first pieces, or given a k-th best score all the others that matter."""
        step = max(1, CELLS // max(1, len(self.piece)))
        for first in range(0, len(queries), step):
            highest, to_pivot = self.best_scores(queries[first : first + step], collections[first : first + step])
            order = np.lexsort((np.broadcast_to(self.piece, highest.shape), to_pivot, -highest), axis=1)
            before = np.cumsum(self.rows[order], axis=1) - self.rows[order]
            home = np.zeros(highest.shape, bool)
            np.put_along_axis(home, order, before < k, axis=1)
            home &= highest > -np.inf
            chosen = home if least is None else ~home & (highest >= least[first : first + step, None] - SLACK)
            row, place = np.nonzero(chosen)
            yield row + first, place


def pivot_count(rows: int) -> int:
    """A cell should have enough rows for a product of matrices to be worth a task's visit."""
    return min(PIVOTS, max(LEAST_PIVOTS, rows // CELL_ROWS))


def pivot_rows(corpus: DataFrame, count: int) -> np.ndarray:
    """Directions of ``count`` rows, taken evenly by a hash of their id."""
    spoken = corpus.where(F.exists("embedding", lambda x: x != 0))
    rows = spoken.orderBy(F.xxhash64("id"), "id").limit(count).select("embedding").collect()
    if not rows:
        return np.zeros((0, 0))
    vectors = [np.asarray(r["embedding"], np.float64) for r in rows]
    if len({len(v) for v in vectors}) > 1:
        raise ValueError("query and corpus vectors differ in length")
    return unit(np.stack(vectors))[0]


def placed(corpus: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``collection, id, embedding, cell, angle, length`` of every corpus row; cell -1 has the zeros."""
    shared = corpus.sparkSession.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            directions, length = unit(as_matrix(batch.column("embedding"), known.shape[1] if len(known) else None))
            near = directions @ known.T if len(known) else np.zeros((len(length), 1))
            cell = np.where(length > 0, near.argmax(axis=1), -1).astype(np.int32)
            angle = np.arccos(np.clip(near.max(axis=1, initial=-1.0), -1.0, 1.0))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("collection", "id", "embedding")), pa.array(cell), pa.array(angle), pa.array(length)],
                ["collection", "id", "embedding", "cell", "angle", "length"],
            )

    kind = corpus.schema["embedding"].dataType.simpleString()
    return corpus.select("collection", F.col("id").cast("bigint").alias("id"), "embedding").mapInArrow(
        place, f"collection string, id bigint, embedding {kind}, cell int, angle double, length double"
    )


def in_pieces(rows: DataFrame) -> tuple[DataFrame, pd.DataFrame]:
    """Rows with ``piece``, and the bounds of each piece.

    Rings are cut only where a cell is large, and a ring into hashed parts only where it still
    is, as one that holds many equal vectors. So pieces have some ``PIECE_ROWS`` rows.
    """
    cells = materialize(rows.groupBy("collection", "cell").agg(F.count("*").alias("n")), "cells")
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    most = max(PIECE_ROWS, math.ceil(4 * total / MOST_PIECES))
    ring = F.when(F.col("n") > most, F.least(F.floor(F.col("angle") / math.pi * RINGS), F.lit(RINGS - 1))).otherwise(F.lit(0)).cast("int")
    ringed = rows.join(F.broadcast(cells), ["collection", "cell"]).withColumn("ring", ring).drop("n")
    rings = ringed.groupBy("collection", "cell", "ring").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    # Numbered by name: at most a few pieces for ``most`` rows, beside the cells and rings.
    numbered = rings.withColumn("first", F.sum("parts").over(Window.orderBy("collection", "cell", "ring")) - F.col("parts"))
    numbered = materialize(numbered.withColumn("first", F.col("first").cast("bigint")), "rings")
    piece = F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))
    pieced = ringed.join(F.broadcast(numbered), ["collection", "cell", "ring"]).withColumn("piece", piece).drop("ring", "parts", "first")
    bounds = pieced.groupBy("piece").agg(
        F.first("collection").alias("collection"), F.first("cell").alias("cell"), F.min("angle").alias("low"), F.max("angle").alias("high"),
        F.min("length").alias("short"), F.max("length").alias("long"), F.count("*").alias("rows"),
    )
    known = sharded(bounds.toPandas())
    # An Arrow table becomes rows on the JVM's side; a pandas one would start Python workers of another kind, which stay.
    shards = pieced.sparkSession.createDataFrame(pa.table({c: pa.array(known[c], pa.int64()) for c in ("piece", "shard")}))
    return pieced.join(F.broadcast(shards), "piece").select("shard", "piece", "collection", "id", "embedding"), known


def sharded(bounds: pd.DataFrame) -> pd.DataFrame:
    """Bounds with ``shard``: pieces of one collection in the order of their numbers, up to some ``SHARD_ROWS`` rows."""
    bounds = bounds.sort_values("piece")
    most = min(SHARD_ROWS, max(1, -(-int(bounds["rows"].sum()) // SHARDS)))
    shards, held, last = [], 0, None
    for rows, collection in zip(bounds["rows"].tolist(), bounds["collection"].tolist(), strict=True):
        if not shards or collection != last or held + rows > most:
            shards.append(shards[-1] + 1 if shards else 0)
            held, last = 0, collection
        else:
            shards.append(shards[-1])
        held += rows
    return bounds.assign(shard=np.array(shards, np.int64))


def visiting(queries: DataFrame, shared, k: int, bounded: bool) -> DataFrame:
    """``shard, pieces, query_id, collection, query_vec`` of every visit; ``bounded`` queries carry ``least``.

    Visits come in batches of some ``VISIT_VALUES`` values, however many pieces a query visits.
    """
    carried = ["query_id", "collection", "query_vec", *(["least"] if bounded else [])]

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, pieces, metrics = shared.value
        known = Bounds(pivots, pieces, metrics)
        for batch in batches:
            vectors = as_matrix(batch.column("query_vec"), pivots.shape[1] if len(pivots) else None)
            collections = np.array(batch.column("collection").to_pylist(), dtype=object)
            least = np.array([-np.inf if x is None else x for x in batch.column("least").to_pylist()]) if bounded else None
            most = max(1, VISIT_VALUES // max(1, vectors.shape[1]))
            for row, place in known.visits(vectors, collections, least, k):
                shard = known.shard[place]
                starts = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (shard[1:] != shard[:-1])])) if len(row) else row
                for first in range(0, len(starts), most):
                    own = starts[first : first + most]
                    end = starts[first + most] if first + most < len(starts) else len(row)
                    lists = pa.ListArray.from_arrays(pa.array(np.append(own, end) - own[0], pa.int32()), pa.array(known.piece[place[own[0] : end]]))
                    chosen = batch.select(carried).take(pa.array(row[own]))
                    yield pa.RecordBatch.from_arrays([pa.array(shard[own]), lists, *chosen.columns], ["shard", "pieces", *carried])

    fields = {f.name: f.dataType.simpleString() for f in queries.schema.fields}
    schema = f"shard bigint, pieces array<bigint>, query_id {fields['query_id']}, collection string, query_vec {fields['query_vec']}"
    return queries.select(*carried).mapInArrow(visit, schema + (", least double" if bounded else ""))


class Side(NamedTuple):
    """One side of the pairs that are scored: vectors, squared lengths, and single-precision directions to sieve pairs by.

    Directions are the vectors over their length, or over ``longest`` if that is given.
    """

    vectors: np.ndarray
    squares: np.ndarray
    directions: np.ndarray

    @classmethod
    def of(cls, vectors: np.ndarray, longest: float | None = None) -> Side:
        squares = (vectors * vectors).sum(axis=1)
        scale = np.sqrt(squares)[:, None] if longest is None else np.full((1, 1), longest)
        return cls(vectors, squares, (vectors / np.where(scale > 0, scale, 1.0)).astype(np.float32))

    def part(self, some: np.ndarray | slice) -> Side:
        return Side(*(x[some] for x in self))


def least_products(least: np.ndarray, length: np.ndarray | float, width: int) -> np.ndarray:
    """What the single-precision product of two directions is at least if the score reaches ``least``; ``length`` is that of a score of 1.

    A product of ``width`` terms is off by less than ``width + 4`` units of rounding.
    """
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        bound = np.where(length > 0, (least - SLACK) / length, -np.inf)
    return np.minimum(bound - 1.5 * (width + 4) * 2.0**-24, 2.0).astype(np.float32)


def sieved(asked: np.ndarray, rows: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the products that reach the ``least`` of their row."""
    passed = (asked @ rows.T >= least[:, None]).ravel()
    # Few pass, so eight are looked at at a time.
    eights = len(passed) // 8 * 8
    some = np.flatnonzero(passed[:eights].view(np.uint64))
    near = (some[:, None] * 8 + np.arange(8)).ravel()
    near = np.concatenate([near[passed[near]], eights + np.flatnonzero(passed[eights:])])
    return np.divmod(near, max(1, len(rows)))


def single_scores(queries: Side, rows: Side, row: np.ndarray, column: np.ndarray, metric: str) -> np.ndarray:
    """Scores of single pairs, as ``block_scores`` has them."""
    raw = np.einsum("ij,ij->i", queries.vectors[row], rows.vectors[column])
    if metric == "dot":
        return rounded(raw)
    squares = queries.squares[row] * rows.squares[column]
    with np.errstate(divide="ignore", invalid="ignore"):
        return rounded(np.where(squares > 0, raw / np.sqrt(squares), 0.0))


def best_rows(row: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best hits of every row, by row, score descending and id ascending."""
    order = np.lexsort((ids, -scores, row))
    row = row[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], ids[order[kept]], scores[order[kept]]


class Best:
    """The k best hits so far of every query, and the score that a further one must reach. New hits wait, and some are merged at a time."""

    def __init__(self, least: np.ndarray, k: int) -> None:
        self.k, self.least, self.count = k, least.copy(), np.zeros(len(least), np.int64)
        self.ids, self.scores = np.zeros((len(least), k), np.int64), np.zeros((len(least), k))
        self.waiting: list[tuple[np.ndarray, ...]] = []

    def add(self, row: np.ndarray, ids: np.ndarray, scores: np.ndarray, at_once: bool) -> None:
        reached = ~(scores < self.least[row])
        self.waiting.append((row[reached], ids[reached], scores[reached]))
        if at_once or sum(len(found[0]) for found in self.waiting) > WAITING:
            self.merge()

    def merge(self) -> None:
        if not self.waiting:
            return
        row, ids, scores = (np.concatenate(parts) for parts in zip(*self.waiting, strict=True))
        self.waiting = []
        touched, new = np.unique(row, return_inverse=True)
        held = np.arange(self.k) < self.count[touched, None]
        row, ids, scores = best_rows(
            np.concatenate([np.nonzero(held)[0], new]),
            np.concatenate([self.ids[touched][held], ids]),
            np.concatenate([self.scores[touched][held], scores]),
            self.k,
        )
        place = np.arange(len(row)) - np.searchsorted(row, row)
        self.ids[touched[row], place], self.scores[touched[row], place] = ids, scores
        self.count[touched] = np.bincount(row, minlength=len(touched))
        full = touched[self.count[touched] == self.k]
        self.least[full] = np.fmax(self.least[full], self.scores[full, -1])

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.merge()
        row, place = np.nonzero(np.arange(self.k) < self.count[:, None])
        return row, self.ids[row, place], self.scores[row, place]


def best_in(best: Best, own: np.ndarray, queries: Side, rows: Side, ids: np.ndarray, metric: str, longest: float) -> None:
    """Add to the hits of the queries ``own`` those of ``rows``; pairs are sieved by single-precision products.

    Without a bound, or where very many pairs pass, a block is scored as a whole.
    """
    length = np.sqrt(queries.squares) * longest if metric == "dot" else 1.0
    start = 0
    while start < len(ids):
        least = best.least[own]
        whole = np.isneginf(least).any()
        end = start + (max(best.k, BLOCK) if whole else BLOCK)
        part, names = rows.part(slice(start, end)), ids[start:end]
        start = end
        if not whole:
            row, column = sieved(queries.directions, part.directions, least_products(least, length, queries.vectors.shape[1]))
            whole = len(row) * DENSE > len(own) * len(names)
        if whole:
            scores = block_scores(queries.vectors, part.vectors, metric)
            row, column = best_of(scores, names, best.k)
            best.add(own[row], names[column], scores[row, column], True)
        else:
            best.add(own[row], names[column], single_scores(queries, part, row, column, metric), False)


def best_of_pieces(
    queries: np.ndarray, guest: np.ndarray, host: np.ndarray, least: np.ndarray, vectors: np.ndarray, ids: np.ndarray, piece: np.ndarray, metric: str, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of the query, id and score of its k best in all the pieces it visits: query ``guest`` visits piece ``host``.

    Rows are in the order of ``piece``. Only k hits of a query are held at any time, and the k-th is its
    bound for the pieces that follow.
    """
    longest = math.sqrt((vectors * vectors).sum(axis=1).max(initial=0.0))
    asked, rows = Side.of(queries), Side.of(vectors, longest if metric == "dot" else None)
    best, block = Best(least, k), guest // BLOCK
    order = np.lexsort((host, block))
    guest, host, block = guest[order], host[order], block[order]
    starts = np.flatnonzero((np.diff(host, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
    for own, one in zip(np.split(guest, starts[1:]), host[starts].tolist(), strict=True) if len(starts) else ():
        held = slice(np.searchsorted(piece, one), np.searchsorted(piece, one, "right"))
        best_in(best, own, asked.part(own), rows.part(held), ids[held], metric, longest)
    return best.hits()


def scored(visits: DataFrame, pieced: DataFrame, metrics: dict[str, str], k: int) -> DataFrame:
    """``query_id, id, score``: the k best of the visited pieces of every shard, without those below the query's ``least`` if it has one."""
    visits = materialize(visits, "visits")
    bounded = "least" in visits.columns
    most = max(1, min(QUERY_ROWS, HITS // max(1, k)))
    fans = materialize(visits.groupBy("shard").agg(F.ceil(F.count("*") / most).cast("int").alias("fan")), "fans")
    asked = visits.join(F.broadcast(fans), "shard").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("fan")).cast("int"))
    rows = pieced.join(F.broadcast(fans), "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)))
    # The work of a group is not in its bytes, by which partitions would be merged.
    groups = max(1, min(GROUPS, fans.agg(F.coalesce(F.sum("fan"), F.lit(0))).head()[0]))
    kind = visits.schema["query_id"].dataType.simpleString()

    def score(asked_part: pa.Table, row_part: pa.Table) -> pa.Table:
        found: list[pa.Table] = []
        if asked_part.num_rows and row_part.num_rows:
            order = np.argsort(row_part.column("piece").to_numpy(), kind="stable")
            ids, piece = (row_part.column(c).to_numpy()[order] for c in ("id", "piece"))
            vectors = as_matrix(row_part.column("embedding").combine_chunks())[order]
            metric = metrics[asked_part.column("collection")[0].as_py()]
            for start in range(0, asked_part.num_rows, ASKED_ROWS):
                some = asked_part.slice(start, ASKED_ROWS).combine_chunks()
                queries = as_matrix(some.column("query_vec").combine_chunks(), vectors.shape[1])
                least = some.column("least").fill_null(-np.inf).to_numpy() if bounded else np.full(len(queries), -np.inf)
                lists = some.column("pieces").combine_chunks()
                guest, host = np.repeat(np.arange(len(queries)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
                row, near, value = best_of_pieces(queries, guest, host, least, vectors, ids, piece, metric, k)
                found.append(pa.table({"query_id": some.column("query_id").take(pa.array(row)), "id": near, "score": value}))
        if not found:
            found.append(pa.table({"query_id": asked_part.column("query_id").slice(0, 0), "id": np.zeros(0, np.int64), "score": np.zeros(0)}))
        return pa.concat_tables(found)

    columns = ["pieces", "query_id", "collection", "query_vec", *(["least"] if bounded else [])]
    return (
        asked.select("shard", "part", *columns).repartition(groups, "shard", "part").groupBy("shard", "part")
        .cogroup(rows.select("shard", "part", "piece", "id", "embedding").repartition(groups, "shard", "part").groupBy("shard", "part"))
        .applyInArrow(score, f"query_id {kind}, id bigint, score double")
    )


def knn_join(queries: DataFrame, corpus: DataFrame, k: int, metrics: dict[str, str], pivots: int | None = None) -> DataFrame:
    """``query_id, id, score`` candidates that hold the exact k best of every query.

    Queries and corpus carry ``collection``; a query is scored with the rows of its own one, by
    the metric named for it. Query ids are distinct.
    """
    # Vectors may still have to be made from texts.
    with text_batches(corpus.sparkSession):
        stored = materialize(corpus.select("collection", "id", "embedding"), "corpus")
        asked = materialize(queries.select("query_id", "collection", "query_vec"), "queries")
    known = pivot_rows(stored, pivots or pivot_count(stored.count()))
    rows = materialize(placed(stored, known), "placed")
    pieced, bounds = in_pieces(rows)
    shared = corpus.sparkSession.sparkContext.broadcast((known, bounds, metrics))
    first = materialize(scored(visiting(asked, shared, k, False), pieced, metrics, k), "first-hits")
    # A query with fewer than k hits so far has no bound.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    kth = first.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") == k).select("query_id", F.col("score").alias("least"))
    rest = scored(visiting(asked.join(kth, "query_id", "left"), shared, k, True), pieced, metrics, k)
    return first.unionByName(rest)


def search_work(queries: DataFrame, corpus: DataFrame, k: int, metrics: dict[str, str], pivots: int | None = None) -> DataFrame:
    """``query_id, pieces, pieces_visited, rows, rows_scored``: how much the bounds leave to be scored."""
    known = pivot_rows(corpus, pivots or pivot_count(corpus.count()))
    pieced, bounds = in_pieces(materialize(placed(corpus, known), "placed"))
    asked = materialize(queries.select("query_id", "collection", "query_vec"), "queries")
    shared = corpus.sparkSession.sparkContext.broadcast((known, bounds, metrics))
    visits = materialize(visiting(asked, shared, k, False), "visits")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    first = scored(visits, pieced, metrics, k).withColumn("_rank", F.row_number().over(order))
    kth = first.where(F.col("_rank") == k).select("query_id", F.col("score").alias("least"))
    both = visits.unionByName(visiting(asked.join(kth, "query_id", "left"), shared, k, True).drop("least")).withColumn("piece", F.explode("pieces"))
    sizes = pieced.groupBy("piece", "collection").agg(F.count("*").alias("n"))
    totals = sizes.groupBy("collection").agg(F.count("*").alias("pieces"), F.sum("n").alias("rows"))
    work = both.select("query_id", "collection", "piece").join(F.broadcast(sizes.drop("collection")), "piece")
    per_query = work.groupBy("query_id", "collection").agg(F.count("*").alias("pieces_visited"), F.sum("n").alias("rows_scored"))
    return per_query.join(F.broadcast(totals), "collection").select("query_id", "pieces", "pieces_visited", "rows", "rows_scored")
