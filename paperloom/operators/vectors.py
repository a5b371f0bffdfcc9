"""Vector search: exact join by pivots, a neighbour graph for approximate search, embeddings."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import tokens, word_codes, word_slices
from paperloom.operators.neighbours import BEAM, HOPS, KEPT, Graph, beam_search, neighbour_graph
from paperloom.operators.pivots import knn_join
from paperloom.operators.skew import top_rows

SCORE_DIGITS = 6
#: Hashed words that a task remembers (some 40 MB), beside those of the rows at hand.
KNOWN_WORDS = 1 << 18


def embed_hashing(docs: DataFrame, id_col: str, text_col: str, dims: int = 64, unit: bool = True) -> DataFrame:
    """Signed feature hashing of word counts (Weinberger et al. 2009), inside each row.

    Words are split in Spark; a batched function hashes each distinct word of some rows once, or
    finds it among those it hashed before, and adds up. Nothing is exchanged. With ``unit=False`` the integer sums are kept, which
    cosine treats the same. A text without words has a vector of zeros.
    """

    def mark(word: str) -> int:
        return int.from_bytes(hashlib.md5(word.encode()).digest()[:2])

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in (part for whole in batches for part in word_slices(whole)):
            owner, codes, distinct = word_codes(batch.column("words"))
            if len(known) > KNOWN_WORDS:
                known.clear()
            fresh = [w for w in distinct if w not in known]
            known.update(zip(fresh, map(mark, fresh), strict=True))
            marks = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))
            cells, signs = marks % dims, np.where(marks // dims % 2 == 1, -1.0, 1.0)
            sums = np.bincount(owner * dims + cells[codes], weights=signs[codes], minlength=batch.num_rows * dims).reshape(-1, dims)
            if unit:
                length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
                sums = sums / np.where(length > 0, length, 1.0)
            vectors = pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * dims, pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), vectors], [id_col, "embedding"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, tokens(F.col(text_col)).alias("words")).mapInArrow(embed, f"{id_col} {kind}, embedding array<double>")


def vector_search(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "cosine", pivots: int | None = None) -> DataFrame:
    """Exact top-k of ``corpus(id, embedding)`` for each of ``queries(query_id, query_vec)``.

    A join by pivots (``operators/pivots.py``): one way for any number of queries, neither
    side is broadcast, and only pieces of the corpus that can hold a better row are scored.
    """
    one = F.lit("all").alias("collection")
    asked, rows = queries.select("query_id", "query_vec", one), corpus.select("id", "embedding", one)
    found = knn_join(asked, rows, k, {"all": metric}, pivots)
    return top_rows(found, ["query_id"], [F.desc("score"), F.asc("id")], k)


def search_collections(
    queries: DataFrame, corpus: DataFrame, metrics: dict[str, str], k: int
) -> DataFrame:
    """Search each named collection with its own metric, all in one join.

    Both inputs carry ``collection``. A query for a collection that is not configured is
    an error, as is one for a content type that has an embedder but no collection.
    """
    unknown = queries.where(~F.col("collection").isin(*metrics)).select("collection").head()
    if unknown is not None:
        raise KeyError(f"no such collection: {unknown['collection']}")
    found = knn_join(queries, corpus.where(F.col("collection").isin(*metrics)), k, metrics)
    ranked = top_rows(found, ["query_id"], [F.desc("score"), F.asc("id")], k)
    return ranked.join(queries.select("query_id", "collection"), "query_id")


def dot(a: Column, b: Column) -> Column:
    """Dot product of two array columns, in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    squares = dot(a, a) * dot(b, b)
    return F.when(squares > 0, dot(a, b) / F.sqrt(squares)).otherwise(F.lit(0.0))


def vector_search_ann(
    queries: DataFrame, corpus: DataFrame, k: int, graph: Graph | None = None, beam: int = BEAM, kept: int = KEPT, hops: int = HOPS
) -> DataFrame:
    """Approximate cosine top-k by beam search over a neighbour graph (``operators/neighbours.py``).

    The graph of ``corpus(id, embedding)`` is built unless one is given; build it once for many
    searches. Vectors of zeros have no direction: they are neither found nor can they ask.
    """
    seen = beam_search(queries, graph or neighbour_graph(corpus), beam, max(kept, k), hops)
    return top_rows(seen, ["query_id"], [F.desc("score"), F.asc("id")], k)
