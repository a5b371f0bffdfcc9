"""N-gram Jaccard join: documents whose shingle sets overlap enough, as components.

Method: grouped prefix join. A set is its distinct ``WIDTH``-word shingles (64-bit hashes).
Equal sets are one. In one global order of shingles two sets that reach the threshold share
an element among their first ``n - ceil(t * n) + 1`` (the prefix), wherever the order comes
from. It is used twice. First with hashes below the ``BAND``-th part of the hash range in front, by
document frequency, then all others by hash: only a fifth of the shingles is counted and
shuffled, and sets that share no prefix element with another set are done. For the candidates
left, whole sets are stored, and the order is by frequency over all their shingles, so that
shingles of one set alone come first and edited copies meet only what they can reach. Sets with
identical prefix and size collapse into one group; group pairs are filtered by size and by
the places of the common element; members of what remains are verified on their whole sets
with integer arithmetic.

Not all pairs inside a group of copies are compared. First every set meets the leader of each
of its buckets (the set with the fewest unique shingles), in a group its group's leader.
Found links give components. Then, in buckets that hold more than one component, the sets
outside the largest component meet every set of another component there: whatever link is
left must be among these, so no link between components is missed.

Results: one row per document row. ``n_shingles`` is the size of the set. ``component_id`` is
the smallest id reachable over links; null texts and texts without words have size 0 and
their own id; equal texts share a component; rows that repeat count once; a row with null
id gets the smallest id of its component, if it has one, and links like any other. An empty
table gives no rows. Only ``doc_id`` and ``text`` are read, whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from paperloom.llm.buffers import chained, mixed, not_white, slices, text_bytes, words
from paperloom.llm.folds import free_name
from paperloom.operators.components import components
from paperloom.storage import materialize

WIDTH = 4
PERCENT = 85
BAND = 5
EDGE = np.uint64((1 << 64) // BAND)
FLIP = np.uint64(1 << 63)
BROADCAST_SETS = 1_000_000
KEYED_ROWS = 256


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; texts of fewer words are one shingle."""
    *_, owner, hashes = words(data, offsets, not_white())
    bounds = np.searchsorted(owner, np.arange(len(offsets)))
    for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        mine = hashes[first:last]
        yield np.unique(chained(mine, min(width, len(mine)))) if len(mine) else mine


def set_key(shingles: np.ndarray) -> int:
    """64-bit name of a set, the same for equal sets."""
    total = int(mixed(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) + len(shingles)
    return int(mixed(np.array([total % (1 << 64)], np.uint64)).view(np.int64)[0])


def needed(size: int, percent: int) -> int:
    """Least common elements with a set of any size; ``ceil(percent * size / 100)``."""
    return (percent * size + 99) // 100


def _signed(hashes: np.ndarray) -> np.ndarray:
    """Signed form that keeps the order."""
    return (hashes ^ FLIP).view(np.int64)


def _each(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    data, all_offsets = text_bytes(batch.column("text"))
    for first, last in slices(all_offsets):
        base = all_offsets[first]
        for row, shingles in enumerate(shingle_sets(data[base : all_offsets[last]], all_offsets[first : last + 1] - base, width)):
            yield first + row, shingles


def members(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n, k`` of every row."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(s), set_key(s)) for _, s in _each(batch, width)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([n for n, _ in found], pa.int64()), pa.array([k for _, k in found], pa.int64())],
                ["doc_id", "n", "k"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(measure, f"doc_id {kind}, n bigint, k bigint")


def leading(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``k, n, band, front`` once per distinct set: the part that can hold the prefix.

    ``front`` is the band of small hashes, or as many of the smallest as the prefix is long.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, seen = [], set()
            for _, s in _each(batch, width):
                key = set_key(s)
                if len(s) and key not in seen:
                    seen.add(key)
                    band = int(np.searchsorted(s, EDGE))
                    rows.append((key, len(s), band, _signed(s[: max(band, len(s) - needed(len(s), percent) + 1)])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.list_(pa.int64()))],
                ["k", "n", "band", "front"],
            )

    found = docs.select("text").mapInArrow(cut, "k bigint, n bigint, band bigint, front array<bigint>")
    return found.groupBy("k").agg(F.first("n").alias("n"), F.first("band").alias("band"), F.first("front").alias("front"))


def prefixes(sets: DataFrame, percent: int, edge: int | None = None) -> DataFrame:
    """``k, n, alone, prefix`` of sets that can have a partner, from ``k, n, band, front``.

    ``prefix`` holds the shingles of the prefix that other sets have too, with their places;
    ``alone`` is the number of shingles in ``front`` that no other set has. The order is by
    frequency below ``edge`` (everywhere if there is none), then by hash.
    """
    posts = sets.select("k", F.explode("front").alias("h"))
    shared = posts.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    far = F.lit(0) if edge is None else (F.col("h") >= edge).cast("int")
    element = F.struct(far.alias("far"), F.when(far == 0, F.col("df")).otherwise(F.lit(0)).alias("df"), F.col("h").alias("h"))
    listed = posts.join(shared, "h").groupBy("k").agg(
        F.sort_array(F.collect_list(element)).alias("found"), F.count_if(far == 0).alias("near"), F.count("*").alias("met")
    )
    joined = sets.select("k", "n", "band", F.size("front").alias("_front")).join(listed, "k")
    # Shingles of this set alone come first in the band, so found ones begin after them.
    first = F.col("band") - F.col("near")
    length = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1
    inside = F.least(F.greatest(length - first, F.lit(0)), F.col("met")).cast("int")
    placed = joined.where(inside > 0).select("k", "n", (F.col("_front") - F.col("met")).alias("alone"), first.alias("first"), F.slice("found", F.lit(1), inside).alias("found"))
    return placed.select(
        "k", "n", "alone", F.transform("found", lambda x, i: F.struct(x["h"].alias("h"), (F.col("first") + i).alias("at"))).alias("prefix")
    )


def enough(percent: int, n: Column, at: Column, m: Column, other_at: Column) -> Column:
    """Whether sets of sizes n and m whose first common element has these places can link.

    They have at most one and what follows in both in common; a link needs
    ``percent / (100 + percent)`` of both sizes.
    """
    most = F.lit(1) + F.least(n - at, m - other_at) - 1
    return (most * (100 + percent) >= (n + m) * percent) & (F.least(n, m) * 100 >= F.greatest(n, m) * percent)


def whole_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``k, s``: whole sets of the wanted names, made from the texts.

    If at most ``BROADCAST_SETS`` sets are asked for, their names (8 bytes each) go to the
    tasks, which pass on only these sets; else all sets are made and a join picks them.
    """
    names = wanted.limit(BROADCAST_SETS + 1).toPandas()["k"].to_numpy(dtype=np.int64)
    few = len(names) <= BROADCAST_SETS
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(names) if few else None)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        for batch in batches:
            rows = {}
            for _, s in _each(batch, width):
                key = set_key(s)
                if len(s) and key not in rows:
                    if asked is not None:
                        at = int(np.searchsorted(asked, key))
                        if at == len(asked) or asked[at] != key:
                            continue
                    rows[key] = _signed(s)
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.array(list(rows.values()), pa.list_(pa.int64()))], ["k", "s"])

    sets = docs.select("text").mapInArrow(build, "k bigint, s array<bigint>")
    if not few:
        sets = sets.join(wanted, "k", "left_semi")
    return sets.groupBy("k").agg(F.first("s").alias("s"))


def verified(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs ``(a, b)`` of set names that link; whole sets meet at ``b``."""
    left = pairs.join(sets.select(F.col("k").alias("a"), F.col("s").alias("_a")), "a")
    both = left.join(sets.select(F.col("k").alias("b"), F.col("s").alias("_b")), "b")
    common = F.size(F.array_intersect("_a", "_b"))
    return both.select("a", "b", common.alias("c"), (F.size("_a") + F.size("_b")).alias("t")).where(F.expr(f"100 * c >= {percent} * (t - c)")).select("a", "b")


def candidates(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``k``: names of the sets whose prefix, by the cheap order, shares an element."""
    fronts = materialize(leading(docs, width, percent), "fronts")
    edge = int(_signed(np.array([EDGE]))[0])
    posts = materialize(prefixes(fronts, percent, edge).select("k", F.explode("prefix.h").alias("h")), "postings")
    shared = posts.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    return materialize(posts.join(shared, "h").select("k").distinct(), "candidates")


def linked_sets(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``id, root``: components of the sets that have links, by set name."""
    sets = materialize(whole_sets(docs, candidates(docs, width, percent), width), "sets")
    size = F.size("s").cast("bigint")
    found = prefixes(sets.select("k", size.alias("n"), size.alias("band"), F.col("s").alias("front")), percent)
    # Identical prefix and size: one group. A shingle of its own makes a prefix unique.
    same = F.when(F.col("alone") == 0, F.xxhash64("n", "prefix")).otherwise(F.col("k"))
    stored = materialize(found.withColumn("same", same), "prefixes")
    groups = stored.groupBy("same", "n", F.col("alone") == 0).agg(F.min("k").alias("g"))
    grouped = materialize(
        stored.join(groups.select("same", "n", "g"), ["same", "n"]).select("k", "n", "alone", "g", "prefix"), "groups"
    )
    posts = materialize(
        grouped.where("k = g").select("g", "n", "alone", F.explode("prefix").alias("e")).select("g", "n", "alone", "e.h", "e.at"), "postings"
    )
    # Leaders: the set with the fewest shingles of its own, compared to its size.
    typical = F.struct((F.col("alone") / F.col("n")).alias("own"), F.col("g").alias("g"), F.col("n").alias("n"), F.col("at").alias("at"))
    leaders = posts.groupBy("h").agg(F.min(typical).alias("l"), F.count("*").alias("c")).where("c > 1")
    star = (
        posts.join(leaders, "h")
        .where("g <> l.g")
        .where(enough(percent, F.col("n"), F.col("at"), F.col("l.n"), F.col("l.at")))
        .select(F.col("g").alias("a"), F.col("l.g").alias("b"))
        .unionByName(grouped.where("k <> g").select(F.col("k").alias("a"), F.col("g").alias("b")))
        .distinct()
    )
    first = materialize(verified(sets, materialize(star, "pairs"), percent), "links")
    roots = materialize(components(first), "roots")
    labelled = grouped.join(roots.withColumnRenamed("id", "k"), "k", "left").select(
        "k", "n", F.coalesce("root", "k").alias("root"), "prefix"
    )
    entries = materialize(labelled.select("k", "n", "root", F.explode("prefix").alias("e")).select("k", "n", "root", "e.h", "e.at"), "entries")
    shares = entries.groupBy("h", "root").agg(F.count("*").alias("c"))
    largest = shares.groupBy("h").agg(F.max(F.struct("c", "root")).alias("most"), F.count("*").alias("parts")).where("parts > 1")
    some = largest.select("h", F.col("most.root").alias("main"))
    open_entries = entries.join(some, "h").where("root <> main")
    a, b = open_entries.alias("a"), entries.join(some, "h").alias("b")
    rest = (
        a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.root") != F.col("b.root"))
               & enough(percent, F.col("a.n"), F.col("a.at"), F.col("b.n"), F.col("b.at")))
        .select(F.least("a.k", "b.k").alias("a"), F.greatest("a.k", "b.k").alias("b"))
        .distinct()
    )
    rest = materialize(rest, "pairs")
    if rest.limit(1).count() == 0:
        return roots
    return components(first.unionByName(verified(sets, rest, percent)))


def row_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n, k, component_id`` of every row of ``docs``."""
    rows = materialize(members(docs, width), "members")
    roots = linked_sets(docs, width, percent)
    least = rows.where("n > 0").groupBy("k").agg(F.min("doc_id").alias("least"))
    labelled = least.join(roots.withColumnRenamed("id", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    named = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    final = labelled.join(named, "root").select("k", "component_id", "root")
    own = rows.where("n = 0").select("doc_id", "n", "k", F.col("doc_id").alias("component_id"), F.lit(None).cast("bigint").alias("root"))
    linked = rows.where("n > 0").join(final, "k", "left").select("doc_id", "n", "k", "component_id", "root")
    return linked.unionByName(own)


def joined_documents(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``; see the module."""
    return row_components(docs, width, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row of each component, with all columns: the one with the smallest id.

    Rows without words all stay. Of rows with the same id and the same set one stays. Rows are
    named by id and set; the list of names to drop is broadcast up to ``BROADCAST_SETS``, else
    it is joined by a shuffle.
    """
    rows = materialize(row_components(docs, width, percent).where("n > 0").select("doc_id", "k", "root"), "components")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("k").alias("k"))
    # Stored, so that the join deals it anew and can split a component that holds very many rows.
    keep = materialize(rows.groupBy("root").agg(F.min(order).alias("o")).select("root", F.col("o.doc_id").alias("_id"), F.col("o.k").alias("_k")), "kept")
    names = materialize(rows.groupBy("root", "doc_id", "k").agg(F.count("*").alias("times")), "names")
    joined = names.join(keep, "root").select(
        F.col("doc_id").alias("_id"), F.col("k").alias("_k"), "times", (F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("k") == F.col("_k"))).alias("kept")
    )
    odd = materialize(joined.where("not kept or times > 1"), "dropped")

    key = free_name(docs, "_key")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, KEYED_ROWS):
                part = batch.slice(first, KEYED_ROWS)
                keys = [set_key(s) if len(s) else None for _, s in _each(part, width)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys, pa.int64())], [*part.schema.names, key])

    named = docs.mapInArrow(keyed, StructType([*docs.schema.fields, StructField(key, LongType())]))
    few = odd.count() <= BROADCAST_SETS
    mark = F.broadcast if few else (lambda df: df)
    same = named["doc_id"].eqNullSafe(odd["_id"]) & (named[key] == odd["_k"])
    main = named.join(mark(odd), same, "left_anti").select(*docs.columns)
    repeats = odd.where("kept")
    if repeats.limit(1).count() == 0:
        return main
    again = named.join(mark(repeats), same, "left_semi").dropDuplicates(["doc_id", key]).select(*docs.columns)
    return main.unionByName(again)
