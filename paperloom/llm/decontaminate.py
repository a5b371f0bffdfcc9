"""Benchmark decontamination by winnowing.

Method: of every ``WINDOW`` consecutive ``GRAM``-word hashes the smallest is a fingerprint, in
documents and items alike. A shared run of ``GRAM + WINDOW - 1`` (13) words holds one whole
window on both sides, so both sides keep its smallest hash: no shared run of 13 words is
missed. Equal fingerprints are hits; each is extended to both sides while the words agree,
and a run of 13 or more words marks its document words. Where repeated words make very many
hits of one item, runs are read off its consecutive shared windows instead. Items of fewer than 13 words are
looked up by the hash of their whole word sequence at every place.

The index of the items (fingerprints, places, word hashes: some 30 bytes a word) is broadcast
only if the benchmark has at most ``BROADCAST_WORDS`` words, which is counted first. Beyond
that, fingerprints of documents and items meet in a Spark join, and only the pairs found are
extended. Both ways give the same rows. Words are compared by 64-bit hashes.

Results: one row per document row. Null text has no words, nothing hit and no items; empty
texts likewise. Items with null or wordless text have no window; items of one id that
repeat count once. A null ``item_id`` cannot be named in a digest, so such an item is left
out of ``n_items`` and the digest, though its words count as hit. Repeated document rows are
each judged. An empty table of either kind is fine. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.buffers import byte_class, chained, mixed, shared_object, slices, text_bytes, words
from paperloom.llm.folds import free_name
from paperloom.storage import materialize

GRAM = 6
WINDOW = 8
SPAN = GRAM + WINDOW - 1
BROADCAST_WORDS = 1_000_000
FILTER_ROWS = 1000
#: Equal grams of one text and one item that are extended one by one.
FEW_PAIRS = 256
EMPTY_DIGEST = hashlib.sha256(b"").hexdigest()


def word_bytes() -> np.ndarray:
    """Bytes of words: digits, letters and everything beyond ASCII."""
    return byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and word offsets of the texts."""
    *_, owner, hashes = words(data, offsets, word_bytes())
    return hashes, np.searchsorted(owner, np.arange(len(offsets)))


def winnowed(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest hash of each full window inside one text, and the word place where it begins."""
    grams = chained(hashes, GRAM)
    count = len(grams) - WINDOW + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    least = grams[:count].copy()
    for step in range(1, WINDOW):
        np.minimum(least, grams[step : step + count], out=least)
    inside = np.zeros(len(hashes), bool)
    for first, last in zip(offsets[:-1], offsets[1:], strict=True):
        if last - first >= SPAN:
            inside[first : last - SPAN + 1] = True
    places = np.flatnonzero(inside[:count])
    return least[places], places


class Items:
    """Items with an index from winnowed grams and from short whole sequences."""

    def __init__(self, names: list[str | None], texts: list[str | None]) -> None:
        self.names = names
        data, offsets = text_bytes(pa.array(texts, pa.string()))
        self.hashes, self.offsets = word_hashes(data, offsets)
        least, _ = winnowed(self.hashes, self.offsets)
        prints = np.unique(least)
        grams = chained(self.hashes, GRAM)
        size = np.diff(self.offsets)
        owner = np.repeat(np.arange(len(names)), size)
        at = np.flatnonzero(np.isin(grams, prints))
        at = at[owner[at] == owner[at + GRAM - 1]]
        order = np.argsort(grams[at], kind="stable")
        self.keys, self.places, self.owner = grams[at][order], at[order], owner
        self.short: dict[int, dict[int, list[int]]] = {}
        for item in np.flatnonzero((size > 0) & (size < SPAN)).tolist():
            run = self.hashes[self.offsets[item] : self.offsets[item + 1]]
            self.short.setdefault(len(run), {}).setdefault(int(chained(run, len(run))[0]), []).append(item)

    def spans(self, hashes: np.ndarray, likely: np.ndarray | None = None) -> list[tuple[int, int, int]]:
        """``(first word, end, item)`` of every maximal shared run in one document's words."""
        found: list[tuple[int, int, int]] = []
        if len(hashes) >= SPAN and len(self.keys) and (likely is None or likely.any()):
            found = self._long_spans(hashes)
        for width, known in self.short.items():
            runs = chained(hashes, width)
            keys = np.fromiter(known, np.uint64, len(known))
            for at in np.flatnonzero(np.isin(runs, keys)).tolist():
                found += [(at, at + width, item) for item in known[int(runs[at])]]
        return found

    def _long_spans(self, hashes: np.ndarray) -> list[tuple[int, int, int]]:
        """Shared runs of ``SPAN`` or more words, item by item, in time linear in text and index.

        Every equal gram of an item is counted first. Where they are few, each is extended to
        both sides. Words that repeat make them as many as the product of both lengths; there
        a run is what consecutive shared windows cover, which takes the same words.
        """
        grams = chained(hashes, GRAM)
        gram, kind, uses = np.unique(grams, return_inverse=True, return_counts=True)
        low, high = np.searchsorted(self.keys, gram, side="left"), np.searchsorted(self.keys, gram, side="right")
        size = high - low
        if not size.any():
            return []
        which = np.repeat(np.arange(len(gram)), size)
        places = self.places[np.arange(len(which)) + np.repeat(low - (np.cumsum(size) - size), size)]
        order = np.argsort(self.owner[places], kind="stable")
        which, places = which[order], places[order]
        items, first = np.unique(self.owner[places], return_index=True)
        by_kind = np.argsort(kind, kind="stable")
        begin = np.cumsum(uses) - uses
        windows: np.ndarray | None = None
        found: list[tuple[int, int, int]] = []
        for item, start, stop in zip(items.tolist(), first.tolist(), [*first[1:].tolist(), len(places)], strict=True):
            if int(uses[which[start:stop]].sum()) > FEW_PAIRS:
                windows = chained(hashes, SPAN) if windows is None else windows
                found += [(a, b, item) for a, b in self._by_windows(windows, item)]
                continue
            pairs = [
                (at, place) for g, place in zip(which[start:stop].tolist(), places[start:stop].tolist(), strict=True)
                for at in by_kind[begin[g] : begin[g] + uses[g]].tolist()
            ]
            reach: dict[int, int] = {}
            for at, place in sorted(pairs):
                if reach.get(place - at, -1) >= at + GRAM:
                    continue
                begins, ends = self._extended(hashes, at, place, item)
                reach[place - at] = ends
                if ends - begins >= SPAN:
                    found.append((begins, ends, item))
        return found

    def _by_windows(self, windows: np.ndarray, item: int) -> list[tuple[int, int]]:
        """Stretches of a text that windows of an item cover, from hashes of all its windows."""
        shared = np.isin(windows, chained(self.hashes[self.offsets[item] : self.offsets[item + 1]], SPAN))
        turns = np.flatnonzero(np.diff(np.concatenate([[False], shared, [False]]).astype(np.int8)))
        return [(a, b + SPAN - 1) for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True)]

    def _extended(self, hashes: np.ndarray, at: int, place: int, item: int) -> tuple[int, int]:
        """The run of equal words around a common gram."""
        back = min(at, place - int(self.offsets[item]))
        same = hashes[at - back : at][::-1] == self.hashes[place - back : place][::-1]
        first = at - (back if same.all() else int(np.argmin(same)))
        ahead = min(len(hashes) - at, int(self.offsets[item + 1]) - place)
        same = hashes[at : at + ahead] == self.hashes[place : place + ahead]
        return first, at + (ahead if same.all() else int(np.argmin(same)))


def covered(spans: list[tuple[int, int, int]], count: int) -> int:
    """Number of words inside any of the spans."""
    change = np.zeros(count + 1, np.int64)
    for first, last, _ in spans:
        change[first] += 1
        change[last] -= 1
    return int((np.cumsum(change[:-1]) > 0).sum())


def digest(names: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def _schema(docs: DataFrame) -> str:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return f"doc_id {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string"


def _verdict(rows: DataFrame, share: int) -> DataFrame:
    return rows.withColumn("contaminated", F.expr(f"n_hit > 0 and {share} * n_hit >= n_words"))


def _judged(index: Items, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Words, hit words, items and digest of each text of a batch."""
    prints = np.unique(index.keys)
    data, all_offsets = text_bytes(column)
    n = len(column)
    n_words, n_hit, n_items = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    digests = [EMPTY_DIGEST] * n
    for first, last in slices(all_offsets):
        base = all_offsets[first]
        hashes, offsets = word_hashes(data[base : all_offsets[last]], all_offsets[first : last + 1] - base)
        n_words[first:last] = np.diff(offsets)
        least, places = winnowed(hashes, offsets)
        owner = np.searchsorted(offsets, places, side="right")
        fresh = np.ones(len(least), bool)
        fresh[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
        least, owner = least[fresh], owner[fresh]
        todo = set(owner[np.isin(least, prints)].tolist())
        for width, known in index.short.items():
            keys = np.fromiter(known, np.uint64, len(known))
            at = np.flatnonzero(np.isin(chained(hashes, width), keys))
            todo |= set(np.searchsorted(offsets, at, side="right").tolist())
        for doc in (d - 1 for d in todo):
            mine = hashes[offsets[doc] : offsets[doc + 1]]
            spans = index.spans(mine)
            names = {index.names[item] for *_, item in spans} - {None}
            n_hit[first + doc] = covered(spans, len(mine))
            n_items[first + doc], digests[first + doc] = len(names), digest(names)
    return n_words, n_hit, n_items, digests


def _with_broadcast(docs: DataFrame, items: Items) -> DataFrame:
    shared = shared_object(docs.sparkSession, items)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared()
        for batch in batches:
            n_words, n_hit, n_items, digests = _judged(index, batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words), pa.array(n_hit), pa.array(n_items), pa.array(digests)],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(judge, _schema(docs))


def _prints(texts: DataFrame, key: str, widths: list[int]) -> DataFrame:
    """Distinct fingerprints of each text, and its runs of the short widths."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, all_offsets = text_bytes(batch.column("text"))
            for first, last in slices(all_offsets):
                base = all_offsets[first]
                hashes, offsets = word_hashes(data[base : all_offsets[last]], all_offsets[first : last + 1] - base)
                rows = []
                for doc in range(last - first):
                    mine = hashes[offsets[doc] : offsets[doc + 1]]
                    least, _ = winnowed(mine, np.array([0, len(mine)]))
                    short = [mixed(chained(mine, width) ^ np.uint64(width)) for width in widths]
                    rows.append(np.unique(np.concatenate([least, *short])).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key).slice(first, last - first), pa.array(rows, pa.list_(pa.int64()))], [key, "prints"]
                )

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, "text").mapInArrow(emit, f"{key} {kind}, prints array<bigint>").select(
        key, F.explode("prints").alias("print")
    )


def _with_join(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The way for a benchmark of any size: fingerprints meet in a join, pairs are extended.

    Equal texts are one text here (named by its sha2), so rows may repeat or lack ids.
    """
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("t", F.sha2("text", 256))
    texts = texts.groupBy("t").agg(F.first("text").alias("text"))
    own = items.select(F.col("item_id").cast("string").alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("i", F.sha2("text", 256))
    bodies = own.groupBy("i").agg(F.first("text").alias("item"))

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = word_hashes(*text_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(offsets))], ["n"])

    sizes = own.select("text").mapInArrow(size, "n bigint").where(f"n > 0 and n < {SPAN}").distinct()
    widths = sorted(r["n"] for r in sizes.collect())  # at most SPAN - 1 rows
    pairs = (
        _prints(texts, "t", widths)
        .join(_prints(bodies.withColumnRenamed("item", "text"), "i", widths), "print")
        .select("t", "i")
        .distinct()
    )

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found = [], []
            columns = (batch.column(c).to_pylist() for c in ("t", "i", "text", "item"))
            for t, i, text, item in zip(*columns, strict=True):
                hashes, _ = word_hashes(*text_bytes(pa.array([text])))
                spans = Items([i], [item]).spans(hashes)
                if spans:
                    keys.append((t, i))
                    found.append([{"a": a, "b": b} for a, b, _ in spans])
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
                 pa.array(found, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))], ["t", "i", "spans"],
            )

    spans = pairs.join(texts, "t").join(bodies, "i").select("t", "i", "text", "item").mapInArrow(
        extend, "t string, i string, spans array<struct<a: bigint, b: bigint>>"
    )
    state = "named_struct('upto', 0L, 'hit', 0L)"
    step = "(s, x) -> named_struct('upto', greatest(s.upto, x.b), 'hit', s.hit + greatest(0L, x.b - greatest(s.upto, x.a)))"
    hit = (
        spans.select("t", F.explode("spans").alias("x")).groupBy("t").agg(F.array_sort(F.collect_set("x")).alias("xs"))
        .select("t", F.expr(f"aggregate(xs, {state}, {step}).hit").alias("n_hit"))
    )
    named = (
        spans.select("t", "i").join(own.select("i", "name").where("name is not null").distinct(), "i")
        .groupBy("t").agg(F.array_sort(F.collect_set("name")).alias("names"))
        .select("t", F.size("names").cast("bigint").alias("n_items"), F.sha2(F.array_join("names", ","), 256).alias("items_sha256"))
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = word_hashes(*text_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), pa.array(np.diff(offsets))], ["doc_id", "t", "n_words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    sized = docs.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("t")).mapInArrow(
        count, f"doc_id {kind}, t string, n_words bigint"
    )
    return sized.join(hit, "t", "left").join(named, "t", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.lit(EMPTY_DIGEST)).alias("items_sha256"),
    )


def _collected(items: DataFrame, most_words: int) -> Items | None:
    """The items' index if their size is within the bound; measured before any text is read."""
    length = items.select(F.coalesce(F.sum(F.length("text") + 64), F.lit(0)).alias("n")).head()["n"]
    if length // 2 > most_words:
        return None
    rows = items.select(F.col("item_id").cast("string").alias("name"), "text").collect()
    return Items([r["name"] for r in rows], [r["text"] for r in rows])


def contamination(docs: DataFrame, items: DataFrame, share: int = 20, most_words: int = BROADCAST_WORDS) -> DataFrame:
    """Words of each document inside shared runs with benchmark items; see the module.

    ``contaminated`` when at least one in ``share`` words is hit.
    """
    index = _collected(items, most_words)
    found = _with_join(docs, items) if index is None else _with_broadcast(docs, index)
    return _verdict(found, share)


def without_contaminated(docs: DataFrame, items: DataFrame, share: int = 20, most_words: int = BROADCAST_WORDS) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all columns.

    With a broadcast index each task filters its own rows and nothing is shuffled. Beyond the
    bound a verdict belongs to a text, so rows meet the contaminated texts by their sha2.
    """
    index = _collected(items, most_words)
    if index is not None:
        shared = shared_object(docs.sparkSession, index)

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared()
            for batch in batches:
                for first in range(0, batch.num_rows, FILTER_ROWS):
                    part = batch.slice(first, FILTER_ROWS)
                    n_words, n_hit, *_ = _judged(known, part.column("text"))
                    yield part.filter(pa.array(~((n_hit > 0) & (share * n_hit >= n_words))))

        return docs.mapInArrow(keep, docs.schema)
    key = F.sha2(F.coalesce("text", F.lit("")), 256)
    texts = docs.select(key.alias("doc_id"), "text")
    name = free_name(docs, "_t")
    bad = _verdict(_with_join(texts, items), share).where("contaminated").select(F.col("doc_id").alias(name)).distinct()
    return docs.withColumn(name, key).join(materialize(bad, "contaminated"), name, "left_anti").select(*docs.columns)
