"""Spelling variants: words one edit apart, by composing automata.

Method: the vocabulary is an acceptor V of words and T the transducer of one inserted, deleted
or replaced code point; what V o T o V accepts are the pairs of near words. An edit has one place,
so two near words of lengths l and l or l + 1 share their first l // 2 code points or their last
l - l // 2. These halves name the initial states: a partition holds the words that reach one
state, or (read backwards) leave it, and only what is left of them. In a partition the rests are
built into one minimised acyclic acceptor, both lengths in one register of states, and the
composition is walked from its initial state: equal symbols first, then one edit at the first
difference, then equal symbols to the end. Results are kept by state or pair of states, so what
many words share is composed once, and words are ranks in the acceptor (counts of the words
that sort before), not strings. A pair is found once: forwards if the edit is not in the
first half, else backwards.

The words, their counts and the links are Spark aggregates: runs are counted in batches and
combined before they are shuffled, and a partition passes on one row a word, its number of near
words and the best of them. Partitions of more than ``MOST`` words are cut into pieces that
meet pairwise. Roots are found by pointer doubling; as a form is at least twice as frequent as
its word, 64 doubled counts, so six rounds, are the most there can be.

Results: one row per word of at least ``MIN_LENGTH`` code points and ``MIN_COUNT``
occurrences. A null text has no words, a null id is an empty one in the hash of a run, repeated
rows count each, an empty table gives no rows. Only ``doc_id`` and ``text`` are read. Runs of a
batch are told apart by 64-bit hashes, words of the table by themselves.
"""

from __future__ import annotations

import sys
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.buffers import byte_class, lower_ascii, mixed, run_hashes, runs, slices, text_bytes, worker_cache
from paperloom.operators.skew import row_lookup
from paperloom.storage import materialize

MIN_LENGTH, MIN_COUNT = 5, 3
EVERY = 97
MOST = 20_000
#: Runs of more bytes are hashed one by one.
SHORT = 64


def crc_table() -> np.ndarray:
    """The byte table of CRC-32, from its polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table.astype(np.uint32)


def run_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each run of bytes, going on from the CRC ``before`` it."""
    table = worker_cache("crc table", crc_table)
    sizes = ends - starts
    found = np.zeros(len(starts), np.uint32)
    long = sizes > SHORT
    for i in np.flatnonzero(long).tolist():
        found[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(before[i]))
    order = np.flatnonzero(~long)
    order = order[np.argsort(-sizes[order], kind="stable")]
    at, state, left = starts[order], ~before[order], sizes[order]
    for step in range(int(left.max(initial=0))):
        count = int(np.searchsorted(-left, -step, side="left"))
        part = state[:count]
        state[:count] = table[(part ^ data[at[:count] + step]) & np.uint32(255)] ^ (part >> np.uint32(8))
    found[order] = ~state
    return found


def gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The given runs of bytes as strings."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    values = data[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(values)).cast(pa.string())


def batch_words(ids: list, column: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Words and their counts, slice by slice; a word may come in several slices."""
    data, all_offsets = text_bytes(column)
    letter = worker_cache("letter bytes", lambda: byte_class((65, 90), (97, 122)))
    for first, last in slices(all_offsets):
        base = all_offsets[first]
        lowered = lower_ascii()[data[base : all_offsets[last]]]
        offsets = all_offsets[first : last + 1] - base
        # U+00C0 to U+00FF are the byte C3 and one more.
        lead = lowered == 0xC3
        inside = letter[lowered] | lead
        inside[1:] |= lead[:-1]
        starts, ends, owner = runs(inside, offsets)
        if not len(starts):
            continue
        hashes = run_hashes(lowered, starts, ends)
        _, where, times = np.unique(hashes ^ mixed(owner.astype(np.uint64) + np.uint64(1)), return_index=True, return_counts=True)
        starts, ends, owner, hashes = starts[where], ends[where], owner[where], hashes[where]
        names = [f"{'' if i is None else i}:".encode() for i in ids[first:last]]
        before = np.array([zlib.crc32(n) for n in names], np.uint32)
        crc = run_crcs(lowered, starts, ends, before[owner])
        leads = np.concatenate([[0], np.cumsum(lead)])
        length = ends - starts - (leads[ends] - leads[starts])
        changed = crc % EVERY == 0
        kept = np.flatnonzero(~changed & (length >= MIN_LENGTH))
        _, one, group = np.unique(hashes[kept], return_index=True, return_inverse=True)
        if len(kept):
            yield gathered(lowered, starts[kept][one], ends[kept][one]), np.bincount(group, weights=times[kept]).astype(np.int64)
        cut: Counter[str] = Counter()
        for i in np.flatnonzero(changed & (length > MIN_LENGTH)).tolist():
            run = lowered[starts[i] : ends[i]].tobytes().decode()
            at = int(crc[i]) % len(run)
            cut[run[:at] + run[at + 1 :]] += int(times[i])
        if cut:
            yield pa.array(list(cut), pa.string()), np.array(list(cut.values()), np.int64)


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, n`` of all words that are long and frequent enough."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, times in batch_words(batch.column("doc_id").to_pylist(), batch.column("text")):
                yield pa.RecordBatch.from_arrays([words, pa.array(times)], ["word", "n"])

    counted = docs.select("doc_id", "text").mapInArrow(count, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


class Acceptor:
    """A minimised acyclic acceptor: states are equal if the rests they accept are.

    ``moves[q]`` maps a symbol to the next state and to the number of words of ``q`` that sort
    before those that begin with it. State 0 ends a word. Words of one ``add`` have one length.
    """

    def __init__(self) -> None:
        self.moves: list[dict[str, tuple[int, int]]] = [{}]
        self.size = [1]
        self.register: dict[tuple, int] = {}
        self.same: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.replaced: dict[int, list[tuple[int, int]]] = {0: []}
        self.inserted: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def add(self, words: list[str]) -> int:
        """The initial state of an acceptor of sorted, distinct words of one length."""
        length = len(words[0])
        if not length:
            return 0
        open_moves: list[list[tuple[str, int]]] = [[] for _ in range(length)]
        before = words[0]
        for word in [*words[1:], ""]:
            common = 0
            while common < len(word) and word[common] == before[common]:
                common += 1
            state = 0
            for depth in range(length - 1, common - 1, -1):
                open_moves[depth].append((before[depth], state))
                if depth > common or not word:
                    state = self.state(tuple(open_moves[depth]))
                    open_moves[depth] = []
            before = word
        return state

    def state(self, moves: tuple) -> int:
        known = self.register.get(moves)
        if known is None:
            known = self.register[moves] = len(self.moves)
            table, total = {}, 0
            for symbol, target in moves:
                table[symbol] = target, total
                total += self.size[target]
            self.moves.append(table)
            self.size.append(total)
        return known

    def common(self, p: int, q: int) -> list[tuple[int, int]]:
        """Ranks in p and in q of the words that both accept."""
        if p == q:
            return [(i, i) for i in range(self.size[p])]
        found = self.same.get((p, q))
        if found is None:
            found, other = [], self.moves[q]
            for symbol, (a, i) in self.moves[p].items():
                if symbol in other:
                    b, j = other[symbol]
                    found += [(i + x, j + y) for x, y in self.common(a, b)]
            self.same[p, q] = found
        return found

    def replacements(self, q: int) -> list[tuple[int, int]]:
        """Ranks of pairs of q's words that differ in one symbol, the smaller word first."""
        found = self.replaced.get(q)
        if found is None:
            found, moves = [], list(self.moves[q].values())
            for at, (a, i) in enumerate(moves):
                found += [(i + x, i + y) for x, y in self.replacements(a)]
                for b, j in moves[at + 1 :]:
                    found += [(i + x, j + y) for x, y in self.common(a, b)]
            self.replaced[q] = found
        return found

    def insertions(self, p: int, q: int) -> list[tuple[int, int]]:
        """Ranks in p and q of pairs whose word in q has one symbol more, at the first difference."""
        found = self.inserted.get((p, q))
        if found is None:
            found, short, long = [], self.moves[p], self.moves[q]
            for symbol, (a, i) in short.items():
                if symbol in long:
                    b, j = long[symbol]
                    found += [(i + x, j + y) for x, y in self.insertions(a, b)]
            for more, (b, j) in long.items():
                if p == 0:
                    found.append((0, j))
                rest = self.moves[b]
                for symbol, (a, i) in short.items():
                    if symbol != more and symbol in rest:
                        c, k = rest[symbol]
                        found += [(i + x, j + k + y) for x, y in self.common(a, c)]
            self.inserted[p, q] = found
        return found


def near_pairs(words: list[str], size: int, backwards: bool) -> Iterator[tuple[str, str]]:
    """Pairs of near words, the shorter of which has ``size`` symbols, in one partition.

    All words share their first ``size // 2`` symbols, or backwards their last ones; backwards
    only pairs that differ in their first half are given.
    """
    half = size // 2
    way, begin = (-1, size - half) if backwards else (1, half)
    rests = {w[::way][begin:]: w for w in words}
    groups = [sorted(r for r in rests if len(r) == length - begin) for length in (size, size + 1)]
    if not groups[0] or len(rests) < 2:
        return
    if size > 200:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 10 * size + 1000))
    machine = Acceptor()
    short = machine.add(groups[0])
    for i, j in machine.replacements(short):
        yield rests[groups[0][i]], rests[groups[0][j]]
    if groups[1]:
        for i, j in machine.insertions(short, machine.add(groups[1])):
            one, other = rests[groups[0][i]], rests[groups[1][j]]
            if not backwards or one[:half] != other[:half]:
                yield one, other


def partition_links(key: tuple, rows: list[tuple[str, int, int]]) -> dict[str, tuple[int, int, str]]:
    """Per word of a partition its number of near words, and count and name of the best one."""
    side, size, _, low, high = key
    counts = {word: n for word, n, _ in rows}
    piece = {word: p for word, _, p in rows} if low != high else None
    found: dict[str, tuple[int, int, str]] = {}
    for pair in near_pairs(list(counts), size, side == 1):
        if piece is not None and piece[pair[0]] == piece[pair[1]]:
            continue  # found where the piece meets itself
        for word, near in (pair, pair[::-1]):
            n = counts[near]
            number, best_n, best = found.get(word, (0, -1, ""))
            better = n > best_n or (n == best_n and near < best)
            found[word] = (number + 1, n, near) if better else (number + 1, best_n, best)
    return found


def partition_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of all partitions of a task, whose rows come sorted by partition."""
    current, rows = None, []
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["word", "n_near", "best_n", "best"])

    def close() -> None:
        if len(rows) > 1:
            out.extend((word, *link) for word, link in partition_links(current, rows).items())

    for part in batches:
        columns = [part.column(c).to_pylist() for c in ("side", "size", "key", "low", "high", "word", "n", "piece")]
        for *key, word, n, piece in zip(*columns, strict=True):
            if key != current:
                close()
                current, rows = key, []
                if len(out) > 10_000:
                    yield batch()
                    out.clear()
            rows.append((word, n, piece))
    close()
    if out:
        yield batch()


def near_words(words: DataFrame, most: int | None = None) -> DataFrame:
    """``word, n_near, best_n, best``: near words of a stored vocabulary, for words that have any."""
    most = most or MOST
    length = F.length("word")
    sized = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("size")).where(F.col("size") >= MIN_LENGTH)
    half = F.floor(F.col("size") / 2).cast("int")
    ways = F.array(
        F.struct(F.lit(0).alias("side"), F.left("word", half).alias("key")),
        F.struct(F.lit(1).alias("side"), F.right("word", F.col("size") - half).alias("key")),
    )
    keyed = sized.select("word", "n", "size", F.explode(ways).alias("way")).select("word", "n", "size", "way.*")
    place = ["side", "size", "key"]
    # At most one partition for ``most`` rows is large.
    large = keyed.groupBy(*place).count().where(F.col("count") > most)
    fans = materialize(large.select(*place, F.ceil(F.col("count") / most).cast("int").alias("_fan")), "large-partitions")
    piece = F.pmod(F.xxhash64("word"), F.col("_fan")).cast("int")
    fanned = keyed.join(F.broadcast(fans), place, "left").withColumn("_fan", F.coalesce("_fan", F.lit(1))).withColumn("piece", piece)
    met = fanned.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_fan") - 1)))
    cells = met.select(*place, F.least("piece", "_other").alias("low"), F.greatest("piece", "_other").alias("high"), "word", "n", "piece")
    dealt = cells.repartition(*place, "low", "high").sortWithinPartitions(*place, "low", "high")
    found = dealt.mapInArrow(partition_rows, "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best"))).alias("_best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("_best.m")).alias("best_n"), "_best.best")


def roots(links: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: each word's last form, by pointer doubling."""
    at = materialize(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = materialize(row_lookup(at, further, "root", F.col("word")), "roots")
        if step.where("_next is not null").head() is None:
            return at
        at = step.select("word", F.coalesce("_next", "root").alias("root"))


def spelling_variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word; see the module."""
    words = materialize(vocabulary(docs), "vocabulary")
    near = near_words(words)
    formed = F.col("best_n") >= 2 * F.col("n")
    linked = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")
    )
    linked = materialize(linked, "linked-words")
    last = roots(linked.where("form is not null"))
    return linked.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
