"""Language-model scores from a class-based bigram model (Brown et al. 1992).

Method: exchange clustering assigns every word to a class, in two steps.

1. The ``CORE`` most frequent words and ``BINS`` bins of all others (by their last three bytes)
   are clustered one by one on the driver, whose bigram table so has a fixed bound: each
   unit in turn moves to the class that raises the likelihood of the bigrams most, until no
   unit moves.
2. Every other word of the corpus then gets the class of its own neighbours: Spark counts the
   classes to the left and right of each word, gathers these counts by word, and each word
   moves to its best class, its own bigrams taken out of the class table first. Such a pass
   moves all words at once, so it is kept only if the likelihood rose; ``PASSES`` are tried. What is
   counted, shuffled and decided grows with the vocabulary and the text.

Bins remain for unknown words only. Then
``log10 P(text) = sum of log10 P(class | class before) + log10 P(word | class)``, with the
transition counts smoothed towards class frequencies and emissions by adding 0.5 a word;
a bin's class keeps one more half count for unknown words.

What is learned covers all rows outside the held-out fold. Counts and classes of at most ``TABLE``
words with the highest counts are broadcast (some 20 bytes each); all other words of a text meet
theirs in a join, so any vocabulary is exact. Only the class table that transitions are
estimated from takes these other words at the class of their bin.

Results: one row per document row. Null text is empty: one end token. A null id is neither
held out nor learned from. Repeated rows are each scored. Without training rows N and V are 0
and every score is that of one unknown type. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.llm.buffers import mixed, not_white, shared_object, slices, text_bytes, words
from paperloom.llm.folds import remainder
from paperloom.storage import materialize

CORE = 511
BINS = 512
END_UNIT = CORE + BINS
UNITS = END_UNIT + 1
CLASSES = 64
END_CLASS = 0
PASSES = 2
TABLE = 1 << 19
#: (word, neighbour class) counts that a task holds before it passes them on.
ENTRIES = 1 << 20
FEW = 16
MOST_COUNT = (1 << 24) - 1
TREND = 20.0
#: Rows in a batch between Spark and Python: texts of a few KB then take a few MB at a time.
BATCH_ROWS = 1000
END = np.uint64(0x243F6A8885A308D3)


def _word_batches(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice: first and last row, word offsets of the rows, word hashes, word bins."""
    data, all_offsets = text_bytes(batch.column("text"))
    for first, last in slices(all_offsets):
        base = all_offsets[first]
        offsets = all_offsets[first : last + 1] - base
        lowered, starts, ends, owner, hashes = words(data[base : all_offsets[last]], offsets, not_white())
        tail = np.zeros(len(ends), np.uint64)
        for back in (1, 2, 3):
            at = ends - back
            tail = tail * np.uint64(256) + np.where(at >= starts, lowered[np.maximum(at, 0)] if len(lowered) else 0, 0).astype(np.uint64)
        bins = (mixed(tail) % np.uint64(BINS)).astype(np.int64) + CORE
        yield first, last, np.searchsorted(owner, np.arange(len(offsets))), hashes, bins


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, a place of each, and which of them each word is."""
    distinct, inverse = np.unique(hashes, return_inverse=True)
    where = np.zeros(len(distinct), np.int64)
    where[inverse] = np.arange(len(hashes))
    return distinct, where, inverse


def word_counts(docs: DataFrame) -> DataFrame:
    """``h, bin, c`` of every distinct word and of the end token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, _, hashes, bins in _word_batches(batch):
                found, where, inverse = _distinct(hashes)
                n = np.bincount(inverse, minlength=len(found))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(found, END).view(np.int64)), pa.array(np.append(bins[where], END_UNIT)), pa.array(np.append(n, last - first))],
                    ["h", "bin", "c"],
                )

    found = docs.select("text").mapInArrow(count, "h bigint, bin bigint, c bigint")
    return found.groupBy("h").agg(F.min("bin").alias("bin"), F.sum("c").alias("c"))


class Lexicon:
    """Counts and classes of the frequent words, and which of them are units of their own."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, bins: np.ndarray) -> None:
        order = np.argsort(hashes)
        self.hashes, self.counts, self.bins = hashes[order], counts[order], bins[order].astype(np.int16)
        top = np.lexsort((self.hashes, -self.counts))
        top = top[self.hashes[top] != END][:CORE]
        self.unit = np.full(len(self.hashes), -1, np.int16)
        self.unit[top] = np.arange(len(top))
        self.bin_class = np.zeros(UNITS, np.int64)
        self.classes = np.zeros(len(self.hashes), np.int8)

    def labelled(self, label: np.ndarray) -> Lexicon:
        """The same words with the classes of their units."""
        return self._with(label, label[np.where(self.unit >= 0, self.unit, self.bins)].astype(np.int8))

    def moved(self, hashes: np.ndarray, classes: np.ndarray) -> Lexicon:
        """The same words, of which these have other classes."""
        found = self.classes.copy()
        found[np.searchsorted(self.hashes, hashes)] = classes
        return self._with(self.bin_class, found)

    def _with(self, bin_class: np.ndarray, classes: np.ndarray) -> Lexicon:
        other = Lexicon.__new__(Lexicon)
        other.__dict__.update(self.__dict__ | {"bin_class": bin_class, "classes": classes})
        return other

    def core(self) -> np.ndarray:
        return np.flatnonzero(self.unit >= 0)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each of distinct words in the table, and whether it is there."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes

    def units(self, hashes: np.ndarray, bins: np.ndarray) -> np.ndarray:
        at, listed = self.find(hashes)
        unit = self.taken(self.unit, at, listed, -1)
        return np.where(unit >= 0, unit, bins)

    def word_classes(self, hashes: np.ndarray, bins: np.ndarray) -> np.ndarray:
        """Class of each word; one outside the table has that of its bin."""
        at, listed = self.find(hashes)
        return self.taken(self.classes, at, listed, self.bin_class[bins])

    @staticmethod
    def taken(values: np.ndarray, at: np.ndarray, listed: np.ndarray, other: np.ndarray | int) -> np.ndarray:
        return np.where(listed, values[at], other).astype(np.int64) if len(values) else np.broadcast_to(other, at.shape).astype(np.int64)


def lexicon(vocabulary: DataFrame, most: int = TABLE) -> Lexicon:
    """The words from some frequency step upwards, as many steps as fit into ``most`` words."""
    step = F.floor(F.log(F.col("c").cast("double")) * 100)
    steps = sorted((r["s"], r["n"]) for r in vocabulary.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect())
    least, total = None, 0
    for s, n in reversed(steps):
        if total + n > most:
            break
        least, total = s, total + n
    if least is None:
        return Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    rows = vocabulary.where(step >= least).select("h", "c", F.col("bin").cast("smallint")).toArrow()
    return Lexicon(rows["h"].to_numpy().view(np.uint64), rows["c"].to_numpy(), rows["bin"].to_numpy())


def _with_ends(bounds: np.ndarray, values: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values with an end after each text, text index of each, and place of each word."""
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(bounds))
    tokens = np.full(len(values) + n, end, values.dtype)
    places = np.arange(len(values)) + owner
    tokens[places] = values
    return tokens, np.repeat(np.arange(n), np.diff(bounds) + 1), places


def bigrams(docs: DataFrame, known: Lexicon, size: int) -> np.ndarray:
    """How often each unit (``size`` is ``UNITS``) or class follows each; ``size`` rows reach the driver."""
    shared = shared_object(docs.sparkSession, known)
    schema = "u int, counts binary"
    by_unit, end = size == UNITS, END_UNIT if size == UNITS else END_CLASS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, lex = np.zeros((size, size), np.int64), shared()
        for batch in batches:
            for _, _, bounds, hashes, bins in _word_batches(batch):
                distinct, where, inverse = _distinct(hashes)
                found = (lex.units if by_unit else lex.word_classes)(distinct, bins[where])
                tokens, _, _ = _with_ends(bounds, found[inverse], end)
                if len(tokens):
                    pairs = np.append(end, tokens[:-1]) * size + tokens
                    if by_unit:
                        pairs, n = np.unique(pairs, return_counts=True)
                        table.ravel()[pairs] += n
                    else:
                        table += np.bincount(pairs, minlength=size * size).reshape(size, size)
        some = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([table[u].tobytes() for u in some], pa.binary())], ["u", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for u, counts in zip(batch.column("u").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[u] = sums.get(u, 0) + np.frombuffer(counts, np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["u", "counts"])

    table = np.zeros((size, size), np.int64)
    for row in docs.select("text").mapInArrow(count, schema).repartition("u").mapInArrow(add, schema).collect():
        table[row["u"]] = np.frombuffer(bytes(row["counts"]), np.int64)
    return table


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(grid: np.ndarray) -> float:
    """Log likelihood of the class bigrams, up to a constant of the words."""
    return float(xlogx(grid).sum() - xlogx(grid.sum(axis=0)).sum() - xlogx(grid.sum(axis=1)).sum())


def exchange(table: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """Class of each unit. The end is class 0 alone; other units move while likelihood grows.

    A move must raise it by more than rounding could, so the sweeps come to an end.
    """
    table = table.astype(np.float64)
    size = len(table)
    frequency = table.sum(axis=0)
    order = np.argsort(-frequency, kind="stable")
    order = order[(order != size - 1) & (frequency[order] > 0)]
    label = np.zeros(size, np.int64)
    label[: size - 1] = 1
    label[order] = 1 + np.arange(len(order)) % (classes - 1)
    onto = np.zeros((size, classes))
    onto[np.arange(size), label] = 1
    grid = onto.T @ table @ onto
    least = 1e-9 + 1e-13 * float(xlogx(table.sum()))
    moved = len(order)
    while moved:
        moved = 0
        for w in order.tolist():
            old, self_count = label[w], table[w, w]
            right, left = table[w] @ onto, table[:, w] @ onto
            right[old] -= self_count
            left[old] -= self_count
            grid[old] -= right
            grid[:, old] -= left
            grid[old, old] -= self_count
            base = xlogx(grid)
            gain = (xlogx(grid + right) - base).sum(axis=1) + (xlogx(grid + left[:, None]) - base).sum(axis=0)
            here = np.diag(grid)
            gain -= xlogx(here + right) + xlogx(here + left) - xlogx(here) - xlogx(here + right + left + self_count)
            outs, ins = grid.sum(axis=1) + left, grid.sum(axis=0) + right
            gain -= xlogx(outs + right.sum() + self_count) - xlogx(outs)
            gain -= xlogx(ins + left.sum() + self_count) - xlogx(ins)
            gain[0] = -np.inf
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + least:
                new = old
            grid[new] += right
            grid[:, new] += left
            grid[new, new] += self_count
            if new != old:
                moved += 1
                onto[w, old], onto[w, new], label[w] = 0, 1, new
    return label


def small_steps(grid: np.ndarray) -> list[np.ndarray]:
    """What fewer than ``FEW`` more bigrams change in each cell, for classes to the right and to the left."""
    tables = [np.ascontiguousarray(t, dtype=np.float64) for t in (grid.T, grid)]
    return [xlogx(t + np.arange(FEW)[:, None, None]) - xlogx(t) for t in tables]


def best_classes(
    grid: np.ndarray, old: np.ndarray, left: np.ndarray, right: np.ndarray, own: np.ndarray, few: list[np.ndarray] | None = None
) -> np.ndarray:
    """Class of each word that raises the likelihood most if this word alone moves.

    ``left`` and ``right`` count the classes beside the words (a row a word), ``own`` how often
    a word follows itself. The class table includes these bigrams under the class ``old``.
    """
    few = few or small_steps(grid)
    rows, gain = np.arange(len(old)), np.zeros(left.shape)
    for beside, across, table, steps in ((right, left, grid, few[0]), (left, right, grid.T, few[1])):
        word, other = np.nonzero(beside)
        n, at, mine = beside[word, other], np.arange(len(word)), old[word]
        cells = np.ascontiguousarray(table.T, dtype=np.float64)
        change = steps[np.minimum(n, FEW - 1).astype(np.int64), other]
        fresh = np.flatnonzero((n >= FEW) | (other == mine))
        some = cells[other[fresh]]
        home = other[fresh] == mine[fresh]
        some[home] -= across[word[fresh[home]]]
        change[fresh] = xlogx(some + n[fresh, None]) - xlogx(some)
        whole = cells[other, mine]
        change[at, mine] = xlogx(whole) - xlogx(whole - n)
        change[at, other] = 0  # the cell of a class with itself comes below
        firsts = np.flatnonzero(np.diff(word, prepend=-1))
        if len(firsts):
            gain[word[firsts]] += np.add.reduceat(change, firsts, axis=0)
        totals, kind = np.unique(beside.sum(axis=1) + own, return_inverse=True)
        sums = table.sum(axis=1).astype(np.float64)
        gain -= (xlogx(sums + totals[:, None]) - xlogx(sums))[kind]
        whole, less = sums[old], sums[old] - totals[kind]
        gain[rows, old] += xlogx(whole + totals[kind]) - xlogx(whole) - xlogx(whole) + xlogx(less)
    word, k = np.nonzero(left + right + own[:, None])
    n = left[word, k] + right[word, k] + own[word]
    here = np.diag(grid).astype(np.float64)[k] - np.where(k == old[word], n, 0)
    gain[word, k] += xlogx(here + n) - xlogx(here)
    gain[:, END_CLASS] = -np.inf
    new = np.argmax(gain, axis=1)
    least = 1e-9 + 1e-13 * float(xlogx(grid.sum()))
    return np.where(gain[rows, new] > gain[rows, old] + least, new, old)


def _summed(word: np.ndarray, code: np.ndarray, n: np.ndarray, together: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries in order of word and code, those of equal ones added up; ``together``: words are in order already."""
    if together:
        new = np.diff(word, prepend=word[:1] - 1) != 0
        distinct, inverse = word[new], np.cumsum(new) - 1
    else:
        distinct, inverse = np.unique(word, return_inverse=True)
    keys = inverse * 256 + code
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    at = np.flatnonzero(np.diff(keys, prepend=-1))
    keys = keys[at]
    return distinct[keys >> 8], keys & 255, np.add.reduceat(n, at) if len(at) else n


#: Codes of an entry: a class to the left, one to the right, the word itself to the left; the class that the
#: class table counts the word under, for words outside the broadcast table and (the last codes) in it.
RIGHT, OWN = CLASSES, 2 * CLASSES
OLD, LISTED = 2 * CLASSES, 3 * CLASSES  # plus the class, which is never the end's


def neighbours(docs: DataFrame, known: Lexicon) -> DataFrame:
    """Words outside the core with the classes beside them: a few rows a word and task.

    ``entries`` are 32-bit numbers, 256 times a count plus a code; a larger count has several.
    """
    shared = shared_object(docs.sparkSession, known)

    def rows(word: np.ndarray, code: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        parts = n // MOST_COUNT + 1
        if len(n) and parts.max() > 1:
            left = n - (parts - 1) * MOST_COUNT
            word, code, n = np.repeat(word, parts), np.repeat(code, parts), np.full(parts.sum(), MOST_COUNT, np.int64)
            n[np.cumsum(parts) - 1] = left
        packed = (n * 256 + code).astype(np.uint32)
        starts = np.flatnonzero(np.diff(word, prepend=word[:1] - 1))
        found, starts = word[starts], np.append(starts, len(word))
        for first in range(0, len(found), 10_000):
            last = min(first + 10_000, len(found))
            base, ends = starts[first], starts[first : last + 1]
            offsets = pa.py_buffer(((ends - base) * 4).astype(np.int32))
            entries = pa.Array.from_buffers(pa.binary(), last - first, [None, offsets, pa.py_buffer(packed[base : ends[-1]].copy())])
            yield pa.RecordBatch.from_arrays([pa.array(found[first:last]), entries], ["h", "entries"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared()
        none = [np.zeros(0, np.int64)] * 3
        parts, held = [none], 0
        for batch in batches:
            for _, _, bounds, hashes, bins in _word_batches(batch):
                distinct, where, inverse = _distinct(hashes)
                bins = bins[where]
                at, listed = lex.find(distinct)
                own = lex.taken(lex.classes, at, listed, lex.bin_class[bins])
                loose = lex.taken(lex.unit, at, listed, -1) < 0
                classes, _, places = _with_ends(bounds, own[inverse], END_CLASS)
                again = np.zeros(len(classes) + 1, bool)
                again[places[1:]] = (inverse[1:] == inverse[:-1]) & (places[1:] == places[:-1] + 1)
                free = np.flatnonzero(loose[inverse])
                spots, mine = places[free], inverse[free]
                left = np.where(again[spots], OWN, np.append(END_CLASS, classes[:-1])[spots])
                after = ~again[spots + 1]
                marks = np.flatnonzero(loose)
                keys, n = np.unique(
                    np.concatenate([mine * 256 + left, mine[after] * 256 + RIGHT + classes[spots[after] + 1], marks * 256 + np.where(listed, LISTED, OLD)[marks] + own[marks]]),
                    return_counts=True,
                )
                parts.append([distinct.view(np.int64)[keys >> 8], keys & 255, n])
                held += len(keys)
                if held > ENTRIES:
                    summed = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                    parts, held = [summed], len(summed[0])
                    if held > ENTRIES // 2:
                        yield from rows(*summed)
                        parts, held = [none], 0
        yield from rows(*_summed(*(np.concatenate(x) for x in zip(*parts, strict=True))))

    return docs.select("text").mapInArrow(count, "h bigint, entries binary")


def reassigned(beside: DataFrame, grid: np.ndarray, most: int = 1 << 13) -> DataFrame:
    """``h, listed, c, class`` of every word outside the core, each moved to its best class."""
    shared = beside.sparkSession.sparkContext.broadcast(grid)

    def answer(found: np.ndarray, listed: np.ndarray, c: np.ndarray, new: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(found), pa.array(listed), pa.array(c.astype(np.int64)), pa.array(new.astype(np.int8))], ["h", "listed", "c", "class"]
        )

    def choose(word: np.ndarray, code: np.ndarray, n: np.ndarray, few: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.diff(word, prepend=word[:1] - 1))
        found, sizes = word[starts], np.diff(np.append(starts, len(word)))
        mark = starts + sizes - 1  # the mark has the largest code of a word
        listed = code[mark] > LISTED
        old = code[mark] - np.where(listed, LISTED, OLD)
        # Words that stand once have one class on either side; equal ones are decided together.
        once = (sizes == 3) & (n[starts] == 1) & (code[starts] < RIGHT)
        at = starts[once]
        once_kinds, kind = np.unique((old[once] * 256 + code[at]) * 256 + code[at + 1], return_inverse=True)
        new = np.zeros(len(once_kinds), np.int64)
        for first in range(0, len(once_kinds), most // 2):
            kinds = once_kinds[first : first + most // 2]
            tables = np.zeros((2 * CLASSES + 1, len(kinds)))
            tables[(kinds >> 8) & 255, np.arange(len(kinds))] = 1
            tables[kinds & 255, np.arange(len(kinds))] = 1
            new[first : first + len(kinds)] = best_classes(shared.value, kinds >> 16, tables[:RIGHT].T, tables[RIGHT:OWN].T, tables[OWN], few)
        new = new[kind]
        yield answer(found[once], listed[once], np.ones(len(at)), new)
        rest = np.flatnonzero(~once)
        ends = np.cumsum(sizes[rest])
        first = 0
        while first < len(rest):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + most)))
            some = rest[first:last]
            size = sizes[some] - 1  # without the mark
            w = np.repeat(np.arange(len(some)), size)
            entry = np.repeat(starts[some] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(len(w))
            tables = np.zeros((2 * CLASSES + 1, len(some)))
            tables[code[entry], w] = n[entry]
            left, right, own = tables[:RIGHT].T, tables[RIGHT:OWN].T, tables[OWN]
            yield answer(found[some], listed[some], left.sum(axis=1) + own, best_classes(shared.value, old[some], left, right, own, few))
            first = last

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, few = [np.zeros(0, np.int64)] * 3, small_steps(shared.value)
        for batch in batches:
            h = batch.column("h").to_numpy(zero_copy_only=False)
            if not len(h):
                continue
            lists = batch.column("entries").cast(pa.large_binary())
            _, bounds, data = lists.buffers()
            bounds = np.frombuffer(bounds, np.int64, len(h) + 1, 8 * lists.offset)
            packed = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]].copy().view(np.uint32)
            word = np.repeat(h, np.diff(bounds) // 4)
            fresh = (word, (packed & 255).astype(np.int64), (packed >> 8).astype(np.int64))
            kept = list(_summed(*(np.concatenate(pair) for pair in zip(kept, fresh, strict=True)), together=True))
            cut = int(np.searchsorted(kept[0], h[-1]))  # rows come in order, so the last word may go on
            yield from choose(*(k[:cut] for k in kept), few)
            kept = [k[cut:] for k in kept]
        yield from choose(*kept, few)

    return beside.repartition("h").sortWithinPartitions("h").mapInArrow(decide, "h bigint, listed boolean, c bigint, class tinyint")


class ClassModel:
    """Log10 transition and emission tables of a clustering."""

    def __init__(self, grid: np.ndarray, mass: np.ndarray) -> None:
        share = mass / mass.sum()
        with np.errstate(divide="ignore"):
            self.move = np.log10((grid + TREND * share) / (grid.sum(axis=1, keepdims=True) + TREND))
            self.root = np.log10(mass)


def first_classes(vocabulary: DataFrame, known: Lexicon) -> DataFrame:
    """Every word outside the core with the class of its bin."""
    core = [int(h) for h in known.hashes[known.core()].view(np.int64)]
    by_bin = F.array(*(F.lit(int(c)).cast("tinyint") for c in known.bin_class))
    rest = vocabulary.where(~F.col("h").isin([*core, int(END.view(np.int64))]))
    return rest.select("h", "c", F.get(by_bin, F.col("bin").cast("int")).alias("class"))


def fit(docs: DataFrame, vocabulary: DataFrame, known: Lexicon, passes: int = PASSES) -> tuple[Lexicon, DataFrame, ClassModel]:
    """Classes of the listed words, classes of all words outside the core, and the model."""
    table = bigrams(docs, known, UNITS)
    label = exchange(table)
    known = known.labelled(label)
    onto = np.zeros((UNITS, CLASSES), np.int64)
    onto[np.arange(UNITS), label] = 1
    grid = onto.T @ table @ onto
    loose = first_classes(vocabulary, known)
    for _ in range(passes):
        decided = materialize(reassigned(neighbours(docs, known), grid), "classes")
        mine = decided.where("listed").select("h", "class").toArrow()  # at most TABLE rows
        tried = known.moved(mine["h"].to_numpy().view(np.uint64), mine["class"].to_numpy())
        found = bigrams(docs, tried, CLASSES)
        if likelihood(found) <= likelihood(grid):
            break
        known, grid, loose = tried, found, decided.select("h", "c", "class")
    core = known.core()
    mass = np.bincount(label[CORE:END_UNIT], minlength=CLASSES) * 0.5  # one unknown word type a bin
    mass += np.bincount(known.classes[core], weights=known.counts[core] + 0.5, minlength=CLASSES)
    for row in loose.groupBy("class").agg((F.sum("c") + F.count("*") * 0.5).alias("m")).collect():  # at most CLASSES rows
        mass[row["class"]] += row["m"]
    mass[END_CLASS] += grid[:, END_CLASS].sum() + 0.5  # nothing learned: the end is unknown too
    return known, loose, ClassModel(grid, mass)


def score(docs: DataFrame, vocabulary: DataFrame, known: Lexicon, loose: DataFrame, model: ClassModel) -> DataFrame:
    """Add up the parts of every row; words outside the broadcast table get theirs in a join."""
    end = F.when(F.col("h") == int(END.view(np.int64)), F.col("c"))
    totals = vocabulary.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(n) for x, n in ((F.col("c"), "n"), (end, "ends"))), F.count("*").alias("v")).head()
    train, types, ends = int(totals["n"]), int(totals["v"]), int(totals["ends"])
    floor = float(np.log10(train + 0.5 * (types + 1)))
    words, classes = shared_object(docs.sparkSession, known), shared_object(docs.sparkSession, model)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, lm = words(), classes()
        for batch in batches:
            for first, last, bounds, hashes, bins in _word_batches(batch):
                n = last - first
                distinct, inverse = np.unique(hashes, return_inverse=True)
                at, listed = lex.find(distinct)
                own = lex.taken(lex.classes, at, listed, -1)[inverse]
                log_counts = np.where(listed, np.log10(lex.counts[at] + 0.5), 0.0)[inverse] if len(lex.counts) else 0.0
                listed = listed[inverse]
                tokens, owner, places = _with_ends(bounds, own, END_CLASS)
                log_count = np.full(len(tokens), np.log10(ends + 0.5))
                log_count[places] = log_counts
                before = np.append(END_CLASS, tokens[:-1])
                moves = np.where((before >= 0) & (tokens >= 0), lm.move[before, tokens], 0.0) - np.where(tokens >= 0, lm.root[tokens], 0.0)
                sums = [np.bincount(owner, weights=w, minlength=n) for w in (log_count, moves)]
                mine = np.repeat(np.arange(n), np.diff(bounds))
                seen = np.bincount(mine[listed], minlength=n) + (ends > 0)
                rare = np.flatnonzero(~listed)
                cut = np.searchsorted(mine[rare], np.arange(n + 1))
                where = rare - bounds[:-1][mine[rare]]
                # Place, class before, class after (0 for one that is not listed, else 1 more) and class of the bin.
                beside = (before[places[rare]] + 1) * 65536 + (tokens[places[rare] + 1] + 1) * 256 + lex.bin_class[bins[rare]]
                asked = pa.StructArray.from_arrays([pa.array(hashes[rare].view(np.int64)), pa.array(where * (1 << 24) + beside)], ["h", "spot"])
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), asked)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, n), batch.column("held_out").slice(first, n), pa.array(np.diff(bounds) + 1),
                     pa.array(seen), pa.array(sums[0]), pa.array(sums[1]), lists],
                    ["doc_id", "held_out", "n_tokens", "seen", "log_counts", "moves", "rare"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = docs.select("doc_id", "held_out", "text").mapInArrow(
        part,
        f"doc_id {kind}, held_out boolean, n_tokens bigint, seen bigint, log_counts double, moves double, rare array<struct<h: bigint, spot: bigint>>",
    )
    stored = materialize(parts.withColumn("row", F.monotonically_increasing_id()), "parts")
    found = rare_parts(stored.select("row", F.inline("rare")), loose, model)
    known_words = F.col("seen") + F.coalesce("known", F.lit(0))
    log_counts = F.col("log_counts") + F.coalesce("more", F.lit(0.0))
    return stored.drop("rare").join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", known_words.alias("n_known"), F.lit(train).cast("bigint").alias("train_tokens"),
        (log_counts - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        (log_counts + F.col("moves") + F.coalesce("turns", F.lit(0.0))).alias("score"),
    )


def rare_parts(asked: DataFrame, loose: DataFrame, model: ClassModel) -> DataFrame:
    """``row, more, known, turns``: what the words outside the broadcast table add to each row."""
    spark = asked.sparkSession
    spot = F.col("spot")
    met = asked.join(loose, "h", "left").select(
        "row", "spot", "c",
        F.coalesce(F.col("class").cast("int"), spot.bitwiseAND(F.lit(255)).cast("int")).alias("class"),
        (F.shiftright(spot, 16).bitwiseAND(F.lit(255)) - 1).cast("int").alias("before"),
        (F.shiftright(spot, 8).bitwiseAND(F.lit(255)) - 1).cast("int").alias("after"),
    )
    # A word before that is not listed either is the row before this one.
    back = F.lag("class").over(Window.partitionBy("row").orderBy("spot"))
    linked = met.withColumn("before", F.when(F.col("before") >= 0, F.col("before")).otherwise(back))
    moves = [(a, b, float(model.move[a, b])) for a in range(CLASSES) for b in range(CLASSES)]
    into = spark.createDataFrame([(a, b, m - float(model.root[b])) for a, b, m in moves], "before int, class int, into double")
    out = spark.createDataFrame(moves, "class int, after int, out double")
    return (
        linked.join(F.broadcast(into), ["before", "class"], "left").join(F.broadcast(out), ["class", "after"], "left")
        .groupBy("row")
        .agg(
            F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"), F.count("c").alias("known"),
            F.sum(F.col("into") + F.coalesce("out", F.lit(0.0))).alias("turns"),
        )
    )


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of at most ``BATCH_ROWS`` rows between Spark and Python, whose buffers count on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def class_scores(docs: DataFrame, divisor: int = 5, held: int = 1) -> DataFrame:
    """Learn from the rows outside the held-out fold and score every row; see the module."""
    rest = remainder(F.col("doc_id"), divisor)
    train = docs.where(rest != held)
    with small_batches(docs.sparkSession):  # all work in Python is done when this returns
        vocabulary = materialize(word_counts(train), "vocabulary")
        known, loose, model = fit(train, vocabulary, lexicon(vocabulary))
        marked = docs.select("doc_id", "text", F.coalesce(rest == held, F.lit(False)).alias("held_out"))
        return score(marked, vocabulary, known, loose, model)
