"""Best-fit packing of token sequences by bin completion.

Tokens: texts are split at spaces, tabs and line ends, which this tokenizer drops and never
merges across, and where it splits them itself: between letters, single digits and signs. Letters
are lower-cased as it does. Each distinct unit is tokenized once by the library itself, many in one
call. This holds for ASCII and the letters of Latin-1; a white-space separated piece with anything
else (or an apostrophe, or what a special string begins with) goes to the library as it is.

Method: documents are cut into pieces of at most ``capacity`` tokens; full pieces are
sequences of their own. For the others only the number of pieces of each length matters, so
the problem is a table of at most ``capacity`` rows whatever the corpus. Bin completion
branches on the undominated fillings around the largest length left: fillings to which no
left piece can be added and in which no piece can be swapped for a larger left one (dominance
by single swaps). Best-fit decreasing over the table is the incumbent; a branch is pruned when
its waste so far exceeds what a better solution may waste in total. The search ends when a lower
bound is met (proven best) or after ``NODES`` branchings; as a node keeps its ``FILLINGS`` fullest
fillings, an end without the bound is no proof. A filling is used as often as the lengths left
allow, so a plan is a short list of (filling, times).

Placement: pieces of one length are numbered over all partitions by offsets from counts per
partition and length (no global sort, no window over a group), and find their sequence by
their number in the plan, which is broadcast (at most ``2 * capacity`` fillings, so at most
``2 * capacity ** 2`` entries of one piece, in practice a few thousand).

Results: every document row has at least one token (the separator), so at least one piece;
null text is an empty one; a null id stays null and its pieces too; repeated rows are
packed each; an empty table gives no rows. Only ``doc_id`` and ``text`` are read. A long
text is cut, nothing is dropped.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.buffers import lower_ascii, run_hashes, runs, slices, text_bytes, worker_cache
from paperloom.storage import materialize

CAPACITY = 2048
SEPARATOR = 0
#: Distinct units in each of the two generations of a worker; a power of two.
CACHE_ROWS = 1 << 19
#: Units that the library gets as one text.
JOINED = 500
#: The split that ``Pieces.units`` follows, after lower-casing; files with another one get whole pieces only.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WHITE, LETTER, DIGIT, SIGN, ODD = range(5)
NODES = 2000
STEPS = 1000
FILLINGS = 4


class Generation:
    """Token ids of up to ``most`` pieces by 64-bit hash, in an open-addressing table of fixed size."""

    def __init__(self, most: int, kind: np.dtype) -> None:
        self.most, self.count = most, 0
        self.mask = np.uint64(2 * most - 1)
        self.keys = np.zeros(2 * most, np.uint64)
        self.slots = np.full(2 * most, -1, np.int32)
        self.starts = np.zeros(most + 1, np.int64)
        self.ids = np.zeros(4 * most, kind)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each hash, -1 where it is not kept."""
        found = np.full(len(hashes), -1, np.int64)
        open_rows, at = np.arange(len(hashes)), hashes & self.mask
        while len(open_rows):
            slots = self.slots[at]
            same = (slots >= 0) & (self.keys[at] == hashes[open_rows])
            found[open_rows[same]] = slots[same]
            going = (slots >= 0) & ~same
            open_rows, at = open_rows[going], (at[going] + np.uint64(1)) & self.mask
        return found

    def add(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Keep distinct hashes that are not here yet, with their ids one after another."""
        first, used = self.count, int(self.starts[self.count])
        self.count += len(hashes)
        if used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[:used], np.zeros(used + 2 * len(ids), self.ids.dtype)])
        self.ids[used : used + len(ids)] = ids
        self.starts[first + 1 : self.count + 1] = used + np.cumsum(sizes)
        rows, at = np.arange(len(hashes)), hashes & self.mask
        while len(rows):
            free = self.slots[at] < 0
            # Of several rows at one free place the last written gets it; the others go on.
            self.slots[at[free]] = first + rows[free]
            self.keys[at[free]] = hashes[rows[free]]
            put = free & (self.slots[at] == first + rows)
            rows, at = rows[~put], (at[~put] + np.uint64(1)) & self.mask

    def ids_of(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the given slots one after another, and how many each has."""
        begin, size = self.starts[slots], self.starts[slots + 1] - self.starts[slots]
        place = np.cumsum(size) - size
        return self.ids[np.repeat(begin - place, size) + np.arange(int(size.sum()))], size


def byte_kinds(spec: dict) -> tuple[np.ndarray, bool]:
    """Kind of each byte, and whether the file's split is the known one; if not, all but white bytes are odd."""
    kinds = np.full(256, ODD, np.uint8)
    kinds[[0x20, 0x09, 0x0A, 0x0D]] = WHITE
    parts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    changes = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    specials = [t["content"] for t in spec["added_tokens"]]
    split = [x["type"] for x in parts] == ["Split", "ByteLevel"] and parts[0]["pattern"] == {"Regex": SPLIT} and not parts[1]["add_prefix_space"]
    known = split and changes == ["NFC", "Replace", "Lowercase"] and all(map(str.isascii, specials))
    if known:
        kinds[0x21:0x7F] = SIGN
        kinds[0x30:0x3A] = DIGIT
        kinds[0x41:0x5B] = kinds[0x61:0x7B] = LETTER
        for sign in ("'", *specials):
            kinds[[ord(sign[0].lower()), ord(sign[0].upper())]] = ODD
    return kinds, known


class Pieces:
    """Token ids of texts from the ids of their distinct units, by hash; kept in two generations.

    New units enter the young generation. When it is full it becomes the old one, and what is
    asked for again is copied from there, so frequent units stay and single ones go.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype(np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self.young, self.old = Generation(CACHE_ROWS, self.kind), Generation(1, self.kind)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.kinds, self.known = byte_kinds(spec)
        self.lower = lower_ascii()
        # Tokens that end a unit; in this vocabulary every unit ends with one and has no other.
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if suffix := spec["model"].get("end_of_word_suffix"):
            self.last[[i for token, i in spec["model"]["vocab"].items() if token.endswith(suffix)]] = True

    def make_room(self, count: int) -> None:
        if self.young.count + count > self.young.most:
            self.old, self.young = self.young, Generation(max(CACHE_ROWS, 1 << (count - 1).bit_length()), self.kind)

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, lower-cased in units that are not odd; starts, ends and kinds of the units."""
        kind, lowered = self.kinds[data], self.lower[data]
        lead = np.flatnonzero(data[:-1] == 0xC3) if self.known else ()
        if len(lead):  # U+00C0 to U+00FF, letters but for U+00D7 and U+00F7
            second = data[lead + 1]
            letter = (second != 0x97) & (second != 0xB7)
            lead, second = lead[letter], second[letter]
            kind[lead] = kind[lead + 1] = LETTER
            lowered[lead + 1] = np.where(second < 0x9F, second + 0x20, second)
        odd = np.flatnonzero(kind == ODD)
        if len(odd):
            starts, ends, _ = runs(kind != WHITE, offsets)
            pieces = np.unique(np.searchsorted(starts, odd, side="right") - 1)
            steps = np.zeros(len(data) + 1, np.int8)
            steps[starts[pieces]] += 1
            steps[ends[pieces]] -= 1
            whole = np.cumsum(steps[:-1], dtype=np.int8).astype(bool)
            kind[whole], lowered[whole] = ODD, data[whole]
        begins = np.ones(len(data), bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        begins[offsets[offsets < len(data)]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts, len(data))[1:]
        kind = kind[starts]
        unit = kind != WHITE
        return lowered, starts[unit], ends[unit], kind[unit]

    def ask(self, units: list[bytes], odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units one after another, those that are not odd first, and how many each has."""
        plain = [u for u, o in zip(units, odd.tolist(), strict=True) if not o]
        joined = [b" ".join(plain[i : i + JOINED]).decode() for i in range(0, len(plain), JOINED)]
        found = [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.concatenate([np.zeros(0, self.kind), *found])
        ends = np.flatnonzero(self.last[ids]) + 1
        single = [u.decode() for u, o in zip(units, odd.tolist(), strict=True) if o]
        if len(ends) != len(plain):  # a vocabulary without ends of units
            ids, ends, single = ids[:0], ends[:0], [*(u.decode() for u in plain), *single]
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(single, add_special_tokens=False)] if single else []
        sizes = np.concatenate([np.diff(ends, prepend=0), np.array([len(x) for x in encoded], np.int64)])
        return np.concatenate([ids, np.fromiter((i for x in encoded for i in x), self.kind)]), sizes

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts as one array, with offsets; no separators."""
        lowered, starts, ends, kind = self.units(data, offsets)
        distinct, where, inverse = np.unique(run_hashes(lowered, starts, ends), return_index=True, return_inverse=True)
        if self.young.count + len(distinct) > self.young.most:
            self.make_room(len(distinct))
        slots = self.young.find(distinct)
        asked = np.flatnonzero(slots < 0)
        kept = self.old.find(distinct[asked])
        again = kept >= 0
        if again.any():
            slots[asked[again]] = self.young.count + np.arange(int(again.sum()))
            self.young.add(distinct[asked[again]], *self.old.ids_of(kept[again]))
        fresh = asked[~again]
        if len(fresh):
            odd = kind[where[fresh]] == ODD
            raw = lowered.tobytes()
            units = [raw[s:e] for s, e in zip(starts[where[fresh]].tolist(), ends[where[fresh]].tolist(), strict=True)]
            fresh = np.concatenate([fresh[~odd], fresh[odd]])
            slots[fresh] = self.young.count + np.arange(len(fresh))
            self.young.add(distinct[fresh], *self.ask(units, odd))
        ids, size = self.young.ids_of(slots[inverse])
        before = np.concatenate([[0], np.cumsum(size)])
        return ids.astype(np.uint32), before[np.searchsorted(starts, offsets)]


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece of every row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_cache(("pieces", tokenizer_path), lambda: Pieces(tokenizer_path))
        for batch in batches:
            data, all_offsets = text_bytes(batch.column("text"))
            for first, last in slices(all_offsets):
                base = all_offsets[first]
                ids, offsets = known.encode(data[base : all_offsets[last]], all_offsets[first : last + 1] - base)
                rows, piece, start, length, crc = [], [], [], [], []
                for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    own = np.append(ids[a:b], np.uint32(SEPARATOR)).astype("<u4", copy=False)
                    for number, begin in enumerate(range(0, len(own), capacity)):
                        part = own[begin : begin + capacity]
                        rows.append(first + row)
                        piece.append(number)
                        start.append(begin)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    )


def fillings(left: dict[int, int], order: list[int], capacity: int, most: int = FILLINGS) -> list[tuple[int, ...]]:
    """The ``most`` fullest undominated fillings around the largest length left, fullest first.

    Depth-first over lengths from large to small, each with as many copies as fit and then
    fewer, so the depth is the number of different lengths. A filling is kept if no piece
    left fits into what is free and no piece of it (but the largest) could be swapped for a
    larger one that is left and fits. The search of one node ends after ``STEPS`` steps or
    when ``most`` fillings without waste are found.
    """
    largest = order[0]
    usable = [x for x in order if x <= capacity - largest]
    spare = {x: left[x] - (x == largest) for x in usable}
    found: list[tuple[int, tuple[int, ...]]] = []
    steps = 0

    def undominated(part: dict[int, int], space: int) -> bool:
        for value in (0, *part):
            for other in usable:
                if other <= value:
                    break
                if other - value <= space and spare[other] > part.get(other, 0):
                    return False
        return True

    def extend(part: dict[int, int], at: int, space: int) -> bool:
        """Whether to stop the search."""
        nonlocal steps
        steps += 1
        while at < len(usable) and usable[at] > space:
            at += 1
        if at == len(usable):
            if undominated(part, space):
                found.append((space, tuple(x for x, n in part.items() for _ in range(n))))
                found.sort(key=lambda f: f[0])
                del found[most:]
            return steps > STEPS or (len(found) == most and found[-1][0] == 0)
        value = usable[at]
        for copies in range(min(spare[value], space // value), -1, -1):
            more = {**part, value: copies} if copies else part
            if extend(more, at + 1, space - copies * value) or (found and steps > STEPS):
                return True
        return False

    extend({}, 0, capacity - largest)
    return [(largest, *part) for _, part in found] or [(largest,)]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that are needed at least (Martello and Toth 1990, bound L2)."""
    number, volume = [0] * (capacity + 2), [0] * (capacity + 2)
    for x in range(1, capacity + 1):
        number[x + 1] = number[x] + counts.get(x, 0)
        volume[x + 1] = volume[x] + x * counts.get(x, 0)
    half, best = capacity // 2, 0
    for least in range(1, half + 1):
        high = capacity - least
        alone = number[capacity + 1] - number[high + 1]
        large = number[high + 1] - number[half + 1]
        space = large * capacity - (volume[high + 1] - volume[half + 1])
        small = volume[half + 1] - volume[least]
        best = max(best, alone + large + max(0, -(-(small - space) // capacity)))
    return max(best, -(-volume[capacity + 1] // capacity))


def times(filling: tuple[int, ...], left: dict[int, int]) -> int:
    """How often a filling can be used with the pieces left."""
    return min(left[x] // filling.count(x) for x in set(filling))


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """A plan of (filling, times): every piece, the longest first, goes where least space is left.

    Pieces of one length go into sequences of one free space together: the fullest that can
    take one takes as many as it can, so a length costs a step per free space, not per piece.
    """
    open_bins: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]
    for x in sorted((x for x, n in counts.items() if n > 0), reverse=True):
        n, free = counts[x], x
        while n:
            while free < capacity and not open_bins[free]:
                free += 1
            if free == capacity:
                copies = capacity // x
                for used, times in ((copies, n // copies), (n % copies, 1)):
                    if used and times:
                        open_bins[capacity - used * x].append(((x,) * used, times))
                break
            filling, times = open_bins[free].pop()
            copies = free // x
            whole = min(times, n // copies)
            rest = min(n - whole * copies, copies) if whole < times else 0
            for used, number in ((copies, whole), (rest, 1)):
                if used and number:
                    open_bins[free - used * x].append((filling + (x,) * used, number))
                    n -= used * number
                    times -= number
            if times:
                open_bins[free].append((filling, times))
    return [plan for plans in open_bins for plan in plans]


def pack_lengths(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """A plan of (filling, times) that places every piece, and the lower bound of sequences.

    Bin completion with depth-first branching. The incumbent is best-fit decreasing, so no
    plan is worse than that; a descent that fills the fullest way first often improves on it.
    """
    total = sum(x * n for x, n in counts.items())
    bound = lower_bound(counts, capacity)
    best = best_fit_decreasing(counts, capacity)
    best_bins = sum(n for _, n in best)
    nodes += 2 * len(counts)  # what the first descent may need
    # Explicit stack: the fillings still to try at each level and what each took.
    left = {x: n for x, n in counts.items() if n > 0}
    path: list[tuple[tuple[int, ...], int]] = []
    waste, bins, visited = 0, 0, 0
    levels: list[list[tuple[int, ...]]] = []

    def choices() -> list[tuple[int, ...]]:
        return fillings(left, sorted(left, reverse=True), capacity)[::-1]

    def take(filling: tuple[int, ...]) -> None:
        nonlocal waste, bins
        n = times(filling, left)
        for x in set(filling):
            left[x] -= n * filling.count(x)
            if not left[x]:
                del left[x]
        path.append((filling, n))
        waste += n * (capacity - sum(filling))
        bins += n

    def undo() -> None:
        nonlocal waste, bins
        filling, n = path.pop()
        for x in set(filling):
            left[x] = left.get(x, 0) + n * filling.count(x)
        waste -= n * (capacity - sum(filling))
        bins -= n

    while True:
        if not left:
            if bins < best_bins:
                best, best_bins = list(path), bins
        # A better solution has fewer sequences, so it wastes less than this in total.
        hopeless = waste > (best_bins - 1) * capacity - total
        if best_bins == bound or visited >= nodes:
            return best, bound
        if left and not hopeless:
            visited += 1
            levels.append(choices())
        else:
            while levels and not levels[-1]:
                levels.pop()
                if path:
                    undo()
            if not levels:
                return best, bound
            if len(path) == len(levels):
                undo()
        take(levels[-1].pop())


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a stored table of pieces."""
    spark = pieces.sparkSession
    placed = pieces.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    stored = materialize(placed, "pieces")
    counts = stored.groupBy("length").count().collect()  # at most ``capacity`` rows
    plan, _ = pack_lengths({r["length"]: r["count"] for r in counts}, capacity)
    # Intervals of piece numbers per length: in use u of a filling, number start + u * each + slot.
    begun: dict[int, int] = {}
    rows, base = [], 0
    for filling, n in plan:
        offset, slots = 0, {}
        for x in filling:
            slots.setdefault(x, []).append(offset)
            offset += x
        for x, offsets in slots.items():
            start = begun.get(x, 0)
            begun[x] = start + n * len(offsets)
            rows.append((x, start, begun[x], base, offsets))
        base += n
    table: dict[int, list] = {}
    for x, start, end, first, offsets in rows:
        table.setdefault(x, []).append((start, end, first, offsets))
    shared = spark.sparkContext.broadcast(table)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("_number").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length).tolist():
                mine = np.flatnonzero(length == x)
                spans = shared.value[x]
                at = np.searchsorted([s[0] for s in spans], number[mine], side="right") - 1
                for index in np.unique(at).tolist():
                    start, _, first, offsets = spans[index]
                    those = mine[at == index]
                    use, slot = np.divmod(number[those] - start, len(offsets))
                    sequence[those], offset[those] = first + use, np.array(offsets)[slot]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"]
            )

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return numbered(stored).mapInArrow(
        place,
        f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    )


def numbered(stored: DataFrame) -> DataFrame:
    """Add ``_number``, from 0, to the pieces of each length.

    Pieces of one written partition and length are ranked by their place there, in groups
    that are as small as a task's share; the counts of the partitions before are added.
    """
    from pyspark.sql.window import Window

    per = stored.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("length", "_part").orderBy("_at")
    ranked = stored.withColumn("_rank", F.row_number().over(inside) - 1)
    return ranked.join(starts, ["length", "_part"]).withColumn("_number", F.col("_first") + F.col("_rank"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize, cut and pack all rows of ``docs``; see the module."""
    return pack(tokenized_pieces(docs, tokenizer_path, capacity), capacity)
