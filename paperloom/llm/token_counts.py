"""Token counts: byte-pair merging of whole batches by rank, in numpy.

Method: rank-synchronous array merging. The distinct pre-tokens of a batch are ragged
numpy arrays of symbols; in each round every array applies its own lowest-rank pair at all
its places at once, until no pair has a rank. The surviving symbols are the tokens.

Results: one row per document row. Null text counts as empty (0 bytes, 0 tokens), a null id
stays null, repeated rows are counted each, an empty table gives no rows. Only ``doc_id``
and ``text`` are read, so further columns of any name do no harm. A text of any length is
counted whole; memory follows the longest text and the bounded cache of pre-tokens.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from paperloom.llm.buffers import SLICE, code_points, run_hashes, text_bytes, worker_cache

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
CACHE_ROWS = 1 << 20
NO_RANK = np.int32(2**31 - 1)


class Vocabulary:
    """Merge ranks, special strings and character classes of a byte-level tokenizer file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        ids, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.size = max(ids.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([ids[a] * self.size + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int32)
        self.symbol = np.array([ids[c] for c in byte_letters()], np.int32)
        self.classes = np.zeros(0x110000, np.uint8)
        self.hashes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def classify(self, points: np.ndarray) -> np.ndarray:
        """Class of each code point, as the library's own splitter treats it."""
        found = self.classes[points]
        for point in np.unique(points[found == 0]).tolist():
            char, one = chr(point), self.splitter.pre_tokenize_str
            tests = ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!"))
            self.classes[point] = next((kind for kind, lead in tests if len(one(lead + char)) == 1), SPACE)
        return self.classes[points]

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NO_RANK)


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte value.

    Printable Latin-1 bytes stand for themselves; the others follow in order from U+0100.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(shifted)) for b in range(256)]


def merged_lengths(pieces: list[bytes], vocabulary: Vocabulary) -> np.ndarray:
    """Number of symbols left of each piece after all merges."""
    lengths = np.array([len(p) for p in pieces], np.int64)
    result = lengths.astype(np.int32)
    symbols = vocabulary.symbol[np.frombuffer(b"".join(pieces), np.uint8)]
    live = np.flatnonzero(lengths > 1)
    keep = np.repeat(lengths > 1, lengths)
    symbols, lengths = symbols[keep], lengths[live]

    def ranked(at: np.ndarray, last: np.ndarray) -> np.ndarray:
        following = np.minimum(at + 1, len(symbols) - 1)
        return np.where(last[at], NO_RANK, vocabulary.pair_ranks(symbols[at], symbols[following]))

    def lasts() -> np.ndarray:
        mark = np.zeros(len(symbols), bool)
        mark[np.cumsum(lengths) - 1] = True
        return mark

    ranks = ranked(np.arange(len(symbols)), lasts()) if len(live) else None
    while len(live):
        starts = np.cumsum(lengths) - lengths
        lowest = np.minimum.reduceat(ranks, starts)
        done = lowest == NO_RANK
        if done.any():
            result[live[done]] = lengths[done]
            keep = np.repeat(~done, lengths)
            symbols, ranks = symbols[keep], ranks[keep]
            live, lengths, lowest = live[~done], lengths[~done], lowest[~done]
            if not len(live):
                break
        hit = ranks == np.repeat(lowest, lengths)
        # In a run of one repeated symbol every second pair merges, from the left.
        places = np.flatnonzero(hit)
        fresh = np.ones(len(places), bool)
        fresh[1:] = np.diff(places) != 1
        run_start = places[np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))]
        places = places[(places - run_start) % 2 == 0]
        symbols[places] = vocabulary.made[ranks[places]]
        keep = np.ones(len(symbols), bool)
        keep[places + 1] = False
        owner = np.repeat(np.arange(len(live)), lengths)
        lengths = lengths - np.bincount(owner[places], minlength=len(live))
        symbols, ranks = symbols[keep], ranks[keep]
        moved = places - np.arange(len(places))  # one symbol went before each later place
        last = lasts()
        touched = np.unique(np.concatenate([moved, moved[moved > 0] - 1]))
        ranks[touched] = ranked(touched, last)
    return result


def pre_tokens(points: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text index of the pre-tokens, as the library's split pattern makes them.

    Runs of letters, of numbers and of other signs take one plain space before them along;
    of other white space before a run the last character stands alone; an apostrophe alone
    before s, t, m, d, re, ve or ll takes these letters with it.
    """
    count = len(points)
    if not count:
        return (np.zeros(0, np.int64),) * 3
    kind = vocabulary.classify(points)
    first = np.zeros(count, bool)
    first[offsets[:-1][offsets[:-1] < count]] = True
    begins = first.copy()
    begins[1:] |= kind[1:] != kind[:-1]
    # White space before a run: its last character leaves the run of white space.
    last_of_text = np.zeros(count, bool)
    last_of_text[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True
    leaving = np.flatnonzero((kind == SPACE) & ~last_of_text & np.append(kind[1:] != SPACE, False))
    begins[leaving] = True
    plain = leaving[points[leaving] == 0x20]
    begins[plain + 1] = False
    # Contractions: an apostrophe that begins a pre-token and has letters after it.
    quote = np.flatnonzero((points == 0x27) & begins & ~last_of_text)
    for at in quote.tolist():
        stop = int(offsets[np.searchsorted(offsets, at, side="right")])
        tail = "".join(map(chr, points[at + 1 : min(at + 3, stop)].tolist()))
        taken = 1 if tail[:1] in ("s", "t", "m", "d") else 2 if tail in ("re", "ve", "ll") else 0
        if taken:
            begins[at + 1 : at + 1 + taken] = False
            if at + 1 + taken < stop and kind[at + 1 + taken] == LETTER:
                begins[at + 1 + taken] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], count)
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def count_texts(texts: list[str], vocabulary: Vocabulary) -> np.ndarray:
    """Tokens of each text; special strings count one each and split the text around them."""
    total = np.zeros(len(texts), np.int64)
    pieces, owners = [], []
    for index, text in enumerate(texts):
        if vocabulary.special is not None and vocabulary.special.search(text):
            found = vocabulary.special.split(text)
            total[index] += len(found) - 1
            pieces += found
            owners += [index] * len(found)
        else:
            pieces.append(text)
            owners.append(index)
    points, offsets = code_points(pieces)
    starts, ends, piece = pre_tokens(points, offsets, vocabulary)
    distinct, where, inverse = np.unique(run_hashes(points, starts, ends), return_index=True, return_inverse=True)
    at = np.searchsorted(vocabulary.hashes, distinct)
    known = np.zeros(len(distinct), bool)
    if len(vocabulary.hashes):
        known = vocabulary.hashes[np.minimum(at, len(vocabulary.hashes) - 1)] == distinct
    counts = np.zeros(len(distinct), np.int32)
    counts[known] = vocabulary.counts[at[known]]
    fresh = np.flatnonzero(~known)
    if len(fresh):
        whole = "".join(pieces)
        new = [whole[s:e].encode() for s, e in zip(starts[where[fresh]].tolist(), ends[where[fresh]].tolist(), strict=True)]
        counts[fresh] = merged_lengths(new, vocabulary)
        if len(vocabulary.hashes) + len(fresh) > CACHE_ROWS:
            vocabulary.hashes, vocabulary.counts = distinct, counts
        else:
            vocabulary.hashes = np.insert(vocabulary.hashes, at[fresh], distinct[fresh])
            vocabulary.counts = np.insert(vocabulary.counts, at[fresh], counts[fresh])
    sums = np.bincount(np.asarray(owners, np.int64)[piece], weights=counts[inverse], minlength=len(texts))
    return total + sums.astype(np.int64)


def token_counts(docs: DataFrame, vocabulary_path: str, limit: int = 512) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs``; see the module."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = worker_cache(("merges", vocabulary_path), lambda: Vocabulary(vocabulary_path))
        for batch in batches:
            _, offsets = text_bytes(batch.column("text"))
            n_bytes = np.diff(offsets)
            column = batch.column("text").fill_null("")
            n_tokens, first = np.zeros(len(n_bytes), np.int64), 0
            while first < len(n_bytes):
                last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE, side="right")) - 1)
                n_tokens[first:last] = count_texts(column.slice(first, last - first).to_pylist(), vocabulary)
                first = last
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    return docs.select("doc_id", "text").mapInArrow(count, schema)
