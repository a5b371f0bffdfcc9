"""Language identification: multinomial naive Bayes over hashed character n-grams.

Method: n-grams of 1 to 3 characters (letters in lower case, everything else one space) are
hashed into ``BUCKETS`` cells. Counts per language and cell come from all training rows and
are summed by Spark; the matrix of log-probabilities is broadcast (``BUCKETS`` x languages
cells of 4 bytes; more than ``MAX_LANGUAGES`` languages are refused, so at most 256 MB) and
each task scores its batches in numpy from the cells that a text really has.

Results: one row per document row. Null text and text without a letter is ``und`` with score
0; so is every row if there is nothing to learn from. Ties go to the language that sorts
first. A null id is held out of nothing (its remainder is unknown: ``held_out`` is false, and
it is not learned from). Repeated rows count each time. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.buffers import SLICE, code_points, text_bytes, worker_cache
from paperloom.llm.folds import remainder

BITS = 16
BUCKETS = 1 << BITS
BLOCKS = 64
MAX_LANGUAGES = 1000
ALPHA = 0.02
NONE = "und"


def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 for what is not a letter."""
    table = np.zeros(0x110000, np.uint32)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            low = char.lower()
            table[point] = ord(low) if len(low) == 1 else point
    return table


def text_cells(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of all n-grams of the texts, the text index of each, and whether a text has letters."""
    table = worker_cache("letter points", _letters)
    points, offsets = code_points(texts)
    letter = table[points]
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    has = np.bincount(owner[letter > 0], minlength=len(texts)) > 0
    # A run of other characters is one space; a text begins and ends with one.
    keep = letter > 0
    keep[1:] |= (letter[:-1] > 0) & (owner[1:] == owner[:-1])
    letter, owner = letter[keep], owner[keep]
    cells, owners = [], []
    factors = np.uint32([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D])
    for width in (1, 2, 3):
        count = len(letter) - width + 1
        if count <= 0:
            break
        total = np.full(count, width * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
        for step in range(width):
            total = (total ^ letter[step : step + count]) * factors[step]
            total ^= total >> np.uint32(15)
        total *= np.uint32(0x2C1B3C6D)
        same = owner[:count] == owner[width - 1 :]
        if width == 1:
            same &= letter > 0
        cells.append((total >> np.uint32(32 - BITS))[same])
        owners.append(owner[:count][same])
    if not cells:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), has
    return np.concatenate(cells), np.concatenate(owners), has


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[str]]]:
    _, offsets = text_bytes(batch.column("text"))
    first, column = 0, batch.column("text").fill_null("")
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE, side="right")) - 1)
        yield first, last, column.slice(first, last - first).to_pylist()
        first = last


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probability matrix from all rows with a text and a ``lang``.

    The rows that reach the driver are at most ``BUCKETS`` times ``MAX_LANGUAGES``.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for first, last, texts in _parts(batch):
                cells, owner, _ = text_cells(texts)
                for lang in set(langs[first:last]):
                    mine = (langs[first:last] == lang)[owner]
                    table = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    table += np.bincount(cells[mine], minlength=BUCKETS)
        for lang, table in sums.items():
            blocks = [part.tobytes() for part in table.reshape(BLOCKS, -1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * BLOCKS), pa.array(range(BLOCKS), pa.int32()), pa.array(blocks, pa.binary())], ["lang", "block", "counts"]
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for lang, block, counts in zip(*(batch.column(c).to_pylist() for c in ("lang", "block", "counts")), strict=True):
                sums[lang, block] = sums.get((lang, block), 0) + np.frombuffer(counts, np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in sums]), pa.array([k[1] for k in sums], pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())],
                ["lang", "block", "counts"],
            )

    rows = docs.where("text is not null and lang is not null")
    known = [r["lang"] for r in rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect()]
    if len(known) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    kind = "lang string, block int, counts binary"
    summed = rows.select("text", "lang").mapInArrow(count, kind).repartition("lang", "block").mapInArrow(add, kind).collect()
    langs = sorted({r["lang"] for r in summed})
    if not langs:
        return [], np.zeros((0, BUCKETS), np.float32)
    counts = np.full((len(langs), BLOCKS, BUCKETS // BLOCKS), ALPHA)
    for r in summed:
        counts[langs.index(r["lang"]), r["block"]] += np.frombuffer(bytes(r["counts"]), np.int64)
    counts = counts.reshape(len(langs), BUCKETS)
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def predict(docs: DataFrame, langs: list[str], logs: np.ndarray) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row.

    The score is the posterior of the chosen language, with the evidence of a long text
    tempered to that of ``EVIDENCE`` n-grams, as neighbouring n-grams are not independent.
    """
    shared = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(logs.T))
    evidence = 60.0

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            names, scores = [], []
            for _, _, texts in _parts(batch):
                cells, owner, has = text_cells(texts)
                size = np.bincount(owner, minlength=len(texts))
                sums = np.stack(
                    [np.bincount(owner, weights=table[cells, at], minlength=len(texts)) for at in range(len(langs))]
                    or [np.zeros(len(texts))], axis=1
                )
                scaled = sums * (np.minimum(size, evidence) / np.maximum(size, 1))[:, None]
                chance = np.exp(scaled - scaled.max(axis=1, keepdims=True))
                chance /= chance.sum(axis=1, keepdims=True)
                best = sums.argmax(axis=1)
                fine = has & bool(langs)
                names += [langs[b] if ok else NONE for b, ok in zip(best, fine, strict=True)]
                scores += np.where(fine, chance[np.arange(len(texts)), best], 0.0).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "held_out", "text").mapInArrow(
        score, f"doc_id {kind}, held_out boolean, lang_pred string, score double"
    )


def identify(docs: DataFrame, divisor: int = 4, held: int = 2) -> DataFrame:
    """Learn from rows whose id remainder is not ``held`` and predict all rows."""
    rest = remainder(F.col("doc_id"), divisor)
    langs, logs = train(docs.where(rest != held).select("text", "lang"))
    marked = docs.select("doc_id", "text", F.coalesce(rest == held, F.lit(False)).alias("held_out"))
    return predict(marked, langs, logs)
