"""Quality classifier: regularised quadratic discriminant analysis.

Method: each text becomes a vector of transformed document statistics (log counts and log
rates). Sums, products and counts per class are added up by Spark over every labelled row
outside the held-out fold (no sample), and give class means and covariances; each covariance
is shrunk towards the pooled one and towards its diagonal. A score is the logistic of the
difference of the two log-densities, from squared Mahalanobis distances with cached Cholesky
factors, divided by ``TEMPER`` since the statistics are not independent.

Results: one row per document row; null text counts as empty and is scored too; repeated rows
are scored each. Rows without id (null) are scored, never learned from, and not held out.
Label rows with null id or null label are ignored, an id with both labels is not learned
from, and repeated equal labels count once per document row. Without any label every score
is 0.5; with labels of one class only, every score is that label. Only the named columns are
read, so clashing further columns do no harm. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.buffers import byte_class, mixed, not_white, run_hashes, runs, shared_object, slices, text_bytes
from paperloom.llm.folds import remainder
from paperloom.storage import materialize

SHRINK_POOLED = 0.3
SHRINK_DIAGONAL = 0.3
TEMPER = 6.0
KEEP_FROM = 0.3
FEATURES = (
    "log words", "word length", "capitals", "digits", "sentence marks", "exclamations", "bars", "other signs",
    "repeated neighbours", "distinct words", "repeated lines", "words a line",
)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of transformed statistics per text."""
    n = len(offsets) - 1
    owner_of = lambda places: np.searchsorted(offsets, places, side="right") - 1
    per = lambda places: np.bincount(owner_of(places), minlength=n)[:n].astype(float)
    count = lambda *ranges: per(np.flatnonzero(byte_class(*ranges)[data]))
    starts, ends, owner = runs(not_white()[data], offsets)
    hashes = run_hashes(data, starts, ends)
    words = np.bincount(owner, minlength=n).astype(float)
    letters_in_words = np.bincount(owner, weights=ends - starts, minlength=n)
    capitals, small = count((0x41, 0x5A)), count((0x61, 0x7A))
    digits = count((0x30, 0x39))
    marks = count((0x2C, 0x2C), (0x2E, 0x2E), (0x3A, 0x3B), (0x3F, 0x3F))
    exclamations, bars = count((0x21, 0x21)), count((0x7C, 0x7C))
    others = count((0x22, 0x2B), (0x2D, 0x2D), (0x2F, 0x2F), (0x3C, 0x3E), (0x40, 0x40), (0x5B, 0x60), (0x7B, 0x7B), (0x7D, 0x7E))
    same = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    repeated = np.bincount(owner[1:][same], minlength=n).astype(float)

    def distinct(keys: np.ndarray, owners: np.ndarray) -> np.ndarray:
        _, first = np.unique(mixed(keys ^ (owners.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), return_index=True)
        return np.bincount(owners[first], minlength=n).astype(float)

    line_starts, line_ends, line_owner = runs(data != 0x0A, offsets)
    lines = np.bincount(line_owner, minlength=n).astype(float)
    different_lines = distinct(run_hashes(data, line_starts, line_ends), line_owner)
    rate = lambda part, whole: np.log((part + 0.5) / (whole + 10.0))
    return np.stack(
        [
            np.log1p(words),
            np.log1p(letters_in_words / np.maximum(words, 1)),
            np.log((capitals + 1.0) / (capitals + small + 20.0)),
            rate(digits, letters_in_words),
            rate(marks, words),
            rate(exclamations, words),
            rate(bars, words),
            rate(others, words),
            rate(repeated, words),
            np.log((distinct(hashes, owner) + 1.0) / (words + 1.0)),
            rate(lines - different_lines, lines),
            np.log1p(words / np.maximum(lines, 1)),
        ],
        axis=1,
    )


def with_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, stats`` of every row."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, all_offsets = text_bytes(batch.column("text"))
            for first, last in slices(all_offsets):
                base = all_offsets[first]
                found = statistics(data[base : all_offsets[last]], all_offsets[first : last + 1] - base)
                values = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(found) + 1) * len(FEATURES), pa.int32()), pa.array(found.ravel())
                )
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), values], ["doc_id", "stats"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(measure, f"doc_id {kind}, stats array<double>")


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(FEATURES))


class Discriminant:
    """Class means with the inverse Cholesky factors of their shrunk covariances."""

    def __init__(self, sums: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> None:
        self.classes = {}
        total = sum(n for n, _, _ in sums.values())
        spread = {c: products - np.outer(s, s) / n for c, (n, s, products) in sums.items()}
        pooled = sum(spread.values()) / max(total, 1) if sums else None
        for c, (n, s, _) in sums.items():
            own = (1 - SHRINK_POOLED) * spread[c] / n + SHRINK_POOLED * pooled
            own = (1 - SHRINK_DIAGONAL) * own + SHRINK_DIAGONAL * np.diag(np.diag(own))
            own += 1e-3 * np.eye(len(own))
            factor = np.linalg.cholesky(own)
            self.classes[c] = (s / n, np.linalg.inv(factor), np.log(np.diag(factor)).sum(), np.log(n / total))

    def scores(self, values: np.ndarray) -> np.ndarray:
        """Chance of class 1."""
        if len(self.classes) < 2:
            return np.full(len(values), float(next(iter(self.classes), 0.5)))
        logs = {}
        for c, (mean, inverse, log_root, prior) in self.classes.items():
            distance = (((values - mean) @ inverse.T) ** 2).sum(axis=1)
            logs[c] = -0.5 * distance - log_root + prior
        return 1.0 / (1.0 + np.exp(np.clip((logs[0] - logs[1]) / TEMPER, -500, 500)))


def fit(stats: DataFrame, labels: DataFrame, divisor: int = 5, held: int = 0) -> Discriminant:
    """Learn from every labelled row of ``stats`` outside the held-out fold."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            label, values = batch.column("quality").to_numpy(), matrix(batch.column("stats"))
            for c in np.unique(label).tolist():
                mine = values[label == c]
                part = np.concatenate([[len(mine)], mine.sum(axis=0), (mine.T @ mine).ravel()])
                sums[c] = sums.get(c, 0) + part
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tolist() for v in sums.values()])], ["quality", "sums"])

    known = (
        labels.where("quality in (0, 1) and doc_id is not null")
        .groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.max("quality").alias("_max"))
        .where("quality = _max")
    )
    rows = stats.where(remainder(F.col("doc_id"), divisor) != held).join(known.drop("_max"), "doc_id")
    partial = rows.select("quality", "stats").mapInArrow(add, "quality int, sums array<double>")
    summed = partial.select("quality", F.posexplode("sums").alias("at", "v")).groupBy("quality", "at").agg(F.sum("v").alias("v"))
    found: dict[int, np.ndarray] = {}
    size = len(FEATURES)
    for row in summed.collect():  # two classes of 1 + size + size ** 2 numbers
        found.setdefault(row["quality"], np.zeros(1 + size + size * size))[row["at"]] = row["v"]
    return Discriminant({c: (v[0], v[1 : size + 1], v[size + 1 :].reshape(size, size)) for c, v in found.items()})


def scored(stats: DataFrame, model: Discriminant, divisor: int = 5, held: int = 0) -> DataFrame:
    shared = shared_object(stats.sparkSession, model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(known.scores(matrix(batch.column("stats"))))], ["doc_id", "score"]
            )

    kind = stats.schema["doc_id"].dataType.simpleString()
    found = stats.select("doc_id", "stats").mapInArrow(score, f"doc_id {kind}, score double")
    return found.select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), divisor) == held, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"),
    )


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``; see the module."""
    stats = materialize(with_statistics(docs), "statistics")
    return scored(stats, fit(stats, labels))


def without_rejects(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all columns, in one pass without a shuffle."""
    model = shared_object(docs.sparkSession, fit(materialize(with_statistics(docs), "statistics"), labels))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model()
        for batch in batches:
            data, all_offsets = text_bytes(batch.column("text"))
            for first, last in slices(all_offsets):
                base = all_offsets[first]
                found = statistics(data[base : all_offsets[last]], all_offsets[first : last + 1] - base)
                yield batch.slice(first, last - first).filter(pa.array(known.scores(found) >= KEEP_FROM))

    return docs.mapInArrow(keep, docs.schema)
