"""Numpy views of Arrow text columns: bytes or code points, runs, and 64-bit hashes of runs.

Inside a task a batch of texts is one flat array. Texts are cut into slices of bounded
size, so that working arrays stay a few tens of MB; only one text that is longer than a
slice gets arrays of its own size.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

SLICE = 1 << 20
STEP = 0x9E3779B97F4A7C15 | 1
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def worker_cache(key: Any, make: Callable[[], Any]) -> Any:
    """A value kept as long as the Python worker lives, across its tasks."""
    home = sys.modules.setdefault("_paperloom_worker", types.ModuleType("_paperloom_worker"))
    kept = home.__dict__.setdefault("kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def shared_object(spark: SparkSession, made: Any) -> Callable[[], Any]:
    """Broadcast an object of a class of this package; in a task the result gives the object.

    Only its plain attributes are broadcast. The class travels with the task's function, by
    value, so workers need no install; a broadcast object itself would be pickled by reference.
    """
    kind, shared = type(made), spark.sparkContext.broadcast(vars(made))

    def get() -> Any:
        one = kind.__new__(kind)
        one.__dict__.update(shared.value)
        return one

    return get


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and offsets: text i is ``data[offsets[i]:offsets[i + 1]]``.

    A null text is an empty one.
    """
    pa.default_memory_pool().release_unused()  # what earlier batches freed goes back to the system
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column, wide = column.cast(pa.large_string()), True
    kind = np.dtype(np.int64 if wide else np.int32)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, dtype=kind, count=len(column) + 1, offset=kind.itemsize * column.offset).astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold at most ``most`` units together, or one longer text."""
    first, count = 0, len(offsets) - 1
    while first < count:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), count)
        yield first, last
        first = last


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts as one array, with offsets."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32), offsets


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true cells that do not cross a text's border: starts, ends, text index."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    borders = offsets[(offsets > 0) & (offsets < len(inside))]
    before[borders] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[borders - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finaliser of splitmix64)."""
    values = values ^ (values >> np.uint64(30))
    values = values * MIX_1
    values = values ^ (values >> np.uint64(27))
    values = values * MIX_2
    return values ^ (values >> np.uint64(31))


def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``STEP`` and of its inverse, modulo 2^64; grown when a longer text comes."""
    kept = worker_cache("powers", dict)
    if kept.get("count", 0) < count:
        size = max(count, SLICE + 1)
        inverse = pow(STEP, -1, 1 << 64)
        found = []
        for base in (STEP, inverse):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            found.append(np.cumprod(steps, dtype=np.uint64))
        if size > 4 * SLICE:
            return found[0][:count], found[1][:count]
        kept.update(count=size, found=found)
    return kept["found"][0][:count], kept["found"][1][:count]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal runs of ``values`` get equal 64-bit hashes, wherever they stand.

    A polynomial over the run modulo 2^64, from prefix sums; then mixed with its length.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    if values.dtype == np.uint8:
        table = worker_cache("byte values", lambda: mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(STEP)))
        terms = table[values]
    else:
        terms = mixed((values.astype(np.uint64) + np.uint64(1)) * np.uint64(STEP))
    power, inverse = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(terms * power[:-1], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def chained(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive values; entry i covers i to i + width - 1."""
    count = len(hashes) - width + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(count, np.uint64)
    factor = 1
    for step in range(width):
        total += hashes[step : step + count] * np.uint64(factor)
        factor = factor * STEP % (1 << 64)
    return mixed(total)


def lower_ascii() -> np.ndarray:
    """Byte table that maps A-Z to a-z."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Byte table that is true inside the given inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


def not_white() -> np.ndarray:
    """True for bytes of words split at space, tab, line feed, vertical tab, form feed, return."""
    return ~byte_class((0x20, 0x20), (0x09, 0x0D))


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the lower-cased (A-Z only) bytes: lowered bytes, starts, ends, text index, hashes."""
    lowered = lower_ascii()[data]
    starts, ends, owner = runs(inside[lowered], offsets)
    return lowered, starts, ends, owner, run_hashes(lowered, starts, ends)
