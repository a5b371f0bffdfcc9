"""Prefix trie of conversations from padded matrices of turn ids.

Every conversation is rebuilt: the first ``h`` turns of the base conversation (the id without
its last two digits), then its own turns after its first ``h``. Each distinct sequence of first
``d`` turns is a node of the trie.

Method: rebuilt conversations are paths of 128-bit turn digests. Spark sorts them into range
shards by (path, id). A task takes its shard in slices: the digests of a slice become a
padded matrix of small turn ids, ``lexsort`` orders it, and the change masks between
neighbouring rows, OR-accumulated over the columns, mark where a node starts at each depth.
``reduceat`` over these starts sums up members, children, leaves and saved tokens of every
depth. Only the nodes on the first and the last path of a slice can go on in another one:
they leave the task as partial sums under a digest of their path. The sums are additive but for
what two neighbouring slices both counted as new, the nodes they share; for each border of two
slices these are taken back, in the task or, between tasks, from a table with the first and last
path of each task. The partial rows are then summed up in Spark, and the nodes right below
them look up their parent.

What bounds a task: a slice has at most ``CELLS`` matrix cells (or one longer conversation). The
ids that end at one node come in sorted parts and pass through its hash as a stream. One
conversation's turn digests (16 bytes a turn) are one row, since a path is one key of the sort.

Results: ``turn`` sorts null first; turns of equal number are ordered by role, then by digest.
A null role or text is an empty one; repeated rows are turns of their own. Rows without a
``conv_id`` belong to no conversation and give no node. A conversation that is empty after
rebuilding is a member of the root. An empty table has no node, not even the root. Only
``conv_id``, ``turn``, ``role`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.operators.skew import row_lookup
from paperloom.storage import materialize

GROUP = 100
MOST_HEAD = 6
CELLS = 1 << 20
EMPTY = hashlib.sha256(b"").hexdigest()
ROOT = ""
SUMS = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
PARTIAL = (
    "kind int, key string, parent_key string, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, "
    "n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, slice bigint, ends array<bigint>, "
    "first array<binary>, last array<binary>, first_chars array<bigint>"
)
#: Kinds of rows that leave a task: finished nodes, partial ones, and the task's two outer paths.
NODE, PART, BORDER = 0, 1, 2


def digest(role: Column, text: Column) -> Column:
    """16 bytes that stand for a turn; the role's length keeps the two fields apart."""
    whole = F.concat_ws("|", F.length(role).cast("string"), role, text)
    return F.substring(F.unhex(F.sha2(whole, 256)), 1, 16)


def rebuilt(turns: DataFrame) -> DataFrame:
    """``conv_id, path, chars``: digests and lengths of every conversation's rebuilt turns."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.struct(F.col("turn").alias("turn"), role.alias("role"), digest(role, text).alias("id"), F.length(text).cast("bigint").alias("chars")).alias("turn"),
    )
    listed = F.transform(F.array_sort(F.collect_list("turn")), lambda t: F.struct(t["id"].alias("id"), t["chars"].alias("chars")))
    own = materialize(rows.groupBy("conv_id").agg(listed.alias("turns")), "conversations")
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    heads = own.where(F.col("conv_id") == base).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, MOST_HEAD - 1).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_HEAD).cast("int")
    both = own.withColumn("_base", base).withColumn("_h", h).join(heads, "_base", "left")
    head = F.slice(F.coalesce("_head", F.array().cast("array<struct<id:binary,chars:bigint>>")), F.lit(1), F.col("_h"))
    rest = F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    path = both.select("conv_id", F.concat(head, rest).alias("path"))
    return path.select("conv_id", F.col("path.id").alias("path"), F.col("path.chars").alias("chars"))


def matrix(digests: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows of turn ids, from 1 and in the order of the digests; 0 pads behind the last turn."""
    padded = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int32)
    if len(digests):
        high, low = digests.astype(np.uint64).T
        order = np.lexsort((low, high))
        changed = np.ones(len(order), bool)
        changed[1:] = (np.diff(high[order]) != 0) | (np.diff(low[order]) != 0)
        ids = np.empty(len(order), np.int32)
        ids[order] = np.cumsum(changed)
        padded[np.arange(padded.shape[1]) < sizes[:, None]] = ids
    return padded


def path_keys(path: list[bytes], seed: str = ROOT) -> list[str]:
    """A digest of each prefix of a path, the textless root first."""
    keys = [seed]
    for turn in path:
        keys.append(hashlib.sha256(bytes.fromhex(keys[-1]) + turn).hexdigest()[:32])
    return keys


class Rows:
    """Columns of rows that leave a task."""

    names = [c.strip().split(" ")[0] for c in PARTIAL.split(",")]

    def __init__(self) -> None:
        self.rows: dict[str, list] = {name: [] for name in self.names}
        self.count = 0

    def add(self, count: int, **columns) -> None:
        for name in self.names:
            values = columns.get(name)
            self.rows[name].extend(values if values is not None else [None] * count)
        self.count += count

    def batch(self) -> pa.RecordBatch:
        kinds = {
            "kind": pa.int32(), "key": pa.string(), "parent_key": pa.string(), "ends_sha256": pa.string(), "ends": pa.list_(pa.int64()),
            "first": pa.list_(pa.binary()), "last": pa.list_(pa.binary()), "first_chars": pa.list_(pa.int64()),
        }
        arrays = [pa.array(self.rows[name], kinds.get(name, pa.int64())) for name in self.names]
        return pa.RecordBatch.from_arrays(arrays, self.names)


def taken_back(last: list[bytes], first: list[bytes], chars: list[int]) -> dict[str, list]:
    """What two neighbouring slices both counted as new, by node they share, as negative rows.

    ``last`` ends one slice and ``first``, with its turn lengths, begins the next. Shared are
    the prefixes up to their common one: each was counted as a child twice, its last text was
    subtracted twice from the saved ones, and ``last`` was called a leaf though it goes on.
    """
    common = 0
    for a, b in zip(last, first, strict=False):
        if a != b:
            break
        common += 1
    below = np.zeros(common + 1, np.int64)
    below[:common] = np.cumsum(np.array(chars[:common][::-1], np.int64))[::-1]
    # A node's own text counts too, but for the root, which has none.
    own = below + np.array([0, *chars[:common]], np.int64)
    keys = path_keys(first[:common])
    return {
        "kind": [PART] * (common + 1),
        "key": keys,
        "parent_key": [None, *keys[:-1]],
        "depth": list(range(common + 1)),
        "n_convs": [0] * (common + 1),
        "n_children": [-1] * common + [0],
        "n_leaves": [-int(len(last) == common)] * (common + 1),
        "saved_tokens": own.tolist(),
    }


def slice_nodes(conv: np.ndarray, digests: np.ndarray, chars: np.ndarray, sizes: np.ndarray, number: int, out: Rows) -> tuple[list, list, list]:
    """Add the nodes of one slice to ``out``; its first path with lengths, and its last path."""
    padded = matrix(digests, sizes)
    order = np.lexsort((conv, *padded.T[::-1]))
    starts_at = (np.cumsum(sizes) - sizes)[order]
    padded, conv, sizes = padded[order], conv[order], sizes[order]
    rows, width = padded.shape
    # new[i, j]: row i differs from the row above in one of the columns up to j.
    new = np.ones((rows, width), bool)
    new[1:] = padded[1:] != padded[:-1]
    np.logical_or.accumulate(new, axis=1, out=new)
    begins = new & (padded != 0)
    shared = np.where(new.any(axis=1), new.argmax(axis=1), width) if width else np.zeros(rows, np.int64)
    leaf = np.ones(rows, np.int64)
    leaf[:-1] = shared[1:] < sizes[:-1]
    raw = digests.tobytes()

    def path_of(row: int) -> list[bytes]:
        begin = int(starts_at[row])
        return [raw[16 * t : 16 * t + 16] for t in range(begin, begin + int(sizes[row]))]

    first, last = path_of(0), path_of(rows - 1)
    first_chars = chars[starts_at[0] : starts_at[0] + sizes[0]].tolist()
    keys = path_keys(first), path_keys(last)
    segments = [np.zeros(1, np.int64), *(np.flatnonzero(new[:, d]) for d in range(width))]
    saved = np.zeros(rows, np.int64)
    found = []
    for depth in range(width, -1, -1):
        starts = segments[depth]
        here = starts if depth == 0 else starts[padded[starts, depth - 1] != 0]
        members = np.diff(np.append(starts, rows))
        if depth:
            members = members[padded[starts, depth - 1] != 0]
            saved[here] += (members - 1) * chars[starts_at[here] + depth - 1]
        keep = np.searchsorted(starts, here)
        sums = [
            members,
            np.add.reduceat(begins[:, depth], starts, dtype=np.int64)[keep] if depth < width else np.zeros(len(here), np.int64),
            np.add.reduceat(leaf, starts)[keep],
            np.add.reduceat(saved, starts)[keep],
            np.minimum.reduceat(conv, starts)[keep],
            np.add.reduceat(sizes == depth, starts, dtype=np.int64)[keep],
        ]
        found.append((depth, here, sums))
    found.reverse()
    least = {0: found[0][2][4]}
    for depth, here, (members, children, leaves, spared, lowest, ending) in found:
        least[depth] = lowest
        count = len(here)
        outer = (here == 0) | (here + members == rows)
        up = np.searchsorted(found[depth - 1][1], here, side="right") - 1 if depth else np.zeros(count, np.int64)
        if depth:
            above, held = found[depth - 1][1], found[depth - 1][2][0]
            outer_up = ((above == 0) | (above + held == rows))[up]
            last_up = (above + held == rows)[up] & (above != 0)[up]
            parent = least[depth - 1][up]
        for edge in (False, True):
            mine = np.flatnonzero(outer == edge)
            if not len(mine):
                continue
            ids = [conv[here[i] : here[i] + ending[i]] for i in mine.tolist()]
            columns = dict(
                kind=[PART if edge else NODE] * len(mine),
                conv_id=lowest[mine].tolist(),
                depth=[depth] * len(mine),
                **{name: values[mine].tolist() for name, values in zip(SUMS, (members, children, leaves, spared), strict=True)},
            )
            if depth:
                # Outer nodes only lie on the two outer paths, so a parent's key is one of theirs.
                names = [keys[int(l)][depth - 1] if o else None for o, l in zip(outer_up[mine], last_up[mine], strict=True)]
                columns["parent_key"] = names
                columns["parent_conv_id"] = [None if n is not None else p for n, p in zip(names, parent[mine].tolist(), strict=True)]
            if edge:
                columns["key"] = [keys[int(here[i] != 0)][depth] for i in mine.tolist()]
                columns["ends"] = [i.tolist() if len(i) else None for i in ids]
                columns["slice"] = [number] * len(mine)
            else:
                columns["ends_sha256"] = [hashlib.sha256(",".join(map(str, i.tolist())).encode()).hexdigest() if len(i) else EMPTY for i in ids]
            out.add(len(mine), **columns)
    return first, first_chars, last


def cuts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose padded matrix has at most ``CELLS`` cells, or one row."""
    first, widest = 0, 0
    for row, size in enumerate(sizes.tolist()):
        widest = max(widest, size, 1)
        if row > first and (row + 1 - first) * widest > CELLS:
            yield first, row
            first, widest = row, max(size, 1)
    if first < len(sizes):
        yield first, len(sizes)


def shard_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes, partial nodes and outer paths of one sorted shard."""
    number, outer, before = 0, None, None
    for batch in batches:
        conv = batch.column("conv_id").to_numpy()
        paths, lengths = batch.column("path"), batch.column("chars")
        sizes = np.diff(paths.offsets.to_numpy()).astype(np.int64)
        flat = paths.flatten()
        digests = np.frombuffer(b"".join(flat.to_pylist()), dtype=">u8").reshape(-1, 2)
        chars = lengths.flatten().to_numpy().astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        for first, last in cuts(sizes):
            out = Rows()
            span = slice(int(offsets[first]), int(offsets[last]))
            if number == 0:
                from pyspark import TaskContext

                number = (TaskContext.get().partitionId() << 32) + 1
            begin, begin_chars, end = slice_nodes(conv[first:last], digests[span], chars[span], sizes[first:last], number, out)
            if before is not None:
                back = taken_back(before, begin, begin_chars)
                out.add(len(back["key"]), **back)
            else:
                outer = begin, begin_chars
            before, number = end, number + 1
            yield out.batch()
    if before is not None:
        out = Rows()
        out.add(1, kind=[BORDER], slice=[number], first=[outer[0]], first_chars=[outer[1]], last=[before])
        yield out.batch()


def between_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is taken back at the borders between tasks."""
    for batch in batches:
        out = Rows()
        for before, first, chars in zip(*(batch.column(c).to_pylist() for c in ("before", "first", "first_chars")), strict=True):
            back = taken_back(before, first, chars)
            out.add(len(back["key"]), **back)
        yield out.batch()


def end_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash a key from its sorted parts, which pass as a stream."""
    current, state = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([current]), pa.array([state.hexdigest()])], ["key", "ends_sha256"])

    for batch in batches:
        for key, ids in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if key != current:
                if current is not None:
                    yield done()
                current, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(",".join(map(str, ids)).encode())
    if current is not None:
        yield done()


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations; see the module."""
    paths = materialize(rebuilt(turns), "paths")
    sharded = paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    left = materialize(sharded.mapInArrow(shard_nodes, PARTIAL), "trie")
    # One row a task: the path before each task's first one.
    borders = left.where(F.col("kind") == BORDER).select("slice", "first", "first_chars", "last")
    paired = borders.select(F.lag("last").over(Window.orderBy("slice")).alias("before"), "first", "first_chars").where("before is not null")
    back = paired.mapInArrow(between_tasks, PARTIAL)
    parts = left.where(F.col("kind") == PART).unionByName(back)
    summed = parts.groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in SUMS)
    )
    ended = left.where((F.col("kind") == PART) & F.col("ends").isNotNull()).select("key", "slice", "ends")
    hashes = ended.repartition("key").sortWithinPartitions("key", "slice").mapInArrow(end_hashes, "key string, ends_sha256 string")
    outer = materialize(summed.join(hashes, "key", "left").na.fill(EMPTY, ["ends_sha256"]), "outer-nodes")
    columns = ["conv_id", "depth", "parent_conv_id", *SUMS, "ends_sha256"]
    nodes = left.where(F.col("kind") == NODE)
    known = nodes.where("parent_key is null").select(*columns)
    root = outer.where("parent_key is null").withColumn("parent_conv_id", F.lit(None).cast("bigint")).select(*columns)
    asking = nodes.where("parent_key is not null").drop("parent_conv_id").unionByName(outer.where("parent_key is not null"), allowMissingColumns=True)
    parents = outer.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    found = row_lookup(asking, parents, "parent_key", F.struct("conv_id", "depth"), "inner").select(*columns)
    return known.unionByName(root).unionByName(found)
