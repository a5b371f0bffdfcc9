"""Content handlers and embedders by type: registries that a user can add to.

A handler is a table function over batches ``id, content`` with the one result schema
``SCHEMA``. Rows go to the handler of their type; each handler is one branch of the plan.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import text as tx

SCHEMA = "id string, part string, value string, status string, error string"


#: Rows that are held as Python objects before they go on as a table.
ROWS_PER_TABLE = 10_000


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.table({n: pa.array(c, pa.string()) for n, c in zip(("id", "part", "value", "status", "error"), columns, strict=True)})


class Handler:
    """Base of handlers: ``parts(content)`` gives ``(part, value)`` pairs of one text.

    A text that makes it fail becomes a failed row and never ends the job.
    """

    def parts(self, content: str) -> Iterator[tuple[str, str]]:
        raise NotImplementedError

    def eval(self, table: pa.RecordBatch) -> Iterator[pa.Table]:
        rows: list[tuple] = []
        for name, content in zip(table.column("id"), table.column("content"), strict=True):
            try:
                rows += [(name.as_py(), part, value, "success", None) for part, value in self.parts(content.as_py() or "")]
            except Exception as e:  # any fault of a handler is that row's own
                rows.append((name.as_py(), None, None, "failed", f"{type(e).__name__}: {e}"))
            if len(rows) >= ROWS_PER_TABLE:
                yield _table(rows)
                rows = []
        yield _table(rows)


class Lines(Handler):
    """Lines that are not empty."""

    def parts(self, content: str) -> Iterator[tuple[str, str]]:
        return ((f"line {i}", line) for i, line in enumerate(content.split("\n")) if line)


class Titles(Handler):
    """Titles of a page, as text."""

    def parts(self, content: str) -> Iterator[tuple[str, str]]:
        for title in re.findall(tx.TITLE, content):
            text = re.sub(tx.MARKUP_BLOCKS[-1], "", title)
            for entity, char in tx.ENTITIES:
                text = text.replace(entity, char)
            yield "title", re.sub("[ \\t\\r\\n]+", " ", text).strip(" ")


def handled(rows: DataFrame, registry: dict[str, type[Handler]]) -> DataFrame:
    """``SCHEMA`` rows of ``rows(id, type, content)`` by the handler of each type.

    A type without a handler, null too, gives a failed row that names it.
    """
    known = F.coalesce(F.col("type").isin(*registry), F.lit(False))
    error = F.concat(F.lit("no handler for "), F.coalesce("type", F.lit("no type")))
    none = F.lit(None).cast("string")
    found = rows.where(~known).select(F.col("id").cast("string").alias("id"), none.alias("part"), none.alias("value"), F.lit("failed").alias("status"), error.alias("error"))
    for handler in dict.fromkeys(registry.values()):
        types = [name for name, own in registry.items() if own is handler]
        mine = rows.where(F.col("type").isin(*types)).select(F.col("id").cast("string").alias("id"), "content")
        found = found.unionByName(F.arrow_udtf(handler, returnType=SCHEMA)(mine.asTable()))
    return found


Embedder = Callable[[DataFrame, str, str], DataFrame]


def embedded(rows: DataFrame, registry: dict[str, Embedder]) -> DataFrame:
    """``id, type, embedding`` by the embedder of each type, called as ``embedder(rows, "id", "content")``.

    A type without an embedder has a null vector, so that it can be found and is never lost.
    """
    known = F.coalesce(F.col("type").isin(*registry), F.lit(False))
    found = rows.where(~known).select("id", "type", F.lit(None).cast("array<double>").alias("embedding"))
    for name, embedder in registry.items():
        vectors = embedder(rows.where(F.col("type") == name).select("id", "content"), "id", "content")
        found = found.unionByName(vectors.select("id", F.lit(name).alias("type"), "embedding"))
    return found
