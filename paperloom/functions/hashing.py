"""Keys and stable hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def query_key(query: Column) -> Column:
    """Cache key of a question text."""
    return F.concat(F.lit("query_"), F.md5(query))


def content_id(text: Column) -> Column:
    return F.sha2(text, 256)


def hashed_feature(digest: Column, dims: int) -> tuple[Column, Column]:
    """Bucket below ``dims`` and sign (1 or -1) from the first four hex digits of a digest."""
    value = F.conv(F.substring(digest, 1, 4), 16, 10).cast("int")
    odd = F.floor(value / dims) % 2 == 1
    return value % dims, F.when(odd, F.lit(-1)).otherwise(F.lit(1))
