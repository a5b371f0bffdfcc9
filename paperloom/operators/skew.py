"""Building blocks that stay distributed when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.storage import materialize

HOT_KEYS = 256
HOT_MIN_ROWS = 50_000
SALTS = 16


class HotKeys(list):
    """Frequent keys, with the row count of the most frequent one."""

    most = 0


def hot_values(df: DataFrame, key: str, share: float = 0.0, min_rows: int = HOT_MIN_ROWS) -> HotKeys:
    """Values of ``key`` with more rows than one task should have; at most ``HOT_KEYS``.

    One pass with a mergeable frequent-items sketch: nothing is shuffled by key. Estimates
    only decide which rows get salted, never which rows are kept.
    """
    row = df.agg(
        F.expr(f"approx_top_k({key}, {HOT_KEYS}, {40 * HOT_KEYS})").alias("top"), F.count("*").alias("n")
    ).head()
    least = max(share * row["n"], min_rows)
    found = [item for item in row["top"] or [] if item["count"] > least]
    keys = HotKeys(item["item"] for item in found)
    keys.most = max((item["count"] for item in found), default=0)
    return keys


def top_keys(counts: DataFrame, keys: list[str], count: str) -> DataFrame:
    """The ``HOT_KEYS`` most frequent keys of a count table.

    Any other key holds less than 1 / ``HOT_KEYS`` of the counted rows.
    """
    return counts.orderBy(F.desc(count)).limit(HOT_KEYS).select(*keys)


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    spread: Column,
    hot: DataFrame | Column,
    how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Join many ``left`` rows to the single ``right`` row of their key.

    ``hot`` names the keys with very many left rows: a table of at most ``HOT_KEYS`` keys,
    which is broadcast, or a condition. Their left rows are spread over ``salts`` by
    ``spread`` and their right row is repeated once per salt. Other keys have one salt.
    """

    def with_fan(df: DataFrame) -> DataFrame:
        if isinstance(hot, Column):
            return df.withColumn("_fan", F.when(hot, F.lit(salts)).otherwise(F.lit(1)))
        marked = df.join(F.broadcast(hot.select(*keys, F.lit(salts).alias("_hot"))), keys, "left")
        return marked.withColumn("_fan", F.coalesce("_hot", F.lit(1))).drop("_hot")

    salted_left = with_fan(left).withColumn("_salt", F.pmod(F.xxhash64(spread), F.col("_fan")).cast("int"))
    salted_right = with_fan(right).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_fan") - 1)))
    joined = salted_left.drop("_fan").join(salted_right.drop("_fan"), [*keys, "_salt"], how)
    return joined.drop("_salt")


def row_lookup(left: DataFrame, right: DataFrame, key: str, spread: Column, how: str = "left") -> DataFrame:
    """``lookup_join`` that salts only the keys found to be hot in ``left``.

    The number of salts follows the rows of the most frequent key, so a task gets some
    ``HOT_MIN_ROWS`` of it whatever its share; at most ``HOT_KEYS`` right rows are repeated.
    """
    values = hot_values(left, key)
    if not values:
        return left.join(right, key, how)
    salts = max(SALTS, -(-getattr(values, "most", 0) // HOT_MIN_ROWS))
    return lookup_join(left, right, [key], spread, F.col(key).isin(*values), how, salts)


def number_rows(
    df: DataFrame, keys: list[str], order: list[Column], name: str = "rn"
) -> DataFrame:
    """Exact 1-based row number inside each ``keys`` group, without one task per group.

    A distributed sort on keys and order lets a group span many partitions. The sorted
    rows are stored once; each partition's first position and count per group give the
    offset to add, and that offset table has at most groups + partitions rows.
    """
    ordered = df.orderBy(*keys, *order).withColumn("_at", F.monotonically_increasing_id())
    stored = materialize(ordered).withColumn("_part", F.shiftrightunsigned("_at", 33))
    runs = stored.groupBy("_part", *keys).agg(
        F.min("_at").alias("_first"), F.count("*").alias("_rows")
    )
    earlier = (
        Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    runs = runs.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    # Keys may be null, so the offsets are matched null-safe.
    named = runs.select(F.col("_part").alias("_run"), *(F.col(k).alias(f"_run_{k}") for k in keys), "_first", "_before")
    same = F.col("_part") == F.col("_run")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_run_{k}"))
    return (
        stored.join(named, same)
        .withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1)
        .drop("_at", "_part", "_first", "_before", "_run", *(f"_run_{k}" for k in keys))
    )


def running_totals(df: DataFrame, keys: list[str], order: list[Column], weight: str, name: str = "upto") -> DataFrame:
    """Sum of ``weight`` of all rows up to each one inside its ``keys`` group, as ``number_rows`` numbers them."""
    ordered = df.orderBy(*keys, *order).withColumn("_at", F.monotonically_increasing_id())
    stored = materialize(ordered).withColumn("_part", F.shiftrightunsigned("_at", 33))
    runs = stored.groupBy("_part", *keys).agg(F.sum(weight).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    named = runs.select(F.col("_part").alias("_run"), *(F.col(k).alias(f"_run_{k}") for k in keys), "_before")
    same = F.col("_part") == F.col("_run")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_run_{k}"))
    inside = Window.partitionBy("_part", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    counted = stored.withColumn("_here", F.sum(weight).over(inside)).join(named, same)
    return counted.withColumn(name, F.col("_here") + F.col("_before")).drop("_at", "_part", "_here", "_before", "_run", *(f"_run_{k}" for k in keys))


def top_rows(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per group; Spark cuts to k inside each task before the shuffle."""
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(ranked)).where(F.col(name) <= k)
