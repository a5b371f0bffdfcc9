"""Exact duplicates by deterministic block naming, in DataFrame functions only.

Method (Karp, Miller and Rosenberg 1972): a text is cut into blocks of ``BLOCK`` code points.
All distinct blocks are sorted and numbered, so equal blocks have equal integer names and
different ones never do. Then the distinct pairs of neighbouring names are sorted and numbered
in turn, which halves the names of a document, until each has a single one. Two documents
with the same name of the same round are equal texts, without any chance of collision.

A block reaches its name by two 64-bit hashes that only route it: the aggregate that finds the
distinct blocks compares whole blocks, and it is checked that no two of them share both hashes;
if any did, all is done again with another seed. A document that holds a block or pair
which occurs once is settled as unique in that round and takes no further part, so only texts
that can be copies go on. Whole texts move once, as blocks combined before the exchange, and
are never stored; later rounds carry integers. Names of many rows are joined in parts
(``fanned_join``), groups are pre-aggregated, and every round ends in a stored table.

Results: every row of ``docs`` gives a row. A null text is an empty one, and empty texts are
copies of each other. Of equal texts the row with the largest ``doc_id`` stays; a null id
is smaller than any other, and of repeated rows of that id only the first read stays. An empty
table gives no rows. Only ``doc_id`` and ``text`` are read, whatever other columns are named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.storage import materialize

BLOCK = 4096
#: A key is joined in parts if it has more rows than this and than this share of all rows,
#: so at most ``HOT_SHARE`` keys are broadcast.
HOT_ROWS, HOT_SHARE = 1000, 10_000
MISSING = -1


def blocks(text: Column) -> Column:
    """The text in blocks of ``BLOCK`` code points; an empty text is one empty block."""
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}+"), F.lit(0))
    return F.when(F.length(text) <= BLOCK, F.array(text)).otherwise(cut)


def routes(block: Column, seed: int) -> Column:
    """Two hashes that tell an aggregate and a join where a block belongs."""
    return F.struct(F.xxhash64(F.lit(seed), block).alias("left"), F.xxhash64(block, F.lit(seed)).alias("right"))


def numbered(keyed: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct ``keys`` with ``n`` rows and an integer ``name``: their place in sorted partitions."""
    counted = keyed.groupBy(*keys).agg(F.count("*").alias("n"))
    return counted.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def fanned_join(rows: DataFrame, names: DataFrame, keys: list[str], spread: str) -> DataFrame:
    """Join rows to the single row of their keys in ``names``, which counts them in ``n``.

    The rows of a hot key are spread over parts that follow its count, and its name is
    repeated once a part.
    """
    total = names.agg(F.sum("n")).head()[0] or 0
    most = max(HOT_ROWS, total // HOT_SHARE)
    hot = names.where(F.col("n") > most).select(*keys, F.ceil(F.col("n") / most).cast("int").alias("_fan"))
    if hot.head() is None:
        return rows.join(names, keys)
    fanned = rows.join(F.broadcast(hot), keys, "left")
    part = F.pmod(F.xxhash64(spread), F.coalesce("_fan", F.lit(1))).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / most).cast("int") - 1))
    return fanned.withColumn("_part", part).drop("_fan").join(names.withColumn("_part", copies), [*keys, "_part"]).drop("_part")


def first_names(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored rows ``_row, _id, _sha, _keys`` with routes for blocks, and the stored names of these."""
    seed = 0
    while True:
        found = texts.select(F.explode(blocks(F.col("_text"))).alias("block")).select(routes(F.col("block"), seed).alias("_key"), "block")
        distinct = numbered(found.select("_key.left", "_key.right", "block"), ["left", "right", "block"])
        names = materialize(distinct.drop("block"), "block-names")
        if names.groupBy("left", "right").count().where("count > 1").head() is None:
            break
        seed += 1
    keys = F.transform(blocks(F.col("_text")), lambda b: routes(b, seed))
    rows = texts.select(
        F.monotonically_increasing_id().alias("_row"), F.col("_id"), F.sha2("_text", 256).alias("_sha"), keys.alias("_keys")
    )
    return materialize(rows, "rows"), names


def paired(names: Column) -> Column:
    """Neighbouring names two by two; the last of an odd number is alone."""
    starts = F.sequence(F.lit(0), F.size(names) - 1, F.lit(2))
    return F.transform(starts, lambda i: F.struct(F.get(names, i).alias("left"), F.coalesce(F.get(names, i + 1), F.lit(MISSING)).alias("right")))


def identities(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``_row, _round, _name`` of the rows that may have copies: equal for equal texts only."""
    found, number, open_rows = None, 0, rows
    while True:
        seen = open_rows.select("_row", F.posexplode("_keys").alias("_at", "_key")).select("_row", "_at", "_key.left", "_key.right")
        names = names if number == 0 else materialize(numbered(seen, ["left", "right"]), "pair-names")
        joined = fanned_join(seen, names, ["left", "right"], "_row")
        put = F.transform(F.array_sort(F.collect_list(F.struct("_at", "name"))), lambda s: s["name"])
        whole = joined.groupBy("_row").agg(F.min("n").alias("_least"), put.alias("_names"))
        shared = materialize(whole.where("_least > 1").select("_row", "_names"), "named")
        ended = shared.where(F.size("_names") == 1).select("_row", F.lit(number).alias("_round"), F.col("_names")[0].alias("_name"))
        found = ended if found is None else found.unionByName(ended)
        going = shared.where(F.size("_names") > 1)
        if going.head() is None:
            return found
        open_rows, number = going.select("_row", paired(F.col("_names")).alias("_keys")), number + 1


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row; see the module."""
    texts = docs.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("_text"))
    rows, names = first_names(texts)
    named = identities(rows, names).join(rows.select("_row", "_id"), "_row")
    named = materialize(named, "identities")
    best = F.max(F.struct(F.col("_id"), (-F.col("_row")).alias("_back")))
    groups = materialize(named.groupBy("_round", "_name").agg(F.count("*").alias("n"), best.alias("_best")), "groups")
    settled = fanned_join(named.drop("_id"), groups, ["_round", "_name"], "_row")
    settled = settled.select("_row", "n", F.col("_best._id").alias("_keep"), (-F.col("_best._back")).alias("_first"))
    copy = F.col("n").isNotNull()
    return rows.drop("_keys").join(settled, "_row", "left").select(
        F.col("_id").alias("doc_id"),
        F.when(copy, F.col("_keep")).otherwise(F.col("_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        F.when(copy, F.col("_row") == F.col("_first")).otherwise(F.lit(True)).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``exact_duplicates`` drops, all columns kept.

    For tables with one row an id; of repeated rows of a kept id all stay.
    """
    dropped = exact_duplicates(docs).where(~F.col("kept") & ~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti")
