"""Exact copies, near duplicates and their clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions.text import shingles, tokens
from paperloom.operators.components import components
from paperloom.operators.skew import HOT_KEYS, HOT_MIN_ROWS, lookup_join, row_lookup
from paperloom.storage import materialize

KEY_MARGIN = 2
BUCKET_ROWS = 4096
#: Up to so many ids (some 64 MB in a hash table) are broadcast.
BROADCAST_IDS = 2_000_000


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Groups of equal texts with their smallest id and their size."""
    return (
        docs.groupBy(F.md5("text").alias("checksum"))
        .agg(F.min("doc_id").alias("canonical"), F.count("*").alias("copies"))
        .where(F.col("copies") > 1)
    )


def _named_in(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The ``rows`` whose id is in ``pairs``, without an exchange; all of them where that needs too many ids."""
    ids = materialize(pairs.select("id").unionByName(pairs.select(F.col("other").alias("id"))).distinct(), "pair-ids")
    return rows.join(F.broadcast(ids), "id", "left_semi") if ids.count() <= BROADCAST_IDS else rows


def _verified(pairs: DataFrame, reps: DataFrame, width: int, threshold: float) -> DataFrame:
    """Pairs ``(id, other)`` whose shingle sets reach the threshold, with their Jaccard.

    Key sets are compared first, with a margin for two keys that are equal by chance; the
    few pairs left are compared on the shingles. Only sets that are in a pair are exchanged. One
    ``other`` may be asked for by very many documents, and is salted then.
    """
    keyed = _named_in(pairs, reps.select("id", "n", "grams"))
    others = keyed.select(F.col("id").alias("other"), F.col("n").alias("m"), F.col("grams").alias("_b"))
    shared = F.size(F.array_intersect("grams", "_b")) + KEY_MARGIN
    likely = materialize(
        row_lookup(pairs, others, "other", F.col("id"), "inner")
        .join(keyed, "id")
        .where(shared * (1 + threshold) >= threshold * (F.col("n") + F.col("m")))
        .select("id", "other"),
        "likely-pairs",
    )
    texts = _named_in(likely, reps.select("id", "words"))
    found = row_lookup(likely, texts.select(F.col("id").alias("other"), F.col("words").alias("_b")), "other", F.col("id"), "inner")
    sets = found.join(texts, "id").select(
        "id", "other", shingles(F.col("words"), width).alias("a"), shingles(F.col("_b"), width).alias("b")
    )
    sizes = sets.select(
        "id", "other", F.size("a").alias("n"), F.size("b").alias("m"), F.size(F.array_intersect("a", "b")).alias("c")
    )
    jaccard = F.col("c") / (F.col("n") + F.col("m") - F.col("c"))
    return sizes.select("id", "other", jaccard.alias("jaccard")).where(F.col("jaccard") >= threshold)


def _shingle_key(gram: Column) -> Column:
    return F.xxhash64(gram)


def _may_reach(threshold: float, at: str, size: str, other_at: str, other_size: str) -> Column:
    """Whether two sets with a common element at these places can share enough.

    Before the element at most the smaller place can be common, after it at most the
    smaller rest (the positional filter of set-similarity joins).
    """
    most = F.least(at, other_at) + F.least(F.col(size) - F.col(at), F.col(other_size) - F.col(other_at))
    return most * (1 + threshold) >= threshold * (F.col(size) + F.col(other_size)) - 1e-6


def _prepared(docs: DataFrame, threshold: float, width: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Texts by content, their shingle sets, and the postings of their prefixes.

    Two sets can only reach the threshold if they share a shingle among the first
    ``n - ceil(t * n) + 1`` in a common order (Chaudhuri 2006, Bayardo 2007). The order is by
    exact count, rarest first: shingles of one set alone fill the front, and a passage that
    many texts share comes last. Postings hold what other sets have too, with places.
    """
    worded = docs.select("doc_id", tokens(F.col("text")).alias("words"))
    content = F.sha2(F.array_join("words", " "), 256).alias("content")
    # As one string the words take less than half of what their array does in the exchange.
    members = worded.select("doc_id", F.array_join("words", " ").alias("_text"), content).groupBy("content").agg(
        F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.min_by("_text", "doc_id").alias("_text")
    )
    members = members.withColumn("words", F.filter(F.split("_text", " "), lambda t: t != ""))
    grams = members.select("*", shingles(F.col("words"), width).alias("_g"))
    reps = materialize(
        grams.select(
            "id", "content", "copies", "words", F.size("_g").alias("n"), F.transform("_g", _shingle_key).alias("grams")
        ),
        "shingle-sets",
    ).where("n > 0")
    # A window deals every shingle once, with a number for its set, where a count and a join would deal it twice.
    uses = reps.select("id", F.explode("grams").alias("g"))
    shared = uses.withColumn("df", F.count("*").over(Window.partitionBy("g"))).where("df > 1")
    found = shared.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("found"))
    # A margin against rounding of t * n: one shingle too many does no harm.
    needed = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1
    placed = reps.select("id", "n").join(found, "id").select(
        "id", "n", needed.alias("_needed"), F.posexplode("found").alias("_at", "_f"), (F.col("n") - F.size("found") + 1).alias("_first")
    )
    prefix = placed.select("id", "n", (F.col("_at") + F.col("_first")).alias("at"), F.col("_f.g").alias("g"), "_needed").where("at <= _needed")
    prefix = materialize(prefix.drop("_needed"), "prefixes")
    buckets = prefix.groupBy("g").agg(
        F.count("*").alias("size"), F.min(F.struct("id", "n", "at")).alias("first")
    ).where("size > 1")
    postings = materialize(
        row_lookup(prefix, buckets, "g", F.col("id"), "inner").select(
            "id", "n", "at", "g", "size", F.col("first.id").alias("first"), F.col("first.n").alias("m"), F.col("first.at").alias("first_at")
        ),
        "postings",
    )
    return worded.select("doc_id", content), reps, postings, prefix


def _first_matches(reps: DataFrame, postings: DataFrame, width: int, threshold: float) -> DataFrame:
    """Each set against the smallest id of every bucket it is in: one comparison a member."""
    pairs = materialize(
        postings.where("first < id")
        .where(_may_reach(threshold, "at", "n", "first_at", "m"))
        .select("id", F.col("first").alias("other"))
        .distinct(),
        "pairs",
    )
    return materialize(_verified(pairs, reps, width, threshold), "first-matches")


def _with_content(texts: DataFrame, reps: DataFrame, outcome: DataFrame) -> DataFrame:
    """What was found for each set, for every document that has its content."""
    most = reps.select("content", "copies").orderBy(F.desc("copies")).limit(HOT_KEYS).collect()
    copied = [row["content"] for row in most if row["copies"] > HOT_MIN_ROWS]
    return lookup_join(
        texts, outcome, ["content"], F.col("doc_id"), F.col("content").isin(*copied) if copied else F.lit(False)
    )


def near_duplicates(docs: DataFrame, threshold: float = 0.8, width: int = 3) -> DataFrame:
    """For each document, the smallest earlier document with Jaccard >= ``threshold``.

    Exact over the sets of ``width``-word shingles; shorter texts take no part. The
    result has at most one row per document, also where very many documents are alike.

    1. Equal word sequences are merged; each copy later inherits its representative's answer.
    2. Prefixes by rarity give buckets of sets that may be alike (see ``_prepared``).
    3. Each set is first compared with the smallest id of every bucket it is in. In a
       large group of near copies that settles all of them with one comparison each.
    4. What could still have a smaller partner than the one found is compared with the
       rest of its buckets; a bucket is cut into pieces by its own size.

    Keys only propose pairs; every reported pair was compared on its shingles.
    """
    texts, reps, postings, _ = _prepared(docs, threshold, width)
    first_found = _first_matches(reps, postings, width, threshold)
    best = first_found.groupBy("id").agg(F.min("other").alias("found"))

    fan = F.greatest(F.lit(1), F.ceil(F.col("size") / BUCKET_ROWS)).cast("int")
    open_postings = (
        postings.where("size > 2 and first < id")
        .join(best, "id", "left")
        .withColumn("below", F.coalesce("found", "id"))
        .where(F.col("below") > F.col("first"))
    )
    salted = open_postings.select(
        "id", "n", "at", "g", "first", "below", F.explode(F.sequence(F.lit(0), fan - 1)).alias("salt")
    )
    others = postings.where("size > 2").select(
        F.col("id").alias("other"),
        F.col("n").alias("m"),
        F.col("at").alias("other_at"),
        "g",
        F.pmod(F.xxhash64("id"), fan).cast("int").alias("salt"),
    )
    rest_pairs = materialize(
        salted.join(others, ["g", "salt"])
        .where((F.col("other") > F.col("first")) & (F.col("other") < F.col("below")))
        .where(_may_reach(threshold, "at", "n", "other_at", "m"))
        .select("id", "other")
        .distinct(),
        "pairs",
    )
    rest_found = _verified(rest_pairs, reps, width, threshold)
    answers = (
        first_found.unionByName(rest_found)
        .groupBy("id")
        .agg(F.min_by(F.struct("other", "jaccard"), "other").alias("match"))
    )
    joined = _with_content(texts, reps, reps.select("content", "id").join(answers, "id", "left"))
    own_copy = F.struct(F.col("id").alias("other"), F.lit(1.0).alias("jaccard"))
    chosen = F.when(F.col("match").isNotNull(), F.col("match")).when(F.col("doc_id") != F.col("id"), own_copy)
    return (
        joined.select("doc_id", chosen.alias("m"))
        .where(F.col("m").isNotNull())
        .select("doc_id", F.col("m.other").alias("duplicate_of"), F.round("m.jaccard", 6).alias("jaccard"))
    )


def duplicate_clusters(docs: DataFrame, threshold: float = 0.8, width: int = 3) -> DataFrame:
    """Connected components over all near-duplicate links, named by their smallest id.

    First matches give components. A link that is left must be between two components that
    share a bucket, so there the sets outside the bucket's largest component meet those of
    every other component; inside a component nothing more is compared.
    """
    texts, reps, postings, prefix = _prepared(docs, threshold, width)
    first = _first_matches(reps, postings, width, threshold).select(F.col("id").alias("a"), F.col("other").alias("b"))
    roots = materialize(components(first), "roots")
    entries = materialize(
        prefix.join(roots, "id", "left").select("id", "n", "at", "g", F.coalesce("root", "id").alias("root")), "entries"
    )
    shares = entries.groupBy("g", "root").agg(F.count("*").alias("c"))
    mixed = shares.groupBy("g").agg(F.max(F.struct("c", "root")).alias("most"), F.count("*").alias("parts")).where("parts > 1")
    inside = entries.join(mixed.select("g", F.col("most.root").alias("main")), "g")
    others = inside.select(
        "g", F.col("id").alias("other"), F.col("n").alias("m"), F.col("at").alias("other_at"), F.col("root").alias("other_root")
    )
    pairs = materialize(
        inside.where("root <> main")
        .join(others, "g")
        .where("root <> other_root")
        .where(_may_reach(threshold, "at", "n", "other_at", "m"))
        .select(F.greatest("id", "other").alias("id"), F.least("id", "other").alias("other"))
        .distinct(),
        "pairs",
    )
    rest = _verified(pairs, reps, width, threshold).select(F.col("id").alias("a"), F.col("other").alias("b"))
    named = components(first.unionByName(rest))
    outcome = reps.select("content", "id", "copies").join(named, "id", "left").where("root is not null or copies > 1")
    return _with_content(texts, reps, outcome.select("content", F.coalesce("root", "id").alias("cluster_id"))).select("doc_id", "cluster_id")
