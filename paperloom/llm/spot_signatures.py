"""Document fingerprints by spot signatures, with DataFrame functions only.

Method (Theobald et al. 2008): very common words are anchors. Each content word that follows
anchors begins a spot: these anchors, the word and the next ``CHAIN - 1`` content words. The
fingerprint is the sorted set of the spots' 32-bit hashes; navigation lines and lists have
few anchors and add little. Two fingerprints are compared by Jaccard: sizes go first, as
``min / max`` of the set lengths bounds it; only pairs whose length parts can reach the asked
likeness are intersected.

A text without a spot (no anchor, or fewer than ``CHAIN`` content words after it) has one
element, the hash of its words, or of the text itself if it has no words. So every text has
a fingerprint, equal texts have equal ones, and likeness is always defined.

The next document (for the edited text) is found without a global sort: a piecewise linear
distribution from 100 quantiles of ``doc_id`` puts rows into at most ``MOST_BUCKETS`` ordered
buckets of about ``BUCKET_ROWS`` rows; the first row of a bucket is also sent to the bucket
before it. Buckets are counted first: where ids lie in far-apart ranges and some bucket has over
four times its share, it is cut at quantiles of its own ids until none has. So whole texts are
shuffled once, and a window sees one small bucket whatever the ids.

Anchors are common words of four languages (``ANCHORS``); a longer text of any other language
mostly has the one element above, so it is like its exact copies only.

Results: one row per document row. Null text counts as empty (n_chars 0). Rows with one id are
ordered by their text; very many rows of a single id stay in one bucket. A row with null id
has no place in the order, so its next document is the empty text. The last document is
followed by the first, a lone one by itself. An empty table gives no rows. Only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.storage import materialize

CHAIN = 3
MARK = "\u0001"
BUCKET_ROWS = 256
MOST_BUCKETS = 100_000
CUTS = 99
SUBS = 256

# Very common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their "
    "they this to was we were which will with you "
    "als auch auf aus bei das dem den der des die ein eine einem einen einer er es für hat ich im ist mit nach nicht "
    "noch oder sich sie sind so über um und vom von vor war wie wird zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas "
    "pour qu que qui sa se ses son sur un une vous "
    "al como con del desde donde el ella entre era esta este fue ha hay la las lo los más muy no nos o para pero por "
    "que se ser si sin su sus también un una y ya"
).split()


def spots(text: Column) -> Column:
    """Sorted distinct spot hashes of a text; never empty."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    anchors = sorted(set(ANCHORS))
    # Anchors are glued to the word after them; what is split at spaces then are content words.
    glued = F.array_join(
        F.transform(F.split(plain, " "), lambda w: F.when(w.isin(anchors), F.concat(w, F.lit(MARK))).otherwise(F.concat(w, F.lit(" ")))), ""
    )
    tokens = F.filter(F.split(glued, " "), lambda w: w != "")

    def of(tokens: Column) -> Column:
        bare = F.transform(tokens, lambda w: F.substring_index(w, MARK, -1))
        chains = tokens
        for step in range(1, CHAIN):
            following = F.slice(bare, F.lit(step + 1), F.size(tokens))
            chains = F.zip_with(chains, following, lambda a, b: F.concat(a, F.lit(" "), b))
        found = F.filter(chains, lambda c: c.isNotNull() & F.contains(c, F.lit(MARK)))
        return F.sort_array(F.array_distinct(F.transform(found, lambda c: F.hash(c))))

    whole = F.array(F.hash(F.when(plain == "", text).otherwise(plain)))
    # A one-element transform names the token list, so that it is computed once.
    signature = F.element_at(F.transform(F.array(tokens), of), 1)
    return F.element_at(F.transform(F.array(signature), lambda s: F.when(F.size(s) > 0, s).otherwise(whole)), 1)


def printed(signature: Column) -> Column:
    """The fingerprint as text: eight hex digits a spot."""
    return F.array_join(F.transform(signature, lambda h: F.lower(F.lpad(F.hex(h.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), ",")


def length_part(size: Column, least: float) -> Column:
    """Part of the set lengths; sets in parts that are two apart cannot reach ``least``."""
    return F.floor(F.log(size.cast("double")) / F.lit(-math.log(least)))


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard of two signatures; 0 without intersecting where it must be below ``least``."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    value = F.transform(F.array(common), lambda c: c / (small + large - c))[0]
    if least <= 0:
        return value
    near = (small >= large * least) & (F.abs(length_part(F.size(a), least) - length_part(F.size(b), least)) <= 1)
    return F.when(near, F.when(value >= least, value).otherwise(F.lit(0.0))).otherwise(F.lit(0.0))


def _cut(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Rows of the buckets in ``cuts`` moved to sub-buckets, in order; a cut value has its own."""
    met = rows.join(F.broadcast(cuts), "_bucket", "left")
    below = F.size(F.filter("_cuts", lambda c: c < F.col("doc_id"))) + F.size(F.filter("_cuts", lambda c: c <= F.col("doc_id")))
    sub = F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(below)
    return met.withColumn("_bucket", F.col("_bucket") * SUBS + sub).drop("_cuts")


def _evened(placed: DataFrame, most: int) -> tuple[DataFrame, list[Row]]:
    """``placed`` with no bucket of several ids above ``most`` rows, and its buckets with their largest id.

    The driver gets one row a bucket. A round cuts a bucket into hundredths, between which only
    a single id can lie, so a few rounds are enough for any distribution; only ids are read.
    """
    ids = placed.select("doc_id", "_bucket")
    while True:
        sized = ids.groupBy("_bucket").agg(F.max("doc_id").alias("top"), F.min("doc_id").alias("low"), F.count("*").alias("n")).collect()
        large = [(r["_bucket"],) for r in sized if r["n"] > most and r["low"] < r["top"]]
        if not large:
            return placed, sized
        inside = ids.join(F.broadcast(ids.sparkSession.createDataFrame(large, "_bucket bigint")), "_bucket")
        shares = [i / (CUTS + 1) for i in range(1, CUTS + 1)]
        cuts = inside.groupBy("_bucket").agg(F.array_distinct(F.percentile_approx("doc_id", shares, 10_000)).alias("_cuts"))
        cuts = materialize(cuts, "cuts")
        ids, placed = _cut(ids, cuts), _cut(placed, cuts)


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with an id, with ``next_<column>`` of the row that follows in descending id order."""
    rows = docs.where("doc_id is not null")
    quantiles = [i / 100 for i in range(101)]
    known = rows.agg(F.count("*").alias("n"), F.percentile_approx("doc_id", quantiles, 10_000).alias("q")).head()
    if not known["n"]:
        return rows.select("*", *(F.col(c).alias(f"next_{c}") for c in columns))
    marks = sorted(set(known["q"]))
    count = max(1, min(MOST_BUCKETS, known["n"] // BUCKET_ROWS))
    bounds = F.array(*(F.lit(m).cast("double") for m in marks))
    place = F.col("doc_id").cast("double")
    below = F.greatest(F.size(F.filter(bounds, lambda m: m <= place)), F.lit(1))
    low, high = F.get(bounds, below - 1), F.coalesce(F.get(bounds, below), F.get(bounds, below - 1) + 1)
    inside = F.least(F.greatest((place - low) / F.greatest(high - low, F.lit(1.0)), F.lit(0.0)), F.lit(0.999999))
    bucket = F.floor((below - 1 + inside) / len(marks) * count).cast("bigint")
    placed = rows.withColumn("_bucket", bucket)
    placed, sized = _evened(placed, 4 * max(BUCKET_ROWS, known["n"] // count))
    heads = sorted(((r["_bucket"], r["top"]) for r in sized), reverse=True)
    # The head of each bucket visits the bucket before it in this order; the very first the last.
    visits = [(top, heads[at - 1][0]) for at, (_, top) in enumerate(heads)]
    kind = docs.schema["doc_id"].dataType.simpleString()
    guests = docs.sparkSession.createDataFrame(visits, f"_top {kind}, _visit bigint")
    copies = placed.join(F.broadcast(guests), F.col("doc_id") == F.col("_top"), "left").withColumn(
        "_at",
        F.explode(
            F.when(F.col("_visit").isNull(), F.array(F.struct(F.col("_bucket").alias("bucket"), F.lit(0).alias("guest"))))
            .otherwise(F.array(F.struct(F.col("_bucket").alias("bucket"), F.lit(0).alias("guest")), F.struct(F.col("_visit").alias("bucket"), F.lit(1).alias("guest"))))
        ),
    )
    order = Window.partitionBy("_home").orderBy("_guest", F.desc("doc_id"), "text")
    homes = copies.select(*docs.columns, F.col("_at.bucket").alias("_home"), F.col("_at.guest").alias("_guest"))
    led = homes.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns))
    return led.where("_guest = 0").drop("_home", "_guest")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row, its edited text and its next document; see the module."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    signed = rows.withColumn("sig", spots(F.col("text")))
    lone = signed.where("doc_id is null").select("*", F.lit("").alias("next_text"), spots(F.lit("")).alias("next_sig"))
    paired = with_next(signed, ["text", "sig"]).unionByName(lone)
    size = F.length("text").cast("bigint")
    share = F.floor(size / 3).cast("int")
    edited = paired.withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), (size - share).cast("int")), F.substring("next_text", F.lit(1), share))
    ).withColumn("n_chars", size)
    both = edited.select("doc_id", "n_chars", "sig", "next_sig", F.sha2("edited", 256).alias("edited_sha256"), spots(F.col("edited")).alias("edited_sig"))
    return both.select(
        "doc_id", "n_chars", "edited_sha256", printed(F.col("sig")).alias("fingerprint"), printed(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
