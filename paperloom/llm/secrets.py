"""Secret scans with DataFrame functions only.

Three pattern kinds (``assign``, ``access``, ``hex``) find secrets by their form. The method
adds a fourth kind, ``entropy``: runs of ``SHORTEST`` or more key characters are candidates; a
window of ``WINDOW`` characters (or the whole of a shorter candidate) slides over each, and
its Shannon entropy is kept up to date from the counts of the characters that enter and
leave. A candidate is a secret if some window reaches the threshold of the candidate's
character class (hexadecimal, letters of one case, letters, letters with digits, any key character), which falls
with the largest entropy a shorter window can have. An allow-list suppresses what merely looks
random: plain words and numbers in a row, UUIDs, and candidates of which little is left without
alphabets and placeholders. A key of letters alone is no plain word if it changes case inside
or has 20 letters or more. Candidates inside a pattern span are not repeated.

Places come from the pieces between the matches of a kind: their lengths add up. Whole texts
are searched; a pattern is only run on texts that hold what it needs.

Results: one row per document row, in code points, ends exclusive. Null and empty texts have
no spans, and the digest of an empty string; a null id stays null; repeated rows are each
scanned; an empty table gives no rows. Only ``doc_id`` and ``text`` are read. A text with k
matches costs time in proportion to its length and k squared (copied spans).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The three base patterns, their kinds in order and their least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_VALUE = 8
KINDS = ("assign", "access", "hex", "entropy")
NEEDED = ("password", "passwd", "secret", "token", "apikey", "api_key")

CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
SHORTEST = 16
WINDOW = 20
# Bits a window of WINDOW characters must reach, by what the candidate is made of.
# Long compound words come to 3.8, so letters of one case have a threshold of their own.
THRESHOLDS = ((r"^[0-9a-fA-F]+$", 2.8), (r"^[A-Z]?[a-z]+$|^[A-Z]+$", 3.9), (r"^[A-Za-z/_=+-]+$", 3.6), (r"^[A-Za-z0-9]+$", 3.6), (r"", 3.9))
# Words and numbers in a row, with or without signs between them; and UUIDs. Possessive, so that long ones are no deep recursion.
ALLOWED = (
    r"^(?:[/_=+-]++|[A-Z]?[a-z]{3,19}+(?![a-z])|[A-Z]{3,19}+(?![A-Z])|(?<![A-Za-z0-9])[A-Za-z]{1,2}(?![A-Za-z0-9])|[0-9]++)*+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
)
# What stands for a secret in manuals; only the rest of a candidate is judged.
PLACEHOLDERS = r"(?i)example|placeholder|changeme|abcdefghij(?:klmnopqrst(?:uvwxyz)?)?|0123456789"
MASK = "<SECRET>"
SPAN = "struct<start: bigint, end: bigint, kind: int, value: string>"


def _spans(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """All matches in order, with their places; ``value`` is the wanted group."""
    whole = F.lit(pattern)
    gaps = F.split(text, pattern, -1)
    found = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, whole, 0).alias("hit"), F.regexp_extract_all(text, whole, group).alias("value"))
    pieces = F.filter(found, lambda x: x["hit"].isNotNull())
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(state: Column, x: Column) -> Column:
        first = state["at"] + F.length(x["gap"])
        last = first + F.length(x["hit"])
        span = F.struct(first.alias("start"), last.alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"))
        return F.struct(last.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    return F.aggregate(pieces, start, step)["spans"]


def _times_log(count: Column) -> Column:
    return F.when(count > 0, count * F.log2(F.greatest(count, F.lit(1)))).otherwise(F.lit(0.0))


def window_entropy(value: Column, width: int | Column = WINDOW) -> Column:
    """Largest Shannon entropy of the windows of ``width`` characters, by incremental counts.

    With n characters of which c are equal, entropy is log2(n) - sum(c * log2(c)) / n. Each
    step takes the leaving character's count down and the entering one's up, and changes the
    sum by these two terms alone.
    """
    width = F.lit(width)
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    alphabet = F.array_distinct(chars)
    at = F.transform(chars, lambda c, i: F.struct(i.alias("i"), c.alias("c"), F.lit(1).alias("by")))
    leaving = F.transform(
        F.slice(chars, F.lit(1), F.greatest(F.size(chars) - width, F.lit(0))),
        lambda c, i: F.struct((i + width).alias("i"), c.alias("c"), F.lit(-1).alias("by")),
    )
    events = F.array_sort(F.transform(F.concat(leaving, at), lambda e: F.struct(e["i"], e["by"], e["c"])))
    start = F.struct(
        F.transform(alphabet, lambda c: F.struct(c.alias("c"), F.lit(0).alias("n"))).alias("counts"),
        F.lit(0.0).alias("sum"),
        F.lit(0.0).alias("best"),
    )

    def step(state: Column, event: Column) -> Column:
        old = F.element_at(F.filter(state["counts"], lambda x: x["c"] == event["c"]), 1)["n"]
        total = state["sum"] - _times_log(old) + _times_log(old + event["by"])
        full = (event["by"] > 0) & (event["i"] >= width - 1)
        entropy = F.log2(width.cast("double")) - total / width
        return F.struct(
            F.transform(
                state["counts"],
                lambda x: F.struct(x["c"].alias("c"), F.when(x["c"] == event["c"], x["n"] + event["by"]).otherwise(x["n"]).alias("n")),
            ).alias("counts"),
            total.alias("sum"),
            F.when(full, F.greatest(state["best"], entropy)).otherwise(state["best"]).alias("best"),
        )

    return F.aggregate(events, start, step)["best"]


def _random_looking(value: Column) -> Column:
    """Not on the allow-list and some window reaches the threshold of the character class."""
    least = F.lit(THRESHOLDS[-1][1])
    for pattern, bits in reversed(THRESHOLDS[:-1]):
        least = F.when(value.rlike(pattern), F.lit(bits)).otherwise(least)
    allowed = F.length(value) < SHORTEST
    for pattern in ALLOWED:
        allowed = allowed | value.rlike(pattern)
    width = F.least(F.length(value), F.lit(WINDOW))
    least = least * F.log2(width.cast("double")) / math.log2(WINDOW)
    return F.when(allowed, F.lit(False)).otherwise(window_entropy(value, width) >= least)


def find_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_base`` and ``_spans``: sorted spans of the patterns, and of all kinds."""
    none = F.array().cast(f"array<{SPAN}>")
    text = F.coalesce("text", F.lit(""))
    low = F.lower(text)
    worth = F.lit(False)
    for word in NEEDED:
        worth = worth | F.contains(low, F.lit(word))
    staged = docs.withColumn("_text", text).withColumn("_worth", (F.contains(text, F.lit(":")) | F.contains(text, F.lit("="))) & worth)
    text = F.col("_text")
    staged = staged.withColumn("_long", text.rlike(CANDIDATE)).withColumn(
        "_assign", F.when(F.col("_worth"), _spans(text, ASSIGN, 0, 2)).otherwise(none)
    )
    staged = staged.withColumn("_access", F.when(F.contains(text, F.lit("AKIA")), _spans(text, ACCESS, 1)).otherwise(none))
    staged = staged.withColumn("_hex", F.when(F.col("_long"), _spans(text, HEX, 2)).otherwise(none))
    staged = staged.withColumn("_some", F.when(F.col("_long"), _spans(text, CANDIDATE, 3)).otherwise(none))
    kept = F.filter("_assign", lambda s: F.length(s["value"]) >= ASSIGN_VALUE)
    staged = staged.withColumn("_base", F.array_sort(F.concat(kept, "_access", "_hex")))

    def fresh(span: Column) -> Column:
        inside = F.exists("_base", lambda b: (b["start"] <= span["start"]) & (span["end"] <= b["end"]))
        return ~inside & _random_looking(F.regexp_replace(span["value"], PLACEHOLDERS, ""))

    staged = staged.withColumn("_entropy", F.when(F.size("_some") > 0, F.filter("_some", fresh)).otherwise(none))
    # Sorted by start; pattern kinds before entropy where starts are equal.
    order = F.transform(F.concat("_base", "_entropy"), lambda s: F.struct(s["start"], s["kind"], s["end"], s["value"]))
    back = F.transform(F.array_sort(order), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
    base = F.transform(
        F.array_sort(F.transform("_base", lambda s: F.struct(s["start"], s["kind"], s["end"], s["value"]))),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")),
    )
    staged = staged.withColumn("_spans", back).withColumn("_base", base)
    return staged.drop("_worth", "_long", "_assign", "_access", "_hex", "_some", "_entropy")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined with commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def secret_spans(docs: DataFrame) -> DataFrame:
    """Counts, digest and list of the secrets of every row; see the module."""
    found = find_spans(docs.select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(listed(F.col("_base")), 256).alias("base_sha256"), listed(F.col("_spans")).alias("spans"),
    )


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``MASK``; overlapping spans are one."""
    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))
    text = F.col("_text")

    def cut(first: Column, count: Column) -> Column:
        return F.substring(text, (first + 1).cast("int"), F.greatest(count, F.lit(0)).cast("int"))

    def step(s: Column, x: Column) -> Column:
        more = F.when(x["start"] >= s["at"], F.array(cut(s["at"], x["start"] - s["at"]), F.lit(MASK))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["out"], more).alias("out"))

    done = F.aggregate("_spans", state, step, lambda s: F.concat(F.array_join(s["out"], ""), cut(s["at"], F.length(text).cast("bigint") - s["at"])))
    # Columns of the input keep out of the way of the working columns.
    packed = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    masked = find_spans(packed).withColumn("_masked", F.when(F.size("_spans") > 0, done).otherwise(F.col("text")))
    return masked.select(*(F.col("_masked").alias("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns))
