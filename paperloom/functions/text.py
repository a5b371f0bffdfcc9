"""Column builders for text: tokens, shingles, markup removal, patterns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns in the regular-expression subset Java and RE2 share.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
IP = r"\b\d{1,3}(?:\.\d{1,3}){3}\b"
CARD = r"\b(?:\d{4}[ -]?){3}\d{4}\b"
PHONE = r"\+?\d[\d ()-]{8,}\d"
LICENSE = r"(?i)copyright|license"
CITE_NUMBER = r"\[\d+\]"
CITE_AUTHOR = r"\([A-Z][A-Za-z]+, \d{4}\)"
CITE_DOI = r"10\.\d{4,9}/[-._;()/:A-Za-z0-9]+"
#: Words that a task takes as arrays at a time.
WORDS = 1 << 18
NOT_WORD = r"[^\p{L}\p{N}]+"
SENTENCE_END = r"[.\n]+"
HEADING = r"(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>"
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
HREF = r"(?i)href=\"([^\"]*)\""
LIST_ITEM = r"(?is)<li[^>]*>(.*?)</li>"

# Order matters: a card number also looks like a phone number, so CARD comes first.
PII_PATTERNS = {"EMAIL": EMAIL, "IP": IP, "CARD": CARD, "PHONE": PHONE}

# A text without these characters has no match, which is much cheaper to see.
NEEDLES = {EMAIL: "@", CITE_NUMBER: "[", CITE_AUTHOR: "(", CITE_DOI: "10."}

# Markup blocks dropped whole, and entities decoded (ampersand last).
MARKUP_BLOCKS = (
    r"(?is)<script[^>]*>.*?</script>",
    r"(?is)<style[^>]*>.*?</style>",
    r"(?s)<!--.*?-->",
    r"(?s)<[^>]*>",
)
ENTITIES = (
    ("&quot;", '"'),
    ("&middot;", "·"),
    ("&copy;", "©"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&nbsp;", " "),
    ("&#39;", "'"),
    ("&amp;", "&"),
)


def tokens(text: Column) -> Column:
    """Lower-case letter/digit runs, in order."""
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda t: t != "")


def word_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """For a column of word lists in a task: row and code of every word, and the words by code."""
    sizes = np.diff(column.offsets.to_numpy()).astype(np.int64)
    if column.null_count:
        sizes = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, sizes)
    encoded = column.flatten().dictionary_encode()
    # By way of numpy the strings are made in a tenth of the time.
    distinct = encoded.dictionary.to_numpy(zero_copy_only=False).tolist()
    return np.repeat(np.arange(len(sizes)), sizes), encoded.indices.to_numpy().astype(np.int64), distinct


def word_slices(batch: pa.RecordBatch, column: str = "words") -> Iterator[pa.RecordBatch]:
    """A batch as slices of at most ``WORDS`` words or one row, so that arrays made of them stay small."""
    yield from _slices(batch, batch.column(column).offsets.to_numpy().astype(np.int64))


def _slices(batch: pa.RecordBatch, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + WORDS, side="right")) - 1)
        last = min(last, batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


def sentence_slices(batch: pa.RecordBatch, column: str = "words") -> Iterator[pa.RecordBatch]:
    """As ``word_slices``, for a column that has a list of words for every sentence."""
    texts = batch.column(column)
    ends = texts.values.offsets.to_numpy().astype(np.int64)[texts.offsets.to_numpy()]
    yield from _slices(batch, ends)


def shingles(words: Column, width: int) -> Column:
    """Distinct runs of ``width`` consecutive words; empty for shorter texts.

    ``words`` should be a stored column. Shifted copies are joined word by word, so the
    cost is linear in the length of the text.
    """
    runs = words
    for step in range(1, width):
        shifted = F.slice(words, F.lit(step + 1), F.size(words))
        runs = F.zip_with(runs, shifted, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.filter(runs, lambda r: r.isNotNull()))


def trigrams(word: Column) -> Column:
    """Character trigrams of one word padded with a space on both sides."""
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    starts = F.sequence(F.lit(1), F.length(padded) - 2)
    return F.transform(starts, lambda i: F.substring(padded, i, F.lit(3)))


def trigram_keys(texts: list[str], padding: int) -> tuple[np.ndarray, np.ndarray]:
    """In a task: trigrams of texts with that many spaces around them, as numbers, and the place of the text of each."""
    space = " " * padding
    sizes = np.array([len(t) for t in texts], np.int64) + 2 * padding
    points = np.frombuffer("".join(f"{space}{t}{space}" for t in texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = np.flatnonzero(owner[2:] == owner[:-2])
    return points[inside] << 42 | points[inside + 1] << 21 | points[inside + 2], owner[inside]


def decode_entities(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def html_text(html: Column) -> Column:
    """Visible text of a page."""
    for block in MARKUP_BLOCKS:
        html = F.regexp_replace(html, block, " ")
    return collapse_spaces(decode_entities(html))


def inner_text(fragment: Column) -> Column:
    """Text of a markup fragment without its tags."""
    return collapse_spaces(decode_entities(F.regexp_replace(fragment, MARKUP_BLOCKS[-1], "")))


def _where_possible(text: Column, pattern: str, found: Column, none: Column) -> Column:
    if pattern not in NEEDLES:
        return found
    lacking = ~F.contains(text, F.lit(NEEDLES[pattern]))
    # A null text has no address, but no count of citations either.
    return F.when(F.coalesce(lacking, F.lit(pattern == EMAIL)), none).otherwise(found)


def pattern_count(text: Column, pattern: str) -> Column:
    return _where_possible(text, pattern, F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("bigint")


def masked_count(text: Column, after: Column, pattern: str) -> Column:
    """``pattern_count`` where ``after`` is ``text`` with its matches masked: equal texts have none."""
    return F.when(text == after, F.lit(0).cast("bigint")).otherwise(pattern_count(text, pattern))


def matches(text: Column, pattern: str) -> Column:
    none = F.array().cast("array<string>")
    return _where_possible(text, pattern, F.regexp_extract_all(text, F.lit(pattern), 0), none)


def masked(text: Column, kind: str) -> Column:
    pattern = PII_PATTERNS[kind]
    return _where_possible(text, pattern, F.regexp_replace(text, pattern, f"<{kind}>"), text)


def masked_texts(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Stepwise masked text columns, and which of them each kind is searched in.

    Each step is a column of its own, computed once from the step before.
    """
    seen_by, last = {}, "text"
    for kind in PII_PATTERNS:
        seen_by[kind] = last
        docs = docs.select("*", masked(F.col(last), kind).alias(f"_no_{kind.lower()}"))
        last = f"_no_{kind.lower()}"
    return docs, {**seen_by, "REST": last}


def file_suffix(path: Column) -> Column:
    """Case-sensitive suffix including the dot; empty when there is none."""
    return F.regexp_extract(path, r"(\.[^./]+)$", 1)
