"""Text enrichment: language, citations, summary, entities, key phrases."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions import text as tx
from paperloom.operators.skew import row_lookup, top_rows
from paperloom.storage import materialize, text_batches

BROADCAST_GRAMS = 1_000_000
CITE_FORMS = {"numbered": tx.CITE_NUMBER, "author_year": tx.CITE_AUTHOR, "doi": tx.CITE_DOI}
ENTITY_PATTERNS = {**tx.PII_PATTERNS, "LICENSE": tx.LICENSE}


def _tagged(values: Column, value: str, tag: str, label: str) -> Column:
    """Array of ``{value, tag}`` with a constant tag."""
    return F.transform(values, lambda v: F.struct(v.alias(value), F.lit(label).alias(tag)))


def html_to_text(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", tx.html_text(F.col("html")).alias("text"))


def html_title_headings(pages: DataFrame) -> DataFrame:
    """Title (level 0) and headings in order of appearance."""
    found = F.arrays_zip(
        F.regexp_extract_all("html", F.lit(tx.HEADING), 1).alias("level"),
        F.regexp_extract_all("html", F.lit(tx.HEADING), 2).alias("body"),
    )
    title = F.transform(
        F.regexp_extract_all("html", F.lit(tx.TITLE), 1),
        lambda t: F.struct(F.lit("0").alias("level"), t.alias("body")),
    )
    rows = pages.select("page_id", F.posexplode(F.concat(title, found)).alias("position", "_h"))
    return rows.select(
        "page_id",
        F.col("position").cast("bigint").alias("position"),
        F.col("_h.level").cast("int").alias("level"),
        tx.inner_text(F.col("_h.body")).alias("heading"),
    )


def html_links(pages: DataFrame) -> DataFrame:
    """Every link target, in order."""
    return pages.select(
        "page_id", F.posexplode(F.regexp_extract_all("html", F.lit(tx.HREF), 1)).alias("position", "link")
    ).withColumn("position", F.col("position").cast("bigint"))


def html_lists(pages: DataFrame) -> DataFrame:
    """Every list item, in order, as text."""
    return pages.select(
        "page_id", F.posexplode(F.regexp_extract_all("html", F.lit(tx.LIST_ITEM), 1)).alias("position", "_i")
    ).select("page_id", F.col("position").cast("bigint").alias("position"), tx.inner_text(F.col("_i")).alias("item"))


def extract_citations(docs: DataFrame) -> DataFrame:
    """Citation counts by form, one row per document."""
    text = F.col("text")
    return docs.select(
        "doc_id",
        tx.pattern_count(text, tx.CITE_NUMBER).alias("numbered"),
        tx.pattern_count(text, tx.CITE_AUTHOR).alias("author_year"),
        tx.pattern_count(text, tx.CITE_DOI).alias("doi"),
    )


def citation_mentions(docs: DataFrame) -> DataFrame:
    """Each cited string with its form."""
    found = [_tagged(tx.matches(F.col("text"), p), "mention", "form", f) for f, p in CITE_FORMS.items()]
    return docs.select("doc_id", F.explode(F.concat(*found)).alias("_c")).select("doc_id", "_c.*")


def extract_entities(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, label)`` per match; a matched span is not matched again."""
    masked, seen_by = tx.masked_texts(docs)
    found = [
        _tagged(tx.matches(F.col(seen_by.get(label, seen_by["REST"])), pattern), "text", "label", label)
        for label, pattern in ENTITY_PATTERNS.items()
    ]
    return masked.select("doc_id", F.explode(F.concat(*found)).alias("_e")).select("doc_id", "_e.*")


def term_lists(docs: DataFrame) -> DataFrame:
    """``doc_id, len, terms``: number of words, and each distinct word with its count, inside the row.

    Words are split in Spark and counted in batches, so nothing is exchanged. A null text has
    no length and no terms.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in tx.word_slices(whole)):
            words = batch.column("words")
            owner, codes, distinct = tx.word_codes(words)
            pairs, times = np.unique(owner * max(len(distinct), 1) + codes, return_counts=True)
            row, code = np.divmod(pairs, max(len(distinct), 1))
            terms = pa.StructArray.from_arrays([pa.array(distinct, pa.string()).take(pa.array(code)), pa.array(times)], ["term", "tf"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(words) + 1)), pa.int32()), terms)
            sizes = pa.array(np.bincount(owner, minlength=len(words)), pa.int64(), mask=words.is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, lists], ["doc_id", "len", "terms"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", tx.tokens(F.col("text")).alias("words")).mapInArrow(
        count, f"doc_id {kind}, len bigint, terms array<struct<term: string, tf: bigint>>"
    )


def postings(lists: DataFrame) -> DataFrame:
    """``doc_id, len, term, tf`` rows of term lists."""
    return lists.select("doc_id", "len", F.explode("terms").alias("_t")).select("doc_id", "len", "_t.*")


def key_phrases(docs: DataFrame, k: int = 5) -> DataFrame:
    """Top terms per document by tf * ln(N / df)."""
    lists = materialize(term_lists(docs), "terms")
    frequency = materialize(postings(lists).groupBy("term").agg(F.count("*").alias("df")), "term-frequency")
    total = lists.agg(F.count("*").alias("n")).scalar()
    weights = frequency.select("term", F.log(total / F.col("df")).alias("idf"))
    scored = row_lookup(postings(lists), weights, "term", F.col("doc_id"), "inner").select(
        "doc_id", "term", F.round(F.col("tf") * F.col("idf"), 6).alias("score")
    )
    return top_rows(scored, ["doc_id"], [F.desc("score"), F.asc("term")], k)


def sentence_sums(docs: DataFrame) -> DataFrame:
    """``doc_id, sentences, sums``: per sentence with words its place, their number and the sum of their counts in the text.

    Sentences and words are split in Spark and counted in batches inside the row, so nothing is exchanged.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in tx.sentence_slices(whole)):
            first = batch.column("words").offsets.to_numpy().astype(np.int64)
            owner, codes, distinct = tx.word_codes(batch.column("words").flatten())
            text = np.repeat(np.arange(batch.num_rows), np.diff(first))
            _, word, times = np.unique(text[owner] * max(len(distinct), 1) + codes, return_inverse=True, return_counts=True)
            words = np.bincount(owner, minlength=len(text))
            total = np.zeros(len(text), np.int64)
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            total[owner[starts]] = np.add.reduceat(times[word], starts) if len(starts) else 0
            spoken = np.flatnonzero(words)
            place = spoken - (first[:-1] - first[0])[text[spoken]]
            sums = pa.StructArray.from_arrays([pa.array(place), pa.array(total[spoken]), pa.array(words[spoken])], ["position", "total", "n"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text[spoken], np.arange(batch.num_rows + 1)), pa.int32()), sums)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("sentences"), lists], ["doc_id", "sentences", "sums"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    split = docs.select("doc_id", F.split("text", tx.SENTENCE_END).alias("sentences"))
    return split.withColumn("words", F.transform("sentences", tx.tokens)).mapInArrow(
        count, f"doc_id {kind}, sentences array<string>, sums array<struct<position: bigint, total: bigint, n: bigint>>"
    )


def summarize_extractive(docs: DataFrame, k: int = 3) -> DataFrame:
    """The k sentences whose words are most frequent in the document, in text order.

    Words are counted inside the row of a text, and no text is exchanged. Rows that share an id are one
    document, so only their words meet. A text without words has a null summary.
    """
    shared = materialize(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "shared-ids")
    alone = docs.join(shared, "doc_id", "left_anti") if shared.head() else docs
    ranked = F.sort_array(F.transform("sums", lambda s: F.struct(-F.round(s["total"] / s["n"], 6), s["position"].cast("int").alias("position"))))
    best = F.sort_array(F.transform(F.slice(ranked, 1, k), lambda s: s["position"]))
    summary = F.array_join(F.transform(best, lambda at: F.trim(F.get("sentences", at))), ". ")
    with text_batches(docs.sparkSession):
        found = sentence_sums(alone).select("doc_id", F.when((F.size("sums") > 0) & F.col("doc_id").isNotNull(), summary).alias("summary"))
        found = materialize(found, "summaries")
    return found.unionByName(_shared_summaries(docs.join(shared, "doc_id", "left_semi"), k)) if alone is not docs else found


def _shared_summaries(docs: DataFrame, k: int) -> DataFrame:
    """Summaries where several rows have an id: the words of a sentence are those at its place in all of them.

    Only sentence numbers travel with the words; the winning sentences are cut from the texts at the end.
    """
    sentences = docs.select("doc_id", F.posexplode(F.split("text", tx.SENTENCE_END)).alias("position", "sentence"))
    words = sentences.select("doc_id", "position", F.explode(tx.tokens(F.col("sentence"))).alias("term"))
    used = words.groupBy("doc_id", "position", "term").agg(F.count("*").alias("n"))
    in_document = Window.partitionBy("doc_id", "term")
    weighed = used.withColumn("total", F.sum("n").over(in_document))
    scores = weighed.groupBy("doc_id", "position").agg(
        F.round(F.sum(F.col("n") * F.col("total")) / F.sum("n"), 6).alias("score")
    )
    best = top_rows(scores, ["doc_id"], [F.desc("score"), F.asc("position")], k)
    chosen = best.groupBy("doc_id").agg(F.sort_array(F.collect_list("position")).alias("_at"))
    parts = F.split("text", tx.SENTENCE_END)
    summary = F.array_join(F.transform("_at", lambda at: F.trim(F.get(parts, at))), ". ")
    return docs.select("doc_id", "text").join(chosen, "doc_id", "left").select("doc_id", summary.alias("summary"))


def language_model(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trigram counts per language and totals per language, from ``(text, lang)`` rows.

    Words are counted per language before they are cut into trigrams.
    """
    words = (
        labelled.select("lang", F.explode(tx.tokens(F.col("text"))).alias("word"))
        .groupBy("lang", "word")
        .agg(F.count("*").alias("n"))
    )
    counts = materialize(
        words.select("lang", "n", F.explode(tx.trigrams(F.col("word"))).alias("gram"))
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("c")),
        "language-trigrams",
    )
    return counts, counts.groupBy("lang").agg(F.sum("c").alias("total"))


def gram_counts(docs: DataFrame) -> DataFrame:
    """``doc_id, grams``: the distinct trigrams of every text as numbers with their counts, inside the row.

    Words are split in Spark; a word is cut into trigrams once for some rows at a time.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in tx.word_slices(whole)):
            owner, codes, distinct = tx.word_codes(batch.column("words"))
            pairs, times = np.unique(owner * max(len(distinct), 1) + codes, return_counts=True)
            row, word = np.divmod(pairs, max(len(distinct), 1))
            found, of_word = tx.trigram_keys(distinct, 1)
            keys, place = np.unique(found, return_inverse=True)
            first = np.searchsorted(of_word, np.arange(len(distinct) + 1))
            sizes = np.diff(first)[word]
            within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            met = np.repeat(row, sizes) * max(len(keys), 1) + place[np.repeat(first[word], sizes) + within]
            order = np.argsort(met)
            met, weight = met[order], np.repeat(times, sizes)[order]
            starts = np.flatnonzero(np.diff(met, prepend=-1))
            row, code = np.divmod(met[starts], max(len(keys), 1))
            tf = np.add.reduceat(weight, starts) if len(starts) else weight
            grams = pa.StructArray.from_arrays([pa.array(keys[code]), pa.array(tf, pa.int64())], ["g", "tf"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32()), grams)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "grams"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", tx.tokens(F.col("text")).alias("words")).mapInArrow(
        count, f"doc_id {kind}, grams array<struct<g: bigint, tf: bigint>>"
    )


def _numbered(table: DataFrame) -> DataFrame:
    """``gram, logs`` with the trigram's number ``g`` in its place."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, _ = tx.trigram_keys(batch.column("gram").to_pylist(), 0)
            yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column("logs")], ["g", "logs"])

    return table.mapInArrow(number, "g bigint, logs array<double>")


def detect_language(docs: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Naive Bayes over character trigrams with add-one smoothing; ties go to the first name.

    An unseen trigram adds ln 1 = 0 to the count part, and the smoothing part is the
    document's trigram number times ln(total + vocabulary). The distinct trigrams of a
    text are counted in its row. The trigram table has one row a trigram with a number per language. Up to ``BROADCAST_GRAMS`` rows it is broadcast, so
    that each text is scored where it is and only sums per document are exchanged; a larger
    one is met by a salted join. A text without words has a null language.
    """
    languages = [(r["lang"], r["total"]) for r in totals.orderBy("lang").collect()]
    logs = [F.sum(F.when(F.col("lang") == lang, F.log(F.col("c") + 1)).otherwise(0.0)) for lang, _ in languages]
    table = counts.groupBy("gram").agg(F.array(*logs).cast("array<double>").alias("logs"))
    table = materialize(_numbered(table), "trigram-logs")
    size = table.count()
    grams = gram_counts(docs).select("doc_id", F.explode_outer("grams").alias("_g")).select("doc_id", "_g.*")
    if size <= BROADCAST_GRAMS:
        met = grams.join(F.broadcast(table), "g", "left")
    else:
        met = row_lookup(grams, table, "g", F.col("doc_id"))
    sums = [F.sum(F.col("tf") * F.get("logs", F.lit(i))) for i in range(len(languages))]
    found = met.groupBy("doc_id").agg(
        F.coalesce(F.sum("tf"), F.lit(0)).alias("n"), *(F.coalesce(s, F.lit(0.0)).alias(f"s{i}") for i, s in enumerate(sums))
    )
    costs = [
        F.struct((-F.round(F.col(f"s{i}") - F.col("n") * math.log(total + size), 6)).alias("cost"), F.lit(lang).alias("lang"))
        for i, (lang, total) in enumerate(languages)
    ]
    if not costs:
        return found.select("doc_id", F.lit(None).cast("string").alias("language"))
    return found.select("doc_id", F.when(F.col("n") > 0, F.array_min(F.array(*costs))["lang"]).alias("language"))


SWITCHES = ("citations", "entities", "copies", "language", "summary", "near")


def enhance(docs: DataFrame, switches: set[str]) -> DataFrame:
    """One row per document with the enrichments that are switched on, of ``SWITCHES``.

    ``citations`` and ``entities`` are computed in the row; ``copies`` counts equal texts by
    their checksum, so no text is exchanged. ``language`` (learned from the rows' own ``lang``), ``summary``
    and ``near`` (the smallest earlier near duplicate, or null) are joined by ``doc_id``, which names
    one document. An unknown switch is an error.
    """
    unknown = set(switches) - set(SWITCHES)
    if unknown:
        raise ValueError(f"unknown enrichments: {sorted(unknown)}")
    columns = ["doc_id"]
    rows = docs
    if "citations" in switches:
        forms = {f: tx.pattern_count(F.col("text"), p) for f, p in CITE_FORMS.items()}
        rows, columns = rows.withColumns(forms), [*columns, *forms]
    if "entities" in switches:
        rows, seen_by = tx.masked_texts(rows)
        steps = [*seen_by.values()]
        after = dict(zip(seen_by, steps[1:]))
        found = [
            tx.masked_count(F.col(seen_by[label]), F.col(after[label]), p) if label in after else tx.pattern_count(F.col(seen_by["REST"]), p)
            for label, p in ENTITY_PATTERNS.items()
        ]
        rows, columns = rows.withColumn("entities", reduce(lambda a, b: a + b, found)), [*columns, "entities"]
    rows = rows.select(*columns, F.md5("text").alias("_sum"))
    if "copies" in switches:
        sizes = rows.groupBy("_sum").agg(F.count("*").alias("copies"))
        rows = row_lookup(rows, sizes, "_sum", F.col("doc_id"))
    rows = rows.drop("_sum")
    if "language" in switches:
        rows = rows.join(detect_language(docs, *language_model(docs.select("text", "lang"))), "doc_id", "left")
    if "summary" in switches:
        rows = rows.join(summarize_extractive(docs).select("doc_id", "summary"), "doc_id", "left")
    if "near" in switches:
        from paperloom.operators.duplicates import near_duplicates

        rows = rows.join(near_duplicates(docs).select("doc_id", "duplicate_of"), "doc_id", "left")
    return rows


def entity_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, line, entity, label``: the distinct entities of every line of a text."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    masked, seen_by = tx.masked_texts(lines)
    found = [
        _tagged(tx.matches(F.col(seen_by.get(label, seen_by["REST"])), pattern), "entity", "label", label)
        for label, pattern in ENTITY_PATTERNS.items()
    ]
    listed = F.explode(F.array_distinct(F.concat(*found))).alias("_e")
    return masked.select("doc_id", F.col("line").cast("bigint").alias("line"), listed).select("doc_id", "line", "_e.*")


def entity_relations(docs: DataFrame, support: int = 2) -> DataFrame:
    """``first, second, lines, pmi``: entities that stand in one line at least ``support`` times.

    Entities of fewer lines are dropped before any pair is made, as no pair of theirs can have
    the support. ``pmi`` is ln(p(first, second) / (p(first) p(second))) over the lines that hold an
    entity, rounded to 6 digits. Lines meet themselves by (document, line), so a frequent entity's
    pairs are spread over its lines, and pairs are counted in parts.
    """
    mentions = materialize(entity_lines(docs), "entity-lines")
    uses = materialize(mentions.groupBy("entity").agg(F.count_distinct("doc_id", "line").alias("n")).where(F.col("n") >= support), "entities")
    total = mentions.select("doc_id", "line").distinct().count()
    known = mentions.select("doc_id", "line", "entity").distinct()
    kept = materialize(row_lookup(known, uses, "entity", F.struct("doc_id", "line"), "inner"), "frequent-entities")
    other = kept.select("doc_id", "line", F.col("entity").alias("second"), F.col("n").alias("m"))
    met = kept.join(other, ["doc_id", "line"]).where(F.col("entity") < F.col("second"))
    pairs = met.groupBy(F.col("entity").alias("first"), "second", "n", "m").agg(F.count("*").alias("lines")).where(F.col("lines") >= support)
    pmi = F.log(F.col("lines") * F.lit(float(total)) / (F.col("n") * F.col("m")))
    return pairs.select("first", "second", "lines", F.round(pmi, 6).alias("pmi"))
