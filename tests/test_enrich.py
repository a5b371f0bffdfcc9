import hashlib
import math
import types
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from paperloom.functions import text as tx
from paperloom.operators import compliance, enrich, vectors
from paperloom.operators.vectors import embed_hashing


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_citations(spark):
    d = docs(spark, "As shown [1] and [23] (Miller, 2019), see 10.1000/xyz-1(2).", "nothing")
    rows = enrich.extract_citations(d).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == [(0, 2, 1, 1), (1, 0, 0, 0)]
    mentions = {(r["form"], r["mention"]) for r in enrich.citation_mentions(d).collect()}
    assert {("numbered", "[1]"), ("numbered", "[23]"), ("author_year", "(Miller, 2019)")} <= mentions


def test_card_is_not_also_a_phone(spark):
    d = docs(spark, "pay 1234 5678 9012 3456 or call +49 (30) 123-4567, mail a.b@c.org from 10.0.0.1")
    row = compliance.pii_scan(d).head()
    assert (row["email_count"], row["ip_count"], row["card_count"], row["phone_count"]) == (1, 1, 1, 1)
    text = compliance.pii_redact(d).head()["text"]
    assert text == "pay <CARD> or call <PHONE>, mail <EMAIL> from <IP>"
    labels = sorted(r["label"] for r in enrich.extract_entities(d).collect())
    assert labels == ["CARD", "EMAIL", "IP", "PHONE"]


def test_markup_is_removed(spark):
    page = "<title>T</title><script>x('<p>')</script><!-- no --><h1 class=a>A &amp; <b>B</b></h1><p>c&nbsp;d</p>"
    df = spark.createDataFrame([(1, "u", page)], "page_id bigint, url string, html string")
    assert enrich.html_to_text(df).head()["text"] == "T A & B c d"
    heads = [(r["level"], r["heading"]) for r in enrich.html_title_headings(df).orderBy("position").collect()]
    assert heads == [(0, "T"), (1, "A & B")]


def test_shingles_and_trigrams(spark):
    d = spark.createDataFrame([(["a", "b", "c", "a", "b", "c"],), (["a", "b"],), ([],)], "w array<string>")
    rows = [r[0] for r in d.select(tx.shingles(F.col("w"), 3)).collect()]
    assert rows == [["a b c", "b c a", "c a b"], [], []]
    assert d.limit(1).select(tx.trigrams(F.lit("été"))).head()[0] == [" ét", "été", "té "]


def test_summary_keeps_text_order(spark):
    d = docs(spark, "rare one. data data data. more data here. last of data data.\nodd")
    assert enrich.summarize_extractive(d, 2).head()["summary"] == "data data data. last of data data"


def test_language_with_no_known_trigram_still_has_an_answer(spark):
    train = spark.createDataFrame(
        [("the cat and the dog", "en"), ("der hund und die katze", "de")], "text string, lang string"
    )
    counts, totals = enrich.language_model(train)
    d = docs(spark, "the dog", "die katze", "zzz")
    got = {r["doc_id"]: r["language"] for r in enrich.detect_language(d, counts, totals).collect()}
    assert got[0] == "en" and got[1] == "de" and got[2] == "en"


def test_texts_without_words_stay(spark):
    d = docs(spark, "the dog", "...", "", None)
    counts, totals = enrich.language_model(spark.createDataFrame([("the cat", "en"), ("die katze", "de")], "text string, lang string"))
    assert {r["doc_id"]: r["language"] for r in enrich.detect_language(d, counts, totals).collect()} == {0: "en", 1: None, 2: None, 3: None}
    assert {r["doc_id"]: r["summary"] for r in enrich.summarize_extractive(d).collect()} == {0: "the dog", 1: None, 2: None, 3: None}


def test_both_ways_to_meet_trigrams_agree(spark, monkeypatch):
    train = spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de")], "text string, lang string")
    counts, totals = enrich.language_model(train)
    d = docs(spark, "the dog", "die katze", "zzz", "")
    expected = sorted(enrich.detect_language(d, counts, totals).collect())
    monkeypatch.setattr(enrich, "BROADCAST_GRAMS", 0)
    assert sorted(enrich.detect_language(d, counts, totals).collect(), key=str) == sorted(expected, key=str)


def test_a_very_long_sentence_is_summarised(spark):
    d = docs(spark, " ".join(f"w{i % 5000}" for i in range(20_000)) + ". short one")
    assert len(enrich.summarize_extractive(d, 1).head()["summary"]) > 9


def test_relations_need_support_and_distinct_lines(spark):
    text = "mail a@x.org and b@x.org\na@x.org b@x.org b@x.org\nlone c@x.org"
    rows = [(1, text), (2, "a@x.org c@x.org"), (3, None), (4, "no entity here")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [tuple(r) for r in enrich.entity_relations(docs, 2).collect()]
    assert got == [("a@x.org", "b@x.org", 2, round(math.log(2 * 4 / (3 * 2)), 6))]
    assert {(r["first"], r["second"]) for r in enrich.entity_relations(docs, 1).collect()} == {("a@x.org", "b@x.org"), ("a@x.org", "c@x.org")}
    assert enrich.entity_relations(docs.where("false")).count() == 0


def test_enrichments_are_switched_and_unknown_ones_refused(spark, tables):
    one = enrich.enhance(tables.documents, {"language", "near"})
    assert one.columns == ["doc_id", "language", "duplicate_of"] and one.count() == tables.documents.count()
    with pytest.raises(ValueError, match="mood"):
        enrich.enhance(tables.documents, {"mood"})


def test_words_are_taken_in_bounded_slices(spark, monkeypatch):
    texts = ["the dog and the cat", "", None, "a a b " * 40, "die katze"]
    d = docs(spark, *texts)
    counts, totals = enrich.language_model(spark.createDataFrame([("the cat", "en"), ("die katze", "de")], "text string, lang string"))

    def results():
        lists = {r["doc_id"]: (r["len"], sorted(map(tuple, r["terms"]))) for r in enrich.term_lists(d).collect()}
        return lists, sorted(enrich.detect_language(d, counts, totals).collect()), sorted(embed_hashing(d, "doc_id", "text").collect())

    whole = results()
    monkeypatch.setattr(tx, "WORDS", 7)
    assert results() == whole
    rows = pa.record_batch({"words": [["w"] * 5, None, ["w"] * 9, [], ["w"], ["w"] * 6]})
    parts = list(tx.word_slices(rows))
    assert [p.num_rows for p in parts] == [2, 1, 3] and pa.Table.from_batches(parts).to_pydict() == rows.to_pydict()


def test_trigrams_of_a_text_are_counted_once(spark):
    d = docs(spark, "aa aa aaaa é9", None)
    got = {r["doc_id"]: sorted((x["g"], x["tf"]) for x in r["grams"]) for r in enrich.gram_counts(d).collect()}
    wanted = Counter(f" {w} "[i : i + 3] for w in ("aa", "aa", "aaaa", "é9") for i in range(len(w)))
    assert got == {0: sorted((int(tx.trigram_keys([g], 0)[0][0]), n) for g, n in wanted.items()), 1: []}


def test_summaries_of_shared_null_and_odd_rows(spark):
    rows = [(1, "a b. b c. c c d"), (2, "x y"), (2, "x. y y z"), (None, "a. b"), (3, None), (4, "..."), (5, " . \n one. one two \n. three"), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(1)
    found = sorted((r["doc_id"] or 0, r["summary"]) for r in enrich.summarize_extractive(docs, 1).where("summary is not null").collect())
    assert found == [(1, "b c"), (2, "x"), (2, "x y"), (5, "one")]
    assert enrich.summarize_extractive(docs).count() == len(rows)
    assert sorted(r["summary"] for r in enrich.summarize_extractive(docs).where("doc_id = 5").collect()) == ["one. one two. three"]


def test_summaries_are_the_same_in_small_slices(spark, monkeypatch):
    docs = spark.createDataFrame([(i, ". ".join(f"w{(i * j) % 11} w{j % 7} w{i % 5}" for j in range(i % 9))) for i in range(200)], "doc_id bigint, text string")
    whole = sorted(map(tuple, enrich.summarize_extractive(docs).collect()))
    monkeypatch.setattr(enrich.tx, "WORDS", 10)
    assert sorted(map(tuple, enrich.summarize_extractive(docs).collect())) == whole
    assert sorted(map(tuple, enrich._shared_summaries(docs, 3).collect())) == whole


def test_summaries_exchange_no_words(spark):
    docs = spark.createDataFrame([(1, "a b. b c")], "doc_id bigint, text string")
    plan = enrich.sentence_sums(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_texts_without_a_needed_character_are_not_searched(spark):
    texts = ["none here", "see [12] and (Smith, 2020), 10.1234/abc", "a@b.co 10.0.0.1 1234 5678 9012 3456 +49 170 123456", "<IP> <CARD> ()[]@", None, "1.2.3.4 1.2.3.4 copyright"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in enrich.enhance(docs, {"citations", "entities"}).collect()}
    assert [tuple(rows[i])[1:] for i in range(6)] == [(0, 0, 0, 0), (1, 1, 1, 0), (0, 0, 0, 4), (0, 0, 0, 0), (None,) * 4, (0, 0, 0, 3)]
    entities = enrich.extract_entities(docs).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in entities} == {2: 4, 5: 3}
    plan = enrich.enhance(docs, {"citations"})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("contains") >= 3


def test_each_word_is_hashed_once_in_a_task(spark, monkeypatch):
    made = []

    class Hashing:
        @staticmethod
        def md5(data):
            made.append(data)
            return hashlib.md5(data)

    class Given:
        schema = {"doc_id": types.SimpleNamespace(dataType=LongType())}

        def select(self, *columns):
            return self

        def mapInArrow(self, function, schema):
            return function

    monkeypatch.setattr(vectors, "hashlib", Hashing)
    batch = pa.record_batch({"doc_id": [1, 2], "words": [["a", "b", "a"], ["c"]]})
    embed = vectors.embed_hashing(Given(), "doc_id", "text")
    first, second = (b.column("embedding").to_pylist() for b in embed(iter([batch, batch])))
    assert first == second and sorted(made) == [b"a", b"b", b"c"]
    monkeypatch.setattr(vectors, "KNOWN_WORDS", 0)
    assert [b.column("embedding").to_pylist() for b in embed(iter([batch, batch]))] == [first, first]
