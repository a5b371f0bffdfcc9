"""Decontamination, n-gram join and class model against brute force."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from samples import SMALL, awkward, empty, lower, ordered

from paperloom.llm import class_lm, ngram_join
from paperloom.llm.decontaminate import Items, _judged, contamination, without_contaminated
from paperloom.llm.queries import QUERIES
from paperloom.operators.components import components

ITEM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_contamination(docs, items):
    windows = {}
    for item, text in items:
        w = ITEM_WORD.findall(lower(text))
        size = min(13, len(w))
        for j in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[j : j + size]), set()).add(item)
    rows = []
    for doc, text in docs:
        w, hit, found = ITEM_WORD.findall(lower(text)), set(), set()
        for size in {len(k) for k in windows}:
            for j in range(len(w) - size + 1):
                if tuple(w[j : j + size]) in windows:
                    hit |= set(range(j, j + size))
                    found |= windows[tuple(w[j : j + size])]
        names = sorted(str(i) for i in found - {None})
        rows.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), 20 * len(hit) >= max(len(w), 1)))
    return rows


def pairs(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_op8_equals_brute_force_on_the_whole_table(spark):
    docs, items = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "benchmark"))
    expected = brute_contamination(pairs(docs, "doc_id", "text"), pairs(items, "item_id", "text"))
    assert ordered(QUERIES["op8_decontamination"](spark, SMALL).collect()) == ordered(expected)
    assert any(r[5] for r in expected)


@pytest.mark.parametrize("most_words", [10**9, 0])
def test_op8_awkward_rows_by_both_ways(spark, most_words):
    items = spark.createDataFrame(
        [(1, "word"), (2, None), (3, "the the"), (3, "the the"), (None, "alpha beta"), (4, " ".join("abcdefghijklmnop"))], "item_id long, text string"
    )
    more = [(20, " ".join("xabcdefghijklmnopy")), (21, " ".join("abcdefghijkl")), (22, " ".join("abcdefghijklmabcdefghijklm"))]
    docs = awkward(spark, more)
    expected = brute_contamination(pairs(docs, "doc_id", "text"), pairs(items, "item_id", "text"))
    assert ordered(contamination(docs, items, most_words=most_words).collect()) == ordered(expected)
    assert contamination(empty(spark), items, most_words=most_words).count() == 0
    kept = without_contaminated(docs, items, most_words=most_words)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not r[5] for r in expected)


@pytest.mark.parametrize("most_words", [10**9, 0])
def test_op8_neighbours_with_equal_windows_are_each_judged(spark, most_words):
    item = [f"item{i}" for i in range(20)]
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    sizes = [13, 13, 13, 16, 16, 16, 20, 20, 20, 12]
    docs = spark.createDataFrame([(n, " ".join(item[:size])) for n, size in enumerate(sizes)], "doc_id long, text string").coalesce(1)
    expected = brute_contamination(pairs(docs, "doc_id", "text"), pairs(items, "item_id", "text"))
    assert [r[2] for r in expected] == sizes[:-1] + [0]
    assert ordered(contamination(docs, items, most_words=most_words).collect()) == ordered(expected)
    assert [r["doc_id"] for r in without_contaminated(docs, items, most_words=most_words).collect()] == [9]


@pytest.mark.parametrize("most_words", [10**9, 0])
def test_op8_repeated_words_equal_brute_force(spark, most_words):
    rng = random.Random(8)
    items = [(1, "la " * 40), (2, "la lo " * 30), (3, "x " + "la " * 20 + "y " * 14), (4, " ".join(rng.choice("ab") for _ in range(60)))]
    texts = ["la " * 300, "lo la " * 90 + "z " + "la " * 12, "y " * 100 + "la " * 13 + "x", " ".join(rng.choice("ab") for _ in range(900)), "la " * 12]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = brute_contamination(list(enumerate(texts)), items)
    found = contamination(docs, spark.createDataFrame(items, "item_id long, text string"), most_words=most_words)
    assert ordered(found.collect()) == ordered(expected)


def test_op8_one_word_very_often_takes_linear_time():
    index = Items(["1"], ["la " * 20_000])
    started = time.monotonic()
    n_words, n_hit, n_items, _ = _judged(index, pa.array(["la " * 20_000, "la lo " * 10_000]))
    assert time.monotonic() - started < 10
    assert (n_words.tolist(), n_hit.tolist(), n_items.tolist()) == ([20_000, 20_000], [20_000, 0], [1, 0])


def test_op8_without_items_marks_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(awkward(spark), none).where("n_hit > 0").count() == 0


def brute_components(docs):
    sets, members = {}, collections.defaultdict(list)
    for i, t in docs:
        w = WORD.findall(lower(t))
        s = frozenset(tuple(w[j : j + 4]) for j in range(len(w) - 3)) if len(w) > 3 else frozenset([tuple(w)] if w else [])
        sets.setdefault(s, []).append(i)
    names = [s for s in sets if s]
    parent = {s: s for s in names}

    def find(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for i, a in enumerate(names):
        for b in names[:i]:
            c = len(a & b)
            if 100 * c >= 85 * (len(a) + len(b) - c):
                parent[find(a)] = find(b)
    for s in names:
        members[find(s)] += [i for i in sets[s] if i is not None]
    rows = []
    for s, ids in sets.items():
        least = min(members[find(s)], default=None) if s else None
        rows += [(i, len(s), least if s else i) for i in ids]
    return rows


def chains():
    """Near copies in chains and stars, among texts that share one long passage."""
    rng = np.random.default_rng(5)
    passage = " ".join(f"p{i}" for i in range(60))
    rows, number = [], 100
    for family in range(6):
        base = [f"f{family}w{i}" for i in range(90)]
        for step in range(7):
            words = list(base)
            for at in rng.choice(90, 1 + step % 3, replace=False):
                words[at] = f"n{rng.integers(1 << 30)}"
            base = words if family % 2 else base  # odd families drift, even ones are stars
            rows.append((number, " ".join(words)))
            number += 1
    for i in range(40):
        rows.append((number + i, passage + " " + " ".join(f"own{i}x{j}" for j in range(50))))
    for i in range(10):
        rows.append((number + 50 + i, passage))
    return rows


def test_op5_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    expected = brute_components(pairs(docs, "doc_id", "text"))
    assert ordered(QUERIES["op5_ngram_join"](spark, SMALL).collect()) == ordered(expected)


def test_op5_awkward_rows_chains_and_shared_passages(spark, monkeypatch):
    docs = awkward(spark, [*chains(), (None, "word"), (11, "A text WITHOUT an id")])
    expected = ordered(brute_components(pairs(docs, "doc_id", "text")))
    assert ordered(ngram_join.joined_documents(docs).collect()) == expected
    monkeypatch.setattr(ngram_join, "BROADCAST_SETS", 0)  # the way for any number of sets
    assert ordered(ngram_join.joined_documents(docs).collect()) == expected
    assert ngram_join.joined_documents(empty(spark)).count() == 0


def test_op5_filter_keeps_one_of_each(spark):
    docs = awkward(spark, [*chains(), (5, "another text of this id"), (None, "a text without an id")])
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    rows = ngram_join.joined_documents(kept).where("n_shingles > 0").collect()
    classes = {(n, c) for _, n, c in brute_components(pairs(docs, "doc_id", "text")) if n}
    assert len(rows) == len({r["component_id"] for r in rows if r["component_id"] is not None}) + sum(r["component_id"] is None for r in rows) + 1
    assert {r["component_id"] for r in rows} == {c for _, c in classes}
    assert kept.where("coalesce(trim(text), '') = ''").count() == docs.where("coalesce(trim(text), '') = ''").count()


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(200, 201), (7, 7)], "a long, b long")
    found = {r["id"]: r["root"] for r in components(links).collect()}
    assert found == {**{i: 0 for i in range(61)}, 200: 200, 201: 200}


def brute_base(docs):
    words = {}
    counts = collections.Counter()
    for n, (i, t) in enumerate(docs):
        words[n] = WORD.findall(lower(t)) + [None]
        if i is not None and zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(words[n])
    total = sum(counts.values())
    floor = math.log10(total + 0.5 * (len(counts) + 1))
    return [
        (i, i is not None and zlib.crc32(str(i).encode()) % 5 == 1, len(w), sum(counts[x] > 0 for x in w), total, sum(math.log10(counts[x] + 0.5) - floor for x in w))
        for (i, _), w in zip(docs, words.values(), strict=True)
    ]


@pytest.mark.parametrize("table", [1 << 19, 40])
def test_op6_base_score_is_exact_and_the_model_beats_it(spark, monkeypatch, table):
    monkeypatch.setattr(class_lm.lexicon, "__defaults__", (table,))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = class_lm.class_scores(docs).toPandas().sort_values("doc_id")
    expected = sorted(brute_base(pairs(docs, "doc_id", "text")))
    assert [tuple(r) for r in found[["doc_id", "held_out", "n_tokens", "n_known", "train_tokens"]].itertuples(index=False)] == [r[:5] for r in expected]
    assert np.allclose(found.base_score, [r[5] for r in expected])
    held = found[found.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_op6_awkward_rows(spark):
    docs = awkward(spark)
    rows = class_lm.class_scores(docs).collect()
    expected = brute_base(pairs(docs, "doc_id", "text"))
    assert ordered(tuple(r)[:5] for r in rows) == ordered(r[:5] for r in expected)
    assert all(math.isfinite(r["score"]) for r in rows)
    assert class_lm.class_scores(empty(spark)).count() == 0
    unlearned = class_lm.class_scores(spark.createDataFrame([(None, "some words")], "doc_id long, text string")).head()
    assert (unlearned["train_tokens"], unlearned["n_known"], unlearned["n_tokens"]) == (0, 0, 3)
    assert math.isfinite(unlearned["score"])


def test_op6_exchange_separates_two_vocabularies():
    rng = np.random.default_rng(0)
    size = 21
    table = np.zeros((size, size), np.int64)
    for _ in range(4000):
        side = rng.integers(2)
        u, v = rng.integers(10, size=2) + 10 * side
        table[u, v] += 1
    label = class_lm.exchange(table, classes=3)
    assert len(set(label[:10])) == len(set(label[10:20])) == 1
    assert label[0] != label[10]


def test_op6_exchange_goes_on_until_no_unit_moves():
    def bits(table, label, classes):
        grid = np.zeros((classes, classes))
        np.add.at(grid, (label[:, None], label[None, :]), table)
        f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return f(grid) - f(grid.sum(axis=0)) - f(grid.sum(axis=1))

    rng = np.random.default_rng(4)
    size, classes = 301, 24
    table = rng.poisson(rng.gamma(0.3, 1, (size, size)))
    label = class_lm.exchange(table, classes=classes)
    best = bits(table, label, classes)
    for w in rng.permutation(size - 1)[:20].tolist():
        for new in range(1, classes):
            other = label.copy()
            other[w] = new
            assert bits(table, other, classes) <= best + 1e-5


def test_op6_best_class_equals_counting_the_likelihood_again():
    rng = np.random.default_rng(1)
    count, classes = 40, class_lm.CLASSES
    label = np.append(0, rng.integers(1, classes, count))
    tokens = rng.integers(0, count + 1, 3000)
    tokens[1::9] = tokens[: len(tokens[1::9]) * 9 : 9]  # words that follow themselves

    def grid(of):
        table = np.zeros((classes, classes), np.int64)
        np.add.at(table, (of[tokens[:-1]], of[tokens[1:]]), 1)
        return table

    before, after = tokens[:-1], tokens[1:]
    for w in range(1, count + 1):
        left = np.bincount(label[before[(after == w) & (before != w)]], minlength=classes)[None, :]
        right = np.bincount(label[after[(before == w) & (after != w)]], minlength=classes)[None, :]
        own = np.array([((before == w) & (after == w)).sum()])
        new = class_lm.best_classes(grid(label), label[w : w + 1], left, right, own)[0]
        found = []
        for k in range(1, classes):
            other = label.copy()
            other[w] = k
            found.append(class_lm.likelihood(grid(other)))
        assert math.isclose(found[new - 1], max(found), abs_tol=1e-6)


def brute_score(docs, known, loose, model):
    """Log10 probability of each text by the fitted tables, token by token."""
    classes = {int(r["h"]): (r["c"], r["class"]) for r in loose.collect()}
    core = {int(known.hashes[i].view(np.int64)): (int(known.counts[i]), int(known.classes[i])) for i in known.core()}
    ends = sum(int(c) for h, c in zip(known.hashes, known.counts, strict=True) if h == class_lm.END)
    scores = []
    for text in docs:
        batch = pa.RecordBatch.from_arrays([pa.array([text], pa.string())], ["text"])
        (_, _, _, hashes, bins), = class_lm._word_batches(batch)
        total, before = 0.0, class_lm.END_CLASS
        for h, b in [*zip(hashes.view(np.int64).tolist(), bins.tolist(), strict=True), (None, None)]:
            c, k = (ends, class_lm.END_CLASS) if h is None else core.get(h) or classes.get(h) or (0, int(known.bin_class[b]))
            total += model.move[before, k] + math.log10(c + 0.5) - model.root[k]
            before = k
        scores.append(total)
    return scores


@pytest.mark.parametrize("table", [1 << 19, 600])
def test_op6_scores_equal_the_model_token_by_token(spark, monkeypatch, table):
    monkeypatch.setattr(class_lm.lexicon, "__defaults__", (table,))
    kept = {}
    fit = class_lm.fit
    monkeypatch.setattr(class_lm, "fit", lambda *args: kept.setdefault("model", fit(*args)))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = sorted((r["doc_id"], r["score"]) for r in class_lm.class_scores(docs).collect())
    texts = dict(pairs(docs, "doc_id", "text"))
    known, loose, model = kept["model"]
    expected = brute_score([texts[i] for i, _ in found], known, loose, model)
    assert np.allclose([s for _, s in found], expected)
    assert math.isclose((10 ** (model.move)).sum(axis=1).max(), 1.0) and math.isclose((10 ** (model.move)).sum(axis=1).min(), 1.0)
    # Words outside the core are not bound to the class of their bin.
    assert any(r["class"] != known.bin_class[r["bin"]] for r in loose.join(class_lm.word_counts(docs).select("h", "bin"), "h").collect())


def test_op6_passes_do_not_depend_on_how_counts_are_cut(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    vocabulary = class_lm.word_counts(docs).cache()
    known = class_lm.lexicon(vocabulary, 700)
    label = np.append(1 + np.arange(class_lm.UNITS - 1) % (class_lm.CLASSES - 1), class_lm.END_CLASS)
    known = known.labelled(label)
    grid = class_lm.bigrams(docs, known, class_lm.CLASSES)

    def moved(parts):
        rows = class_lm.reassigned(class_lm.neighbours(docs.repartition(parts), known), grid).collect()
        return sorted((r["h"], r["listed"], r["c"], r["class"]) for r in rows)

    expected = moved(1)
    core = {int(h) for h in known.hashes[known.core()].view(np.int64)} | {int(class_lm.END.view(np.int64))}
    counts = sorted((r["h"], r["c"]) for r in vocabulary.collect() if r["h"] not in core)
    assert [(h, c) for h, _, c, _ in expected] == counts
    assert any(k != label[r["bin"]] for r, (_, _, _, k) in zip(sorted((r for r in vocabulary.collect() if r["h"] not in core), key=lambda r: r["h"]), expected, strict=True))
    monkeypatch.setattr(class_lm, "ENTRIES", 500)
    monkeypatch.setattr(class_lm, "MOST_COUNT", 2)
    monkeypatch.setattr(class_lm, "FEW", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert moved(5) == expected
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_op6_takes_small_batches_and_leaves_the_session_as_it_was(spark, monkeypatch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen, count = spark.conf.get(name), [], class_lm.word_counts
    monkeypatch.setattr(class_lm, "word_counts", lambda docs: (seen.append(int(spark.conf.get(name))), count(docs))[1])
    docs = spark.createDataFrame([(i, f"one two w{i}") for i in range(20)], "doc_id long, text string")
    assert class_lm.class_scores(docs).count() == 20
    assert 0 < seen[0] <= 1000 and spark.conf.get(name) == before
