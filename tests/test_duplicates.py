import random

from pyspark.sql import functions as F

from paperloom.operators import duplicates as dup

WORDS = [f"w{i}" for i in range(60)]


def brute(texts, threshold=0.8):
    sets = {}
    for i, text in texts.items():
        words = text.split()
        if len(words) >= 3:
            sets[i] = {tuple(words[j : j + 3]) for j in range(len(words) - 2)}
    found = {}
    for i in sets:
        for j in sorted(sets):
            if j >= i:
                break
            common = len(sets[i] & sets[j])
            if common / (len(sets[i]) + len(sets[j]) - common) >= threshold:
                found[i] = j
                break
    return found


def sample():
    """A third exact copies, a third near copies of one text, a third others, some related."""
    rng = random.Random(9)
    base = [rng.choice(WORDS) for _ in range(60)]
    texts = {}
    for i in range(240):
        if i % 3 == 0:
            text = list(base)
        elif i % 3 == 1:
            text = list(base)
            for _ in range(rng.randrange(1, 5)):
                text[rng.randrange(60)] = rng.choice(WORDS)
        else:
            text = [rng.choice(WORDS) for _ in range(rng.randrange(1, 40))]
            if i % 2:
                text = base[: rng.randrange(40, 60)] + text[:4]
        texts[i] = " ".join(text)
    texts[500], texts[501] = "a b", "a b"
    return texts


def links(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(6)
    return dup.near_duplicates(docs)


def test_equals_brute_force_with_large_groups(spark):
    texts = sample()
    found = {r["doc_id"]: r["duplicate_of"] for r in links(spark, texts).collect()}
    assert found == brute(texts)
    assert len(found) > 150


def all_links(texts, threshold=0.8):
    sets = {i: {tuple(w[j : j + 3]) for j in range(len(w) - 2)} for i, t in texts.items() if len(w := t.split()) >= 3}
    ids = sorted(sets)
    for at, i in enumerate(ids):
        for j in ids[:at]:
            common = len(sets[i] & sets[j])
            if common / (len(sets[i]) + len(sets[j]) - common) >= threshold:
                yield i, j


def test_clusters_are_components_of_all_links(spark):
    texts = sample()
    drift = [f"d{i}" for i in range(60)]
    for step in range(12):  # each version is near the last one only
        drift[(step * 5) % 60] = f"v{step}"
        texts[900 - step] = " ".join(drift)
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    linked = set()
    for i, j in all_links(texts):
        linked |= {i, j}
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(6)
    got = {r["doc_id"]: r["cluster_id"] for r in dup.duplicate_clusters(docs).collect()}
    assert got == {i: find(i) for i in linked}


def test_a_common_passage_proposes_few_pairs(spark):
    passage = " ".join(f"commonpassage{i}" for i in range(400))
    texts = {i: passage + " " + " ".join(f"own{i}x{j}" for j in range(200)) for i in range(150)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    _, _, postings, _ = dup._prepared(docs, 0.8, 3)
    assert postings.count() <= 2 * len(texts)
    assert dup.near_duplicates(docs).count() == 0


def test_no_documents_no_links(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert dup.near_duplicates(docs).count() == 0


def test_exact_copies_are_near_duplicates(spark):
    texts = sample()
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    groups = dup.exact_duplicates(docs).collect()
    linked = {r["doc_id"] for r in links(spark, texts).collect()}
    assert any(g["copies"] >= 80 for g in groups)
    for g in groups:
        same = {i for i, t in texts.items() if t == texts[g["canonical"]] and len(t.split()) >= 3}
        assert same - {g["canonical"]} <= linked


def test_only_sets_in_a_pair_are_exchanged(spark, monkeypatch):
    rows = spark.range(1000).withColumn("grams", F.array("id"))
    pairs = spark.createDataFrame([(7, 3), (9, 3)], "id bigint, other bigint")
    named = dup._named_in(pairs, rows)
    assert sorted(r["id"] for r in named.collect()) == [3, 7, 9]
    assert " Exchange" not in named._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(dup, "BROADCAST_IDS", 2)
    assert dup._named_in(pairs, rows).count() == 1000
    assert {r["doc_id"]: r["duplicate_of"] for r in links(spark, sample()).collect()} == brute(sample())


def test_shingles_are_dealt_once(spark, monkeypatch):
    plans, keep = {}, dup.materialize

    def kept(df, name="stage"):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return keep(df, name)

    monkeypatch.setattr(dup, "materialize", kept)
    docs = spark.createDataFrame(list(sample().items()), "doc_id bigint, text string")
    dup._prepared(docs, 0.8, 3)
    assert sum("Exchange hashpartitioning(g#" in line for line in plans["prefixes"].splitlines()) == 1
