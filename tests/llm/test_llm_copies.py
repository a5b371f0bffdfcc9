"""Exact copies, conversation tries and spelling variants against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from samples import SMALL, awkward, empty, lower, ordered

from paperloom.llm import exact_dedup, prefix_trie, spelling_variants
from paperloom.llm.queries import QUERIES


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_copies(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    found = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for at, i in enumerate(ids):
            found.append((i, keep, len(ids), at == ids.index(keep), sha(text)))
    return found


def pairs(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


BLOCKY = [
    (30, "a😀" * 6000), (31, "a😀" * 6000), (32, "a😀" * 5999 + "a"), (33, "x" * 4096), (34, "x" * 4096), (35, "x" * 4097), (36, "x" * 8192),
    (37, "x" * 12288), (38, "x" * 12288), (39, "x" * 20480), (40, "x" * 20480), (41, "é" * 4096 + "y"), (42, "é" * 4096 + "y"),
    (43, "é" * 4096 + "z"), (None, ""), (44, "x" * 4096 + "y" * 4096), (45, "y" * 4096 + "x" * 4096), (46, "y" * 4096 + "x" * 4096),
]


def test_op12_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert ordered(QUERIES["op12_exact_dedup"](spark, SMALL).collect()) == ordered(brute_copies(pairs(docs)))
    odd = awkward(spark, BLOCKY)
    assert ordered(exact_dedup.exact_duplicates(odd).collect()) == ordered(brute_copies(pairs(odd)))
    assert exact_dedup.exact_duplicates(empty(spark)).count() == 0


def test_op12_joins_hot_names_in_parts(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 7)
    rows = [(i, "z" * 9000) for i in range(200)] + [(i, f"own {i}") for i in range(200, 300)] + [(i, "z" * 4096) for i in range(300, 350)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    assert ordered(exact_dedup.exact_duplicates(docs).collect()) == ordered(brute_copies(rows))


def test_op12_takes_another_seed_when_two_blocks_share_a_route(spark, monkeypatch):
    honest, seeds = exact_dedup.routes, []

    def routes(block, seed):
        seeds.append(seed)
        return honest(block if seed else exact_dedup.F.length(block).cast("string"), seed)

    monkeypatch.setattr(exact_dedup, "routes", routes)
    rows = [(1, "ab"), (2, "cd"), (3, "ab"), (4, "e")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    assert ordered(exact_dedup.exact_duplicates(docs).collect()) == ordered(brute_copies(rows))
    assert max(seeds) == 1


def test_op12_uses_no_python_workers(spark):
    plan = QUERIES["op12_exact_dedup"](spark, SMALL)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "ExternalRDD"))


def test_op12_filter_keeps_columns(spark):
    docs = awkward(spark, BLOCKY).where("doc_id <> 5")
    kept = exact_dedup.without_copies(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r[0] for r in brute_copies(pairs(docs)) if r[3])


def brute_trie(rows):
    """Every node by its turns themselves: rows are (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    made = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = tuple(turns.get(c - int(math.fmod(c, 100)), [])[:h] + mine[h:])
    nodes = defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            nodes[made[c][:d]].append(c)
    kids, leaves, saved = Counter(k[:-1] for k in nodes if k), Counter(), Counter()
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(members) - 1) * len(k[-1][1]) if k else 0
    return [
        (m[0], len(k), nodes[k[:-1]][0] if k else None, len(m), kids[k], leaves[k], saved[k], sha(",".join(str(c) for c in m if len(made[c]) == len(k))))
        for k, m in nodes.items()
    ]


TURNS = "conv_id long, turn long, role string, text string, key string, path int, kind string"


def odd_turns(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice("ua"), rng.choice(["x", "y", "zé😀"])) for c in range(0, 420) for t in range(rng.randint(0, 4))]
    rows += [(c, t, "u", "same") for c in range(1000, 1080) for t in range(3)]
    rows += [(700, None, "u", None), (700, None, None, "a"), (700, 1, "u", "b"), (700, 1, "u", "b"), (None, 1, "u", "lost"), (-5, 0, "u", "x"), (0, 0, "u", "x")]
    rows += [(801, t, "u", "long") for t in range(700)] + [(803, t, "u", "long") for t in range(650)] + [(805, 0, "ua", "b"), (806, 0, "u", "ab")]
    return spark.createDataFrame([(*r, "k", 1, "t") for r in rows], TURNS)


def four(df):
    return [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]


@pytest.mark.parametrize(("cells", "batch"), [(1 << 20, 10_000), (40, 10_000), (2000, 7)])
def test_op13_equals_brute_force_however_it_is_sliced(spark, monkeypatch, cells, batch):
    monkeypatch.setattr(prefix_trie, "CELLS", cells)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", batch == 10_000)
    turns = odd_turns(spark)
    assert ordered(prefix_trie.prefix_trie(turns).collect()) == ordered(brute_trie(four(turns)))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_op13_on_the_whole_table_and_on_nothing(spark):
    turns = spark.read.parquet(f"{SMALL}/conversations.parquet")
    assert ordered(QUERIES["op13_prefix_trie"](spark, SMALL).collect()) == ordered(brute_trie(four(turns)))
    assert prefix_trie.prefix_trie(empty(spark, TURNS)).count() == 0


def test_op13_matrix_masks(spark):
    digests = np.array([[1, 1], [1, 2], [1, 1], [1, 1]], ">u8")
    assert prefix_trie.matrix(digests, np.array([2, 0, 1, 1])).tolist() == [[1, 2], [0, 0], [1, 0], [1, 0]]
    assert list(prefix_trie.cuts(np.array([1, 1, prefix_trie.CELLS + 1, 1]))) == [(0, 2), (2, 3), (3, 4)]


def brute_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def brute_variants(rows):
    words = brute_words(rows)
    near, masked = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            masked[w[:i], w[i + 1 :]].add(w)
            if w[:i] + w[i + 1 :] in words:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
    for group in masked.values():
        for w in group:
            near[w] |= group - {w}
    forms = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 2 * words[w]:
            forms[w] = best
    found = []
    for w, n in words.items():
        root = w
        while root in forms:
            root = forms[root]
        found.append((w, forms.get(w), root, n, len(near[w]), words.get(forms.get(w))))
    return found


def misspelt(spark):
    rng = random.Random(11)
    letters = "abéÿ×"
    texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(4, 7))) for _ in range(400)) for _ in range(60)]
    chain = " ".join(" ".join([w] * n) for w, n in (("abcde", 3), ("abcdef", 6), ("abcdefg", 12), ("abcdefgh", 24), ("abcdefgx", 24)))
    long = "q" * 3000
    runs = f"{long} {long} {long} {long}r {long}r {long}r {long[:1000]}z{long[:1999]} " * 3
    return awkward(spark, [*enumerate(texts, 100), (50, chain), (51, runs), (52, "VWXYZ Vwxyz aaaaa aaaaaa aaaaaa aaaaaaa " * 3), (None, "nulls nulls nulls")])


@pytest.mark.parametrize("most", [20_000, 30])
def test_op11_equals_brute_force_in_whole_and_cut_partitions(spark, monkeypatch, most):
    monkeypatch.setattr(spelling_variants, "MOST", most)
    docs = misspelt(spark)
    expected = brute_variants(pairs(docs))
    assert ordered(spelling_variants.spelling_variants(docs).collect()) == ordered(expected)
    roots = {r[0]: r[2] for r in expected}
    assert roots["abcde"] == roots["abcdef"] == "abcdefgh"


def test_op11_on_the_whole_table_and_on_nothing(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    expected = brute_variants(pairs(docs))
    assert ordered(QUERIES["op11_spelling_variants"](spark, SMALL).collect()) == ordered(expected)
    assert any(r[1] for r in expected)
    assert spelling_variants.spelling_variants(empty(spark)).count() == 0


def test_op11_acceptor_is_minimal_and_ranks_are_right():
    machine = spelling_variants.Acceptor()
    words = sorted(a + b + c for a in "abc" for b in "xy" for c in "123")
    first = machine.add(words)
    assert len(machine.moves) == 4 and machine.size[first] == len(words)
    near = {(words[i], words[j]) for i, j in machine.replacements(first)}
    assert near == {(u, v) for u in words for v in words if u < v and sum(a != b for a, b in zip(u, v, strict=True)) == 1}


def test_op11_runs_have_the_crc_of_their_bytes():
    texts = [b"abc", b"", b"x" * 64, b"y" * 65, b"z" * 400, "é×".encode()]
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    before = np.array([zlib.crc32(b"%d:" % i) for i in range(len(texts))], np.uint32)
    found = spelling_variants.run_crcs(data, starts, ends, before)
    assert found.tolist() == [zlib.crc32(b"%d:" % i + t) for i, t in enumerate(texts)]
