"""Token counts and packing against the tokenizer library."""

import bisect
import json
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from samples import SMALL, awkward, empty
from tokenizers import Tokenizer

from paperloom.llm import packing
from paperloom.llm.packing import best_fit_decreasing, fillings, lower_bound, pack_documents, pack_lengths
from paperloom.llm.queries import QUERIES
from paperloom.llm.token_counts import Vocabulary, count_texts, token_counts

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = [
    "a", "b", "'s", "'t", "'re", "'ll", "'", " ", "  ", "\n", "\t", "1", "٣", "é", "漢", "!", "<|endoftext|>", "<|startoftext|>",
    "😀", "\x1c", "\x85", "\x0b", "aaaaaaaa", "'S", "　", "é", "İ",
]


def fuzzed(count):
    rng = random.Random(3)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30))) for _ in range(count)]


def test_counts_equal_the_library_on_fuzzed_texts():
    texts = [*fuzzed(1500), "a" * 5000, "ab" * 3000, "".join(random.Random(1).choice("abcdeth") for _ in range(20_000)), ""]
    expected = [len(e.ids) for e in Tokenizer.from_file(BYTES).encode_batch(texts, add_special_tokens=False)]
    assert count_texts(texts, Vocabulary(BYTES)).tolist() == expected


def test_op1_on_the_whole_table_and_awkward_rows(spark):
    library = Tokenizer.from_file(BYTES)
    for docs, found in (
        (spark.read.parquet(f"{SMALL}/documents.parquet"), QUERIES["op1_token_counts"](spark, SMALL)),
        (awkward(spark), token_counts(awkward(spark), BYTES)),
    ):
        rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
        expected = Counter((i, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 512) for i, t in rows)
        assert Counter(map(tuple, found.collect())) == expected
    assert token_counts(empty(spark), BYTES).count() == 0


def checked_packing(docs, pieces):
    library = Tokenizer.from_file(WORDS)
    texts = {r["doc_id"]: library.encode(r["text"] or "", add_special_tokens=False).ids + [0] for r in docs.where("doc_id is not null").collect()}
    rows = pieces.toPandas().sort_values(["sequence_id", "offset"])
    for _, one in rows.groupby("sequence_id"):
        assert one.offset.tolist() == (one.length.cumsum() - one.length).tolist()
        assert one.length.sum() <= 2048
    known = rows[rows.doc_id.notna()]
    for doc_id, start, length, crc in zip(known.doc_id, known.start, known.length, known.ids_crc32, strict=True):
        assert zlib.crc32(np.array(texts[doc_id][start : start + length], "<u4").tobytes()) == crc
    assert set(known.doc_id) == set(texts)
    return rows


def test_op4_places_every_piece_gapless_with_the_right_ids(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = checked_packing(docs, QUERIES["op4_packing"](spark, SMALL))
    assert rows.sequence_id.nunique() == -(-rows.length.sum() // 2048)
    odd = awkward(spark)
    rows = checked_packing(odd, pack_documents(odd, WORDS))
    assert len(rows[rows.piece == 0]) == odd.count()
    assert pack_documents(empty(spark), WORDS).count() == 0


def brute_bins(sizes, capacity):
    """Fewest bins by trying every place for every piece."""
    best = len(sizes)

    def place(at, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if at == len(sizes):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + sizes[at] <= capacity:
                place(at + 1, [*bins[:i], bins[i] + sizes[at], *bins[i + 1 :]])
        place(at + 1, [*bins, sizes[at]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(12))
def test_plans_are_whole_and_near_the_optimum(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.randint(1, 20) for _ in range(10)), reverse=True)
    plan, bound = pack_lengths(dict(Counter(sizes)), 20)
    used = Counter()
    for filling, times in plan:
        assert sum(filling) <= 20
        used.update({x: times * filling.count(x) for x in set(filling)})
    assert used == Counter(sizes)
    best = brute_bins(sizes, 20)
    assert bound <= best <= sum(n for _, n in plan) <= best + 1


def test_fillings_are_undominated_and_bounds_hold():
    assert fillings({6: 1, 4: 1, 3: 2, 1: 1}, [6, 4, 3, 1], 10)[0] == (6, 4)
    assert lower_bound({7: 3}, 10) == 3
    assert pack_lengths({}, 10) == ([], 0)
    assert sum(n for _, n in pack_lengths({1: 5000}, 2048)[0]) == 3


def plain_best_fit(sizes, capacity):
    """Sequences that piece-by-piece best-fit decreasing uses."""
    free = []
    for x in sorted(sizes, reverse=True):
        at = bisect.bisect_left(free, x)
        left = free.pop(at) - x if at < len(free) else capacity - x
        bisect.insort(free, left)
    return len(free)


@pytest.mark.parametrize(("low", "high"), [(600, 1100), (690, 1300), (500, 1000), (300, 700), (1, 2048), (3, 40)])
def test_plans_are_never_behind_best_fit_decreasing(low, high):
    rng = random.Random(low)
    sizes = [rng.randint(low, high) for _ in range(20_000)]
    counts = dict(Counter(sizes))
    first = best_fit_decreasing(counts, 2048)
    used = Counter()
    for filling, times in first:
        assert sum(filling) <= 2048
        used.update({x: times * filling.count(x) for x in set(filling)})
    assert used == counts
    assert sum(n for _, n in first) == plain_best_fit(sizes, 2048)
    assert sum(n for _, n in pack_lengths(counts)[0]) <= plain_best_fit(sizes, 2048)


def test_pieces_outlive_a_full_cache(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_ROWS", 16)
    known, library = packing.Pieces(WORDS), Tokenizer.from_file(WORDS)
    rng = random.Random(9)
    for _ in range(300):
        texts = [" ".join(rng.choice(["the", "of", str(rng.randint(0, 400)), "word" * rng.randint(1, 9)]) for _ in range(rng.randint(0, 30))) for _ in range(3)]
        raw = [t.encode() for t in texts]
        offsets = np.cumsum([0, *(len(t) for t in raw)])
        ids, at = known.encode(np.frombuffer(b"".join(raw), np.uint8), offsets)
        expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == expected


def encoded(known, texts):
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *(len(t) for t in raw)])
    ids, at = known.encode(np.frombuffer(b"".join(raw), np.uint8), offsets)
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]


def test_the_library_gets_a_word_once_whatever_its_case_and_signs():
    known, library, asked = packing.Pieces(WORDS), Tokenizer.from_file(WORDS), []

    class Counting:
        def encode_batch_fast(self, texts, **options):
            asked.extend(word for text in texts for word in text.split())
            return library.encode_batch_fast(texts, **options)

    known.tokenizer = Counting()
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcdeéöñ") for _ in range(8)) for _ in range(700)})
    texts = [" ".join(form(w) for w in words) for form in (str, str.upper, str.capitalize, "{},".format, "({}).".format, "{}7".format, "3{}-x2".format)]
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert encoded(known, texts) == expected
    assert encoded(known, texts[::-1]) == expected[::-1]
    assert sorted(asked) == sorted([*words, ",", "(", ").", "7", "3", "-", "x", "2"])


UNIT_PARTS = [
    "the", "The", "Café", "ÉTÉ", "Straße", "ab12", "2024", "don't", "'tis", "O'NEILL", "'s", "!'s", "'", ",", ").", "$$", "×", "÷", "²", "½", "ª",
    "é", "≠", "́", "̧", "İ", "ẞ", "ſ", "K", "ǅ", "٣", "漢", "가", "😀", "—", "’", "\xa0", "\x00", "\x0b", "\x85", "　",
    " ", "  ", "\n", "\t", "\r", "</w>", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "_",
]


def test_units_equal_the_library_on_fuzzed_texts():
    rng = random.Random(8)
    plain = [chr(c) for c in (*range(0x20, 0x7F), *range(0xC0, 0x100))]
    texts = ["".join(rng.choice(UNIT_PARTS) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    texts += [a + b + c for a in plain for b in plain for c in ("", "'s")]
    expected = [e.ids for e in Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)]
    assert encoded(packing.Pieces(WORDS), texts) == expected
    unended = packing.Pieces(WORDS)
    unended.last[:] = False
    assert encoded(unended, texts[:6000]) == expected[:6000]
    for few in ([], [""], ["", "a", ""], [" "]):
        assert [len(ids) for ids in encoded(packing.Pieces(WORDS), few)] == [t.count("a") for t in few]


def test_files_with_another_split_or_specials_keep_whole_pieces(tmp_path):
    with open(WORDS, encoding="utf-8") as file:
        spec = json.load(file)
    split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]
    changes = spec["normalizer"]["normalizers"]
    rng = random.Random(6)
    texts = ["".join(rng.choice([*UNIT_PARTS, "x9", "Qu", "qu"]) for _ in range(rng.randint(0, 12))) for _ in range(1000)]
    for name, change in (
        ("split", lambda: split.update(Regex=r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]+")),
        ("case", lambda: (split.update(Regex=packing.SPLIT), changes.pop())),
        ("special", lambda: (changes.append({"type": "Lowercase"}), spec["added_tokens"].append({**spec["added_tokens"][0], "id": 320, "content": "qu"}))),
    ):
        change()
        path = str(tmp_path / f"{name}.json")
        with open(path, "w", encoding="utf-8") as file:
            json.dump(spec, file)
        expected = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
        assert encoded(packing.Pieces(path), texts) == expected
