import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import corpus_fixture as C
import numpy as np
import pytest

from ravelgrid.llm import fillings, packing


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


def check(rows, docs, tok, capacity):
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    want = defaultdict(list)
    for i, t, *_ in docs:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for p, s in enumerate(range(0, len(ids), capacity)):
            some = ids[s : s + capacity]
            want[i].append((p, s, len(some), zlib.crc32(some.tobytes())))
    assert {k: sorted((r.piece, r.start, r.length, r.ids_crc32) for r in v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= capacity
    return len(seqs)


@pytest.mark.parametrize("capacity", [2048, 64])
def test_pieces_and_sequences(spark, tok, capacity):
    docs = C.documents()
    rows = packing.pack(C.frame(spark, docs, clashing=True), capacity).collect()
    n = check(rows, docs, tok, capacity)
    total = sum(r.length for r in rows)
    assert n <= -(-total // capacity) * 1.05 + 1


def test_word_cache_equals_whole_text(tok):
    texts = ["It's we'll don't STOP", "a<|endoftext|>b <|startoftext|>", "ÄÖ é ΑΣ ΣΑΣ. 漢字 😀😀", "x y z", "tabs\tand\r\nlines\x0b\x0c", "'S 'RE 12345 $$$!!", "", "İstanbul İ. \u0958 \u0958, \u0344 ﬁne ǅ ª º ⅷ e\u0301a é, word; other:! 中文.", "\u1e9e ÉCOLE Ωμέγα ΣΑΣ, \u2126"]
    enc = packing.CachedEncoder(packing.default_tokenizer(), cache=3)
    for t in texts * 2:
        assert enc.encode(t).tolist() == tok.encode(t, add_special_tokens=False).ids


def test_word_cache_on_real_texts(spark, tok):
    enc = packing.CachedEncoder(packing.default_tokenizer(), cache=5000)
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    for r in rows:
        assert enc.encode(r.text).tolist() == tok.encode(r.text, add_special_tokens=False).ids


def _histograms():
    rng = random.Random(2)
    yield Counter(rng.randint(1, 2048) for _ in range(3000))
    yield Counter(1366 if rng.random() < 0.4 else rng.randint(1, 2048) for _ in range(3000))
    yield Counter(rng.randint(300, 1500) for _ in range(20000))
    yield Counter(min(2047, max(1, int(rng.lognormvariate(6, 1)))) for _ in range(20000))
    yield {k: 100_000 * n for k, n in Counter(rng.randint(300, 1500) for _ in range(2000)).items()}
    yield {682: 300, 683: 300, 1000: 10}


def test_the_program_places_nearly_all_pieces():
    for counts in _histograms():
        got = fillings.solve(counts, 2048)
        held = Counter()
        for f, n in got.fillings:
            assert n > 0 and sum(k * c for k, c in f.items()) <= 2048
            for k, c in f.items():
                held[k] += c * n
        assert held == Counter(counts)
        used = sum(n for _, n in got.fillings) - counts.get(2048, 0)
        # what is left to best fit decreasing depends on the number of lengths, not of pieces
        assert got.left_over <= len(counts)
        assert got.relaxed.bound <= used <= got.relaxed.bound * 1.015 + 10
        assert got.relaxed.bound <= got.relaxed.value <= got.relaxed.bound * 1.02 + 1
        # the variables cover every length
        covered = Counter()
        for f, n in got.relaxed.fillings.items():
            for k, c in f:
                covered[k] += c * n
        assert all(covered[k] >= n * (1 - 1e-5) for k, n in counts.items() if k != 2048)


def _optimum(counts, capacity):
    """The linear program's optimum by trying every basis of maximal fillings."""
    lengths = sorted(counts)
    found = []

    def extend(at, room, so_far):
        if at == len(lengths):
            if room < lengths[0]:
                found.append(so_far)
            return
        for n in range(room // lengths[at] + 1):
            extend(at + 1, room - n * lengths[at], (*so_far, n))

    extend(0, capacity, ())
    need, best = np.array([counts[k] for k in lengths], float), np.inf
    # a covering program: slack columns let a length be covered more often than needed
    columns = [np.array(f, float) for f in found] + [-np.eye(len(lengths))[i] for i in range(len(lengths))]
    cost = [1.0] * len(found) + [0.0] * len(lengths)
    for basis in combinations(range(len(columns)), len(lengths)):
        a = np.stack([columns[i] for i in basis], axis=1)
        if abs(np.linalg.det(a)) > 1e-9 and (x := np.linalg.solve(a, need)).min() >= -1e-9:
            best = min(best, sum(cost[i] * v for i, v in zip(basis, x)))
    return best


@pytest.mark.parametrize("capacity, counts", [
    (20, {7: 100, 9: 60, 12: 30}), (20, {3: 50, 8: 70, 11: 40}), (10, {4: 1000, 6: 10, 3: 7}), (30, {10: 5, 11: 500, 16: 90}), (10, {6: 30, 7: 12}),
])
def test_the_relaxation_is_near_the_optimum(capacity, counts):
    best = _optimum(counts, capacity)
    got = fillings.relax(counts, capacity)
    assert 0.96 * best <= got.bound <= best + 1e-6
    assert best - 1e-3 <= got.value <= 1.02 * best


def test_lengths_beyond_the_capacity_are_refused():
    with pytest.raises(ValueError):
        fillings.solve({11: 1}, 10)


def test_words_of_another_tokenizer(tok):
    enc = packing.CachedEncoder(packing.default_tokenizer())
    enc.closes[:] = True  # as if every id ended a word
    assert enc.encode("several ordinary words, unbelievably").tolist() == tok.encode("several ordinary words, unbelievably", add_special_tokens=False).ids


def test_empty_table(spark):
    assert packing.pack(C.frame(spark, [])).collect() == []
