import hashlib

import corpus_fixture as C
import numpy as np
import pytest
import xxhash

from ravelgrid.llm import minhash


def shingles(text):
    ws = text.encode().lower().split()
    k = min(5, len(ws))
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if ws else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("range_bytes", [8 << 20, 2000])
def test_edited_texts_and_likeness(spark, range_bytes):
    rows = C.documents()
    def tie(text):  # Spark's hash, as a signed number
        h = xxhash.xxh64_intdigest(text.encode(), 42)
        return h - (1 << 64) if h >> 63 else h

    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), tie(r[1] or ""), r[1] or ""))
    want, true = [], {}
    for r, nxt in zip(order, order[1:] + order[:1]):
        t, n = r[1] or "", nxt[1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        want.append((-1 if r[0] is None else r[0], len(t), hashlib.sha256(edited.encode()).hexdigest()))
        true[want[-1]] = (jaccard(t, edited), jaccard(t, n))
    got = minhash.edited_pairs(C.frame(spark, rows, clashing=True), range_bytes).collect()
    mine = {(-1 if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256): r for r in got}
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    off = np.array([(r.near_edited - true[k][0], r.near_next - true[k][1]) for k, r in mine.items()])
    assert np.abs(off).max() < 0.13 and np.sqrt((off**2).mean()) < 0.035
    by_text = {}
    texts = {r[0]: r[1] or "" for r in rows if r[0] not in (None, 310)}
    for r in got:
        if r.doc_id in texts:
            assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint


def test_estimates_have_no_bias():
    rng = np.random.default_rng(1)
    h = minhash.MinHasher()
    off = []
    for n in (3, 20, 100, 2000):
        for share in (0.0, 0.3, 0.8):
            for rep in range(20):
                a = [f"w{x}" for x in rng.integers(0, 1 << 40, n + 4)]
                b = list(a)
                cut = int(len(a) * share)
                b[cut:] = [f"v{x}" for x in rng.integers(0, 1 << 40, len(a) - cut)]
                a, b = " ".join(a), " ".join(b)
                off.append(minhash.likeness(h.sketch(a.encode()), h.sketch(b.encode())) - jaccard(a, b))
    assert abs(np.mean(off)) < 0.01


def test_defined_cases(spark):
    h = minhash.MinHasher()
    assert minhash.pack(h.sketch(b"  ")) == "-" and minhash.likeness(None, None) == 1.0
    assert minhash.likeness(None, h.sketch(b"a")) == 0.0
    assert minhash.edited_pairs(C.frame(spark, [])).collect() == []
    one = minhash.edited_pairs(C.frame(spark, [(7, "abc def", "en", "s", 7)])).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abc abc").hexdigest() and one[0].near_next == 1.0


def test_many_null_and_equal_ids(spark):
    rows = [(None if i % 3 else 5, f"some words and the number {i} to tell them apart", "en", "s", 0) for i in range(600)]
    got = minhash.edited_pairs(C.frame(spark, rows), 500).collect()
    assert len(got) == 600 and len({r.fingerprint for r in got}) > 590
    # every text follows exactly one other: the edited texts end in it
    halves = {hashlib.sha256((a[1][: len(a[1]) - len(a[1]) // 2] + b[1][: len(a[1]) // 2]).encode()).hexdigest() for a in rows[:40] for b in rows}
    assert sum(r.edited_sha256 in halves for r in got) >= 40
