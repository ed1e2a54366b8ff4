import math
from collections import Counter

import corpus_fixture as C
import numpy as np
import pytest

from ravelgrid.llm import lm_scoring


def brute(rows):
    docs = [(i, (t or "").encode().lower().split() + [None]) for i, t, *_ in rows]
    train = Counter(w for i, ws in docs if C.fold(i, 5) != 1 for w in ws)
    n, v = sum(train.values()), len(train)
    out = []
    for i, ws in docs:
        base = sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        out.append((i, C.fold(i, 5) == 1, len(ws), sum(train[w] > 0 for w in ws), n, round(base, 6)))
    return out


@pytest.mark.parametrize("clashing", [False, True])
def test_base_score_and_counts_equal_brute_force(spark, clashing):
    rows = C.documents()
    got = lm_scoring.score_documents(C.frame(spark, rows, clashing)).collect()
    mine = sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got if r.doc_id is not None)
    want = sorted(b for b in brute(rows) if b[0] is not None)
    assert [m[:5] for m in mine] == [w[:5] for w in want]
    assert all(abs(m[5] - w[5]) < 1e-5 for m, w in zip(mine, want))
    assert len(got) == len(rows)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_score_is_the_interpolated_probability(spark, monkeypatch, order):
    rows = C.documents()
    kept = []
    real = lm_scoring.learn_weights
    monkeypatch.setattr(lm_scoring, "learn_weights", lambda *a: kept.append(real(*a)) or kept[-1])
    got = lm_scoring.score_documents(C.frame(spark, rows), order=order).collect()
    assert len(kept) == order and all((w >= 0).all() and (w < 1).all() for w in kept)
    grams, documents = Counter(), 0
    for i, t, *_ in rows:
        if C.fold(i, 5) != 1:
            ws = [1] * order + (t or "").encode().lower().split() + [0]
            documents += 1
            grams.update(tuple(ws[at - k + 1 : at + 1]) for at in range(order, len(ws)) for k in range(1, order + 1))
    n = sum(c for g, c in grams.items() if len(g) == 1)
    v = sum(len(g) == 1 for g in grams)
    text = {i: t for i, t, *_ in rows if i not in (None, 310)}
    for r in got:
        if r.doc_id in text:
            ws = [1] * order + (text[r.doc_id] or "").encode().lower().split() + [0]
            want = 0.0
            for at in range(order, len(ws)):
                p = 1 / (v + 1)
                for k in range(1, order + 1):
                    h = tuple(ws[at - k + 1 : at])
                    ctx = n if not h else documents if set(h) == {1} else grams[h]
                    w = kept[k - 1][min(1 + int(math.floor(math.log2(ctx))), lm_scoring.BUCKETS - 1) if ctx else 0]
                    p = w * grams[(*h, ws[at])] / max(ctx, 1) + (1 - w) * p
                want += math.log10(p)
            assert abs(want - r.score) < 1e-6 * max(1, abs(want))


def test_longer_contexts_make_held_out_text_likelier(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sums = [lm_scoring.score_documents(docs, order=k).filter("held_out").agg({"score": "sum"}).first()[0] for k in (1, 2, 3)]
    assert sums[0] < sums[1] < sums[2]


def test_weights_maximise_the_held_out_likelihood():
    """One bucket, two cells: EM ends at the best weight of a fine search."""
    rng = np.random.default_rng(1)
    f, p = rng.integers(60, lm_scoring.RATIO_LEVELS, 50), rng.integers(180, lm_scoring.LOWER_LEVELS, 50)
    cell = (5 * lm_scoring.RATIO_LEVELS + f) * lm_scoring.LOWER_LEVELS + p
    count = rng.integers(1, 10_000, 50).astype(float)
    w = lm_scoring.learn_weights(cell, count, rounds=2000)[5]
    fv, pv = lm_scoring._value(f, lm_scoring.RATIO_LEVELS), lm_scoring._value(p, lm_scoring.LOWER_LEVELS)
    grid = np.linspace(0.001, 0.999, 999)
    best = grid[np.argmax([(count * np.log(g * fv + (1 - g) * pv)).sum() for g in grid])]
    assert abs(w - best) < 0.003


def test_held_out_text_is_likelier_than_under_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm_scoring.score_documents(docs).filter("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_small_blocks_give_the_same(spark, monkeypatch):
    want = {(r.doc_id, r.n_tokens, round(r.score, 8)) for r in lm_scoring.score_documents(C.frame(spark)).collect()}
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 3000)
    got = {(r.doc_id, r.n_tokens, round(r.score, 8)) for r in lm_scoring.score_documents(C.frame(spark)).collect()}
    assert got == want


def test_empty_table(spark):
    assert lm_scoring.score_documents(C.frame(spark, [])).collect() == []
