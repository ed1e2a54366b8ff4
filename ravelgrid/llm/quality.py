"""Quality classifier by attention-based multiple-instance learning (operator 9).

A document is a bag of passages (``PASSAGE_WORDS`` words each, the whole text).
Every passage is encoded as a vector of surface statistics and of signed hashed
word counts, passed through a learnt tanh layer; gated attention, ``softmax(w . (tanh(V h) * sigmoid(U h)))``,
weighs the passages, and a logistic layer scores the weighted representation.
All weights are learnt from document labels only, by Adam on full batches; a
tenth of the bags is kept out and says when to stop.

Training takes at most ``max_fit`` labelled documents (documented bound: the
smallest by a hash of the id, per label), encoded on the executors.  Fitting and
scoring use every passage of every text.  The driver gets the bags sorted and
adds gradients in that order, so the model does not depend on partitioning.

Defined results: a text without words (null, empty) is one passage of zeros.
No labels at all: every score is 0.5.  A null doc_id falls into fold 0
(held out).  Of rows that share an id the one with the least text is learnt
from; an id with both labels counts for both.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelgrid.llm.common import fold

PASSAGE_WORDS = 100
MAX_FIT = 6000
THRESHOLD = 0.3
HIDDEN, GATE = 16, 8
_CLASSES = 8


def _byte_class() -> np.ndarray:
    """0 lower case, 1 upper case, 2 digit, 3 space, 4 line end, 5 full stop or comma, 6 other ASCII, 7 beyond ASCII."""
    c = np.full(256, 6, np.uint8)
    c[97:123], c[65:91], c[48:58], c[9:14], c[32], c[10] = 0, 1, 2, 3, 3, 4
    c[[44, 46]] = 5
    c[128:] = 7
    return c


_CLASS = _byte_class()
WORD_PLACES = 8
N_FEATURES = _CLASSES + 8 + WORD_PLACES


def passages(text: bytes) -> np.ndarray:
    """One row of statistics per passage."""
    words = text.split()
    if not words:
        return np.zeros((1, N_FEATURES), np.float32)
    n = -(-len(words) // PASSAGE_WORDS)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    of_word = np.arange(len(words)) // PASSAGE_WORDS
    # class shares, over the words' bytes joined by single spaces
    joined = np.frombuffer(b" ".join(words), np.uint8)
    of_byte = np.repeat(of_word, lengths + 1)[: len(joined)]
    cls = np.bincount(of_byte * _CLASSES + _CLASS[joined], minlength=n * _CLASSES).reshape(n, _CLASSES).astype(np.float64)
    size = cls.sum(axis=1)
    count = np.bincount(of_word, minlength=n).astype(np.float64)
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    # distinct words in the passage, and words equal to the one before
    pairs = np.unique(of_word * np.int64(len(numbers)) + ids)
    distinct = np.bincount(pairs // len(numbers), minlength=n)
    same = np.append(False, ids[1:] == ids[:-1])
    repeats = np.bincount(of_word[same], minlength=n)
    first_seen = np.zeros(len(words), bool)
    first_seen[np.unique(ids, return_index=True)[1]] = True
    fresh = np.bincount(of_word[first_seen], minlength=n)
    last = np.frombuffer(b"".join(w[-1:] for w in words), np.uint8)
    odd_end = np.bincount(of_word[(_CLASS[last] == 6)], minlength=n)
    mean_len = np.bincount(of_word, lengths, minlength=n) / count
    long_words = np.bincount(of_word[lengths > 20], minlength=n)
    # words as signed counts in hashed places, case of A-Z dropped
    code = np.fromiter((zlib.crc32(w.lower()) for w in numbers), np.int64, len(numbers))[ids]
    sign = 1.0 - 2.0 * ((code >> 16) & 1)
    content = np.bincount(of_word * WORD_PLACES + code % WORD_PLACES, sign, n * WORD_PLACES).reshape(n, WORD_PLACES)
    out = np.column_stack([
        cls / np.maximum(size, 1)[:, None], distinct / count, repeats / count, fresh / count, odd_end / count,
        np.log1p(mean_len), long_words / count, np.log1p(count), np.full(n, np.log1p(len(words))),
        content / np.sqrt(count)[:, None],
    ])
    return out.astype(np.float32)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Attention:
    """Gated-attention pooling over bags given as (rows, bag number per row, sorted)."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(N_FEATURES, np.float32), np.ones(N_FEATURES, np.float32)
        first = {
            "E": rng.normal(0, 0.3, (N_FEATURES, HIDDEN)), "e": np.zeros(HIDDEN),
            "V": rng.normal(0, 0.3, (HIDDEN, GATE)), "U": rng.normal(0, 0.3, (HIDDEN, GATE)), "w": rng.normal(0, 0.3, GATE),
            "o": rng.normal(0, 0.3, HIDDEN), "b": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in first.items()}

    def forward(self, x, starts, sizes):
        p = self.p
        z = (x - self.mean) / self.scale
        h = np.tanh(z @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        s = (t * g) @ p["w"]
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), sizes))
        a = s / np.repeat(np.add.reduceat(s, starts), sizes)
        pooled = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return z, h, t, g, a, pooled, _sigmoid(pooled @ p["o"] + p["b"])

    def scores(self, x, sizes):
        sizes = np.asarray(sizes)
        return self.forward(x, np.cumsum(sizes) - sizes, sizes)[-1]

    def fit(self, x, sizes, y, rounds: int = 300, rate: float = 0.02):
        """Learn from bags; every tenth bag only says which round was best (where there are a hundred bags)."""
        sizes, y = np.asarray(sizes), np.asarray(y, np.float32)
        kept_out = (np.arange(len(sizes)) % 10 == 9) & (len(sizes) >= 100)
        of = np.repeat(kept_out, sizes)
        x = x.astype(np.float32)
        test, x = (x[of], sizes[kept_out], y[kept_out]), x[~of]
        sizes, y = sizes[~kept_out], y[~kept_out]
        starts = np.cumsum(sizes) - sizes
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + np.float32(1e-3)
        weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum())).astype(np.float32)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        best, best_p, since = np.inf, self.p, 0
        for step in range(1, rounds + 1):
            if step % 10 == 0 and kept_out.any():
                out = np.clip(self.scores(*test[:2]), 1e-6, 1 - 1e-6)
                loss = -float(np.mean(np.where(test[2] > 0, np.log(out), np.log(1 - out))))
                if loss < best - 1e-4:
                    best, best_p, since = loss, dict(self.p), 0
                elif (since := since + 1) == 5:
                    break
            p = self.p
            z, h, t, g, a, pooled, out = self.forward(x, starts, sizes)
            d = (out - y) * weight
            dp = np.repeat(d[:, None] * p["o"], sizes, axis=0)
            da = (dp * h).sum(axis=1)
            ds = a * (da - np.repeat(np.add.reduceat(a * da, starts), sizes))
            dt, dg = ds[:, None] * p["w"] * g * (1 - t**2), ds[:, None] * p["w"] * t * g * (1 - g)
            dh = a[:, None] * dp + dt @ p["V"].T + dg @ p["U"].T
            dz = dh * (1 - h**2)
            grad = {
                "E": z.T @ dz, "e": dz.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ ds,
                "o": pooled.T @ d, "b": np.array([d.sum()]),
            }
            for k in p:
                gk = grad[k] + 1e-5 * p[k]
                m[k] = 0.9 * m[k] + 0.1 * gk
                s[k] = 0.999 * s[k] + 0.001 * gk**2
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
        if kept_out.any():
            self.p = dict(best_p)
        return self


def _encode(batches):
    for batch in batches:
        made, sizes = [], []
        for t in batch.column(1).cast(pa.binary()):
            x = passages(t.as_py())
            made.append(x.tobytes()), sizes.append(len(x))
        yield pa.record_batch([batch.column(0), pa.array(made, pa.binary()), pa.array(sizes, pa.int32())], names=["y", "x", "n"])


def fit_documents(docs: DataFrame, labels: DataFrame, label_col: str = "quality", train=None, max_fit: int = MAX_FIT):
    """Fit on at most ``max_fit`` labelled documents; ``train`` is a condition on doc_id (default: fold is not 0 of 5).

    Labels that fail the condition are not looked at, not even counted.  The
    sample has as many of either label as there are, up to half each; the
    shares of the labels enter as the intercept, so scores are probabilities.
    """
    train = fold("doc_id", 5) != 0 if train is None else train
    marks = labels.filter(train & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("lab_id"), F.col(label_col).cast("int").alias("y")
    ).filter("y in (0, 1)")
    marks = marks.withColumn("k", F.pmod(F.xxhash64("lab_id"), F.lit(1 << 30)))
    total = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    if not total:
        return None
    each = max_fit // 2
    keep = F.lit(False)
    for y, n in total.items():
        keep = keep | ((F.col("y") == y) & (F.col("k") < int(min(1.0, each / n) * (1 << 30))))
    # about max_fit labels, a bounded number of small rows: broadcast
    chosen = F.broadcast(marks.filter(keep).orderBy("k", "lab_id", "y").limit(max_fit).select("lab_id", "y"))
    rows = docs.select(F.col("doc_id").cast("long").alias("lab_id"), F.coalesce("text", F.lit("")).alias("text"))
    # rows that share an id count once, so no more than max_fit bags are collected
    joined = rows.join(chosen, "lab_id").groupBy("lab_id", "y").agg(F.min("text").alias("text")).select("y", "text")
    got = joined.mapInArrow(_encode, "y int, x binary, n int").collect()
    got.sort(key=lambda r: (r["y"], r["x"]))
    if not got:
        return None
    x = np.concatenate([np.frombuffer(r["x"], np.float32).reshape(-1, N_FEATURES) for r in got])
    model = Attention().fit(x, [r["n"] for r in got], [r["y"] for r in got])
    model.p["b"] = model.p["b"] + np.log((total.get(1, 0) + 0.5) / (total.get(0, 0) + 0.5))
    return model


def _scores_of(model, texts) -> np.ndarray:
    """Scores of a list of UTF-8 texts, by groups of bounded size."""
    out, group, sizes, rows = [], [], [], 0

    def flush():
        if group:
            out.append(model.scores(np.concatenate(group), sizes).astype(np.float64) if model else np.full(len(sizes), 0.5))

    for t in texts:
        x = passages(t)
        group.append(x), sizes.append(len(x))
        rows += len(x)
        if rows > 4000:
            flush()
            group, sizes, rows = [], [], 0
    flush()
    return np.concatenate(out) if out else np.empty(0)


def score_documents(docs: DataFrame, model, held_out=None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    held_out = fold("doc_id", 5) == 0 if held_out is None else held_out
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), held_out.alias("held_out")
    )

    def run(batches):
        for batch in batches:
            s = _scores_of(model, (t.as_py() for t in batch.column(1).cast(pa.binary())))
            yield pa.record_batch(
                [batch.column(0), batch.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the model accepts; all columns stay."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = batch.column(at).fill_null("").cast(pa.binary())
            yield batch.filter(pa.array(_scores_of(model, (t.as_py() for t in texts)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
