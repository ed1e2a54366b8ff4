"""Language identification by hierarchical discrimination (operator 4).

A linear classifier first picks the language family; inside the family,
one-versus-one linear support vector machines separate the languages and vote.
Features are counts of character bigrams and trigrams (letters only, everything
else one separator), hashed to ``DIM`` places and scaled to unit length.

``FAMILIES`` says which family a language code belongs to; a code not listed is
a family of its own, so any set of labels works.

Every label of the training documents is learnt.  Training takes at most
``max_fit`` labelled documents, or two of each label if those are more
(documented bound: the smallest by a hash of id and text, spread over the
labels); features are made on the executors, and only these reach the driver,
sorted, so the model does not depend on how the table is partitioned.  Labels
are configuration and may be at most ``max_labels`` (an error says so beyond).

Defined results: null text, or text without a letter: ``und`` with score 0.
No labelled document at all: every document is ``und``.  A null doc_id falls
into fold 0.  The whole of a very long text is used.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelgrid.llm.common import fold

DIM = 2048
MAX_FIT = 2400
MAX_LABELS = 2000
#: Families of the common codes of ISO 639-1.
FAMILIES = {
    "germanic": "en de nl sv da no is af",
    "romance": "fr es pt it ro ca gl",
    "slavic": "ru uk pl cs sk bg sr hr sl",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "semitic": "ar he am",
    "indic": "hi bn ur mr pa gu",
    "sinitic": "zh",
    "japonic": "ja",
    "koreanic": "ko",
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family_of(code: str) -> str:
    return _FAMILY_OF.get(code.split("-")[0].lower(), code)


def _letters() -> np.ndarray:
    """Byte to byte: a-z and bytes above 127 as they are, A-Z lowered, all else a separator."""
    b = np.arange(256)
    lower = np.where((b >= 65) & (b <= 90), b + 32, b)
    return np.where(((lower >= 97) & (lower <= 122)) | (lower > 127), lower, 32).astype(np.uint32)


_LETTERS = _letters()


def features(text: bytes) -> np.ndarray:
    """Unit-length hashed counts of byte bigrams and trigrams over the whole text."""
    x = _LETTERS[np.frombuffer(text, np.uint8)]
    x = np.concatenate([[np.uint32(32)], x, [np.uint32(32)]]).astype(np.uint32)
    out = np.zeros(DIM, np.float64)
    for at in range(0, len(x), 1 << 20):  # by pieces, for memory
        y = x[at : at + (1 << 20) + 2]
        if len(y) > 1:
            two = (y[:-1] * np.uint32(251) + y[1:]) * np.uint32(2654435761)
            out += np.bincount(two >> np.uint32(21), minlength=DIM)
        if len(y) > 2:
            three = ((y[:-2] * np.uint32(251) + y[1:-1]) * np.uint32(257) + y[2:]) * np.uint32(2246822519)
            out += np.bincount(three >> np.uint32(21), minlength=DIM)
    out = np.sqrt(out)
    norm = np.linalg.norm(out)
    return (out / norm if norm else out).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, rounds: int = 300, c: float = 30.0) -> np.ndarray:
    """Linear SVMs (squared hinge, L2) by Nesterov gradient steps, one per row of ``y`` (+1/-1); last weights are the biases."""
    x1 = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    # classes weigh alike
    weight = np.where(y > 0, 0.5 / np.maximum(1, (y > 0).sum(axis=1, keepdims=True)), 0.5 / np.maximum(1, (y < 0).sum(axis=1, keepdims=True)))
    step = 1.0 / (1.0 + 2 * c * 2.0)
    w = v = np.zeros((len(y), x1.shape[1]))
    for k in range(rounds):
        slack = np.maximum(0.0, 1 - y * (v @ x1.T))
        grad = v - 2 * c * ((weight * y * slack) @ x1)
        new = v - step * grad
        v = new + (k / (k + 3)) * (new - w)
        w = new
    return w


@dataclass
class Model:
    families: list[str] = field(default_factory=list)
    members: dict[str, list[str]] = field(default_factory=dict)
    family_w: np.ndarray | None = None
    pair_w: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        def squash(margin):
            return 1 / (1 + np.exp(-np.clip(4 * margin, -60, 60)))

        x1 = np.hstack([x, np.ones((len(x), 1), x.dtype)])
        if len(self.families) > 1:
            sure = squash(x1 @ self.family_w.T)
            pick, fam_p = sure.argmax(axis=1), sure.max(axis=1)
        else:
            pick, fam_p = np.zeros(len(x), int), np.ones(len(x))
        lang, score = np.empty(len(x), object), np.zeros(len(x))
        for f, name in enumerate(self.families):
            rows = np.flatnonzero(pick == f)
            langs = self.members[name]
            votes = np.zeros((len(rows), len(langs)))
            for i in range(len(langs)):
                for j in range(i + 1, len(langs)):
                    p = squash(x1[rows] @ self.pair_w[langs[i], langs[j]])
                    votes[:, i] += (p >= 0.5) + 1e-3 * p
                    votes[:, j] += (p < 0.5) + 1e-3 * (1 - p)
            best = votes.argmax(axis=1)
            lang[rows] = np.array(langs, object)[best]
            own = np.ones(len(rows))
            if len(langs) > 1:
                for i in range(len(langs)):
                    for j in range(i + 1, len(langs)):
                        p = squash(x1[rows] @ self.pair_w[langs[i], langs[j]])
                        own = np.where(best == i, np.minimum(own, p), np.where(best == j, np.minimum(own, 1 - p), own))
            score[rows] = fam_p[rows] * own
        return list(zip(lang.tolist(), score.tolist()))


def fit(x: np.ndarray, langs: list[str]) -> Model:
    codes = np.array(langs, object)
    names = sorted(set(langs))
    model = Model(families=sorted({family_of(c) for c in names}))
    model.members = {f: [c for c in names if family_of(c) == f] for f in model.families}
    if len(model.families) > 1:
        of = np.array([family_of(c) for c in langs], object)
        model.family_w = svm(x, np.stack([np.where(of == f, 1.0, -1.0) for f in model.families]))
    for members in model.members.values():
        for i, a in enumerate(members):
            for b in members[i + 1 :]:
                rows = np.flatnonzero((codes == a) | (codes == b))
                model.pair_w[a, b] = svm(x[rows], np.where(codes[rows] == a, 1.0, -1.0)[None, :])[0]
    return model


def _featurize(batches):
    for batch in batches:
        made = [features(t.as_py()).tobytes() for t in batch.column(1).cast(pa.binary())]
        yield pa.record_batch([batch.column(0), pa.array(made, pa.binary())], names=["lang", "x"])


def fit_documents(docs: DataFrame, train=None, max_fit: int = MAX_FIT, max_labels: int = MAX_LABELS) -> Model | None:
    """Fit on at most ``max_fit`` documents with a language where ``train`` holds (default: fold is not 2 of 4)."""
    train = fold("doc_id", 4) != 2 if train is None else train
    key = F.xxhash64(F.col("doc_id"), F.col("text"))
    pool = docs.filter(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", key.alias("k"))
    # each task and label offers at most its share before anything is shuffled
    counts = pool.groupBy("lang").count().limit(max_labels + 1).collect()
    if not counts:
        return None
    if len(counts) > max_labels:
        raise ValueError(f"more than {max_labels} languages")
    each = max(2, max_fit // len(counts))
    total = {r["lang"]: r["count"] for r in counts}
    # a hash threshold leaves about twice the wanted number of each label, then the smallest of those
    cut = {lang: int(min(1.0, 2.0 * each / n + 20.0 / n) * (1 << 20)) + 1 for lang, n in total.items()}
    limits = F.broadcast(docs.sparkSession.createDataFrame(sorted(cut.items()), "lang string, cut long"))  # max_labels rows
    few = pool.join(limits, "lang").filter(F.pmod("k", F.lit(1 << 20)) < F.col("cut"))
    order = Window.partitionBy("lang").orderBy("k", "text")
    chosen = few.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= each)
    got = chosen.select("lang", "text").mapInArrow(_featurize, "lang string, x binary").collect()
    got.sort(key=lambda r: (r["lang"], r["x"]))
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in got])
    return fit(x, [r["lang"] for r in got])


def _has_letter():
    import regex

    return regex.compile(r"\p{L}")


def _predict(model: Model | None):
    def run(batches):
        letter = _has_letter()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out = [("und", 0.0)] * len(texts)
            real = [i for i, t in enumerate(texts) if t and letter.search(t)] if model else []
            for lo in range(0, len(real), 256):
                some = real[lo : lo + 256]
                x = np.stack([features(texts[i].encode("utf-8", "replace")) for i in some])
                for i, found in zip(some, model.predict(x)):
                    out[i] = found
            yield pa.record_batch(
                [batch.column(0), batch.column(2), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return run


def identify(docs: DataFrame, model: Model | None, held_out=None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    held_out = fold("doc_id", 4) == 2 if held_out is None else held_out
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out.alias("held_out"))
    return rows.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")
