"""Document fingerprints by one-permutation MinHash (operator 3).

Shingles of five words (lower-case A-Z, cut at ASCII white space) are hashed
once; the hash picks the bin, the least remaining value stays in it.  Empty
bins are filled by optimal densification: bin ``i`` draws bins from a sequence
fixed by ``i`` alone until one is filled, so equal sets borrow alike.  Of each
bin the low ``B_BITS`` bits are kept, packed and written in base64.  With
``C = 2**-B_BITS`` agreement by chance, the likeness of two fingerprints is
``(agreeing share - C) / (1 - C)``, kept within 0 and 1.

Defined results: fewer than five words are one shingle; a text without words
(null, empty) has fingerprint ``-``; two such are alike (1), one such and any
other are not (0).  Equal texts have equal fingerprints.

``edited_pairs`` also needs each document's successor by descending doc_id.
Rows are dealt to ranges of (doc_id, hash of the text) by Spark's range
partitioning, so equal and null ids spread too, and run through in order, one
row held at a time.  Each range puts its first and last row beside its results;
the last rows then meet the first rows of the next ranges in a small join.
Ties in doc_id go by the text's hash, then text; null ids come last.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelgrid.llm.common import id_and_text, materialize, shuffle_partitions

BINS = 512
B_BITS = 4
SHINGLE = 5
RANGE_BYTES = 8 << 20
EMPTY = "-"
_DRAWS = 64

PAIR_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double"
)


def _draw_table(bins: int) -> np.ndarray:
    """For each bin the bins it tries when empty: a rule, not data."""
    i = np.arange(bins, dtype=np.uint64)[:, None]
    t = np.arange(1, _DRAWS + 1, dtype=np.uint64)[None, :]
    x = i * np.uint64(0x9E3779B97F4A7C15) + t * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return (x % np.uint64(bins)).astype(np.int64)


class MinHasher:
    """Fingerprints of texts; keeps a bounded cache of word hashes between texts."""

    def __init__(self, bins: int = BINS, shingle: int = SHINGLE, cache: int = 500_000):
        self.bins, self.shingle, self.cache = bins, shingle, cache
        self.draws = _draw_table(bins)
        self.word_hash: dict[bytes, int] = {}

    def hashes(self, text: bytes) -> np.ndarray:
        from xxhash import xxh64_intdigest

        words = text.lower().split()
        if not words:
            return np.empty(0, np.uint64)
        known = self.word_hash
        if len(known) > self.cache:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self.shingle, len(words))
        out = np.zeros(len(words) - k + 1, np.uint64)
        for j in range(k):
            out = (out ^ h[j : j + len(out)]) * np.uint64(0x9FB21C651E98DF25)
            out ^= out >> np.uint64(35)
        return out

    def sketch(self, text: bytes) -> np.ndarray | None:
        h = self.hashes(text)
        if not len(h):
            return None
        none = np.uint64(0xFFFFFFFFFFFFFFFF)
        least = np.full(self.bins, none)
        bin_of = (h % np.uint64(self.bins)).astype(np.int64)
        value = h // np.uint64(self.bins)
        np.minimum.at(least, bin_of, value)
        empty = np.flatnonzero(least == none)
        if len(empty):
            filled = least != none
            tries = self.draws[empty]
            hit = filled[tries]
            first = hit.argmax(axis=1)
            source = tries[np.arange(len(empty)), first]
            for at in np.flatnonzero(~hit.any(axis=1)):  # very few bins filled: go on from the drawn place
                source[at] = next(b for b in np.roll(np.arange(self.bins), -int(tries[at, 0])) if filled[b])
            least[empty] = least[source]
        x = least * np.uint64(0xD6E8FEB86659FD93)
        return ((x >> np.uint64(40)) & np.uint64((1 << B_BITS) - 1)).astype(np.uint8)


def pack(sketch: np.ndarray | None) -> str:
    if sketch is None:
        return EMPTY
    return base64.b64encode((sketch[0::2] << 4 | sketch[1::2]).astype(np.uint8).tobytes()).decode()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    if a is None or b is None:
        return float(a is None and b is None)
    chance = 2.0**-B_BITS
    return float(min(1.0, max(0.0, (np.mean(a == b) - chance) / (1 - chance))))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every document."""

    def run(batches):
        hasher = MinHasher()
        for batch in batches:
            made = [pack(hasher.sketch(t.as_py())) for t in batch.column(1).cast(pa.binary())]
            yield pa.record_batch([batch.column(0), pa.array(made, pa.string())], names=["doc_id", "fingerprint"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, fingerprint string")


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_EDGE = "range int, edge string, text string"


def _row(hasher, doc_id, text, mine, following, next_sketch):
    edited = _edited(text, following).encode("utf-8", "replace")
    changed = hasher.sketch(edited)
    return (doc_id, len(text), hashlib.sha256(edited).hexdigest(), pack(mine), pack(changed), likeness(mine, changed), likeness(mine, next_sketch))


def _batch(rows) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string()]
    names = [f.split()[0] for f in f"{PAIR_SCHEMA}, {_EDGE}".split(", ")]
    width = len(names)
    columns = zip(*((*r, *(None,) * (width - len(r))) for r in rows))
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _along(batches):
    """Sorted rows to a result for each but the last; first and last row themselves as edges."""
    hasher, of = MinHasher(), TaskContext.get().partitionId()
    held = None
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sketch = hasher.sketch(text.encode("utf-8", "replace"))
            if held is None:
                rows.append((doc_id, *(None,) * 6, of, "first", text))
            else:
                rows.append(_row(hasher, *held, text, sketch))
            held = (doc_id, text, sketch)
        if rows:
            yield _batch(rows)
    if held is not None:
        yield _batch([(held[0], *(None,) * 6, of, "last", held[1])])


def _across(batches):
    """Last rows with the first row of the range after theirs (doc_id, text, next_text)."""
    hasher = MinHasher()
    for batch in batches:
        rows = []
        for doc_id, text, following in zip(*(c.to_pylist() for c in batch.columns)):
            mine, other = (hasher.sketch(t.encode("utf-8", "replace")) for t in (text, following))
            rows.append(_row(hasher, doc_id, text, mine, following, other))
        if rows:
            made = _batch(rows)
            yield pa.RecordBatch.from_arrays(made.columns[:7], names=made.schema.names[:7])


def edited_pairs(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likenesses (see PAIR_SCHEMA)."""
    spark = docs.sparkSession
    rows = id_and_text(docs).withColumn("h", F.xxhash64("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(4 * shuffle_partitions(spark), -(-size // range_bytes))
    order = [F.col("doc_id").desc_nulls_last(), F.col("h")]
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    made = materialize(dealt.mapInArrow(_along, f"{PAIR_SCHEMA}, {_EDGE}"), "minhash")
    edges = made.filter("edge is not null")
    first = edges.filter("edge = 'first'").select(F.col("range").alias("after"), F.col("text").alias("next_text"))
    last = edges.filter("edge = 'last'").select("range", "doc_id", "text")
    # one small row per range, without texts: which range comes next (the last one: the first)
    along = Window.orderBy("range")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = last.select("range", F.coalesce(F.lead("range").over(along), F.min("range").over(whole)).alias("after"))
    pairs = last.join(following, "range").join(first, "after").select("doc_id", "text", "next_text").mapInArrow(_across, PAIR_SCHEMA)
    columns = [f.split()[0] for f in PAIR_SCHEMA.split(", ")]
    return made.filter("edge is null").select(*columns).union(pairs)
