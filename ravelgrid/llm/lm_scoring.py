"""Language-model scoring by deleted interpolation (operator 1).

Model.  With maximum-likelihood n-gram estimates of every order up to ``order``
(3) and the uniform ``P0 = 1/(V+1)``,
``Pk(w | h) = l c(h w)/c(h) + (1 - l) Pk-1(w | h')``, where ``l`` belongs to the
order and to the bucket of the context frequency ``c(h)`` (0, then powers of
two).  The training documents are divided: counts of the retained part give the
estimates, the deleted part gives held-out counts on which expectation-
maximisation learns the weights, order by order.  The final model uses the
weights with the counts of all training documents.

Plan.  Documents are packed into blocks (one row holds some megabytes of text
as word numbers).  Each block sends its *distinct* n-grams of each order, as
sorted hashes dealt over hash ranges; each range adds up the counts and
answers each block with what the other blocks have.  A very frequent n-gram so arrives once per block,
not once per token, and a range holds total/parts items whatever the skew.
Words have 64-bit hashes; those of longer n-grams are cut to ``HASH_SPARE``
bits more than the number of tokens has, so one n-gram in 2 ** HASH_SPARE at
most shares its count with a stranger, at any size.
Blocks are stored in buckets by number, so only the answers travel back to
them; the counted blocks are written to the shared folder.  EM sees, for each
order, a histogram over (bucket, c(hw)/c(h), Pk-1) on a fixed logarithmic grid
(four steps a factor of two: a cell's value is right to 9 %), whose size does
not depend on the corpus; at most ``CELLS`` rows reach the driver at a time.

Edge cases: a null or empty text is the single end token.  A null doc_id falls
into fold 0 and is carried through.  Repeated rows are counted and scored each.
An empty table gives an empty result; without training tokens every word gets
the uniform part's weight.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelgrid.llm.common import fold, id_and_text, materialize, materialize_bucketed, shuffle_partitions

BLOCK_BYTES = 16 << 20
BUCKETS = 24
STEPS = 4  # grid steps per factor of two
RATIO_LEVELS = 30 * STEPS + 2
LOWER_LEVELS = 60 * STEPS + 2
CELLS = BUCKETS * RATIO_LEVELS * LOWER_LEVELS
ORDER = 3
HASH_SPARE = 16
TOTALS = 4096  # groups that the ranges' totals are dealt to
RETAINED, DELETED, HELD_OUT = 0, 1, 2
END_HASH = np.uint64(0x9E3779B97F4A7C15)
START_HASH = np.uint64(0xD1B54A32D192ED03)

BLOCK_SCHEMA = "block long, doc_id array<long>, part array<byte>, n array<int>, ids binary, vocab binary"
ITEM_SCHEMA = "block long, range int, hashes binary, counts binary"
ANSWER_SCHEMA = "block long, range int, counts binary"
COUNTED_SCHEMA = (
    "block long, doc_id array<long>, part array<byte>, n array<int>, counts binary, deleted binary,"
    " v_all long, n_all long, n_ret long, v_ret long"
)
SCORE_SCHEMA = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long,"
    " base_score double, score double"
)


def _planes(a: np.ndarray) -> bytes:
    """Bytes by significance, which the column codec shrinks well."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()


def _unplanes(b: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, -1).T).reshape(-1).view(dtype)


def _encode_blocks(batches):
    """Documents to blocks: word numbers, and the hash of each distinct word."""
    import xxhash

    task, seq = TaskContext.get().partitionId(), 0
    for batch in batches:
        ids, parts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        texts = batch.column(1).cast(pa.binary())
        at = 0
        while at < len(ids):
            number: dict[bytes, int] = {}
            seqs, ns, size, start = [], [], 0, at
            while at < len(ids) and (size < BLOCK_BYTES or at == start):
                raw = texts[at].as_py().lower()
                words = raw.split()
                for w in set(words).difference(number):
                    number[w] = len(number) + 1  # 0 is the end token
                seqs.append(np.fromiter(map(number.__getitem__, words), np.uint32, len(words)))
                seqs.append(np.zeros(1, np.uint32))
                ns.append(len(words) + 1)
                size += len(raw)
                at += 1
            vocab = np.empty(len(number) + 1, np.uint64)
            vocab[0] = END_HASH
            vocab[1:] = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))
            yield pa.record_batch(
                [
                    pa.array([(task << 24) | seq], pa.int64()),
                    pa.array([ids[start:at]], pa.list_(pa.int64())),
                    pa.array([parts[start:at]], pa.list_(pa.int8())),
                    pa.array([ns], pa.list_(pa.int32())),
                    pa.array([_squeeze(_planes(np.concatenate(seqs)), 3)], pa.binary()),
                    pa.array([vocab.tobytes()], pa.binary()),
                ],
                names=["block", "doc_id", "part", "n", "ids", "vocab"],
            )
            seq += 1


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a pair of hashes (multiply, xor-shift)."""
    x = a * np.uint64(0xBF58476D1CE4E5B9) + (b ^ (b >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


def _distinct(ids: np.ndarray, n: np.ndarray, vocab: np.ndarray, order: int, bits: int):
    """For each order: the sorted distinct hashes, and which of them each token ends."""
    word = vocab[ids]
    first = np.cumsum(n) - n
    gram = word
    for k in range(1, order + 1):
        if k > 1:  # the (k-1)-gram before a token and the token; documents begin with start marks
            before = np.empty_like(gram)
            before[1:] = gram[:-1]
            before[first] = START_HASH
            gram = _mix(before, word)
        yield k, *np.unique(gram if k == 1 else gram >> np.uint64(64 - bits), return_inverse=True)


def _block_of(row):
    n = np.array(row["n"], np.int64)
    return _unplanes(_unsqueeze(row["ids"]), np.uint32).astype(np.int64), n, np.array(row["part"], np.int8), np.frombuffer(row["vocab"], np.uint64)


def _runs(hashes: np.ndarray, ranges: int, bits: int):
    """(range, from, to) of each hash range that the sorted hashes touch."""
    of = ((hashes >> np.uint64(bits - 32)) * np.uint64(ranges)) >> np.uint64(32)
    starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    return zip(of[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(hashes)])


def _rows(batch):
    """The rows of a batch one by one: a block at a time is in memory as Python objects."""
    for i in range(batch.num_rows):
        yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def _own_counts(inverse: np.ndarray, tok_part: np.ndarray, size: int) -> list[np.ndarray]:
    """A block's own counts of its n-grams in the retained and in the deleted part."""
    return [np.bincount(inverse[tok_part == p], minlength=size).astype(np.uint32) for p in (RETAINED, DELETED)]


def _items(order: int, bits: int, ranges: int):
    def run(batches):
        for batch in batches:
            for row in _rows(batch):
                ids, n, part, vocab = _block_of(row)
                tok_part = np.repeat(part, n)
                for k, hashes, inverse in _distinct(ids, n, vocab, order, bits):
                    kept, gone = _own_counts(inverse, tok_part, len(hashes))
                    out = []
                    for r, lo, hi in _runs(hashes, ranges, 64 if k == 1 else bits):
                        gaps = np.diff(hashes[lo:hi], prepend=np.uint64(0))
                        packed = np.concatenate([kept[lo:hi], gone[lo:hi]])
                        out.append((row["block"], (k - 1) * ranges + r, _squeeze(_planes(gaps)), _squeeze(_planes(packed))))
                    yield pa.record_batch(
                        [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))],
                        names=["block", "range", "hashes", "counts"],
                    )

    return run


def _squeeze(b: bytes, level: int = 1) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(b)


def _unsqueeze(b: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(b)


def _count_range(ranges: int):
    """Add up one hash range over all blocks; answer each block in its own order."""

    def run(table: pa.Table) -> pa.Table:
        blocks = table.column("block").to_pylist()
        rng = table.column("range")[0].as_py()
        hashes, kept, gone = [], [], []
        for h, c in zip(table.column("hashes"), table.column("counts")):
            hashes.append(np.cumsum(_unplanes(_unsqueeze(h.as_py()), np.uint64), dtype=np.uint64))
            k, g = _unplanes(_unsqueeze(c.as_py()), np.uint32).reshape(2, -1)
            kept.append(k), gone.append(g)
        distinct, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        size = len(distinct)
        ret = np.bincount(inverse, np.concatenate(kept), size).astype(np.uint64)
        rest = np.bincount(inverse, np.concatenate(gone), size).astype(np.uint64)
        out, at = [], 0
        for k, g in zip(kept, gone):
            mine = inverse[at : at + len(k)]
            out.append(_squeeze(_planes(np.concatenate([ret[mine] - k, rest[mine] - g]))))
            at += len(k)
        if rng < ranges:  # words: their numbers and tokens
            stats = np.array([np.sum(ret + rest > 0), (ret + rest).sum(), ret.sum(), np.sum(ret > 0)], np.int64)
            blocks.append(-1 - rng % TOTALS)
            out.append(stats.tobytes())
        return pa.table(
            {
                "block": pa.array(blocks, pa.int64()),
                "range": pa.array([rng] * len(blocks), pa.int32()),
                "counts": pa.array(out, pa.binary()),
            }
        )

    return run


def bucket_of(context: np.ndarray) -> np.ndarray:
    """Context-frequency bucket: 0 for unseen, else 1 + floor(log2), at most BUCKETS - 1."""
    safe = np.maximum(context, 1).astype(np.float64)
    return np.where(context > 0, np.minimum(1 + np.floor(np.log2(safe)), BUCKETS - 1), 0).astype(np.int64)


def _grid(values: np.ndarray, levels: int) -> np.ndarray:
    """0 for zero, else by STEPS * log2, rounded and kept on the grid, whose last level is 1."""
    safe = np.where(values > 0, values, 1.0)
    return np.where(values > 0, np.clip(levels - 1 + np.rint(STEPS * np.log2(safe)), 1, levels - 1), 0).astype(np.int64)


def _value(level: np.ndarray, levels: int) -> np.ndarray:
    return np.where(level > 0, np.exp2((level - levels + 1) / STEPS), 0.0)


def _attach(order: int, bits: int):
    """A block and its answers: each order's counts per token; of deleted documents also those of the retained part."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int8()), pa.list_(pa.int32()), pa.binary(), pa.binary(), *[pa.int64()] * 4]
        names = ["block", "doc_id", "part", "n", "counts", "deleted", "v_all", "n_all", "n_ret", "v_ret"]
        if left.num_rows == 0:
            stats = sum(np.frombuffer(b, np.int64) for b in right.column("counts").to_pylist())
            row = [-1, [], [], [], b"", b"", *map(int, stats)]
            return pa.table([pa.array([v], t) for v, t in zip(row, types)], names=names)
        row = next(_rows(left))
        ids, n, part, vocab = _block_of(row)
        by_range = np.argsort(right.column("range").to_numpy())
        answers = right.column("counts")
        tok_part = np.repeat(part, n)
        gone = tok_part == DELETED
        counts, deleted, used = [], [], 0
        for _, hashes, inverse in _distinct(ids, n, vocab, order, bits):
            some, size = [], 0
            while size < len(hashes):
                some.append(_unplanes(_unsqueeze(answers[int(by_range[used])].as_py()), np.uint64).reshape(2, -1))
                size += some[-1].shape[1]
                used += 1
            ret, rest = np.concatenate(some, axis=1) + np.stack(_own_counts(inverse, tok_part, size))
            counts.append(_squeeze(_planes((ret + rest)[inverse]), 3))
            deleted.append(_squeeze(_planes(ret[inverse[gone]]), 3))
        values = [row["block"], row["doc_id"], row["part"], row["n"], _join(counts), _join(deleted), 0, 0, 0, 0]
        return pa.table([pa.array([v], t) for v, t in zip(values, types)], names=names)

    return run


def _join(parts: list[bytes]) -> bytes:
    """Several byte strings as one, their lengths (8 bytes each) before them."""
    return np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts)


def _counts_of(packed: bytes, order: int) -> list[np.ndarray]:
    """Each order's counts per token."""
    sizes = np.frombuffer(packed, np.int64, order)
    ends = 8 * order + np.cumsum(sizes)
    return [_unplanes(_unsqueeze(packed[e - s : e]), np.uint64).astype(np.float64) for s, e in zip(sizes.tolist(), ends.tolist())]


def _estimates(counts: list[np.ndarray], n: np.ndarray, total: int):
    """For each order the bucket of the context's count, and the maximum-likelihood estimate."""
    starts = np.cumsum(n) - n
    documents = counts[0][starts + n - 1]  # the end token's count is the number of documents
    for k, c in enumerate(counts):
        if k == 0:
            context = np.full(len(c), float(total))
        else:
            context = np.empty_like(c)
            context[1:] = counts[k - 1][:-1]
            context[starts] = documents
        yield bucket_of(context), c / np.maximum(context, 1)


def _mixed(counts, n, weights: list[np.ndarray], vocabulary: int, total: int) -> np.ndarray:
    """Probability of each token by the orders that have weights."""
    p = np.full(len(counts[0]), 1.0 / (vocabulary + 1))
    for w, (bucket, f) in zip(weights, _estimates(counts, n, total)):
        p = w[bucket] * f + (1 - w[bucket]) * p
    return p


def _histogram(order: int, weights: list[np.ndarray], v_ret: int, n_ret: int):
    """Deleted tokens by cell (bucket, estimate, lower orders' probability) of the first order without weights."""

    def run(batches):
        for batch in batches:
            for row in _rows(batch):
                n = np.array(row["n"], np.int64)[np.array(row["part"], np.int8) == DELETED]
                if not len(n):
                    continue
                counts = _counts_of(row["deleted"], order)
                lower = _mixed(counts, n, weights, v_ret, n_ret)
                bucket, f = list(_estimates(counts[: len(weights) + 1], n, n_ret))[-1]
                cell = (bucket * RATIO_LEVELS + _grid(f, RATIO_LEVELS)) * LOWER_LEVELS + _grid(lower, LOWER_LEVELS)
                cells, tokens = np.unique(cell, return_counts=True)
                yield pa.record_batch([pa.array(cells), pa.array(tokens.astype(np.int64))], names=["cell", "n"])

    return run


def learn_weights(cell: np.ndarray, count: np.ndarray, rounds: int = 60) -> np.ndarray:
    """EM for one order: per context bucket the weight of its estimate against the lower orders' mixture."""
    bucket, rest = np.divmod(cell.astype(np.int64), RATIO_LEVELS * LOWER_LEVELS)
    ratio, low = np.divmod(rest, LOWER_LEVELS)
    f, p = _value(ratio, RATIO_LEVELS), _value(low, LOWER_LEVELS)
    tokens = np.bincount(bucket, count, BUCKETS)
    weights = np.full(BUCKETS, 0.5)
    weights[0] = 0.0  # a context never seen says nothing
    for _ in range(rounds):
        w = weights[bucket]
        mine = count * w * f / np.maximum(w * f + (1 - w) * p, 1e-300)
        # a token divided evenly keeps rarely seen buckets proper
        weights = (np.bincount(bucket, mine, BUCKETS) + 0.5) / (tokens + 1)
        weights[0] = 0.0
    return weights


def _score_blocks(order: int, weights: list[np.ndarray], v_all: int, n_all: int):
    def run(batches):
        for batch in batches:
            for row in _rows(batch):
                n = np.array(row["n"], np.int64)
                counts = _counts_of(row["counts"], order)
                starts = np.cumsum(n) - n
                p = _mixed(counts, n, weights, v_all, n_all)
                base = np.log10((counts[0] + 0.5) / (n_all + 0.5 * (v_all + 1)))
                part = np.array(row["part"], np.int8)
                yield pa.record_batch(
                    [
                        pa.array(row["doc_id"], pa.int64()),
                        pa.array(part == HELD_OUT),
                        pa.array(n),
                        pa.array(np.add.reduceat((counts[0] > 0).astype(np.int64), starts)),
                        pa.array(np.full(len(n), n_all, np.int64)),
                        pa.array(np.add.reduceat(base, starts)),
                        pa.array(np.add.reduceat(np.log10(p), starts)),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def score_documents(docs: DataFrame, part=None, order: int = ORDER) -> DataFrame:
    """Score every document; ``part`` says 0 retained, 1 deleted, 2 held out (tinyint).

    Default part: fold 1 of 5 is held out, fold 4 deleted, the others retained.
    """
    if order < 1:
        raise ValueError("order must be at least 1")
    spark = docs.sparkSession
    if part is None:
        five = fold("doc_id", 5)
        part = F.when(five == 1, HELD_OUT).when(five == 4, DELETED).otherwise(RETAINED)
    rows = id_and_text(docs).withColumn("part", part.cast("byte"))
    blocks, name = materialize_bucketed(
        rows.mapInArrow(_encode_blocks, BLOCK_SCHEMA), "lm-blocks", "block", shuffle_partitions(spark)
    )
    tokens = blocks.agg(F.sum(F.expr("aggregate(n, 0L, (a, x) -> a + x)"))).first()[0] or 0
    ranges = max(4 * shuffle_partitions(spark), -(-tokens // 2_000_000))
    bits = min(64, max(40, tokens.bit_length() + HASH_SPARE))
    answers = (
        blocks.mapInArrow(_items(order, bits, ranges), ITEM_SCHEMA).groupBy("range").applyInArrow(_count_range(ranges), ANSWER_SCHEMA)
    )
    counted = materialize(
        blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_attach(order, bits), COUNTED_SCHEMA), "lm-counted"
    )
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    sums = counted.filter("block < 0").agg(*(F.sum(c) for c in ("v_all", "n_all", "n_ret", "v_ret"))).first()
    v_all, n_all, n_ret, v_ret = (x or 0 for x in sums)
    texts = counted.filter("block >= 0")
    weights: list[np.ndarray] = []
    for _ in range(order):
        cells = (
            texts.select("part", "n", "deleted")
            .mapInArrow(_histogram(order, weights, v_ret, n_ret), "cell long, n long")
            .groupBy("cell")
            .agg(F.sum("n").alias("n"))
            .orderBy("cell")
            .toPandas()
        )
        weights.append(learn_weights(cells["cell"].to_numpy(np.int64), cells["n"].to_numpy(np.float64)))
    return texts.select("doc_id", "part", "n", "counts").mapInArrow(_score_blocks(order, weights, v_all, n_all), SCORE_SCHEMA)
