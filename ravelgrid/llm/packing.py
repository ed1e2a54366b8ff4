"""Best-fit packing by a configuration linear program (operator 5).

Documents become token ids (plus one end id) and are cut only if longer than a
sequence.  Only the *length histogram* (at most ``capacity`` entries) reaches
the driver, where ``fillings.solve`` turns the configuration linear program
into fillings of a sequence with multiplicities.

Pieces of one length are numbered over the whole table (counts per length and
salt, prefix sums, numbers within the salt), so a hot length spreads over
tasks, and a number falls into one interval of one filling: sequence and offset
follow by arithmetic from a broadcast table of the fillings, whose size depends
on the number of lengths only.  A length's intervals lie in two levels of
``SLOTS`` each, so a lookup reads few of them.

With ``order`` (a column of unique numbers) pieces of one length are handed out
in that order, salts being ranges of it, and sequences are numbered by the
earliest number in them, so the sequences follow the order of the documents as
far as the fillings allow.

Edge cases: null and empty texts are the end id alone (length 1).  Repeated
rows and null ids are packed like any other row.  An empty table gives none.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import defaultdict
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelgrid.llm import fillings
from ravelgrid.llm.common import materialize

CAPACITY = 2048
END_ID = 0
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, salt int, position long"
ORDER_RANGES = 256
SLOTS = 64


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _plain(word: str) -> bool:
    """Letters only, also after the tokenizer's normalisation (which can split off combining marks)."""
    return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())


class CachedEncoder:
    """Ids of whole texts from ids of their words.

    The tokenizer drops white space, lowers case and never joins across white
    space, so the ids of a text are those of its lowered words one after the
    other.  A bounded cache keeps the words seen; plain new words are encoded
    many at a time and told apart by the ids that end a piece.
    """

    def __init__(self, path: str, cache: int = 800_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.cache = cache
        vocab = self.tok.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.marks = {m: vocab[m + "</w>"] for m in ".,;:!?" if m + "</w>" in vocab}
        self._clear()

    def _clear(self):
        self.number: dict[bytes, int] = defaultdict(count().__next__)
        self.known = 0
        self.flat = np.empty(1 << 16, np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)

    def _learn(self):
        """Encode the words numbered since the last time."""
        new = [w.decode() for w in islice(reversed(self.number), len(self.number) - self.known)][::-1]
        # a plain word is one piece for the tokenizer; a plain word and a mark are two, and the word
        # mostly is known or needed anyway, so only it is encoded and the mark's id is put behind
        marked = [(i, w) for i, w in enumerate(new) if w[-1] in self.marks and _plain(w[:-1])]
        core = np.fromiter((self.number[w[:-1].encode()] for _, w in marked), np.int64, len(marked))
        new += [w.decode() for w in islice(reversed(self.number), len(self.number) - self.known - len(new))][::-1]
        while len(self.number) > len(self.start):
            self.start, self.size = np.resize(self.start, 2 * len(self.start)), np.resize(self.size, 2 * len(self.size))
        plain = np.fromiter(map(_plain, new), bool, len(new))
        place = np.fromiter((i for i, _ in marked), np.int64, len(marked))
        for lo in range(0, plain.sum(), 20_000):
            at = np.flatnonzero(plain)[lo : lo + 20_000]
            texts = [" ".join([new[i] for i in at[k : k + 1000]]) for k in range(0, len(at), 1000)]
            encs = self.tok.encode_batch_fast(texts, add_special_tokens=False)
            ids = np.fromiter(chain.from_iterable(e.ids for e in encs), np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1  # the last id of each word
            if len(ends) == len(at):
                self._keep(at, ids, np.diff(ends, prepend=0))
            else:  # this tokenizer cuts some plain word into several pieces: these words one by one
                self._keep_each(at, new)
        if len(marked):
            size = self.size[core] + 1
            ends = np.cumsum(size)
            ids = np.empty(ends[-1], np.uint32)
            inner = np.ones(len(ids), bool)
            inner[ends - 1] = False
            ids[inner] = self._gather(core)
            ids[~inner] = [self.marks[w[-1]] for _, w in marked]
            self._keep(place, ids, size)
        rest = ~plain
        rest[place] = False
        rest = np.flatnonzero(rest)
        for lo in range(0, len(rest), 20_000):
            self._keep_each(rest[lo : lo + 20_000], new)
        self.known = len(self.number)

    def _gather(self, at: np.ndarray) -> np.ndarray:
        """The ids of words by number, one after the other."""
        size = self.size[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.start[at] - (ends - size), size) + np.arange(total)]

    def _keep_each(self, at: np.ndarray, new: list[str]):
        got = [e.ids for e in self.tok.encode_batch_fast([new[i] for i in at], add_special_tokens=False)]
        self._keep(at, np.fromiter(chain.from_iterable(got), np.uint32), np.fromiter(map(len, got), np.int64, len(got)))

    def _keep(self, at: np.ndarray, ids: np.ndarray, size: np.ndarray):
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        self.size[self.known + at] = size
        self.start[self.known + at] = self.used + np.cumsum(size) - size
        self.used += len(ids)

    def encode_all(self, texts: list[str], together: int = 500):
        """The ids of each text, in order; new words of ``together`` texts are learnt at once."""
        for lo in range(0, len(texts), together):
            if len(self.number) > self.cache:
                self._clear()
            numbered = []
            for text in texts[lo : lo + together]:
                raw = text.encode("utf-8", "replace")
                # ASCII white space only; special tokens' names are matched before case is lowered
                words = (raw if b"<|" in raw else raw.lower()).split()
                numbered.append(np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)))
            if len(self.number) > self.known:
                self._learn()
            for at in numbered:
                yield self._gather(at)

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_all([text]))


_encoders: dict[str, CachedEncoder] = {}


def encoder(path: str) -> CachedEncoder:
    """One encoder per Python worker, so its cache outlives a task."""
    if path not in _encoders:
        _encoders[path] = CachedEncoder(path)
    return _encoders[path]


def _pieces(path: str, capacity: int):
    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode_all = encoder(path).encode_all
        salt = TaskContext.get().partitionId()
        for batch in batches:
            out = []
            rows = zip(batch.column(0).to_pylist(), encode_all(batch.column(1).to_pylist()), batch.column(2).to_pylist())
            for doc_id, encoded, position in rows:
                ids = np.append(encoded, np.uint32(END_ID)).astype("<u4")
                for k, start in enumerate(range(0, len(ids), capacity)):
                    some = ids[start : start + capacity]
                    out.append((doc_id, k, start, len(some), zlib.crc32(some.tobytes()), salt, position))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "salt", "position"]
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, order: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; ``order``: see above."""
    path = tokenizer or default_tokenizer()
    position = F.lit(None).cast("long") if order is None else F.col(order).cast("long")
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        position.alias("position"),
    )
    pieces = materialize(texts.mapInArrow(_pieces(path, capacity), PIECE_SCHEMA), "pieces")
    if order is None:
        return place(pieces, capacity).drop("position")
    placed = materialize(place(_salted(pieces), capacity), "pieces-placed")
    return _by_earliest(placed)


def _range_of(position: str, last: int):
    """Which of ``ORDER_RANGES`` equal ranges of 0..last holds the number."""
    return F.floor(F.col(position) * ORDER_RANGES / (last + 1)).cast("int")


def _salted(pieces: DataFrame) -> DataFrame:
    last = pieces.agg(F.max("position")).first()[0] or 0
    return pieces.withColumn("salt", _range_of("position", last))


def _by_earliest(placed: DataFrame) -> DataFrame:
    """Sequences numbered anew by the earliest position in them; ranges of positions spare a global window."""
    last = placed.agg(F.max("position")).first()[0] or 0
    firsts = placed.groupBy("sequence_id").agg(F.min(F.struct("position", "piece")).alias("first"))
    firsts = firsts.withColumn("part", _range_of("first.position", last))
    sizes = firsts.groupBy("part").count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # ORDER_RANGES rows
    bases = sizes.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("first", "sequence_id")
    numbers = (
        firsts.withColumn("r", F.row_number().over(within) - 1)
        .join(F.broadcast(bases), "part")
        .select("sequence_id", (F.col("r") + F.col("base")).cast("long").alias("number"))
    )
    return placed.join(numbers, "sequence_id").select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.col("number").alias("sequence_id"), "offset"
    )


def _slots(spark, filled: list[tuple[dict[int, int], int]]) -> DataFrame:
    """(length, slots): which numbers of a length's pieces go to which sequences, in blocks of ``SLOTS`` intervals."""
    given: dict[int, int] = defaultdict(int)
    of: dict[int, list[dict]] = defaultdict(list)
    sequence = 0
    for filling, times in filled:
        at = 0
        for length in sorted(filling, reverse=True):
            k = filling[length]
            lo, hi = given[length], given[length] + k * times
            given[length] = hi
            of[length].append({"lo": lo, "hi": hi, "k": k, "sequence": sequence, "at": at})
            at += k * length
        sequence += times
    rows = []
    for length, own in of.items():
        blocks = [own[i : i + SLOTS] for i in range(0, len(own), SLOTS)]
        rows.append({"length": length, "slots": [{"lo": b[0]["lo"], "hi": b[-1]["hi"], "slots": b} for b in blocks]})
    number = pa.int64()
    one = pa.struct([(c, number) for c in ("lo", "hi", "k", "sequence", "at")])
    block = pa.struct([("lo", number), ("hi", number), ("slots", pa.list_(one))])
    return spark.createDataFrame(pa.Table.from_pylist(rows, pa.schema([("length", number), ("slots", pa.list_(block))])))


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Sequences and offsets for written pieces (PIECE_SCHEMA)."""
    spark = pieces.sparkSession
    per_salt = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_salt.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in per_salt.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = _slots(spark, fillings.solve(histogram, capacity).fillings)
    within = Window.partitionBy("length", "salt").orderBy("position", "doc_id", "piece", "start", "ids_crc32")
    numbered = (
        pieces.withColumn("r", F.row_number().over(within) - 1)
        .join(bases, ["length", "salt"])
        .withColumn("r", F.col("r") + F.col("base"))
        .join(F.broadcast(slots), "length")
    )
    def holding(intervals):
        return F.filter(intervals, lambda s: (s["lo"] <= F.col("r")) & (F.col("r") < s["hi"]))[0]

    step = F.col("r") - F.col("s.lo")
    return numbered.withColumn("s", holding(holding("slots")["slots"])).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("s.sequence") + F.floor(step / F.col("s.k"))).cast("long").alias("sequence_id"),
        (F.col("s.at") + (step % F.col("s.k")) * F.col("length")).cast("long").alias("offset"),
        "position",
    )
