"""Mixing sources to target weights by Pfair scheduling (operator 10, native).

Documents of a source are numbered and cut into blocks of ``block_docs``.
Slots follow one another, one block each.  With weight ``w`` a source's
``i``-th block (from 0) is released at slot ``floor(i/w)`` and due at slot
``ceil((i+1)/w)``; earliest deadline first among released blocks meets all
deadlines, so after any number of slots a source is less than one block off its
weight.  Weights are taken to ``1/PERIOD = 2^-48``, far below a block at any
number of slots.  When a source runs out, a new phase starts in which the
others share in the same proportion, so every row gets a slot.

The state of the schedule is one number per source (its next block).  The
driver runs through the slots once and keeps that state for every
``segment``-th slot only; from there each segment is scheduled again on the
executors, in SQL, and the slots go to the rows by joins.  So the driver's
memory and what is sent hold one small row per ``segment`` slots, and its time
is some microseconds per block of ``block_docs`` documents.  Numbering is
within (source, salt) with prefix sums over salts, so a hot source spreads over
tasks; each salt receives the slots of its blocks as one array.  Sources are
configuration and may be at most ``max_sources`` (an error says so otherwise).

Defined results: a null source is a source of its own.  Sources without a
given weight share the mean of those given; sources of weight 0 come after all
others, in equal shares; a negative weight is an error.  Within a source rows
follow a hash of the whole row, so null and repeated ids spread as well; rows
alike in all columns are interchangeable.  Input columns named like the three
that are added are replaced.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelgrid.llm.common import shuffle_partitions

BLOCK_DOCS = 16
PERIOD = 1 << 48
SEGMENT = 2048
CHUNK = 1024
MAX_SOURCES = 2000
_NONE = "\0none"


def integer_shares(weights: Mapping[str, float], period: int) -> dict[str, int]:
    """Weights as whole parts of ``period`` (largest remainder, one at least)."""
    period = max(period, len(weights))
    total = sum(weights.values())
    exact = {s: period * w / total for s, w in weights.items()}
    parts = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (parts[s] - exact[s], s))
    k = 0
    while (gap := period - sum(parts.values())) != 0:
        if gap > 0:
            parts[order[k % len(order)]] += 1
        else:
            big = max(parts, key=lambda s: (parts[s] - exact[s] if parts[s] > 1 else -1e18, s))
            parts[big] -= 1
        k += 1
    return parts


def _phase(parts: Mapping[str, int], blocks: Mapping[str, int], segment: int) -> Iterator[tuple[int, dict[str, int]]]:
    """(slots so far, next block of each source) at every ``segment``-th slot and at the end: a source's last block."""
    q = sum(parts.values())
    waiting = [(0, s, 0) for s in parts]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    done = dict.fromkeys(parts, 0)
    t = 0
    yield t, dict(done)
    while True:
        while waiting and waiting[0][0] <= t:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * q // parts[s]), s, i))
        due, s, i = heapq.heappop(ready)
        if due <= t:
            raise AssertionError("weights that sum to one always meet their deadlines")
        done[s] = i + 1
        t += 1
        if i + 1 == blocks[s]:
            yield t, dict(done)
            return
        heapq.heappush(waiting, ((i + 1) * q // parts[s], s, i + 1))
        if t % segment == 0:
            yield t, dict(done)


def segments(blocks: Mapping[str, int], weights: Mapping[str, float], period: int = PERIOD, segment: int = SEGMENT) -> Iterator[dict]:
    """The schedule's state where each segment begins: first slot, number of slots, and one entry per source.

    An entry says the next block (``block``), its release (``rel``) and deadline
    (``due``), the release of the one after (``next``, ``rest`` over ``part``)
    and by how much releases advance (``step``, ``more`` over ``part``).  Slots
    count from the segment's first.
    """
    left = {s: n for s, n in blocks.items() if n > 0}
    before = dict.fromkeys(left, 0)
    slot0 = 0
    while left:
        share = {s: weights[s] for s in left if weights[s] > 0} or dict.fromkeys(left, 1.0)
        parts = integer_shares(share, period) if len(share) > 1 else {next(iter(share)): 1}
        q = sum(parts.values())
        state = None
        for t, done in _phase(parts, left, segment):
            if state is not None and t > state[0]:
                at, first = state
                sources = []
                for k, s in enumerate(sorted(first)):  # ties go by name, as in the heap
                    p, i = parts[s], first[s]
                    after, rest = divmod((i + 1) * q, p)
                    sources.append({
                        "due": after + (rest > 0) - at, "k": k, "source": s, "block": before[s] + i, "rel": i * q // p - at,
                        "next": after - at, "rest": rest, "part": p, "step": q // p, "more": q % p,
                    })
                yield {"slot": slot0 + at, "slots": t - at, "sources": sources}
            state = (t, done)
        slot0 += state[0]
        for s, n in state[1].items():
            before[s] += n
            left[s] -= n
            if not left[s]:
                del left[s]


_ENTRY = pa.struct([
    ("due", pa.int64()), ("k", pa.int32()), ("source", pa.string()), ("block", pa.int64()), ("rel", pa.int64()),
    ("next", pa.int64()), ("rest", pa.int64()), ("part", pa.int64()), ("step", pa.int64()), ("more", pa.int64()),
])


def slots_of(table: DataFrame) -> DataFrame:
    """Segments to (source, block, slot): earliest deadline first from each segment's state, slot by slot."""

    def advance(x):
        rest = x["rest"] + x["more"]
        over = (rest >= x["part"]).cast("long")
        rest, after = rest - over * x["part"], x["next"] + x["step"] + over
        return F.struct(
            (after + (rest > 0).cast("long")).alias("due"), x["k"].alias("k"), x["source"].alias("source"),
            (x["block"] + 1).alias("block"), x["next"].alias("rel"), after.alias("next"), rest.alias("rest"),
            x["part"].alias("part"), x["step"].alias("step"), x["more"].alias("more"),
        )

    def one(acc, t):
        pick = F.array_min(F.filter(acc["sources"], lambda x: x["rel"] <= t))  # due first, then k
        return F.struct(
            F.transform(acc["sources"], lambda x: F.when(x["k"] == pick["k"], advance(x)).otherwise(x)).alias("sources"),
            F.concat(acc["taken"], F.array(F.struct(pick["source"].alias("source"), pick["block"].alias("block")))).alias("taken"),
        )

    none = F.array().cast("array<struct<source: string, block: bigint>>")
    taken = F.aggregate(
        F.sequence(F.lit(0).cast("long"), F.col("slots") - 1), F.struct("sources", none.alias("taken")), one, lambda acc: acc["taken"]
    )
    rows = table.select("slot", F.posexplode(taken).alias("t", "x"))
    return rows.select(F.col("x.source").alias("source"), F.col("x.block").alias("block"), (F.col("slot") + F.col("t")).alias("slot"))


def default_weights(counts: Mapping[str, int]) -> dict[str, float]:
    """Square roots of the sizes: large sources lead, small ones are heard."""
    return {s: n**0.5 for s, n in counts.items()}


def interleave(
    docs: DataFrame, weights: Mapping[str | None, float] | None = None, block_docs: int = BLOCK_DOCS,
    period: int = PERIOD, max_sources: int = MAX_SOURCES, segment: int = SEGMENT,
) -> DataFrame:
    """``docs`` with ``__block``, ``__slot`` and ``__position`` (unique, by slot, gaps after short last blocks)."""
    spark = docs.sparkSession
    added = ("__block", "__slot", "__position")
    parts = shuffle_partitions(spark)
    salts = max(64, 8 * parts)
    # the rows' own columns stay inside a struct, so they clash with nothing
    rows = docs.select(
        F.coalesce(F.col("source").cast("string"), F.lit(_NONE)).alias("source"), F.xxhash64(*docs.columns).alias("h"),
        F.struct(*[docs[c] for c in docs.columns if c not in added]).alias("row"),
    ).withColumn("salt", F.pmod("h", F.lit(salts)))
    per_salt = rows.groupBy("source", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_salt.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    sizes = per_salt.groupBy("source").agg(F.sum("n").alias("n")).limit(max_sources + 1).collect()
    if len(sizes) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    counts = {r["source"]: r["n"] for r in sizes}
    if weights is None:
        target = default_weights(counts)
    else:
        given = {(_NONE if s is None else s): w for s, w in weights.items()}
        if min(given.values(), default=0) < 0:
            raise ValueError("a weight is negative")
        mean = sum(given.values()) / max(1, len(given)) or 1.0
        target = {s: given.get(s, mean) for s in counts}
    made = list(segments({s: -(-n // block_docs) for s, n in counts.items()}, target, period, segment))
    schema = pa.schema([("slot", pa.int64()), ("slots", pa.int64()), ("sources", pa.list_(_ENTRY))])
    table = spark.createDataFrame(pa.Table.from_pylist(made, schema)).repartition(max(1, min(parts, len(made))))
    # slots of a source's blocks as arrays of CHUNK, then for each salt the chunks its rows reach
    chunks = slots_of(table).groupBy("source", F.floor(F.col("block") / CHUNK).alias("chunk")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("block", "slot"))), lambda x: x["slot"]).alias("slots")
    )

    def chunk_of(rank):
        return F.floor(rank / (block_docs * CHUNK))

    reach = bases.select(
        "source", "salt", "base", F.explode(F.sequence(chunk_of(F.col("base")), chunk_of(F.col("base") + F.col("n") - 1))).alias("chunk")
    )
    own = reach.join(chunks, ["source", "chunk"]).groupBy("source", "salt").agg(
        F.first("base").alias("base"), F.min("chunk").alias("chunk0"),
        F.transform(F.sort_array(F.collect_list(F.struct("chunk", "slots"))), lambda x: x["slots"]).alias("slots"),
    )
    within = Window.partitionBy("source", "salt").orderBy("h")
    placed = (
        rows.withColumn("r", F.row_number().over(within))
        .join(own, ["source", "salt"])
        .withColumn("rank", F.col("r") - 1 + F.col("base"))
        .withColumn("block", F.floor(F.col("rank") / block_docs))
        .withColumn("chunk", F.element_at("slots", (F.floor(F.col("block") / CHUNK) - F.col("chunk0") + 1).cast("int")))
        .withColumn("slot", F.element_at("chunk", (F.col("block") % CHUNK + 1).cast("int")))
    )
    return placed.select(
        "row.*", F.col("block").alias("__block"), F.col("slot").alias("__slot"),
        (F.col("slot") * block_docs + F.col("rank") % block_docs).alias("__position"),
    )


def mixed_order(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in mixed order (sorted by position), columns unchanged."""
    # a column of an input that is named like an added one is carried under another name
    kept = docs.select(F.struct("*").alias("whole"), "source")
    return interleave(kept, **options).orderBy("__position").select("whole.*")
