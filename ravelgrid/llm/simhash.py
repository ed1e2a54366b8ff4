"""SimHash near-duplicates by deletion-variant signatures (operator 2).

Fingerprint: XXH64 (seed 42) of every word shingle, repeats included; a bit is
1 where more than half of the hashes have it.  Two fingerprints link at
``bits <= 2``.  The 64 bits are cut into two segments, so of two linked
fingerprints one segment differs by at most one bit: every segment is indexed
under its 32 one-wildcard variants, equal variants meet in one bucket, and the
bucket's members are verified.  Buckets send on a spanning forest of their
verified links, never all pairs.  Equal fingerprints are one node from the
start, so exact copies cost nothing here.

Buckets of more than ``dense`` different fingerprints are not compared member
by member: those members go to a second index of two-wildcard variants of all
64 bits, where an equal key is a link, and each key links its members to the
smallest.  That is linear in the members and exact; nothing is capped.

Edge cases: null and empty texts have fingerprint zero and link like any
other; fewer words than a shingle make one shingle; a null doc_id gets a row
but is never the smallest id (null component_id only if all ids are null).
Repeated rows each get their row.  An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelgrid.llm.common import id_and_text, materialize
from ravelgrid.llm.components import connected

SEED = 42
SHINGLE = 3
DENSE = 512
_BIT_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a UTF-8 text."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    hashes = np.array(
        [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())],
        np.uint64,
    )
    octets = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BIT_OF_BYTE for i in range(8)])
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int):
    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            prints = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
            yield pa.record_batch([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return run


def _variants(batches):
    """fp to (key, fp): 2 segments x 32 wildcards; the key holds segment, wildcard and the other 31 bits."""
    bits = np.arange(32, dtype=np.uint64)
    for batch in batches:
        fp = batch.column(0).to_numpy().view(np.uint64)
        keys = []
        for seg in (0, 1):
            part = (fp >> np.uint64(32 * seg)) & np.uint64(0xFFFFFFFF)
            low = part[:, None] & ((np.uint64(1) << bits) - np.uint64(1))
            high = (part[:, None] >> (bits + np.uint64(1))) << bits
            keys.append((np.uint64(seg) << np.uint64(40)) | (bits << np.uint64(34)) | low | high)
        key = np.concatenate(keys, axis=1)
        yield pa.record_batch(
            [pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(fp, 64).view(np.int64))], names=["key", "fp"]
        )


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _forest(a: np.ndarray, b: np.ndarray, group: np.ndarray):
    """A spanning forest of links within each group, by union-find over the few that verified."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keep = []
    for i, (g, x, y) in enumerate(zip(group.tolist(), a.tolist(), b.tolist())):
        rx, ry = root((g, x)), root((g, y))
        if rx != ry:
            parent[ry] = rx
            keep.append(i)
    return a[keep], b[keep]


def _buckets(bits: int, dense: int):
    """Rows sorted by key to verified links (a, b); members of dense buckets come out as (fp, null)."""

    def emit(a, b):
        return pa.record_batch(
            [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)) if b is not None else pa.nulls(len(a), pa.int64())],
            names=["a", "b"],
        )

    def settle(key, fp, opened_dense):
        """All of these keys' rows are here (but the first key's earlier ones when it was dense)."""
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(starts, len(key)))
        is_dense = sizes > dense
        if opened_dense:
            is_dense[0] = True
        group = np.repeat(np.arange(len(starts)), sizes)
        if is_dense.any():
            yield emit(fp[is_dense[group]], None)
        usable = ~is_dense[group] & (sizes[group] > 1)
        group, fp = group[usable], fp[usable]
        found_a, found_b, found_g = [], [], []
        gap = 1
        at = np.arange(len(fp))
        while True:
            at = at[at < len(fp) - gap]
            at = at[group[at] == group[at + gap]]
            if not len(at):
                break
            hit = at[_distance(fp[at], fp[at + gap]) <= bits]
            found_a.append(fp[hit]), found_b.append(fp[hit + gap]), found_g.append(group[hit])
            gap += 1
        if found_a:
            a, b = _forest(*(np.concatenate(x) for x in (found_a, found_b, found_g)))
            if len(a):
                yield emit(a, b)

    def run(batches):
        key = np.empty(0, np.int64)
        fp = np.empty(0, np.uint64)
        open_key_dense = False
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.concatenate([key, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
            last = np.searchsorted(key, key[-1])  # the last key may go on in the next batch
            if last:
                yield from settle(key[:last], fp[:last], open_key_dense)
                key, fp, open_key_dense = key[last:], fp[last:], False
            if len(key) > dense:
                yield emit(fp, None)
                key, fp, open_key_dense = key[-1:], fp[-1:], True
        if len(key):
            yield from settle(key, fp, open_key_dense)

    return run


def _two_wildcards(batches):
    """fp to (key, fp) for all pairs of positions: equal keys differ in those two bits at most."""
    pairs = np.array(list(combinations(range(64), 2)), np.uint64)
    masks = ~((np.uint64(1) << pairs[:, 0]) | (np.uint64(1) << pairs[:, 1]))
    names = (pairs[:, 0] * np.uint64(64) + pairs[:, 1]).astype(np.int32)
    for batch in batches:
        fp = batch.column(0).to_numpy().view(np.uint64)
        for lo in range(0, len(fp), 500):
            some = fp[lo : lo + 500]
            yield pa.record_batch(
                [
                    pa.array(np.tile(names, len(some))),
                    pa.array((some[:, None] & masks).reshape(-1).view(np.int64)),
                    pa.array(np.repeat(some, len(masks)).view(np.int64)),
                ],
                names=["pair", "rest", "fp"],
            )


def links(fps: DataFrame, bits: int = 2, dense: int = DENSE) -> DataFrame:
    """Links (a, b) that connect whatever lies within ``bits`` <= 2 of one another; ``fps``: distinct (fp)."""
    if not 0 <= bits <= 2:
        raise ValueError("two segments with one wildcard cover at most 2 differing bits")
    index = fps.mapInArrow(_variants, "key long, fp long")
    found = materialize(
        index.repartition("key").sortWithinPartitions("key").mapInArrow(_buckets(bits, dense), "a long, b long"), "links"
    )
    close = found.filter("b is not null")
    if bits < 2:
        return close if found.filter("b is null").isEmpty() else _dense_links(found, fps, bits, close)
    crowded = found.filter("b is null").select(F.col("a").alias("fp")).distinct()
    stars = crowded.mapInArrow(_two_wildcards, "pair int, rest long, fp long").groupBy("pair", "rest")
    low_high = stars.agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all")).filter("size(all) > 1")
    return close.union(low_high.select("a", F.explode("all").alias("b")).filter("a <> b").distinct())


def _dense_links(found, fps, bits, close):
    """bits < 2: the two-wildcard keys, verified; a key has at most four different members."""
    crowded = found.filter("b is null").select(F.col("a").alias("fp")).distinct()
    sets = crowded.mapInArrow(_two_wildcards, "pair int, rest long, fp long").groupBy("pair", "rest").agg(
        F.collect_set("fp").alias("all")
    )
    pairs = sets.filter("size(all) > 1").select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b"))
    return close.union(pairs.filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)).distinct())


def near_duplicates(docs: DataFrame, bits: int = 2, shingle: int = SHINGLE, dense: int = DENSE) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id (smallest reachable doc_id)."""
    prints = materialize(id_and_text(docs).mapInArrow(_fingerprints(shingle), "doc_id long, fp long"), "simhash")
    firsts = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    graph = connected(links(firsts.select("fp"), bits, dense))
    roots = firsts.join(graph.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("rep", "fp").alias("rep")
    )
    smallest = roots.groupBy("rep").agg(F.min("first_id").alias("component_id"))
    named = materialize(roots.join(smallest, "rep").select("fp", "component_id"), "simhash-components")
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
