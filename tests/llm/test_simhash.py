import random

import corpus_fixture as C
import pytest
import xxhash

from ravelgrid.llm import simhash


def brute_print(text):
    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    k = min(3, len(ws))
    hs = [xxhash.xxh64_intdigest(b" ".join(ws[i : i + k]), 42) for i in range(len(ws) - k + 1)]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def components(nodes):
    """nodes: list of (id, fp); smallest id reachable."""
    parent = list(range(len(nodes)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(nodes)):
        for j in range(i):
            if bin(nodes[i][1] ^ nodes[j][1]).count("1") <= 2:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(nodes):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [least.get(root(i)) for i in range(len(nodes))]


def key(r):
    return (r[0] is None, r[0] or 0, r[1], r[2] or -1)


@pytest.mark.parametrize("clashing", [False, True])
def test_equals_brute_force(spark, clashing):
    rows = C.documents()
    nodes = [(i, brute_print(t)) for i, t, *_ in rows]
    want = sorted([(i, f"{f:016x}", c) for (i, f), c in zip(nodes, components(nodes))], key=key)
    got = sorted([tuple(r) for r in simhash.near_duplicates(C.frame(spark, rows, clashing)).collect()], key=key)
    assert got == want


@pytest.mark.parametrize("dense", [512, 3])
def test_links_connect_what_brute_force_connects(spark, dense):
    rng = random.Random(3)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(40):
            f = centre
            for b in rng.sample(range(64), rng.randint(0, 3)):
                f ^= 1 << b
            fps.add(f)
    chain = rng.getrandbits(64)
    for b in range(0, 40, 2):
        chain ^= 3 << b
        fps.add(chain)
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    from ravelgrid.llm.components import connected

    graph = connected(simhash.links(spark.createDataFrame(signed, "fp long"), dense=dense)).collect()
    rep = {r.node: r.rep for r in graph}
    want = components([(i, f) for i, f in enumerate(fps)])
    got = [rep.get(s[0], s[0]) for s in signed]
    assert len(set(got)) == len(set(want)) == len(set(zip(got, want)))


def test_empty_table(spark):
    assert simhash.near_duplicates(C.frame(spark, [])).collect() == []


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_buckets_do_not_depend_on_batches(size):
    """Links within buckets, and which members go to the second index, whatever the batches are."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(8)
    rows = []
    for key in range(40):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 3, 5, 6, 9, 14])):
            f = centre
            for b in rng.sample(range(64), rng.randint(0, 2)):
                f ^= 1 << b
            rows.append((key, f))
    keys = np.array([k for k, _ in rows], np.int64)
    fps = np.array([f for _, f in rows], np.uint64).view(np.int64)
    batches = [pa.record_batch([pa.array(keys[i : i + size]), pa.array(fps[i : i + size])], names=["key", "fp"]) for i in range(0, len(rows), size)]
    out = [r for b in simhash._buckets(2, 5)(iter(batches)) for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    members = {}
    for k, f in zip(keys.tolist(), fps.tolist()):
        members.setdefault(k, []).append(f)
    dense = {f for m in members.values() if len(m) > 5 for f in m}
    assert {a for a, b in out if b is None} == dense
    links = [(a, b) for a, b in out if b is not None]
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 2 for a, b in links)
    for m in members.values():
        if len(m) <= 5:
            want = components([(i, f & (2**64 - 1)) for i, f in enumerate(m)])
            parent = {f: f for f in m}

            def root(x):
                while parent[x] != x:
                    x = parent[x]
                return x

            for a, b in links:
                if a in parent and b in parent:
                    parent[root(a)] = root(b)
            got = [root(f) for f in m]
            assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(len(m)) for j in range(i))
