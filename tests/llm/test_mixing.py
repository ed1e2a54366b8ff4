from collections import Counter

import corpus_fixture as C
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ravelgrid.llm import mixing


def earliest_deadline_first(blocks, weights, period=mixing.PERIOD):
    """Slot by slot over all sources: the plainest form of the schedule; [(source, block)], first slots of phases."""
    left, before, out, starts = dict(blocks), dict.fromkeys(blocks, 0), [], []
    while left:
        starts.append(len(out))
        share = {s: weights[s] for s in left if weights[s] > 0} or dict.fromkeys(left, 1.0)
        parts = mixing.integer_shares(share, period) if len(share) > 1 else {next(iter(share)): 1}
        q, done, t = sum(parts.values()), dict.fromkeys(parts, 0), 0
        while all(done[s] < left[s] for s in parts):
            able = [(-(-(done[s] + 1) * q // parts[s]), s) for s in parts if done[s] * q // parts[s] <= t]
            _, s = min(able)
            out.append((s, before[s] + done[s]))
            done[s] += 1
            t += 1
        for s, n in done.items():
            before[s] += n
            left[s] -= n
        left = {s: n for s, n in left.items() if n}
    return out, starts


def spark_slots(spark, blocks, weights, segment):
    made = list(mixing.segments(blocks, weights, segment=segment))
    schema = pa.schema([("slot", pa.int64()), ("slots", pa.int64()), ("sources", pa.list_(mixing._ENTRY))])
    got = mixing.slots_of(spark.createDataFrame(pa.Table.from_pylist(made, schema))).collect()
    assert all(m["slots"] <= segment for m in made)
    return {r.slot: (r.source, r.block) for r in got}


CASES = [
    ({"a": 700, "b": 300, "c": 500}, {"a": 1, "b": 1, "c": 1}), ({"a": 900, "b": 30, "c": 5}, {"a": 2**0.5, "b": 3**0.5, "c": 0.0004}),
    ({"a": 50, "b": 60, "c": 7, "d": 1}, {"a": 0.0, "b": 0.2, "c": 0.0, "d": 5.0}), ({"a": 40}, {"a": 0.3}),
    ({f"s{i:02d}": 3 + i for i in range(40)}, {f"s{i:02d}": 1.0 + i * i for i in range(40)}),
]


@pytest.mark.parametrize("blocks, weights", CASES)
@pytest.mark.parametrize("segment", [7, 512])
def test_slots_equal_a_plain_schedule(spark, blocks, weights, segment):
    want, _ = earliest_deadline_first(blocks, weights)
    got = spark_slots(spark, blocks, weights, segment)
    assert [got[t] for t in range(len(got))] == want


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text("abcdef", min_size=1, max_size=2), st.tuples(st.integers(1, 60), st.floats(0.0004, 5)), min_size=1, max_size=6))
def test_each_phase_stays_within_one_block(case):
    blocks, weights = {s: b for s, (b, _) in case.items()}, {s: w for s, (_, w) in case.items()}
    slots, starts = earliest_deadline_first(blocks, weights)
    assert Counter(s for s, _ in slots) == blocks
    for lo, hi in zip(starts, [*starts[1:], len(slots)]):
        live = {s for s, _ in slots[lo:]}
        total = sum(weights[s] for s in live)
        seen = Counter()
        for t in range(lo, hi):
            seen[slots[t][0]] += 1
            assert all(abs(seen[s] - weights[s] / total * (t - lo + 1)) < 1 + 1e-9 for s in live)
    # the state kept at segments is that of the schedule
    for m in mixing.segments(blocks, weights, segment=5):
        for x in m["sources"]:
            assert x["block"] == sum(s == x["source"] for s, _ in slots[: m["slot"]])


@pytest.mark.parametrize("weights", [None, {"hot": 0.2, "s1": 0.5, None: 0.3}])
def test_every_row_gets_one_place(spark, weights):
    df = C.frame(spark, clashing=True)
    got = mixing.interleave(df, weights, block_docs=4).collect()
    assert len(got) == df.count() and len({r.__position for r in [] } | {r["__position"] for r in got}) == len(got)
    blocks = {}
    for r in got:
        assert r["__position"] // 4 == r["__slot"]
        blocks.setdefault(r["__slot"], set()).add((r["source"], r["__block"]))
    assert all(len(b) == 1 for b in blocks.values()) and sorted(blocks) == list(range(len(blocks)))
    ordered = mixing.mixed_order(df, weights=weights, block_docs=4)
    assert ordered.columns == df.columns
    assert [r.source for r in ordered.collect()] == [r.source for r in sorted(got, key=lambda r: r["__position"])]


def test_defined_cases(spark):
    assert mixing.interleave(C.frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        mixing.interleave(C.frame(spark), max_sources=2)
    plan = mixing.interleave(C.frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan


def test_long_schedules_stay_within_one_block_of_the_weights_as_given(spark):
    weights = {"a": 2**0.5, "b": 3**0.5, "c": 0.0004, "d": 0.37}
    got = spark_slots(spark, dict.fromkeys(weights, 20_000), weights, mixing.SEGMENT)
    total, seen = sum(weights.values()), Counter()
    for t in range(40_000):
        seen[got[t][0]] += 1
        assert all(abs(seen[s] - w / total * (t + 1)) < 1 + 1e-6 for s, w in weights.items())


def test_rows_without_or_with_equal_ids_spread(spark):
    rows = [(None if i % 2 else 7, f"text {i}", "en", "hot", i) for i in range(4000)]
    got = mixing.interleave(C.frame(spark, rows), block_docs=1)
    assert got.select("__position").distinct().count() == 4000
    same = mixing.interleave(C.frame(spark, [(1, "same", "en", "hot", 4)] * 50)).collect()
    assert sorted(r["__position"] for r in same) == list(range(50))


def test_clashing_columns(spark):
    df = C.frame(spark)
    names = ["source_", "salt", "h", "row", "n", "base", "chunk", "slots", "r", "rank", "block", "slot", "whole", "__block", "__slot", "__position"]
    for c in names:
        df = df.withColumn(c, F.lit(c))
    got = mixing.mixed_order(df)
    assert got.columns == df.columns and got.count() == df.count()
    assert all(r[c] == c for r in got.limit(5).collect() for c in names)
    made = mixing.interleave(df)
    assert made.columns == [*[c for c in df.columns if not c.startswith("__")], "__block", "__slot", "__position"]


def test_weight_zero_comes_last(spark):
    got = mixing.interleave(C.frame(spark), {"hot": 0.0, "s1": 1.0}, block_docs=4).collect()
    hot = [r["__slot"] for r in got if r.source == "hot"]
    assert min(hot) > max(r["__slot"] for r in got if r.source != "hot")
    with pytest.raises(ValueError):
        mixing.interleave(C.frame(spark), {"hot": -1.0})
