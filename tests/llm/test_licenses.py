import re

import corpus_fixture as C

from ravelgrid.llm import licenses


def grams(t):
    w = re.sub(r"[\W_]+", " ", t.lower()).split()
    return set(zip(w, w[1:]))


def words(t):
    return re.sub(r"[\W_]+", " ", t.lower()).split()


def brute(rows, threshold=licenses.THRESHOLD):
    out = []
    for i, t, *_ in rows:
        units = list(enumerate((t or "").split("\n"), 1)) + ([(0, t)] if "\n" in (t or "") else [])
        for name, text in licenses.TEMPLATES.items():
            b = grams(text)
            for line, u in units:
                a = grams(u)
                if a and 2 * len(a & b) >= threshold * (len(a) + len(b)):
                    out.append((i, line, 0, name, len(a & b), 2 * len(a & b) / (len(a) + len(b))))
            w, m = words(t or ""), len(words(text))
            pairs = list(zip(w, w[1:]))
            if len(set(pairs) & b) < len(b) / 2:
                continue
            best = (0, 0, 0)
            for s in range(max(1, len(w) - m + 1)):
                a = set(pairs[s : s + m - 1])
                best = max(best, (2 * len(a & b) / (len(a) + len(b)), -s - 1, len(a & b)))
            if best[0] >= threshold:
                out.append((i, -1, -best[1], name, best[2], best[0]))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    many = list(licenses.TEMPLATES.values())
    more = [
        (500, "Text.\n" + many[1] + "\nreleased under   the MIT license!", "en", "s", 1), (501, "\n".join(many), "en", "s", 1),
        (502, "Licensed under the Apache License, Version 2.1 and more", "en", "s", 1),
        (503, "Released under\nthe MIT License.", "en", "s", 1), (504, "released " * 4000, "en", "s", 1),
        (505, "the mit license the mit license released under the mit license", "en", "s", 1),
    ]
    mit = licenses.TEMPLATES["MIT:text"]
    more += [
        (506, "Some code.\nUse of this source code is governed by a BSD-style\nlicense that can be found in the LICENSE file.\nMore.", "en", "s", 1),
        (507, "Note that this work is licensed under CC BY 4.0. It goes on for a while.", "en", "s", 1),
        (508, "Copyright (c) 2020 Somebody\n\n" + mit.replace("any person", "every person") + "\n\nint main() { return 0; }", "en", "s", 1),
        (509, "the mit license " * 3, "en", "s", 1),
    ]
    rows = C.documents() + more
    got = sorted([tuple(r) for r in licenses.scan(C.frame(spark, rows, clashing=True)).collect()], key=str)
    assert got == brute(rows) and any(g[1] == 0 for g in got)
    assert {(506, "BSD-3-Clause"), (507, "CC-BY-4.0"), (508, "MIT:text")} <= {(g[0], g[3]) for g in got if g[1] == -1}


def test_bounds_are_safe():
    for b in range(1, 40):
        lo, hi = licenses.bounds(b, 0.8)
        for a in range(1, 80):
            if 2 * min(a, b) >= 0.8 * (a + b):
                assert lo <= a <= hi


def test_plan_is_native_and_without_shuffle(spark):
    plan = licenses.scan(C.frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Join" not in plan
    assert licenses.scan(C.frame(spark, [])).collect() == []


def test_no_templates(spark):
    df = C.frame(spark)
    assert licenses.scan(df, {}).collect() == [] == licenses.scan(df, {"one": "word"}).collect()
