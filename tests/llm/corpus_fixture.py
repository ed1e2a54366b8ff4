"""Small tables with the awkward rows: nulls, empties, ties, repeats, long texts, clashing columns."""

from __future__ import annotations

import random
import zlib

WORDS = "the of and to in a is that it for on was be with as at by an from this".split()
FR = "le la les de des du et en un une que qui dans pour est pas sur avec élève être".split()


def prose(rng, n, words=WORDS):
    made = [rng.choice(words) + rng.choice(["", "", "er", "ing", "ness"]) for _ in range(n)]
    return " ".join(made) + "."


def documents():
    """(doc_id, text, lang, source, n_chars)"""
    rng = random.Random(5)
    rows = []
    for i in range(120):
        text = prose(rng, rng.randint(1, 120), FR if i % 3 == 0 else WORDS)
        rows.append((i, text, "fr" if i % 3 == 0 else "en", "hot" if i % 2 else f"s{i % 5}"))
    base = prose(rng, 300)
    rows += [(200 + i, base, "en", "hot") for i in range(10)]
    for i in range(20):
        w = base.split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((220 + i, " ".join(w), "en", "hot"))
    rows += [
        (300, None, "en", "s1"), (301, "", None, None), (302, "   \t\n", "en", None), (303, "One", "en", "s1"),
        (304, "Two words", "en", "s1"), (305, prose(rng, 20000), "en", "s2"), (306, "x" * 50000, "en", "s2"),
        (307, "ÄÖ ß 漢字 emoji 😀 é   nbsp", "de", "s3"), (308, "12345 !!! ###", "en", "s3"),
        (None, "a row without an id", "en", "s3"), (None, None, None, None),
        (310, "repeated row", "en", "s4"), (310, "repeated row", "en", "s4"), (310, "same id, other text", "en", "s4"),
    ]
    return [(i, t, l, s, len(t or "")) for i, t, l, s in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: names that operators use for their own columns
CLASHING = "score double, fingerprint string, n long, fp long, block long, part string, key string, r int, y int"


def frame(spark, rows=None, clashing=False):
    rows = documents() if rows is None else rows
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if clashing:
        from pyspark.sql import functions as F

        for c in CLASHING.split(", "):
            name, kind = c.split()
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def fold(doc_id, modulus):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus
