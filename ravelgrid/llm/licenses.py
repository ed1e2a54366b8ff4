"""Licence scan by Dice coefficient over word bigrams (operator 7, native).

Units are every line of a text, a text of several lines as a whole, and, for
each template, every run of as many words as the template has, wherever it
begins: so a notice is found that is wrapped over lines or stands inside a
longer one.  A unit is normalised (lower case, everything but letters and digits
one space) and compared with the normalised templates:
``2 |A & B| / (|A| + |B|)`` over the sets of word bigrams.

Bounds prune before anything is compared.  A template of ``b`` bigrams can only
reach ``t`` for units of ``t/(2-t) b`` to ``(2-t)/t b`` distinct bigrams, so
lines and texts outside every template's bounds are dropped before bigrams are
made (a unit of ``w`` words has at most ``w - 1``), and a unit meets only the
templates whose bounds hold it.  A run needs ``t/(2-t) b`` of the template's
bigrams somewhere in the text, so only texts that have them are cut into runs;
of the runs for one template the best is reported (the first, if several are).

Templates are a literal of the plan (their number is the caller's, not the
data's): no join, no shuffle, no Python on the executors.

Defined results: null and empty texts, and units of fewer than two words, match
nothing; so does everything if there are no templates.  Repeated rows report
each.  Line numbers count from 1; 0 is the whole text, -1 a run, whose first
word's number in the text is ``word`` (0 otherwise); a text shorter than a
template is one run.  A null doc_id is reported as null.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Notices by which works name their licence, and licences' own texts (named after a colon).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ISC": "Released under the ISC License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "MIT:text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included
in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC:text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS"
AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING
FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause:text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE
COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED
TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE
USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Apache-2.0:text": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES
OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations
under the License.""",
    "GPL-3.0:text": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This
program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
}


def template_words(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def template_bigrams(text: str) -> list[str]:
    words = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def bounds(size: int, threshold: float) -> tuple[int, int]:
    """Fewest and most distinct bigrams with which ``threshold`` is in reach."""
    lo, hi = threshold / (2 - threshold) * size, (2 - threshold) / threshold * size
    return max(1, int(-(-(lo - 1e-9) // 1))), int(hi + 1e-9)


def _known(templates: dict[str, str]) -> list[tuple[str, list[str], int]]:
    """(name, bigrams, words) of the templates that have bigrams."""
    return [(n, g, len(template_words(t))) for n, t in sorted(templates.items()) if (g := template_bigrams(t))]


def _literal(known, threshold: float) -> Column:
    parts = []
    for name, grams, words in known:
        lo, hi = bounds(len(grams), threshold)
        parts.append(F.struct(
            F.lit(name).alias("name"), F.array(*map(F.lit, grams)).alias("grams"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(words).alias("words"),
        ))
    return F.array(*parts)


SCHEMA = "doc_id long, line long, word long, license string, n_shared long, dice double"


def _normal(text):
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _bigrams(words):
    return F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))


def _runs(docs: DataFrame, known, literal: Column, threshold: float) -> DataFrame:
    """The best run of each template's number of words in each text."""
    every = sorted({g for _, grams, _ in known for g in grams})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.split(_normal(F.coalesce(F.col("text"), F.lit(""))), " ").alias("w"))
    rows = rows.filter(F.size("w") > 1).select("doc_id", F.explode(F.array(_bigrams(F.col("w")))).alias("g"))
    have = F.array_intersect("g", F.array(*map(F.lit, every)))
    # nearly all texts have none of these bigrams and stop here
    rows = rows.select("doc_id", "g", F.explode(F.array(have)).alias("have")).filter(F.size("have") > 0)
    able = F.filter(literal, lambda t: F.size(F.array_intersect(F.col("have"), t["grams"])) >= t["lo"])
    rows = rows.select("doc_id", "g", F.explode(able).alias("t"))
    span = F.least(F.col("t.words") - 1, F.size("g"))

    def one(start):
        run = F.slice("g", start, span)
        shared = F.size(F.array_intersect(run, F.col("t.grams")))
        dice = 2.0 * shared / (F.size(F.array_distinct(run)) + F.size("t.grams"))
        return F.struct(dice.alias("dice"), (-start).alias("back"), shared.alias("shared"))

    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("g") - span + 1), one))
    found = rows.select("doc_id", "t.name", F.explode(F.array(best)).alias("b")).filter(F.col("b.dice") >= threshold)
    return found.select(
        "doc_id", F.lit(-1).cast("long").alias("line"), (-F.col("b.back")).cast("long").alias("word"), F.col("name").alias("license"),
        F.col("b.shared").cast("long").alias("n_shared"), F.col("b.dice").alias("dice"),
    )


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per unit and template at ``threshold`` or more: doc_id, line, word, license, n_shared, dice."""
    listed = _known(TEMPLATES if templates is None else templates)
    if not listed:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    known = _literal(listed, threshold)
    limits = [bounds(len(g), threshold) for _, g, _ in listed]
    fewest, most = min(lo for lo, _ in limits), max(hi for _, hi in limits)
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(text, "\n")
    # the whole text is a unit of its own where it has more than one line and its separators
    # do not already make more words than any template allows
    whole = F.when(F.instr(text, "\n") > 0, F.array(text)).otherwise(F.array(F.lit("")))
    units = F.transform(F.concat(whole, lines), _normal)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(units).alias("line", "norm"))
    spaces = F.length("norm") - F.length(F.replace(F.col("norm"), F.lit(" "), F.lit("")))
    # at least ``fewest`` bigrams need as many spaces; repeated bigrams allow more spaces than ``most``
    rows = rows.filter(spaces >= fewest)
    words = F.split("norm", " ")
    grams = F.array_distinct(_bigrams(words))
    # distinct bigrams are at least (distinct words - 1): prune long units by that before making bigrams
    rows = rows.filter((spaces <= most) | (F.size(F.array_distinct(words)) <= most + 1))
    rows = rows.select("doc_id", "line", F.explode(F.array(grams)).alias("grams"))
    size = F.size("grams")
    hits = F.filter(
        F.transform(
            F.filter(known, lambda t: size.between(t["lo"], t["hi"])),
            lambda t: F.struct(
                t["name"].alias("name"),
                F.size(F.array_intersect(F.col("grams"), t["grams"])).alias("shared"),
                F.size(t["grams"]).alias("b"),
            ),
        ),
        lambda h: 2.0 * h["shared"] >= threshold * (size + h["b"]),
    )
    found = rows.filter(size.between(fewest, most)).select("doc_id", "line", size.alias("a"), F.explode(hits).alias("h"))
    in_units = found.select(
        "doc_id", F.col("line").cast("long").alias("line"), F.lit(0).cast("long").alias("word"), F.col("h.name").alias("license"),
        F.col("h.shared").cast("long").alias("n_shared"), (2.0 * F.col("h.shared") / (F.col("a") + F.col("h.b"))).alias("dice"),
    )
    return in_units.union(_runs(docs, listed, known, threshold))


def oracle_sql(threshold: float = THRESHOLD) -> str:
    """The same scan in DuckDB's SQL."""
    values = ", ".join(
        "('{}', [{}], {}, {})".format(n, ", ".join(f"'{g}'" for g in grams), words, bounds(len(grams), threshold)[0])
        for n, grams, words in _known(TEMPLATES)
    )
    return f"""
WITH templates(license, grams, words, least) AS (VALUES {values}),
units AS (
  SELECT doc_id, 0 AS line, text AS unit FROM documents WHERE contains(text, chr(10))
  UNION ALL
  SELECT doc_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS unit
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)
  UNION ALL
  SELECT doc_id, -1 AS line, text AS unit FROM documents WHERE text IS NOT NULL
),
worded AS (
  SELECT doc_id, line, string_split(trim(regexp_replace(lower(unit), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM units
),
grams AS (
  SELECT doc_id, line, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g
  FROM worded WHERE len(w) > 1
),
sets AS (SELECT doc_id, line, list_distinct(g) AS g FROM grams WHERE line >= 0),
pairs AS (
  SELECT doc_id, line, license, len(list_intersect(g, t.grams)) AS n_shared, len(g) + len(t.grams) AS total
  FROM sets, templates t WHERE len(g) <= 3 * len(t.grams)
),
able AS (
  SELECT doc_id, license, t.grams AS b, g, least(t.words - 1, len(g)) AS span
  FROM grams, templates t WHERE line = -1 AND len(list_intersect(list_distinct(g), t.grams)) >= t.least
),
runs AS (
  SELECT doc_id, license, word, len(list_intersect(list_distinct(g[word:word + span - 1]), b)) AS n_shared,
         len(list_distinct(g[word:word + span - 1])) + len(b) AS total
  FROM (SELECT *, unnest(range(1, len(g) - span + 2)) AS word FROM able)
),
ranked AS (
  SELECT doc_id, license, word, n_shared, 2.0::DOUBLE * n_shared / total AS dice,
         row_number() OVER (PARTITION BY doc_id, license ORDER BY 2.0::DOUBLE * n_shared / total DESC, word) AS r
  FROM runs
)
SELECT doc_id, CAST(line AS BIGINT) AS line, CAST(0 AS BIGINT) AS word, license, CAST(n_shared AS BIGINT) AS n_shared,
       2.0::DOUBLE * n_shared / total AS dice
FROM pairs WHERE 2.0::DOUBLE * n_shared >= {threshold}::DOUBLE * total
UNION ALL
SELECT doc_id, CAST(-1 AS BIGINT) AS line, CAST(word AS BIGINT) AS word, license, CAST(n_shared AS BIGINT) AS n_shared, dice
FROM ranked WHERE r = 1 AND dice >= {threshold}::DOUBLE
"""
