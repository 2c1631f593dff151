"""Licence scan in DataFrame functions: Dice coefficient of word bigrams against templates.

A unit is a line of a text, a sentence of a line of several (cut after . ; ! or ? and blanks),
for notices inside prose, or a paragraph of several lines (lines between those without a
letter or digit), for notices that are wrapped or in comments. Units and templates are normalised alike: A-Z in lower
case, everything but a-z and 0-9 a separator. A unit's distinct word bigrams A and a
template's B have the coefficient 2 |A and B| / (|A| + |B|), which can reach t only if
t / (2 - t) <= |A| / |B| <= (2 - t) / t: these bounds on sizes, taken first over all
templates and then for each, prune before anything is intersected. The first bound also
says how many of B's bigrams a unit may miss, so it must hold one of a few words that
touch more bigrams than that: units without any such word are not normalised at all.

Everything happens inside the row: no shuffle, no Python, and hot sources or texts that
repeat cost what any other row costs.

Defined results: a null or empty text has no units, no licence and best_dice 0. Ties
go to the template listed first. Each row, repeated or not, gives one row. Units of
one word have no bigram and match nothing.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: What ends a sentence of a line, and a paragraph: regular expressions of both engines.
SENTENCE_END, PARAGRAPH_END = r"([.;!?])[ \t]+", r"\n[^A-Za-z0-9\n]*\n"

# Notices by which texts state their licence, and the operative paragraphs of short licences.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License - see the LICENSE file for details."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("GPL-3.0-or-later", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("ISC", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bigrams_of(text: str) -> list[str]:
    """Distinct word bigrams of a template."""
    words = re.findall(r"[a-z0-9]+", text.translate(str.maketrans(_UPPER, _LOWER)))
    return sorted({f"{a} {b}" for a, b in zip(words[:-1], words[1:], strict=True)})


def bounds(size: int, threshold: float) -> tuple[int, int]:
    """Sizes of a unit that can reach the threshold against a template of `size` bigrams."""
    return math.ceil(threshold * size / (2 - threshold) - 1e-9), math.floor((2 - threshold) * size / threshold + 1e-9)


# Words of any prose; a template is anchored on others first.
_PROSE = {"a", "all", "and", "any", "are", "as", "be", "by", "file", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "under", "with", "work"}


def anchors_of(text: str, threshold: float) -> set[str]:
    """Words of a template of which every unit that reaches the threshold has one at least.

    A unit reaches it only with t / (2 - t) of the template's bigrams or more, so it misses
    fewer bigrams than touch these words together.
    """
    grams = [g.split(" ") for g in bigrams_of(text)]
    missed = len(grams) - bounds(len(grams), threshold)[0]
    chosen: set[str] = set()
    for word in sorted({w for g in grams for w in g}, key=lambda w: (w in _PROSE, -len(w), w)):
        if sum(bool(chosen.intersection(g)) for g in grams) > missed:
            break
        chosen.add(word)
    return chosen


def _unit_bigrams(unit: Column) -> Column:
    words = F.filter(F.split(F.regexp_replace(F.translate(unit, _UPPER, _LOWER), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    pairs = F.arrays_zip(words.alias("a"), F.slice(words, 2, F.size(words)).alias("b"))
    return F.array_distinct(F.transform(F.filter(pairs, lambda p: p["b"].isNotNull()), lambda p: F.concat(p["a"], F.lit(" "), p["b"])))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_units, n_license_units, licenses, best_license, best_dice of every row of docs."""
    known = [(name, grams) for name, body in templates if (grams := bigrams_of(body))]
    limits = [bounds(len(grams), threshold) for _, grams in known]
    low, high = min(a for a, _ in limits), max(b for _, b in limits)
    every = F.array(*[F.lit(g) for g in sorted({g for _, grams in known for g in grams})])
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda u: F.trim(u) != "")
    several = F.filter(lines, lambda u: u.rlike(SENTENCE_END + "[^ \t]"))
    sentences = F.flatten(F.transform(several, lambda u: F.filter(F.split(F.regexp_replace(u, SENTENCE_END, "$1\n"), "\n"), lambda x: F.trim(x) != "")))
    paragraphs = F.filter(F.split(body, PARAGRAPH_END), lambda u: F.contains(F.trim(u), F.lit("\n")))
    units = F.concat(lines, sentences, paragraphs)

    def best(grams: Column) -> Column:
        size, scored = F.size(grams), []
        for i, ((_, own), (a, b)) in enumerate(zip(known, limits, strict=True)):
            both = F.size(F.array_intersect(grams, F.array(*[F.lit(g) for g in own])))
            dice = F.when(size.between(a, b), both * F.lit(2.0) / (size + len(own)).cast("double")).otherwise(F.lit(0.0))
            scored.append(F.struct(dice.alias("dice"), F.lit(-i).alias("at")))
        return F.array_max(F.array(*scored))

    words = sorted({w for _, t in templates if bigrams_of(t) for w in anchors_of(t, threshold)})
    anchored = "(?i)(?<![a-z0-9])(?:" + "|".join(words) + ")(?![a-z0-9])"
    possible = F.when(body.rlike(anchored), F.filter(units, lambda u: u.rlike(anchored))).otherwise(F.array().cast("array<string>"))
    fitting = F.filter(F.transform(possible, _unit_bigrams), lambda g: F.size(g).between(low, high) & F.arrays_overlap(g, every))
    found = F.filter(F.transform(fitting, best), lambda m: m["dice"] >= threshold)
    names = F.array(*[F.lit(name) for name, _ in known])
    name_of = lambda m: F.element_at(names, (F.lit(1) - m["at"]).cast("int"))
    staged = docs.select(F.col(key).alias("doc_id"), F.size(units).cast("long").alias("n_units"), found.alias("found"))
    top = F.array_max(F.col("found"))
    return staged.select(
        "doc_id", "n_units", F.size("found").cast("long").alias("n_license_units"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("found", name_of))), ",").alias("licenses"),
        F.when(top.isNotNull(), name_of(top)).alias("best_license"), F.coalesce(top["dice"], F.lit(0.0)).alias("best_dice"),
    )


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql(templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    rows = ", ".join(f"({i}, {_literal(name)}, {_literal(body)})" for i, (name, body) in enumerate(templates))
    words = "list_filter(string_split(regexp_replace(translate({}, '" + _UPPER + "', '" + _LOWER + "'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"
    return f"""
WITH tpl AS (
  SELECT i, name, list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS b
  FROM (SELECT i, name, {words.format("body")} AS w FROM (VALUES {rows}) AS v(i, name, body))),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents),
u AS (
  SELECT rid, unnest(list_concat(
    list_filter(string_split(body, chr(10)), lambda x: trim(x) <> ''),
    flatten(list_transform(list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '{SENTENCE_END}[^ \\t]')), lambda x: list_filter(string_split(regexp_replace(x, '{SENTENCE_END}', '\\1' || chr(10), 'g'), chr(10)), lambda y: trim(y) <> ''))),
    list_filter(regexp_split_to_array(body, '{PARAGRAPH_END}'), lambda x: contains(trim(x), chr(10))))) AS unit
  FROM d),
g AS (
  SELECT rid, row_number() OVER () AS uid, list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS a
  FROM (SELECT rid, {words.format("unit")} AS w FROM u)),
s AS (
  SELECT g.rid, g.uid, tpl.i, tpl.name, 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b))::DOUBLE AS dice
  FROM g JOIN tpl ON list_has_any(a, b)),
m AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY dice DESC, i) AS r FROM s WHERE dice >= {threshold}) WHERE r = 1),
per AS (
  SELECT rid, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, first(name ORDER BY dice DESC, i) AS best_license, max(dice) AS best_dice
  FROM m GROUP BY rid),
nu AS (SELECT rid, count(*) AS n_units FROM u GROUP BY rid)
SELECT d.doc_id, CAST(coalesce(nu.n_units, 0) AS BIGINT) AS n_units, CAST(coalesce(per.n, 0) AS BIGINT) AS n_license_units,
       coalesce(per.licenses, '') AS licenses, per.best_license, coalesce(per.best_dice, 0.0::DOUBLE) AS best_dice
FROM d LEFT JOIN per USING (rid) LEFT JOIN nu USING (rid)
"""
