"""Licence scan by the Dice coefficient over word bigrams (native).

Units of a text are its lines, its paragraphs and the whole. A unit is normalised
(ASCII letters lowered, all but letters and digits a space) and compared with
each template whose number of different bigrams is near enough: with a share of
at least s, the sizes differ at most by the factor (2 - s) / s, and a template
outside that bound is not looked at. A template that no unit matches is also
compared with every stretch of the text that starts at one of its bigrams and is
as long as the template, over the ends of sentences, lines and paragraphs, so
that a notice of several paragraphs in a longer text and a statement inside a
line are found. The templates are a fixed small table, so the scan is one pass
without a shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERCENT = 80

#: Public licence statements and notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        'applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."),
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software."),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def pairs(text: str) -> list[str]:
    words = re.sub("[^a-z0-9]+", " ", text.translate(str.maketrans(UPPER, LOWER))).split()
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def bigrams(text: str) -> list[str]:
    return sorted(set(pairs(text)))


def bounds(n: int, percent: int) -> tuple[int, int]:
    """Smallest and largest number of bigrams that can reach the share with n."""
    return -((-percent * n) // (200 - percent)), (200 - percent) * n // percent


def anchors(percent: int) -> list[str]:
    """Words of which every matching unit holds one. For each template words are
    taken, those in most bigrams first, until fewer bigrams are without them than
    a match must share. Short words are taken last, as they occur inside others."""
    out: set[str] = set()
    for text in TEMPLATES.values():
        free = [tuple(g.split()) for g in bigrams(text)]
        need = -((-percent * (bounds(len(free), percent)[0] + len(free))) // 200)
        while len(free) >= need:
            words = sorted({w for g in free for w in g})
            word = max(words, key=lambda w: (len(w) > 4 or w.isdigit(), sum(w in g for g in free), len(w)))
            free = [g for g in free if word not in g]
            out.add(word)
    return sorted(out)


def _templates(percent: int) -> Column:
    rows = []
    for name, text in TEMPLATES.items():
        grams = bigrams(text)
        lo, hi = bounds(len(grams), percent)
        rows.append(F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, grams)).alias("grams"), F.lit(len(grams)).alias("n"),
                             F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(len(pairs(text))).alias("length")))
    return F.array(*rows)


def _pairs(unit: Column, fewest: int) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.translate(unit, UPPER, LOWER), "[^a-z0-9]+", " ")), " ")
    found = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))),
                       F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(words) > fewest, found).otherwise(F.array().cast("array<string>"))


def _unit_grams(unit: Column, fewest: int) -> Column:
    return F.array_distinct(_pairs(unit, fewest))


def _match(g: Column, t: Column, percent: int) -> Column:
    return F.struct(
        (F.size(F.array_intersect(g, t["grams"])) * 2 / (F.size(g) + t["n"])).alias("dice"),
        (F.size(F.array_intersect(g, t["grams"])) * 200 >= (F.size(g) + t["n"]) * percent).alias("ok"), t["name"].alias("name"))


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """(id, n_matches, licenses, best, dice) of every row: matching (unit,
    template) pairs, the templates found (sorted, comma-joined), and the best one
    (ties by name) with its coefficient; null, if nothing matches. A template
    found only in stretches of the text counts once, with its best stretch.

    A text that is one line is one unit. Null and empty texts match nothing.
    Repeated rows agree. Other columns are ignored.
    """
    fewest = min(bounds(len(bigrams(t)), percent)[0] for t in TEMPLATES.values())
    text = F.coalesce(F.col(text_col), F.lit(""))
    units = F.array_distinct(F.flatten(F.array(F.split(text, "\n"), F.split(text, "\n[ \t\r]*\n"), F.array(text))))
    word = f"(?<![a-z0-9])(?:{'|'.join(anchors(percent))})(?![a-z0-9])"

    def hold(t: Column) -> Column:
        return F.translate(t, UPPER, LOWER).rlike(word)

    none = F.array().cast("array<string>")
    base = docs.select(F.col(id_col).alias("_id"), F.when(hold(text), F.filter(units, hold)).otherwise(none).alias("units"),
                       F.when(hold(text), _pairs(text, fewest)).otherwise(none).alias("pairs"))
    grams = base.select("_id", "pairs", F.filter(F.transform("units", lambda u: _unit_grams(u, fewest)), lambda g: F.size(g) >= fewest).alias("grams"))
    tpl = _templates(percent)

    def matches(g: Column) -> Column:
        near = F.filter(tpl, lambda t: (F.size(g) >= t["lo"]) & (F.size(g) <= t["hi"]))
        return F.filter(F.transform(near, lambda t: _match(g, t, percent)), lambda m: m["ok"])

    def stretches(t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size("pairs")), lambda i: F.array_contains(t["grams"], F.element_at(F.col("pairs"), i)))
        runs = F.transform(starts, lambda i: F.array_distinct(F.slice(F.col("pairs"), i, t["length"])))
        return F.array_max(F.filter(F.transform(runs, lambda g: _match(g, t, percent)), lambda m: m["ok"]))

    by_unit = grams.select("_id", "pairs", F.flatten(F.transform("grams", matches)).alias("found"))
    # the templates without a match of which a stretch of the text can hold enough
    left = by_unit.select("_id", "pairs", "found", F.when(F.size("pairs") >= fewest, F.filter(tpl, lambda t: (
        ~F.exists("found", lambda m: m["name"] == t["name"]) & (F.size(F.array_intersect(F.col("pairs"), t["grams"])) >= t["lo"])))).alias("left"))
    found = left.select("_id", F.when(F.size("left") > 0, F.concat("found", F.filter(F.transform("left", stretches), lambda m: m.isNotNull())))
                        .otherwise(F.col("found")).alias("found"))
    best = F.array_max(F.transform("found", lambda m: m["dice"]))
    return found.withColumn("dice", best).select(
        F.col("_id").alias(id_col), F.size("found").cast("long").alias("n_matches"),
        F.nullif(F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda m: m["name"]))), ","), F.lit("")).alias("licenses"),
        F.array_min(F.transform(F.filter("found", lambda m: m["dice"] == F.col("dice")), lambda m: m["name"])).alias("best"), "dice")


def oracle(percent: int = PERCENT) -> str:
    """The scan of the units of ``documents`` in DuckDB SQL; it has no stretches."""
    rows = []
    for name, text in TEMPLATES.items():
        grams = bigrams(text)
        lo, hi = bounds(len(grams), percent)
        rows.append(f"('{name}', {[*grams]!r}, {len(grams)}, {lo}, {hi})")
    return f"""
with tpl(name, grams, n, lo, hi) as (values {', '.join(rows)}),
units as (
  select doc_id, unnest(list_distinct(list_concat(list_concat(string_split(t, chr(10)),
         string_split_regex(t, '\\n[ \\t\\r]*\\n')), [t]))) as u
  from (select doc_id, coalesce(text, '') as t from documents)),
words as (select doc_id, string_split(trim(regexp_replace(translate(u, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g')), ' ') as w
          from units),
grams as (select doc_id, list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) as g from words where len(w) > 1),
hits as (
  select doc_id, name, 2.0::double * len(list_intersect(g, grams)) / (len(g) + n) as dice
  from grams join tpl on len(g) between lo and hi
  where 200 * len(list_intersect(g, grams)) >= {percent} * (len(g) + n)),
best as (select doc_id, count(*) as n_matches, string_agg(distinct name, ',' order by name) as licenses,
                arg_min(name, (-dice, name)) as best, max(dice) as dice from hits group by doc_id)
select d.doc_id, coalesce(n_matches, 0)::bigint as n_matches, licenses, best, dice
from documents d left join best b on d.doc_id = b.doc_id
"""
