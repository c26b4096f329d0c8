"""Licence scans by the Dice coefficient over word bigrams.

Every line of a text, and every paragraph of more than one line, is normalised
(lower case, anything but a-z and 0-9 becomes a blank) and becomes the set of
its word bigrams. It matches a template where twice the number of common bigrams
is at least `least` of the sum of both sets' sizes. That bounds the size of one
set by the other's, so templates of other sizes are pruned before bigrams are
compared. It bounds the common bigrams from below, too: of each template so many
are named, the longest ones, that nothing without any of them can match. Texts
without any are passed over before they are split, and units meet the table of
templates by them. Of several licences that a unit matches the best counts.

A licence that no unit states may be stated inside one, by the words of a comment
block, or over many paragraphs. So windows of a text's words, as long as the
template and laid over one of its named bigrams, are compared in the same way;
where windows of two licences overlap, the better one counts. n_matches then
counts windows that don't overlap. OP5_SQL knows whole units only.

Templates are a parameter, a table of any number that goes to every task up to
SENT_WORDS. Bigrams are compared by 64-bit hashes. Everything is DataFrame
expressions. Null and empty texts match nothing; rows without a doc_id count
together, and so do repeated rows. Very long texts are searched whole. Of equally
good licences of a unit all count. An empty table gives an empty one, and columns
but doc_id and text are not looked at, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.llm.common import cut, table

LEAST = 0.8
#: Words of all templates up to which their table goes to every task.
SENT_WORDS = 1 << 18

#: Notices by which texts state their licence, and short licences as a whole.
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_GNU = "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} General Public License as published by the Free Software Foundation, either version {3} of the License, or (at your option) any later version."
TEMPLATES = {
    "AGPL-3.0": [_GNU.format("program", ":", "Affero", "3")],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "Artistic-2.0": ["This is free software, licensed under: The Artistic License 2.0 (GPL Compatible)"],
    "BSD-2-Clause": [_BSD, f"{_BSD} {_BSD_TWO} {_BSD_AS_IS}"],
    "BSD-3-Clause": [_BSD_THIRD, f"{_BSD} {_BSD_TWO} 3. {_BSD_THIRD} {_BSD_AS_IS}"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "GPL-2.0": [_GNU.format("program", ";", "", "2")],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", _GNU.format("program", ":", "", "3")],
    "ISC": [_ISC, f"{_ISC} THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."],
    "LGPL-2.1": [_GNU.format("library", ";", "Lesser", "2.1")],
    "LGPL-3.0": [_GNU.format("program", ":", "Lesser", "3")],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license.", _MIT, f"{_MIT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}"],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ],
}


def plain(text: str) -> str:
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


def normalised(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def all_bigrams(words: Column) -> Column:
    """Hashes of the bigrams of an array of words, in order."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.xxhash64(a, b))


def units(text: Column) -> Column:
    """All lines, and all paragraphs of more than one line."""
    return F.concat(F.split(text, "\n"), F.filter(F.split(text, r"\n[ \t\r]*\n"), lambda p: F.contains(p, F.lit("\n"))))


def _named(words: list[str], low: float) -> list[tuple[str, str]]:
    """So many of a template's bigrams, the longest first, that a text without any of them can't match it."""
    own = sorted(set(zip(words, words[1:], strict=False)), key=lambda b: (-len(b[0]) - len(b[1]), b))
    return own[: int(len(own) * (1 - low) + 1e-9) + 1]


def template_table(spark: SparkSession, pairs: list[tuple[str, list[str]]], low: float) -> DataFrame:
    """(licence, long, own, named, gram): a row for each named bigram of each template; long is the number of its bigrams, own the distinct ones."""
    rows = F.array(*(F.struct(F.lit(name).alias("licence"), F.lit(" ".join(words)).alias("words"), F.lit(" ".join(f"{a} {b}" for a, b in _named(words, low))).alias("named")) for name, words in pairs))
    split = spark.range(1).select(F.explode(rows).alias("t")).select("t.licence", F.split("t.words", " ").alias("w"), F.split("t.named", " ").alias("n"))
    pairs_of = F.transform(F.sequence(F.lit(0), F.size("n") - 1, F.lit(2)), lambda k: F.xxhash64(F.get("n", k), F.get("n", k + 1)))
    own = split.select("licence", (F.size("w") - 1).alias("long"), F.array_distinct(all_bigrams(F.col("w"))).alias("own"), pairs_of.alias("named"))
    return own.withColumn("gram", F.explode("named"))


def _either(pairs: list[tuple[str, list[str]]], low: float) -> str:
    """A pattern of all named bigrams, by their first words."""
    by_first: dict[str, set] = {}
    for _, words in pairs:
        for a, b in _named(words, low):
            by_first.setdefault(a, set()).add(b)
    return "(?<![a-z0-9])(?:" + "|".join(f"{a}[^a-z0-9]+(?:{'|'.join(sorted(b))})" for a, b in sorted(by_first.items())) + ")(?![a-z0-9])"


def stated(near: DataFrame, known: DataFrame, seeds: Column, least: float) -> DataFrame:
    """(doc_id, licence, score, n): the units' matches."""
    low = least / (2 - least)
    unit = near.select("doc_id", "row", F.posexplode(units(F.col("text"))).alias("pos", "unit"))
    sets = unit.select("doc_id", "row", "pos", F.array_distinct(all_bigrams(F.split(normalised(F.col("unit")), " "))).alias("a")).withColumn("n", F.size("a"))
    met = sets.withColumn("gram", F.explode(F.array_intersect("a", seeds))).join(known, "gram")
    fits = (F.col("n") >= low * F.size("own")) & (F.col("n") * low <= F.size("own"))
    first = F.get(F.array_intersect("named", "a"), F.lit(0)) == F.col("gram")  # of several named bigrams one counts
    score = 2.0 * F.size(F.array_intersect("a", "own")) / (F.col("n") + F.size("own"))
    scores = met.filter(fits).filter(first).select("doc_id", "row", "pos", "licence", score.alias("score")).filter(F.col("score") >= least)
    best = scores.withColumn("best", F.max("score").over(Window.partitionBy("row", "pos"))).filter("score = best")
    return best.groupBy("doc_id", "licence").agg(F.max("score").alias("score"), F.count("*").alias("n"))


def embedded(near: DataFrame, known: DataFrame, seeds: Column, least: float) -> DataFrame:
    """(doc_id, licence, score, n): the matches of windows of words."""
    words = near.select("doc_id", "row", all_bigrams(F.split(normalised(F.col("text")), " ")).alias("all"))
    places = F.filter(F.transform("all", lambda g, k: F.struct(g.alias("gram"), k.alias("at"))), lambda x: F.array_contains(seeds, x["gram"]))
    hits = words.select("doc_id", "row", "all", F.explode(places).alias("hit")).select("doc_id", "row", "all", F.col("hit.gram").alias("gram"), F.col("hit.at").alias("at"))
    first = F.greatest(F.lit(0), F.col("at") - F.col("long") + 1)
    last = F.greatest(first, F.least(F.col("at"), F.size("all") - F.col("long")))
    around = hits.join(known, "gram").select("doc_id", "row", "licence", "long", "own", first.alias("first"), (last - first).alias("more"), F.slice("all", first + 1, 2 * F.col("long")).alias("part"))
    # all windows around a place lie in `part`: what it lacks, they lack
    possible = F.size(F.array_intersect("part", "own")) >= least / (2 - least) * F.size("own")

    def dice(start):
        window = F.array_distinct(F.slice("part", start + 1, F.col("long")))
        return F.struct((2.0 * F.size(F.array_intersect(window, "own")) / (F.size(window) + F.size("own"))).alias("score"), (-start - F.col("first")).alias("back"))

    top = around.filter(possible).select("doc_id", "row", "licence", "long", F.array_max(F.transform(F.sequence(F.lit(0), F.col("more")), dice)).alias("m")).filter(F.col("m.score") >= least)
    span = F.struct((-F.col("m.back")).alias("start"), (F.col("long") + 1 - F.col("m.back")).alias("end"), "licence", "m.score")
    held = top.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set(span)).alias("spans"))
    beaten = lambda x: F.exists("spans", lambda o: (o["score"] > x["score"]) & (o["licence"] != x["licence"]) & (o["start"] < x["end"]) & (x["start"] < o["end"]))
    kept = held.select("doc_id", "row", F.explode(F.filter("spans", lambda x: ~beaten(x))).alias("s"))
    found = kept.groupBy("doc_id", "row", "s.licence").agg(F.max("s.score").alias("score"), F.array_sort(F.collect_set(F.struct("s.start", "s.end"))).alias("spans"))
    apart = F.aggregate(
        "spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, x: F.when(x["start"] >= a["end"], F.struct((a["n"] + 1).alias("n"), x["end"].alias("end"))).otherwise(a),
    )["n"]
    return found.groupBy("doc_id", "licence").agg(F.max("score").alias("score"), F.sum(apart).alias("n"))


def scanned(docs: DataFrame, templates: dict[str, list[str]] | None = None, least: float = LEAST) -> DataFrame:
    """(doc_id, licence, score, n_matches): the licences that each document states, with the best score."""
    pairs = [(name, plain(text).split()) for name, texts in sorted((templates or TEMPLATES).items()) for text in texts]
    pairs = [(name, words) for name, words in pairs if len(words) > 1]
    if not pairs:
        raise ValueError("a template of two words or more is asked for")
    low = least / (2 - least)
    known = template_table(docs.sparkSession, pairs, low)
    if sum(len(words) for _, words in pairs) <= SENT_WORDS:
        known = F.broadcast(known)
    seeds = F.array_distinct(F.array(*(F.xxhash64(F.lit(a), F.lit(b)) for a, b in sorted({g for _, words in pairs for g in _named(words, low)}))))
    near = docs.select("doc_id", "text").filter(F.lower("text").rlike(_either(pairs, low)))
    near = cut(near.withColumn("row", F.monotonically_increasing_id()))
    # a licence that a unit states counts by units
    either = stated(near, known, seeds, least).withColumn("whole", F.lit(True)).unionByName(embedded(near, known, seeds, least).withColumn("whole", F.lit(False)))
    whole = F.col("whole")
    pick = lambda c: F.coalesce(F.max(F.when(whole, F.col(c))), F.max(F.when(~whole, F.col(c))))
    return either.groupBy("doc_id", "licence").agg(F.round(pick("score"), 6).alias("score"), pick("n").cast("long").alias("n_matches"))


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sql() -> str:
    rows = ", ".join(f"('{name}', '{plain(text)}')" for name, texts in TEMPLATES.items() for text in texts)
    grams = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
    return f"""
WITH templates AS (
  SELECT licence, {grams.format('w')} AS b FROM (SELECT licence, string_split(t, ' ') AS w FROM (VALUES {rows}) AS x(licence, t))),
units AS (
  SELECT doc_id, unnest(list_concat(string_split(text, chr(10)),
    list_filter(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n'), lambda p: contains(p, chr(10))))) AS unit FROM documents),
words AS (
  SELECT doc_id, string_split(trim(regexp_replace(lower(unit), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM units),
sets AS (SELECT doc_id, row_number() OVER () AS unit, {grams.format('w')} AS a FROM words WHERE len(w) > 1),
scores AS (
  SELECT doc_id, unit, licence, 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) AS score
  FROM sets JOIN templates ON len(a) >= len(b) * {LEAST / (2 - LEAST)!r} AND len(a) * {LEAST / (2 - LEAST)!r} <= len(b))
SELECT doc_id, licence, round(max(score), 6) AS score, count(*)::BIGINT AS n_matches
FROM (SELECT * FROM scores WHERE score >= {LEAST} QUALIFY score = max(score) OVER (PARTITION BY unit)) GROUP BY doc_id, licence
"""


OP5_SQL = _sql()
