"""Licence scans with built-in functions only.

Units of a document (each of its distinct lines, and the whole text) are normalised to lower-case
words and compared with licence templates by the Dice coefficient of their word-bigram sets. For a template of m bigrams only
units of n bigrams with 2 * min(n, m) >= threshold * (n + m) can reach the threshold, so word counts prune most units
before any bigram is made. A unit or template of one word has that word as its set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

# fixed values: public licence notices; a caller may pass others
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        'applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
        "this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "
        '"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
        "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details.",
    ),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
}


def normalised(text: Column) -> Column:
    """Words of letters and digits in lower case, one space between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", " "))


def bigrams(words: Column) -> Column:
    """Distinct pairs of neighbouring words; of one word that word; of none nothing."""
    n = F.size(words)
    pairs = F.transform(
        F.sequence(F.lit(0), n - 2), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1))
    )
    return F.when(n >= 2, F.array_distinct(pairs)).otherwise(words)


def _templates(docs: DataFrame, templates: dict[str, tuple[str, ...]]) -> DataFrame:
    rows = [(name, text) for name, texts in sorted(templates.items()) for text in texts]
    raw = docs.sparkSession.createDataFrame(rows, "license string, template string")
    words = raw.select("license", F.split(normalised(F.col("template")), " ").alias("w"))
    return words.select("license", bigrams(F.col("w")).alias("t")).withColumn("m", F.size("t"))


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_units, n_matches (pairs of unit and template), license and dice, row by row, without a shuffle.

    license and dice belong to the best match, ties to the smaller name; they are null where nothing reaches the
    threshold. Null and empty texts have one unit, which matches nothing.
    """
    found = _templates(docs, TEMPLATES if templates is None else templates)
    known = [(r["license"], r["t"], r["m"]) for r in found.orderBy(F.desc("license")).collect()]  # as many as the caller gave
    kind = "array<struct<rank:int,license:string,t:array<string>,m:int>>"
    literal = F.array(
        *(F.struct(F.lit(i).alias("rank"), F.lit(a).alias("license"), F.array(*map(F.lit, t)).alias("t"), F.lit(m).alias("m")) for i, (a, t, m) in enumerate(known))
    ).cast(kind)
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    least = low * min((m for _, _, m in known), default=1)
    most = high * max((m for _, _, m in known), default=0)
    text = F.coalesce(F.col("text"), F.lit(""))
    units = F.array_distinct(F.concat(F.split(text, "\n"), F.array(text)))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), units.alias("units"))
    worded = rows.select("doc_id", F.size("units").alias("n_units"), F.transform("units", lambda u: F.split(normalised(u), " ")).alias("w"))
    # a unit has at most one bigram less than words, and at least one less than distinct words
    fit = F.filter("w", lambda w: (F.greatest(F.size(w) - 1, F.lit(1)) >= least) & (F.get(w, F.lit(0)) != "") & (F.size(F.array_distinct(w)) - 1 <= most))
    sets = worded.select("doc_id", "n_units", fit.alias("w")).select("doc_id", "n_units", F.transform("w", bigrams).alias("sets"))

    def scores(b: Column) -> Column:
        n = F.size(b)
        near = F.filter(literal, lambda t: (n >= t["m"] * low) & (n <= t["m"] * high))
        return F.transform(
            near, lambda t: F.struct((2 * F.size(F.array_intersect(b, t["t"])) / (n + t["m"])).alias("dice"), t["rank"].alias("rank"), t["license"].alias("license"))
        )

    matched = sets.select("doc_id", "n_units", F.filter(F.flatten(F.transform("sets", scores)), lambda s: s["dice"] >= threshold).alias("matches"))
    best = F.array_max("matches")
    return matched.select(
        "doc_id", "n_units", F.size("matches").alias("n_matches"), best["license"].alias("license"), F.round(best["dice"], 6).alias("dice")
    )
