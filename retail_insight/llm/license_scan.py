"""Licence notices in texts: word-bigram Dice coefficient against templates.

DataFrame functions only. A text and the templates become normalised words and
their hashed bigrams. A hit is a place of a text whose bigram some template
has; runs of hits that a window of the template's size could hold are compared
with it. A window of n bigrams can reach the Dice threshold t only with
templates of n*t/(2-t) to n*(2-t)/t bigrams, so a hit begins a window only if
enough further hits follow within the longest size that the bound admits, and
texts too short for a template are never compared with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DICE = 0.9
BROADCAST_TEMPLATES = 1000

# Wording of common public licence notices and texts.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "MIT-work": "This project is licensed under the terms of the MIT license.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-released": "Released under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-3-Clause-notice": "Released under the BSD 3-Clause License.",
    "BSD-2-Clause-notice": "Released under the BSD 2-Clause License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF "
        "ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR "
        "A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
        "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING "
        "FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE "
        "FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
        "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING "
        "OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details."),
}


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def template_table(spark, templates: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(sorted(templates.items()), "license_id string, template string")


def pairs(w: Column) -> Column:
    """Hashed pairs of neighbouring words, in order."""
    rest = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, 1, rest), F.slice(w, 2, rest), lambda a, b: F.xxhash64(a, b))


def scan_licenses(documents: DataFrame, templates: DataFrame, dice: float = DICE,
                  key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per key and template found: key, license_id, n_units, best_dice.

    A window of a row's text begins at a hit (a word bigram of the template)
    and ends at the last hit within the template's number of bigrams, or
    within the most that the size bound admits; both are compared. Its Dice
    coefficient is 2 * x / (x + f + m): x distinct bigrams of the template in
    it, f places in it with another bigram, m distinct bigrams of the
    template. Windows that reach ``dice`` and overlap are one unit, wherever
    they stand in the text: it counts for its window with the most x (of
    equals: the greater coefficient, then the first license_id).

    ``templates`` has license_id and template; a template of fewer than two
    words has no bigram and never matches, nor does a text of fewer than two
    words, an empty or a null one. Each row is scanned by itself; the units of
    rows that repeat a key are added up. Empty tables give an empty result;
    other columns are ignored. Templates are broadcast only if they are counted
    as at most BROADCAST_TEMPLATES rows; else their join is left to the
    planner, which can shuffle both sides.
    """
    if not 0 < dice <= 1:
        raise ValueError("dice must be over 0, at most 1")
    low, high = dice / (2 - dice), (2 - dice) / dice
    known = (templates.select("license_id", pairs(words(F.col("template"))).alias("_t"))
             .select("license_id", F.array_distinct("_t").alias("_t"), F.size("_t").alias("_long")).where("_long > 0")
             .select("license_id", F.size("_t").alias("_m"), F.posexplode("_t").alias("_g", "_pair"), "_long")
             .select("_pair", "_g", "license_id", "_m", F.greatest("_long", "_m").alias("_long"),
                     F.greatest(F.ceil(F.col("_m") * F.lit(low) - 1e-9), F.lit(1)).cast("int").alias("_need"),
                     F.greatest(F.floor(F.col("_m") * F.lit(high) + 1e-9).cast("int"), "_long").alias("_most")))
    if templates.count() <= BROADCAST_TEMPLATES:
        known = F.broadcast(known)
    # one word array a text; every bigram's place meets the templates by its hash
    places = (documents.select(F.monotonically_increasing_id().alias("_row"), F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
              .select("_row", "_key", pairs(words(F.col("_text"))).alias("_b"))
              .select("_row", "_key", F.size("_b").alias("_n"), F.posexplode("_b").alias("_at", "_pair")))
    hits = (places.join(known, "_pair").where("_n >= _need")
            .groupBy("_row", "license_id")
            .agg(F.first("_key").alias("_key"), F.first("_m").alias("_m"), F.first("_long").alias("_long"), F.first("_need").alias("_need"),
                 F.first("_most").alias("_most"), F.array_sort(F.collect_list(F.struct("_at", "_g"))).alias("_hits"))
            .where("size(_hits) >= _need"))
    # first hits of windows: the hit that makes the window large enough is near enough
    begins = F.expr("filter(transform(_hits, (h, i) -> struct(h._at AS at, i AS i, _hits[least(i + _need, size(_hits)) - 1]._at AS till)), "
                    "s -> s.i + _need <= size(_hits) AND s.till < s.at + _most)")
    windows = (hits.withColumn("_begin", F.explode(begins))
               .withColumn("_span", F.explode(F.array_distinct(F.array("_long", "_most"))))
               .withColumn("_in", F.expr("filter(slice(_hits, _begin.i + 1, _span), h -> h._at < _begin.at + _span)"))
               .withColumn("_x", F.size(F.array_distinct(F.transform("_in", lambda h: h["_g"]))))
               .withColumn("_end", F.element_at("_in", -1)["_at"])
               .withColumn("_dice", 2.0 * F.col("_x") / (F.col("_x") + (F.col("_end") - F.col("_begin.at") + 1 - F.size("_in")) + F.col("_m")))
               .where(F.col("_dice") >= dice)
               .select("_row", "_key", "license_id", F.col("_begin.at").alias("_start"), "_end", "_x", "_dice"))
    row = W.partitionBy("_row").orderBy("_start", "_end", "license_id")
    apart = F.coalesce(F.max("_end").over(row.rowsBetween(W.unboundedPreceding, -1)) < F.col("_start"), F.lit(True))
    units = (windows.withColumn("_new", apart.cast("int"))
             .withColumn("_unit", F.sum("_new").over(row.rowsBetween(W.unboundedPreceding, 0)))
             .groupBy("_row", "_unit").agg(F.first("_key").alias("_key"), F.min(F.struct(
                 (-F.col("_x")).alias("x"), (-F.col("_dice")).alias("dice"), "license_id")).alias("_best")))
    return (units.groupBy("_key", F.col("_best.license_id").alias("license_id"))
            .agg(F.count(F.lit(1)).alias("n_units"), F.max(-F.col("_best.dice")).alias("best_dice"))
            .withColumnRenamed("_key", key))


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licence notices in every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan_licenses(docs, template_table(spark, TEMPLATES))


def oracle() -> str:
    """The same in SQL, bigrams as text."""
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(TEMPLATES.items()))
    as_words = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    as_pairs = "list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1])"
    low, high = DICE / (2 - DICE), (2 - DICE) / DICE
    return f"""
WITH tw AS (SELECT license_id, {as_words.format('template')} AS w FROM (VALUES {rows}) v(license_id, template)),
tp AS (SELECT license_id, {as_pairs.format('w')} AS p FROM tw),
t AS (SELECT license_id, len(list_distinct(p)) AS m, len(p) AS span, unnest(list_distinct(p)) AS pair FROM tp),
dw AS (SELECT row_number() OVER () AS r, doc_id, {as_words.format('text')} AS w FROM documents WHERE text IS NOT NULL),
dp AS (SELECT r, doc_id, {as_pairs.format('w')} AS p FROM dw WHERE len(w) > 1),
places AS (SELECT r, doc_id, unnest(p) AS pair, unnest(range(1, len(p) + 1)) AS place FROM dp),
h AS (SELECT r, doc_id, license_id, m, place, pair, span, greatest(floor(m * {high} + 1e-9), span) AS most
      FROM places JOIN t USING (pair)),
spans AS (SELECT DISTINCT h.*, unnest([h.span, h.most]) AS reach FROM h),
seen AS (SELECT a.r, a.doc_id, a.license_id, a.m, a.place, a.reach, max(b.place) AS till, count(DISTINCT b.pair) AS x, count(*) AS n
         FROM spans a JOIN h b ON a.r = b.r AND a.license_id = b.license_id AND b.place >= a.place AND b.place < a.place + a.reach
         GROUP BY ALL HAVING count(*) >= a.m * {low} - 1e-9),
found AS (SELECT *, 2.0 * x / (x + (till - place + 1 - n) + m) AS d FROM seen WHERE 2.0 * x / (x + (till - place + 1 - n) + m) >= {DICE}),
marked AS (SELECT *, coalesce(max(till) OVER (PARTITION BY r ORDER BY place, till, license_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < place, true) AS apart FROM found),
numbered AS (SELECT *, sum(apart::INT) OVER (PARTITION BY r ORDER BY place, till, license_id ROWS UNBOUNDED PRECEDING) AS unit FROM marked),
best AS (SELECT * FROM numbered QUALIFY row_number() OVER (PARTITION BY r, unit ORDER BY x DESC, d DESC, license_id) = 1)
SELECT doc_id, license_id, count(*) AS n_units, CAST(max(d) AS DOUBLE) AS best_dice FROM best
GROUP BY doc_id, license_id"""
