"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

A template of m shingles (SHINGLE words each) belongs to the scale c, the next power of 2; windows of that scale hold c + s - 1
shingles of the text and begin every s = max(1, c / 4), so one of them holds any run of c. A window with the share ``containment``
of a template's shingles has a Jaccard similarity with it of at least J = need / (c + s - 1 + m - need), need being that share of
m, rounded up. MinHash values are the k smallest of one hash over a set's shingles, and each is a band of its own: of the k smallest
in the union, one that both sets hold is among the k smallest of either. None of them is held by both with a probability of at
most (1 - J) ** k. A scale has so many bands k that this is at most MISS for each of its templates. DataFrame functions only.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspark.llm.common import store, table

SHINGLE, CONTAINMENT = 5, 0.8
#: Probability with which a window that holds enough of a template may fail to retrieve it.
MISS = 1e-5
#: Shingles whose windows are read at once; the longest step of the windows divides it.
PIECE = 1 << 12

#: Public license notices, to be found in texts.
TEMPLATES = {
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-notice": "Released under the MIT License.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^0-9a-z\x{80}-\x{10FFFF}]+"), "")


def shingles(text: Column) -> Column:
    """Hashes of the runs of SHINGLE words; none for fewer words or null."""
    none = F.array().cast("array<bigint>")

    def of(w):
        last = F.size(w) - SHINGLE + 1
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, SHINGLE)))).otherwise(none)

    # bound as a lambda's argument, a text is split into words once and not once a shingle
    return F.get(F.transform(F.array(word_array(F.coalesce(text, F.lit("")))), of), 0)


#: Words too common to tell texts apart by.
COMMON = "a all an and any as at be by for from if in is it its may must not of on or that the this to was which will with without you your under"


def anchors(templates: dict[str, str]) -> list[str]:
    """Words of which every shingle of every template has at least one.

    Of the words that aren't common nor numbers (any word where a shingle has no other), the one in most uncovered shingles comes first.
    """
    common = set(COMMON.split())
    left = []
    for text in templates.values():
        w = re.findall(r"[0-9a-z\x80-\U0010FFFF]+", text.lower())
        for i in range(len(w) - SHINGLE + 1):
            g = set(w[i : i + SHINGLE])
            left.append({x for x in g if x not in common and not x.isdigit()} or g)
    out = []
    while left:
        counts = Counter(word for g in left for word in g)
        best = max(counts, key=lambda word: (counts[word], len(word), word))
        out.append(best)
        left = [g for g in left if best not in g]
    return sorted(out)


def step_of(scale: int) -> int:
    return max(1, scale // 4)


def need_of(m: int, containment: float) -> int:
    """Shingles of a template of m that a window must hold."""
    return max(1, math.ceil(m * containment - 1e-9))


def bands_of(scale: int, sizes: list[int], containment: float) -> int:
    """Bands of a scale with templates of these sizes, from the least similarity of a window that holds enough of one."""
    width = scale + step_of(scale) - 1
    least = min(need_of(m, containment) / (width + m - need_of(m, containment)) for m in sizes)
    return 1 if least >= 1 else math.ceil(math.log(MISS) / math.log1p(-least))


def _minima(hs: Column, bands: int) -> Column:
    """The MinHash values of an array of shingles: the smallest distinct ones, one for each band."""
    return F.slice(F.sort_array(F.array_distinct(hs)), 1, bands)


def template_rows(spark: SparkSession, templates: dict[str, str]) -> list:
    """(template, m, scale, hs) of each template with a shingle: as many rows as templates are given."""
    texts = spark.createDataFrame(list(templates.items()), "template string, text string")
    hashes = texts.select("template", F.array_distinct(shingles(F.col("text"))).alias("hs")).where("size(hs) > 0")
    return hashes.select("template", F.size("hs").alias("m"), F.pow(F.lit(2), F.ceil(F.log2(F.size("hs")))).cast("int").alias("scale"), "hs").collect()


def _windows(piece: Column, number: Column, scales: dict[int, tuple[int, list[int]]]) -> Column:
    """Of all windows that begin in a piece, those with some template's value in some band: (scale, window, minima, shingles)."""

    def of_scale(h, scale, bands, values):
        step = step_of(scale)
        width = scale + step - 1
        last = F.least(F.lit(PIECE // step), F.ceil(F.size(h) / step).cast("int")) - 1
        every = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(k.alias("k"), _minima(F.slice(h, k * step + 1, width), bands).alias("minima")))
        some = F.filter(every, lambda x: F.arrays_overlap(x["minima"], F.array(*[F.lit(v) for v in values])))
        return F.transform(some, lambda x: F.struct(F.lit(scale).alias("scale"), (number * (PIECE // step) + x["k"]).alias("window"), x["minima"].alias("minima"), F.slice(h, x["k"] * step + 1, width).alias("held")))

    # bound as a lambda's argument, a piece is cut from its text once
    return F.get(F.transform(F.array(piece), lambda h: F.concat(*[of_scale(h, c, b, v) for c, (b, v) in scales.items()])), 0)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """row (a struct of the columns of docs but text), matches: an array of (template, containment, first word, last word) sorted by template.

    A template matches where a window of a text holds at least ``containment`` of its distinct shingles; of several windows
    the best counts, then the first. Null, empty and short texts match nothing, and a template shorter than a shingle is in no text. A
    long text is read in pieces of PIECE shingles, each with all windows that begin in it. Repeated rows each get a row; the columns
    of docs come back inside ``row``, so none clashes. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    templates = templates or TEMPLATES
    known = template_rows(spark, templates)
    rest = [c for c in docs.columns if c != "text"]
    empty = F.array().cast("array<struct<template:string,containment:double,first:int,last:int>>")
    if not known:
        return docs.select(F.struct(*rest).alias("row"), empty.alias("matches"))
    sizes = defaultdict(list)
    for t in known:
        sizes[t.scale].append(t.m)
    bands = {c: bands_of(c, ms, containment) for c, ms in sorted(sizes.items())}
    own = spark.createDataFrame(known, "template string, m int, scale int, hs array<bigint>")
    values = own.select("template", "scale", _minima(F.col("hs"), max(bands.values())).alias("minima")).collect()
    scales = {c: (n, sorted({v for r in values if r.scale == c for v in r.minima[:n]})) for c, n in bands.items()}
    by_band = spark.createDataFrame([(r.template, r.scale, v) for r in values for v in r.minima[: bands[r.scale]]], "template string, scale int, value long")
    # a text without any anchor as a whole word has no shingle of a template, so its shingles needn't be made
    inside = r"[0-9a-z\x{80}-\x{10FFFF}]"
    some_anchor = F.lower("text").rlike(f"(?<!{inside})(?:{'|'.join(anchors(templates))})(?!{inside})")
    hs = F.when(some_anchor, shingles(F.col("text"))).otherwise(F.array().cast("array<bigint>"))
    rows = store(docs.select(F.struct(*rest).alias("row"), hs.alias("hs")).withColumn("uid", F.monotonically_increasing_id()), "shingles")
    longest = max(c + step_of(c) for c in bands)
    pieces = F.transform(F.sequence(F.lit(0), ((F.size("hs") - 1) / PIECE).cast("int")), lambda p: F.struct(p.alias("p"), F.slice("hs", p * PIECE + 1, PIECE + longest).alias("h")))
    dealt = rows.where("size(hs) > 0").select("uid", F.explode(pieces).alias("x"))
    near = store(dealt.select("uid", F.explode(_windows(F.col("x.h"), F.col("x.p"), scales)).alias("w")).select("uid", "w.*"), "windows")
    at = near.select("uid", "scale", "window", F.explode("minima").alias("value"))
    # the bands and shingles of the templates are as many as the templates have, so these broadcasts don't grow with the texts
    retrieved = at.join(F.broadcast(by_band), ["scale", "value"]).select("uid", "scale", "window", "template").distinct()
    held = near.select("uid", "scale", "window", "held").join(retrieved, ["uid", "scale", "window"]).join(F.broadcast(own.select("template", "m", "hs")), "template")
    n = F.size(F.array_intersect("held", "hs"))
    start = F.col("window") * F.greatest(F.lit(1), F.floor(F.col("scale") / 4)).cast("int")
    held = held.withColumn("n", n).where(F.col("n") >= F.ceil(F.col("m") * F.lit(containment) - 1e-9))
    places = F.filter(F.transform("held", lambda h, i: F.when(F.array_contains("hs", h), i)), lambda i: i.isNotNull())
    exact = held.withColumn("places", places).select("uid", "template", (F.col("n") / F.col("m")).alias("containment"), (start + F.array_min("places")).cast("int").alias("first"), (start + F.array_max("places") + SHINGLE - 1).cast("int").alias("last"))
    best = exact.groupBy("uid", "template").agg(F.max(F.struct("containment", (-F.col("first")).alias("o"), "first", "last")).alias("b"))
    per_row = best.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("template", "b.containment", "b.first", "b.last"))).alias("matches"))
    return rows.select("uid", "row").join(per_row, "uid", "left").select("row", F.coalesce("matches", empty).alias("matches"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "row.doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.transform("matches", lambda m: m["template"]), ",").alias("templates"),
        F.round(F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)), 6).alias("containment"),
    )


def _sql() -> str:
    quoted = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
    return rf"""
WITH t(template, text) AS (VALUES {quoted}),
tw AS (SELECT template, list_filter(regexp_split_to_array(lower(text), '[\x00-/:-`{{-\x7F]+'), lambda x: x <> '') AS w FROM t),
ts AS (SELECT DISTINCT template, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT template, w, unnest(range(1, len(w) - 3)) AS i FROM tw)),
tm AS (SELECT template, count(*) AS m, CAST(pow(2, ceil(log2(count(*)))) AS INT) AS c FROM ts GROUP BY template),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-/:-`{{-\x7F]+'), lambda x: x <> '') AS w FROM documents),
ds AS (SELECT doc_id, i - 1 AS pos, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
h AS (SELECT doc_id, pos, ds.g, template, m, c, greatest(1, c // 4) AS s FROM ds JOIN ts ON ds.g = ts.g JOIN tm USING (template)),
k AS (SELECT doc_id, template, m, g, unnest(range(CAST(greatest(0, ceil((pos - (c + s - 1) + 1) / s)) AS BIGINT), pos // s + 1)) AS k FROM h),
e AS (SELECT doc_id, template, m, k, count(DISTINCT g) AS n FROM k GROUP BY ALL HAVING count(DISTINCT g) >= 0.8 * m),
b AS (SELECT doc_id, template, max(n / m) AS containment FROM e GROUP BY ALL)
SELECT d.doc_id, count(template) AS n_matches, coalesce(string_agg(template, ',' ORDER BY template), '') AS templates, round(coalesce(max(containment), 0.0), 6) AS containment
FROM d LEFT JOIN b USING (doc_id) GROUP BY d.doc_id
"""


SQL = _sql()
