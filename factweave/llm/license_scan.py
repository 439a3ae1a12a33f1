"""License notices by MinHash bands over overlapping windows, verified by exact shingle containment.

DataFrame functions only. Texts and templates become words (lower case, a-z and 0-9) and shingles of WIDTH words.
Templates are put into classes by their number of shingles n (up to 1, 2, 4, 8, ...). Windows of a class have
ceil(1.5 n) shingles and start every ceil(n / 2), so that each occurrence lies whole in some window. A window retrieves
a template if they agree on one of BANDS bands of a single minimum hash each: at similarity s the chance of a miss is
(1 - s) ** BANDS; at the worst similarity of an occurrence (0.25) that is 1e-6. A retrieved template matches if the
window holds LEAST of its distinct shingles, compared as strings.

Two exact shortcuts leave out only what cannot match: a text without any anchor word of a template lacks more than
1 - LEAST of its shingles, and a window without any template shingle agrees on no band.

Null and empty texts match nothing. Rows that share a doc_id count as one document; each row without doc_id counts for
itself and appears with a null id. The templates are a parameter; read_templates() reads a folder of them. Notices that
share most of their words may both match the same place; containment tells which fits better.
"""

from __future__ import annotations

import re
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, BANDS, LEAST = 5, 48, 0.8
MOST_BROADCAST = 200_000

# Notices as their stewards publish them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MIT": "Released under the MIT License",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
        to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
        in the documentation and/or other materials provided with the distribution.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
        If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "BSD-3-Clause": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
        from this software without specific prior written permission.""",
    "LGPL-header": """under the terms of the GNU Lesser General Public License as published by the Free Software Foundation""",
    "AGPL-3.0-header": """under the terms of the GNU Affero General Public License as published by the Free Software Foundation""",
    "EPL-2.0": """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0
        which is available at https://www.eclipse.org/legal/epl-2.0/""",
    "CC0-1.0": """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software
        to the public domain worldwide. This software is distributed without any warranty.""",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
        for any damages arising from the use of this software.""",
}


def read_templates(spark: SparkSession, folder: str) -> dict[str, str]:
    """Templates from the text files of a folder, each named by its license."""
    rows = spark.read.text(folder, wholetext=True).select("_metadata.file_name", "value").collect()
    return {r["file_name"].rsplit(".", 1)[0]: r["value"] for r in rows}


def miss_probability(similarity: float, bands: int = BANDS) -> float:
    return (1 - similarity) ** bands


def plain_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def plain_shingles(text: str, width: int = WIDTH) -> list[str]:
    """Distinct shingles in order; fewer words than width make one."""
    w = plain_words(text)
    return list(dict.fromkeys(" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))) if w else []


def anchors(templates: dict[str, str], least: float = LEAST) -> list[str]:
    """Words such that any text that holds `least` of the shingles of a template holds one of them."""
    out: set[str] = set()
    for text in templates.values():
        shingles = [set(s.split()) for s in plain_shingles(text)]
        need = (1 - least) * len(shingles) + 1e-9
        covered = sum(bool(s & out) for s in shingles)
        while shingles and covered <= need:
            rest = [s for s in shingles if not s & out]
            choice = {w for s in rest for w in s}
            out.add(max(choice, key=lambda w: (min(sum(w in s for s in rest), need + 1 - covered) * len(w) ** 2, w)))
            covered = sum(bool(s & out) for s in shingles)
    return sorted(out)


def _once(array: Column) -> Column:
    """The array, marked so that the optimizer computes it once a row: put into a filter it would be computed for each element."""
    return F.when(F.spark_partition_id() >= 0, array)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _shingles(words: Column) -> Column:
    n = F.greatest(F.size(words) - WIDTH + 1, F.least(F.size(words), F.lit(1)))
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(words, i, F.lit(WIDTH)), " "))


def _signature(hashes: Column) -> Column:
    def low(k: int) -> Column:
        return F.array_min(F.transform(hashes, lambda x: F.xxhash64(x, F.lit(k))))

    return F.array(*[F.struct(F.lit(k).alias("band"), low(k).alias("low")) for k in range(BANDS)])


def _spots(size: int, long: int, step: int, before: int) -> Column:
    """The windows of a class that hold one of the places, each with its own words and shingle hashes, so that no window carries the whole text."""
    numbers = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(F.greatest(F.floor(p / step) - before + 1, F.lit(0)), F.floor(p / step)))))

    def window(w: Column) -> Column:
        start = (w * step).cast("int")
        words, h = F.slice("words", start + 1, F.lit(long + WIDTH - 1)), F.slice("h", start + 1, F.lit(long))
        return F.struct(F.lit(size).alias("size"), start.alias("start"), words.alias("words"), h.alias("h"))

    return F.transform(numbers, window)


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, containment, first_word, n_windows) of each match of each document."""
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    rows = [(name, s, len(s)) for name, s in ((n, plain_shingles(t)) for n, t in templates.items()) if s]
    listed = spark.createDataFrame(rows, "license string, shingles array<string>, n int")
    sizes = sorted({1 << max(0, (n - 1).bit_length()) for _, _, n in rows})
    bounds = F.array(*[F.lit(x) for x in sizes])
    listed = listed.withColumn("size", F.array_min(F.filter(bounds, lambda x: x >= F.col("n"))))
    keys = listed.select("license", "shingles", "n", "size", F.explode(_signature(F.transform("shingles", lambda x: F.xxhash64(x)))).alias("b")).select("license", "shingles", "n", "size", "b.*")
    if len(rows) * BANDS <= MOST_BROADCAST:
        keys = F.broadcast(keys)
    known = {x for _, s, _ in rows for x in s}
    hashes = [r[0] for r in spark.createDataFrame([(x,) for x in known], "x string").select(F.xxhash64("x")).collect()] if known else []
    lower = F.lower("text")
    hinted = F.lit(False)
    for word in anchors(templates):
        hinted = hinted | lower.contains(word)
    alone = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("row")
    cut = docs.select("doc_id", "text").where(F.coalesce(hinted, F.lit(False))).select("doc_id", alone, _once(_words(F.col("text"))).alias("words"))
    cut = cut.select("doc_id", "row", "words", _once(F.transform(_shingles(F.col("words")), lambda s: F.xxhash64(s))).alias("h"))
    places = F.filter(F.transform("h", lambda x, i: F.when(x.isin(hashes), i)), lambda i: i.isNotNull())
    cut = cut.withColumn("places", _once(places)).where(F.size("places") > 0)
    spots = []
    for size in sizes:
        long, step = ceil(1.5 * size), ceil(size / 2)
        spots.append(_spots(size, long, step, -(-long // step)))
    if not spots:
        return cut.select("doc_id", F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).alias("first_word"), F.lit(0).cast("long").alias("n_windows")).where("false")
    windows = cut.select("doc_id", "row", F.explode(F.concat(*spots)).alias("w")).select("doc_id", "row", "w.*").where(F.size("h") > 0)
    banded = windows.select("doc_id", "row", "size", "start", "words", F.explode(_signature(F.col("h"))).alias("b")).select("doc_id", "row", "size", "start", "words", "b.*")
    found = banded.join(keys, ["size", "band", "low"])
    share = F.size(F.array_intersect("shingles", _shingles(F.col("words")))) / F.col("n")
    checked = found.select("doc_id", "row", "license", "start", share.alias("containment")).where(F.col("containment") >= LEAST)
    got = checked.groupBy("doc_id", "row", "license").agg(F.max("containment").alias("containment"), F.min("start").alias("first_word"), F.count_distinct("start").alias("n_windows"))
    return got.drop("row")


def op3(spark, sf_dir) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
