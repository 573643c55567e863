"""License scans: MinHash bands over overlapping text windows retrieve license notices, containment verifies them.

DataFrame functions only. Words are runs of ``[a-z0-9]`` of the lower-cased text; a shingle is the hash of three in a
row. Templates are put in classes by length: those of at most S words meet windows of 2 S words that begin every S
words, so an occurrence lies whole in one window at least. For a template whose share ``LEAST`` of shingles is in a
window, the Jaccard similarity is at least ``LEAST * |T| / (|W| + (1 - LEAST) * |T|)``; a class has as many bands of one
MinHash value as bring the chance to miss its shortest template under ``MISS``. Templates may be of any length: classes
go on by halves again. A band agrees where the least hash of the window is that of a shingle of the template, so a window
without any shingle of a template meets none; only windows with one are hashed, which changes nothing in what is retrieved.

Retrieved pairs are verified by exact containment: the share of the template's shingles that the window has.

The templates are few and fixed, so their tables are bounded and broadcast. Windows never leave the row's task before
the result is aggregated by document and license, so a hot document or license costs no more than its own windows.

Null and empty texts, and texts under three words, have no match and no row. Several occurrences give one row, with the
best containment, the first window that reaches it and the number of windows that match. Repeated rows with one id are
taken together as one document. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 3
LEAST, MISS = 0.8, 1e-4
#: Notices by SPDX identifier; fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may"
        " obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "MIT": "Released under the MIT License",
    "MIT text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the"
        " Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,"
        " distribute, sublicense, and/or sell copies of the Software"
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by"
        " the Free Software Foundation"
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "BSD text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    ),
    "MIT full text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the"
        " Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,"
        " distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to"
        " the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions"
        " of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE"
        " WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE"
        " LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN"
        " CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC full text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the"
        " above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL"
        " WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE"
        " LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,"
        " WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS"
        " SOFTWARE."
    ),
    "BSD-2-Clause full text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are"
        " met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2."
        " Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the"
        " documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS"
        " AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A"
        " PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,"
        " SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,"
        " DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT"
        " (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
#: Most words of the templates of the first two classes; each further one has twice those of the one but one before it.
CLASSES = (6, 8)


def class_of(words: int) -> int:
    """Most words of the class that a template of ``words`` words is in: 6, 8, 12, 16, 24, 32 and so on."""
    a, b = CLASSES
    while words > a:
        a, b = b, 2 * a
    return a


def _words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def bands(words: int, size: int) -> int:
    """Bands of one value for windows of ``2 * size`` words and templates of at least ``words`` words."""
    t, w = words - SIZE + 1, 2 * size - SIZE + 1
    similarity = LEAST * t / (w + (1 - LEAST) * t)
    return math.ceil(math.log(MISS) / math.log(1 - similarity))


def templates(spark, texts: dict[str, str] | None = None) -> tuple[DataFrame, dict[int, int]]:
    """Rows ``license, size, shingles`` of the templates, and bands by class size."""
    rows, shortest = [], {}
    for name, text in sorted((TEMPLATES if texts is None else texts).items()):
        found = _words(text)
        if len(found) < SIZE:
            raise ValueError(f"{name}: a template has {SIZE} words at least")
        size = class_of(len(found))
        rows.append((name, size, found))
        shortest[size] = min(shortest.get(size, len(found)), len(found))
    table = spark.createDataFrame(rows, "license string, size int, words array<string>")
    return table.select("license", "size", F.array_distinct(_shingles("words")).alias("shingles")), {s: bands(n, s) for s, n in shortest.items()}


def _shingles(words: str):
    at = F.sequence(F.lit(0), F.size(words) - SIZE)
    hashed = F.transform(at, lambda i: F.xxhash64(*(F.get(F.col(words), i + k) for k in range(SIZE))))
    return F.when(F.size(words) >= SIZE, hashed).otherwise(F.array().cast("array<bigint>"))


def _once(column):
    """``column``, evaluated where it stands: the optimizer copies no nondeterministic expression into later ones."""
    return F.when(F.monotonically_increasing_id() >= 0, column)


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", texts: dict[str, str] | None = None) -> DataFrame:
    """``id_column, license, containment, first_word, n_windows`` for every document and license it contains.

    ``first_word``: first word (from 0) of the window of the best containment, the earliest of several.
    """
    spark = docs.sparkSession
    table, many = templates(spark, texts)
    known = table.select(F.explode("shingles").alias("s")).distinct().collect()  # bounded: shingles of the templates
    literals = [r["s"] for r in known]
    words = F.filter(F.split(F.regexp_replace(F.lower(F.col(text_column)), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    read = docs.select(F.col(id_column).alias("id"), _once(words).alias("words")).select("id", _once(_shingles("words")).alias("h"))
    hits = F.filter(F.transform("h", lambda x, i: F.when(x.isin(literals), i)), lambda i: i.isNotNull())
    read = read.select("id", "h", _once(hits).alias("hits")).where(F.size("hits") > 0)

    def windows_of(size: int, count: int):
        """Windows of a class that have a hit: structs of class size, first word and bands."""
        starts = F.flatten(F.transform("hits", lambda p: F.array(F.floor(p / size).cast("int"), F.floor(p / size).cast("int") - 1)))
        held = F.filter(F.array_distinct(starts), lambda j: j >= 0)
        return F.transform(held, lambda j: F.struct(F.lit(size).alias("size"), (j * size).alias("start"), F.lit(count).alias("bands")))

    per_class = [windows_of(size, count) for size, count in sorted(many.items())]
    windows = read.select("id", "h", F.explode(_once(F.flatten(F.array(*per_class)))).alias("w"))
    windows = windows.select("id", "w.size", "w.start", "w.bands", F.array_distinct(F.slice("h", F.col("w.start") + 1, 2 * F.col("w.size") - SIZE + 1)).alias("shingles"))

    def signature(count):
        return F.transform(F.sequence(F.lit(1), count), lambda b: F.struct(b.alias("band"), F.array_min(F.transform("shingles", lambda x: F.xxhash64(x, b))).alias("least")))

    sizes = F.create_map(*(F.lit(x) for pair in sorted(many.items()) for x in pair))
    held = table.withColumn("sig", F.explode(signature(sizes[F.col("size")]))).select("license", "size", "sig.band", "sig.least", F.col("shingles").alias("wanted"))
    banded = windows.withColumn("sig", F.explode(signature(F.col("bands")))).select("id", "size", "start", "shingles", "sig.band", "sig.least")
    pairs = banded.join(F.broadcast(held), ["size", "band", "least"])
    share = F.size(F.array_intersect("wanted", "shingles")) / F.size("wanted")
    checked = pairs.select("id", "license", "start", share.alias("containment")).where(F.col("containment") >= LEAST)
    best = checked.groupBy("id", "license").agg(F.max(F.struct("containment", -F.col("start"))).alias("best"), F.count_distinct("start").alias("n_windows"))
    return best.select(F.col("id").alias(id_column), "license", "best.containment", (-F.col("best.col2")).cast("int").alias("first_word"), "n_windows")
