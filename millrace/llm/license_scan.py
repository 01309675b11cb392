"""License scan: MinHash bands over overlapping text windows find templates, exact shingle containment confirms.

A template is a license notice as words; its shingles are its runs of five words (all its words, if it has fewer).
A text holds a template if at least 80 % of the template's shingles occur within a window of about its length. The
windows have the template's number of words and start at every eighth of that, so one lies within a sixteenth of
any occurrence; for it the similarity to the template is 0.6 at least, and 24 bands of two rows collide with a
probability above 1 - 0.64**24 = 0.99997. DataFrame functions only.

Only windows near an anchor are hashed, and of each length only those near an anchor that a template of this length
has. A template's anchors are words such that fewer than 80 % of its shingles are without any of them: a text without
anchors can't hold the template, so no case is lost.

Defined results: words are runs of letters and digits, lower-cased; null, empty and wordless texts hold nothing; very
long texts are scanned whole; the matches of rows that share an id come together under it, and each such row gets them;
rows with a null id are told apart by ``text_sha256``, which is null for all others; further columns are not read,
whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bounded_bytes, column, cut

WIDTH = 5
CONTAINED = 80
BANDS, ROWS = 24, 2

#: Public license notices by SPDX-like name; after the short ones whole license texts and file headers.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2",
    "LGPL-3.0": "licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0": "licensed under the GNU Affero General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-text": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "Proprietary": "All rights reserved",
    "MIT-full": """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the
        Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
        notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
        INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
        HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
        SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-2-Clause-full": """
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions
        of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
        above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS
        SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
        INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
        OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING
        IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause-endorsement": """
        Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific
        prior written permission.""",
    "ISC-full": """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
        and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
        WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH
        THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib-full": """
        This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this
        software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely,
        subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you
        use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly
        marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0-header": """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License
        at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License.""",
    "GPL-3.0-header": """
        This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
        Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
}


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def template_shingles(words: list[str]) -> list[str]:
    k = min(WIDTH, len(words))
    return sorted({" ".join(words[i : i + k]) for i in range(len(words) - k + 1)})


def anchors(templates: list[list[str]]) -> list[str]:
    """A few words, the longest first as they are rare, such that fewer than 80 % of each template's shingles are without any."""
    left = [[s.split() for s in template_shingles(w)] for w in templates]
    enough = [-(-CONTAINED * len(t) // 100) for t in left]
    chosen: list[str] = []
    while open_ones := [t for t, n in zip(left, enough, strict=True) if len(t) >= n]:
        word = max({w for t in open_ones for s in t for w in s}, key=lambda w: (len(w) > 9, len(w) > 6, sum(any(w in s for s in t) for t in open_ones), len(w), w))
        chosen.append(word)
        left = [[s for s in t if word not in s] for t in left]
    return chosen


def word_array(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def shingle_array(words: Column, width: Column) -> Column:
    """Distinct shingles of at least ``width`` words."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - width + 1), lambda i: F.array_join(F.slice(words, i, width), " ")))


def bands(shingles: Column) -> Column:
    """For each band the hash of its MinHash values, which are computed once, as the only element of an array."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(BANDS * ROWS - 1)), lambda k: F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, k))))

    def banded(r: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, *[F.element_at(r, b * ROWS + i + 1) for i in range(ROWS)]))

    return F.transform(F.array(rows), banded)[0]


def text_key(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_sha256, template, word, containment): each template that a document holds, the first word of its first window, and the share of shingles found."""
    spark = docs.sparkSession
    words = {name: w for name, text in templates.items() if (w := template_words(text))}
    marks = anchors(list(words.values()))

    def marked(low: Column) -> Column:
        hit = F.lit(False)
        for a in marks:
            hit = hit | F.contains(low, F.lit(a))
        return hit

    # The text is lowered once, as the only element of an array; what is left is a small part of the corpus.
    some = F.exists(F.array(F.lower(F.col("text"))), marked)
    slim = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text")).where(F.coalesce(some, F.lit(False)))
    slim = slim.select("doc_id", F.when(F.col("doc_id").isNull(), text_key(F.col("text"))).alias("text_sha256"), word_array(F.col("text")).alias("words"))
    slim = slim.withColumn("at", F.filter(F.transform("words", lambda w, i: F.when(w.isin(marks), F.struct(w.alias("word"), i.alias("i")))), lambda x: x.isNotNull()))

    table = spark.createDataFrame([(name, len(w), template_shingles(w)) for name, w in words.items()], "template string, length int, wanted array<string>")
    table = table.select("template", "length", "wanted", F.explode(bands(F.col("wanted"))).alias("band"))

    def marks_of(n: int) -> Column:
        own = {x for w in words.values() if len(w) == n for x in w}
        return F.array(*[F.lit(a) for a in marks if a in own])

    kinds = [F.struct(F.lit(n).alias("length"), F.lit(max(1, n // 8)).alias("stride"), F.lit(min(WIDTH, n)).alias("width"), marks_of(n).alias("marks")) for n in sorted({len(w) for w in words.values()})]
    each = slim.select("doc_id", "text_sha256", "words", "at", F.explode(F.array(*kinds)).alias("kind")).select("*", "kind.*")
    length, stride = F.col("length"), F.col("stride")
    mine = F.transform(F.filter("at", lambda x: F.array_contains(F.col("marks"), x["word"])), lambda x: x["i"])
    places = F.transform(mine, lambda i: F.transform(F.sequence(F.greatest(F.floor((i - length - stride) / stride), F.lit(0)), F.floor(i / stride)), lambda s: (s * stride + 1).cast("int")))
    window = F.transform(F.array_distinct(F.flatten(places)), lambda s: F.struct(s.alias("word"), F.slice("words", s, length).alias("body"), F.slice("words", F.greatest(s - stride, F.lit(1)), length + 2 * stride).alias("around")))
    rows = each.select("doc_id", "text_sha256", "length", "width", F.explode(window).alias("w")).where(F.size("w.body") >= F.col("width"))
    rows = rows.select("doc_id", "text_sha256", "length", "w.word", shingle_array(F.col("w.body"), F.col("width")).alias("body"), shingle_array(F.col("w.around"), F.col("width")).alias("around"))
    banded = rows.select("doc_id", "text_sha256", "length", "word", "around", F.explode(bands(F.col("body"))).alias("band"))
    hits = banded.join(bounded_bytes(table, 48 * F.size("wanted")), ["length", "band"])
    share = F.size(F.array_intersect("around", "wanted")) / F.size("wanted")
    hits = hits.select("doc_id", "text_sha256", "template", "word", share.alias("containment")).where(F.col("containment") * 100 >= CONTAINED)
    return hits.groupBy("doc_id", "text_sha256", "template").agg(F.min("word").alias("word"), F.max("containment").alias("containment"))


def op8_license_scan(docs: DataFrame) -> DataFrame:
    found = cut(scan_licenses(docs)).groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n_licenses"), F.array_join(F.array_sort(F.collect_set("template")), ",").alias("licenses"))
    known, nameless = F.col("doc_id").isNotNull(), F.col("doc_id").isNull()
    by_id = docs.where(known).select("doc_id").join(found.where(known).drop("text_sha256"), "doc_id", "left")
    # The text is read once more only where there is no id.
    by_text = docs.where(nameless).select("doc_id", text_key(F.col("text")).alias("text_sha256")).join(found.where(nameless).drop("doc_id"), "text_sha256", "left")
    out = by_id.unionByName(by_text.drop("text_sha256"))
    return out.select("doc_id", F.coalesce("n_licenses", F.lit(0)).cast("long").alias("n_licenses"), F.coalesce("licenses", F.lit("")).alias("licenses"))


def _sql() -> str:
    rows = []
    for name, text in TEMPLATES.items():
        w = template_words(text)
        shingles = template_shingles(w)
        rows += [f"('{name}', '{s}', {len(shingles)}, {len(w)}, {min(WIDTH, len(w))}, {max(1, len(w) // 8)})" for s in shingles]
    return f"""
WITH t(template, shingle, total, len_t, width, stride) AS (VALUES {", ".join(rows)}
), d AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), sha256(text)) AS doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL
), x AS (
  SELECT doc_id, width, p, array_to_string(w[p : p + width - 1], ' ') AS shingle
  FROM d, (SELECT DISTINCT width FROM t), LATERAL (SELECT unnest(range(1, greatest(0, len(w) - width + 1) + 1)) AS p)
), hits AS (SELECT DISTINCT doc_id, template, total, len_t, t.width, stride, p, t.shingle FROM x JOIN t ON x.shingle = t.shingle AND x.width = t.width
), placed AS (
  SELECT *, k * stride + 1 AS s FROM hits, LATERAL (SELECT unnest(range(greatest(0, (p - len_t - 3 * stride) // stride), (p + stride) // stride + 2)) AS k)
), within AS (
  SELECT doc_id, template, total, s, count(DISTINCT shingle) AS n FROM placed
  WHERE p >= greatest(s - stride, 1) AND p + width <= greatest(s - stride, 1) + len_t + 2 * stride GROUP BY doc_id, template, total, s
), found AS (
  SELECT doc_id, count(*) AS n, string_agg(template, ',' ORDER BY template) AS names
  FROM (SELECT DISTINCT doc_id, template FROM within WHERE 100 * n >= {CONTAINED} * total) GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_licenses, coalesce(names, '') AS licenses FROM (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), sha256(text)) AS k FROM documents) LEFT JOIN (SELECT doc_id AS k, n, names FROM found) USING (k)
"""


OP8_SQL = _sql()
