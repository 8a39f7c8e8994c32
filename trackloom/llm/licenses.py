"""Licence of every file: TF-IDF cosine of its headers and licence files to templates, else the nearest ancestor's.

Candidates of a file are, widest first, its whole text if it is named like a licence file (LICENSE, LICENCE,
UNLICENSE or COPYING, endings such as -MIT or .txt included), its blocks, and its single lines. A block is a run
of adjacent lines that are not blank and either all begin with a comment sign or all do not, so a header in
comments is one block and a paragraph of plain text is one. Blocks and lines count if they name a licence.
Word weights are term frequency times log((1 + candidates) / (1 + candidates with the word)) + 1 over the
distinct candidates of all files. Each licence has several templates: notices, titles, SPDX tags, standard
headers, short full texts. A file takes the template most like its widest candidates that have any with a cosine
of at least ``least``. A file that has none inherits from the nearest directory above it (its own first) with a
licence file that has a licence of its own. Only DataFrame functions are used.

Null and empty texts have no header; a file with null path can have a header, but inherits nothing. Ties of
candidates and templates go to the smaller name; of several licence files in a directory the best counts.
Texts of any length are compared whole. Repeated rows are all kept; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, keyed, materialize

LEAST = 0.8
CUE = r"(?i)licen[sc]e|copyright|spdx|public domain"
WORD = r"(?:spdx:)?[a-z0-9]+(?:[.-][a-z0-9]+)*"
TAG = r"spdx-license-identifier:[ \t]*"
LICENCE_FILE = r"(?i)^(?:(?:un)?licen[sc]e|copying)(?:[._-][a-z0-9]+)*$"
_BLANK, _SIGNS = r" \t\r\f\x0B", r"/#*;%<-"
_COMMENT = rf"[{_BLANK}]*[{_SIGNS}][^\n]*"
_PLAIN = rf"[{_BLANK}]*[^{_BLANK}\n{_SIGNS}][^\n]*"
#: Runs of lines of one kind; lines end at \n only, and a run is taken without steps back, so its length costs no stack.
BLOCK = rf"(?md)^{_COMMENT}(?:\n{_COMMENT})*+|^{_PLAIN}(?:\n{_PLAIN})*+"

#: Licence notices as they are written in headers.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-2.1": "This library is free software under the GNU Lesser General Public License, version 2.1.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


#: Titles as licence files carry them; without a version only the family is known.
TITLES = [
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache", "Apache License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", 'The 2-Clause BSD License (Simplified BSD License, "FreeBSD License")'),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", 'The 3-Clause BSD License (New BSD License, "Modified BSD License")'),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International"),
    ("GPL", "GNU GENERAL PUBLIC LICENSE"),
    ("GPL", "Licensed under the GNU General Public License"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", "ISC License"),
    ("ISC", "Licensed under the ISC license"),
    ("LGPL", "GNU LESSER GENERAL PUBLIC LICENSE"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Licensed under the MIT license"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "The Unlicense"),
]

_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""
_GNU = """This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by
the Free Software Foundation, either version {version} of the License, or (at your option) any later version."""
_GNU_REST = """This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received
a copy of the GNU {name} along with this {what}. If not, see <https://www.gnu.org/licenses/>."""
_FAMILY = [("AGPL-3.0", "program", "Affero General Public License", "3"), ("GPL-2.0", "program", "General Public License", "2"),
           ("GPL-3.0", "program", "General Public License", "3"), ("LGPL-2.1", "library", "Lesser General Public License", "2.1"),
           ("LGPL-3.0", "library", "Lesser General Public License", "3")]

#: Standard headers and short full texts.
TEXTS = [
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations
under the License."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at"""),
    ("BSD-2-Clause", f"{_BSD_2} {_AS_IS}"),
    ("BSD-3-Clause", f"{_BSD_2} {_BSD_3} {_AS_IS}"),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE
AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING
FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT
OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means."""),
]


def notices(more: tuple[tuple[str, str], ...] = ()) -> list[tuple[str, str]]:
    """All templates as (license, text), with `more` of the caller's, such as long full texts."""
    tags = {*TEMPLATES, *(k for k, _ in TITLES if "-" in k or k in ("ISC", "MIT"))}
    spdx = [(k, f"SPDX-License-Identifier: {k}{end}") for k in sorted(tags) for end in ("", *(("-only", "-or-later") if "GPL" in k else ()))]
    gnu = [(k, text.format(what=what, name=name, version=version)) for k, what, name, version in _FAMILY for text in (_GNU, f"{_GNU} {_GNU_REST}")]
    return sorted({*TEMPLATES.items(), *TITLES, *TEXTS, *spdx, *gnu, *more})


def _words(text):
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), TAG, "spdx:"), F.lit(WORD), F.lit(0))


def similar_texts(texts: DataFrame, least: float = LEAST, more: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """`key, license, similarity` of distinct candidate texts (key, text, n: how often) near a template."""
    spark = texts.sparkSession
    rows = [(i, k, text) for i, (k, text) in enumerate(notices(more))]
    templates = spark.createDataFrame(rows, "notice int, license string, text string")
    words = materialize(texts.select("key", "n", F.explode(_words("text")).alias("word"))
                             .groupBy("key", "n", "word").agg(F.count("*").alias("tf")), "licence-words")
    total = texts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).scalar()
    common = words.groupBy("word").agg(F.sum("n").alias("df"))
    idf = F.log((1 + total) / (1 + F.coalesce("df", F.lit(0)))) + 1
    wanted = (templates.select("notice", "license", F.explode(_words("text")).alias("word")).groupBy("notice", "license", "word")
              .agg(F.count("*").alias("tf")).join(common, "word", "left").select("notice", "license", "word", (F.col("tf") * idf).alias("b")))
    wanted = materialize(wanted, "licence-templates")           # the words of the templates alone, whatever the corpus holds
    sizes = wanted.groupBy("notice").agg(F.sqrt(F.sum(F.col("b") * F.col("b"))).alias("b_norm"))
    known = wanted.select("word", F.lit(True).alias("known")).distinct()
    weighed = (words.join(common, "word").join(F.broadcast(known), "word", "left")
               .select("key", "word", "known", (F.col("tf") * idf).alias("a")))
    square = F.col("a") * F.col("a")
    # a cosine is at most the share of a text's length that lies in words of the templates: most texts end here
    norm = weighed.groupBy("key").agg(F.sqrt(F.sum(square)).alias("a_norm"), F.sqrt(F.sum(F.when(F.col("known"), square))).alias("shared"))
    norm = norm.filter(F.col("shared") >= (least - 1e-5) * F.col("a_norm")).drop("shared")
    dots = (weighed.filter("known").join(norm, "key").join(F.broadcast(wanted), "word")
            .groupBy("key", "notice", "license", "a_norm").agg(F.sum(F.col("a") * F.col("b")).alias("dot")))
    near = dots.join(F.broadcast(sizes), "notice").select(
        "key", "license", F.round(F.col("dot") / (F.col("a_norm") * F.col("b_norm")), 6).alias("similarity"))
    return near.filter(F.col("similarity") >= least).groupBy("key").agg(
        F.min(F.struct((-F.col("similarity")).alias("s"), "license")).alias("b")).select("key", "b.license", (-F.col("b.s")).alias("similarity"))


def _candidates(text, path):
    """The distinct texts of a file to compare, each with the widest kind it has: whole 0, block 1, line 2."""
    named = F.element_at(F.split(path, "/"), -1).rlike(LICENCE_FILE)
    whole = F.when(named & (text != ""), F.array(text)).otherwise(F.array().cast("array<string>"))
    cued = [F.when(text.rlike(CUE), F.filter(parts, lambda x: x.rlike(CUE))).otherwise(F.array().cast("array<string>"))
            for parts in (F.regexp_extract_all(text, F.lit(BLOCK), F.lit(0)), F.split(text, "\n", -1))]
    blocks, lines = cued
    kinds = [whole, F.array_except(blocks, whole), F.array_except(F.array_except(lines, blocks), whole)]

    def marked(parts, kind):
        return F.transform(parts, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("text")))

    return F.concat(*[marked(parts, i) for i, parts in enumerate(kinds)])


def licenses(files: DataFrame, least: float = LEAST, more: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """`path, license, similarity, origin, source` of every row of `files` (path, text, and doc_id if there is
    one); origin is header, inherited or none, source the directory inherited from. `more` adds templates."""
    names = ["doc_id"] if "doc_id" in files.columns else []
    parts = _candidates(F.coalesce(F.col("text"), F.lit("")), F.col("path"))
    rows = materialize(keyed(files.select(*names, "path", parts.alias("parts")), *names, "path", "parts"), "licence-parts")
    each = rows.filter(F.size("parts") > 0).select(ROW, F.inline("parts")).withColumn("key", F.unhex(F.sha2("text", 256)))
    scored = similar_texts(materialize(each.groupBy("key").agg(F.count("*").alias("n"), F.first("text").alias("text")), "licence-texts"), least, more)
    own = each.select(ROW, "kind", "key").join(scored, "key").groupBy(ROW).agg(
        F.min(F.struct("kind", (-F.col("similarity")).alias("s"), "license")).alias("b"))
    named = rows.drop("parts").join(own, ROW, "left").select(*names, "path", F.col("b.license").alias("own"), (-F.col("b.s")).alias("similarity"))
    folder = F.when(F.contains("path", F.lit("/")), F.regexp_extract("path", "^(.*)/[^/]*$", 1)).otherwise(F.when(F.col("path").isNotNull(), ""))
    named = materialize(named.withColumn("folder", folder), "licence-files")

    holds = named.filter(F.element_at(F.split("path", "/"), -1).rlike(LICENCE_FILE) & F.col("own").isNotNull()).groupBy("folder").agg(
        F.min(F.struct((-F.col("similarity")).alias("s"), "own")).alias("b")).select(F.col("folder").alias("source"), F.col("b.own").alias("from_above"), (-F.col("b.s")).alias("its"))
    folders = named.filter("folder IS NOT NULL").select("folder").distinct()
    parts = F.split("folder", "/")
    above = folders.select("folder", F.explode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))).alias("source"))
    nearest = above.distinct().join(holds, "source").groupBy("folder").agg(F.max(F.struct(F.length("source").alias("depth"), "source", "from_above", "its")).alias("h"))
    return named.join(nearest, "folder", "left").select(
        *names, "path", F.coalesce("own", "h.from_above").alias("license"), F.coalesce("similarity", "h.its").alias("similarity"),
        F.when(F.col("own").isNotNull(), "header").when(F.col("h").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(F.col("own").isNull(), F.col("h.source")).alias("source"))


def sql(files: str, least: float = LEAST) -> str:
    """The same rows for DuckDB over a query that gives doc_id, path and text."""
    values = ", ".join(f"({i}, '{k}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (k, text) in enumerate(notices()))
    block = BLOCK.replace("(?md)", "(?m)").replace("*+", "*")     # the same runs where there are no steps back anyway

    def words(text):
        return f"unnest(regexp_extract_all(regexp_replace(lower({text}), '{TAG}', 'spdx:', 'g'), '{WORD}'))"

    return f"""
WITH files AS MATERIALIZED (SELECT *, row_number() OVER () AS r FROM ({files})),
parts AS MATERIALIZED (
  SELECT r, part, min(kind) AS kind FROM (
    SELECT r, 0 AS kind, text AS part FROM files WHERE text <> '' AND regexp_matches(regexp_extract(path, '([^/]*)$', 1), '{LICENCE_FILE}')
    UNION ALL SELECT r, 1, unnest(regexp_extract_all(text, '{block}')) FROM files WHERE regexp_matches(text, '{CUE}')
    UNION ALL SELECT r, 2, unnest(string_split(text, chr(10))) FROM files WHERE regexp_matches(text, '{CUE}'))
  WHERE kind = 0 OR regexp_matches(part, '{CUE}') GROUP BY r, part),
seen AS MATERIALIZED (SELECT part, count(*) AS n FROM parts GROUP BY part),
total AS (SELECT coalesce(sum(n), 0) AS total FROM seen),
words AS MATERIALIZED (SELECT part, n, word, count(*) AS tf FROM (SELECT part, n, {words('part')} AS word FROM seen) GROUP BY ALL),
common AS (SELECT word, sum(n) AS df FROM words GROUP BY word),
notices AS MATERIALIZED (
  SELECT notice, license, word, tf * (ln((1 + total) / (1 + coalesce(df, 0))) + 1) AS b
  FROM (SELECT notice, license, word, count(*) AS tf FROM (SELECT notice, license, {words('text')} AS word
        FROM (VALUES {values}) v(notice, license, text)) GROUP BY ALL) LEFT JOIN common USING (word), total),
weighed AS MATERIALIZED (SELECT part, word, tf * (ln((1 + total) / (1 + df)) + 1) AS a FROM words JOIN common USING (word), total),
near AS (
  SELECT part, license, round(dot / (a_norm * b_norm), 6) AS similarity
  FROM (SELECT part, notice, license, sum(a * b) AS dot FROM weighed JOIN notices USING (word) GROUP BY ALL)
  JOIN (SELECT part, sqrt(sum(a * a)) AS a_norm FROM weighed GROUP BY part) USING (part)
  JOIN (SELECT notice, sqrt(sum(b * b)) AS b_norm FROM notices GROUP BY notice) USING (notice)),
own AS (
  SELECT r, license AS own, similarity FROM parts JOIN near USING (part) WHERE similarity >= {least}
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY kind, similarity DESC, license) = 1),
named AS (
  SELECT doc_id, path, own, similarity,
         CASE WHEN path LIKE '%/%' THEN regexp_extract(path, '^(.*)/[^/]*$', 1) WHEN path IS NOT NULL THEN '' END AS folder
  FROM files LEFT JOIN own USING (r)),
holds AS (
  SELECT folder AS source, own AS from_above, similarity AS its FROM named
  WHERE own IS NOT NULL AND regexp_matches(regexp_extract(path, '([^/]*)$', 1), '{LICENCE_FILE}')
  QUALIFY row_number() OVER (PARTITION BY folder ORDER BY similarity DESC, own) = 1),
nearest AS (
  SELECT folder, source, from_above, its FROM (SELECT DISTINCT folder FROM named) JOIN holds
    ON source = '' OR folder = source OR starts_with(folder, source || '/')
  QUALIFY row_number() OVER (PARTITION BY folder ORDER BY length(source) DESC) = 1)
SELECT doc_id, path, coalesce(own, from_above) AS license, coalesce(similarity, its) AS similarity,
       CASE WHEN own IS NOT NULL THEN 'header' WHEN from_above IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       CASE WHEN own IS NULL THEN source END AS source
FROM named LEFT JOIN nearest USING (folder)
"""
