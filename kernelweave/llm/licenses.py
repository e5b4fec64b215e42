"""Licence scans: TF-IDF cosine of headers and licence files to templates, then directory inheritance.

Only DataFrame functions. Of whole texts, without the marks of comments, these units are headers if they
hold a word of ``TRIGGER``: each line, each paragraph, each sentence of a paragraph, and each run of comment
lines; a file with a licence file's name is one unit more. Distinct headers are few, however many files
repeat them, so they are counted before they are shuffled, and weighted and compared once. The inverse
document frequencies are those of the headers of all files and of the templates. Templates are names and
SPDX lines by a rule, usual headers, titles, and whole licence texts.

A match has a cosine of ``LEAST`` or more, and the names and versions (``NAMES_OF``) of the header must
agree with the template's: a template whose name or version the header lacks does not match, nor one of
another licence than those the header names; so licences without a template give none. A file's
licence is that of its best match, whole texts before names. A file without one takes the licence of the
nearest directory above it that has a licence file, by equality joins of its ancestors' paths.

Defined results: null and empty texts have no licence of their own; a null path inherits nothing; of
equally similar templates, and of equally near licence files, the first by name counts; a header that names
two licences matches neither; repeated rows repeat their results; an empty table gives no rows; further
columns are not read.
"""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table, text_or_empty

LEAST = 0.6
TRIGGER = r"licen[sc]e|copyright|permission|redistribution|spdx|warrant|public domain"
LICENCE_FILE = r"^(licen[sc]e|copying|unlicense|notice)(\.\w+)?$"
MARK = r"^[ \t]*(//+!?|/\*+!?|\*+/?|#+|--+|;+|<!--+|rem\b|\"{3}|'{3})[ \t]*"
MARK_END = r"[ \t]*(\*+/|--+>|\"{3}|'{3})?[ \t\r]*$"
BROADCAST_BYTES = 32 << 20

#: Names by SPDX identifier.
NAMES = {
    "MIT": "MIT License",
    "Apache-1.1": "Apache Software License, Version 1.1",
    "Apache-2.0": "Apache License, Version 2.0",
    "GPL-1.0": "GNU General Public License, version 1",
    "GPL-2.0": "GNU General Public License, version 2",
    "GPL-3.0": "GNU General Public License, version 3",
    "LGPL-2.1": "GNU Lesser General Public License, version 2.1",
    "LGPL-3.0": "GNU Lesser General Public License, version 3",
    "AGPL-3.0": "GNU Affero General Public License, version 3",
    "BSD-2-Clause": "BSD 2-Clause License",
    "BSD-3-Clause": "BSD 3-Clause License",
    "MPL-1.1": "Mozilla Public License, version 1.1",
    "MPL-2.0": "Mozilla Public License, version 2.0",
    "EPL-1.0": "Eclipse Public License, version 1.0",
    "EPL-2.0": "Eclipse Public License, version 2.0",
    "CDDL-1.0": "Common Development and Distribution License CDDL, version 1.0",
    "EUPL-1.2": "European Union Public Licence EUPL, version 1.2",
    "Artistic-2.0": "Artistic License, version 2.0",
    "BSL-1.0": "Boost Software License, Version 1.0",
    "ISC": "ISC License",
    "Zlib": "zlib License",
    "Unlicense": "Unlicense",
    "WTFPL": "WTFPL",
    "CC0-1.0": "public domain under CC0 1.0",
}
NAMES |= {
    f"CC-BY{kind}-{version}": f"CC BY{kind} {version}"
    for kind, version in product(("", "-SA", "-NC", "-ND", "-NC-SA", "-NC-ND"), ("2.0", "2.5", "3.0", "4.0"))
}
PHRASES = ("Licensed under the {name}.", "This work is released under the {name}.", "{name}")

#: Usual headers and titles of public licences.
HEADERS = [
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("BSL-1.0", """Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy
at https://www.boost.org/LICENSE_1_0.txt)"""),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright under CC0 1.0, to the public domain."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse"),
]
GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} Public
License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any
later version."""
HEADERS += [
    (f"{short}GPL-{version}" + ("" if "." in version else ".0"), GNU.format(name=name, version=version))
    for short, name, version in (("", "General", "2"), ("", "General", "3"), ("L", "Lesser General", "2.1"), ("L", "Lesser General", "3"), ("A", "Affero General", "3"))
]

#: Whole licence texts.
AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT,
OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{third}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""
THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission. """
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software."""
FULL = [
    ("MIT", MIT),
    ("MIT", MIT + """ THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies. """ + AS_IS),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted. """ + AS_IS),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("BSD-2-Clause", BSD.format(third="")),
    ("BSD-3-Clause", BSD.format(third=THIRD)),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is
not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means."""),
]
TEMPLATES = [(name, phrase.format(name=text), False) for name, text in NAMES.items() for phrase in PHRASES]
TEMPLATES += [(name, f"SPDX-License-Identifier: {name}", False) for name in [*NAMES, "0BSD"]]
TEMPLATES += [(name, text, False) for name, text in HEADERS] + [(name, text, True) for name, text in FULL]

#: Terms that tell licences apart; with them go versions (a digit, or two as in 2p1).
NAMES_OF = """mit apache gnu gpl lgpl agpl lesser affero bsd 0bsd mpl mozilla epl eclipse cddl eupl artistic bsl boost isc zlib
unlicense wtfpl cc0 cc ccby ccbync ccbysa ccbynd ccbyncsa ccbyncnd ofl python php ruby perl oracle microsoft ncsa postgresql""".split()
VERSIONS = [str(d) for d in range(1, 10)] + [f"{a}p{b}" for a in range(1, 10) for b in range(1, 10)]
#: Same names and versions in one spelling, by patterns that both engines read alike.
SPELLINGS = [
    (r"\bcc[ -]by\b", "ccby"),
    (r"\bccby[ -](nc|sa|nd)\b", "ccby$1"),
    (r"\bccby(nc)[ -](sa|nd)\b", "ccby$1$2"),
    (r"\b([al]?gpl|mpl|epl|eupl|bsl|cc0)[-_]?v?([0-9])", "$1 $2"),
    (r"(?<![0-9.])v?([0-9])[.]0(?![0-9])", "$1"),
    (r"(?<![0-9.])v?([0-9])[.]([1-9])(?![0-9])", "$1p$2"),
    (r"\bv[.]? ?([0-9])\b", "$1"),
]


def plain(text: Column) -> Column:
    """Most texts hold neither of two signs without which no spelling has to change."""
    out = text = F.lower(text)
    for pattern, new in SPELLINGS:
        out = F.regexp_replace(out, pattern, new)
    return F.when(text.rlike("[0-9]") | text.contains("cc"), out).otherwise(text)


def plain_text(text: str) -> str:
    """What :func:`plain` does, for templates and tests."""
    text = text.lower()
    for pattern, new in SPELLINGS:
        text = re.sub(pattern, re.sub(r"\$(\d)", r"\\\1", new), text)
    return text


def names_in(text: str) -> set[str]:
    return set(re.split(r"[\W_]+", plain_text(text))) & {*NAMES_OF, *VERSIONS}


def allowed(licence: str) -> set[str]:
    """Names and versions that a header of the licence may hold: those of any of its templates."""
    return set().union(*(names_in(text) for name, text, full in TEMPLATES if name == licence and not full))


def terms(text: Column) -> Column:
    return F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bounded(df: DataFrame, width: int) -> DataFrame:
    """To be broadcast, if its rows of about ``width`` bytes are few enough."""
    return F.broadcast(df) if df.count() * width <= BROADCAST_BYTES else df


def units(rows: DataFrame) -> DataFrame:
    """The rows of (text in lower case, named, ..) with ``units``, their distinct headers; see the module's docstring.

    What several units are made of has a column of its own, so that it is made once.
    """
    triggered = lambda parts: F.filter(parts, lambda x: x.rlike(TRIGGER))
    ends = lambda x: x.contains("*/") | x.contains("-->") | x.contains('"""') | x.contains("'''")
    stripped = lambda x: F.regexp_replace(F.regexp_replace(x, MARK, ""), MARK_END, "")
    clean = lambda x: F.when(x.rlike(MARK) | ends(x), stripped(x)).otherwise(F.rtrim(x, F.lit(" \t\r")))
    rows = rows.withColumn("lines", F.split("text", "\n")).withColumn("bare", F.transform("lines", clean))
    marked = F.zip_with("lines", "bare", lambda x, y: F.when(x.rlike(MARK), y).otherwise(F.lit("\x01")))
    # nothing but the whole is a header where no word of a trigger is
    none, told = F.array().cast("array<string>"), F.col("text").rlike(TRIGGER)
    rows = rows.withColumn("whole", F.array_join("bare", "\n"))
    rows = rows.withColumn("paragraphs", F.when(told, triggered(F.split("whole", r"\n[ \t]*\n\s*"))).otherwise(none))
    runs = triggered(F.split(F.array_join(marked, "\n"), "[\x01\n]*\x01[\x01\n]*"))
    sentences = F.flatten(F.transform("paragraphs", lambda x: triggered(F.split(x, r"(?<=[.!?;])\s+"))))
    parts = F.when(told, F.concat(triggered(F.col("bare")), runs, "paragraphs", sentences)).otherwise(none)
    every = F.when(F.col("named"), F.array_append(parts, F.col("whole"))).otherwise(parts)
    spaced = F.transform(F.array_distinct(every), lambda x: F.regexp_replace(x, r"\s+", " "))
    rows = rows.withColumn("units", F.array_distinct(spaced))
    rows = rows.withColumn("units", F.array_distinct(F.transform("units", lambda x: F.trim(plain(x)))))
    return rows.drop("lines", "bare", "whole", "paragraphs")


def headers(files: DataFrame) -> DataFrame:
    """row, path, named, header: the units of all files."""
    lower = F.lower(text_or_empty())
    named = F.coalesce(F.regexp_extract(F.lower(F.element_at(F.split("path", "/"), -1)), LICENCE_FILE, 0) != "", F.lit(False))
    rows = files.select("row", "path", lower.alias("text"), named.alias("named")).where(F.col("text").rlike(TRIGGER) | F.col("named"))
    # "outer", as a filter for filled arrays would be pushed below the units and make them twice more
    return units(rows).select("row", "path", "named", F.explode_outer("units").alias("header")).where("header != ''")


def vectors(texts: DataFrame, idf: DataFrame, known: Column) -> DataFrame:
    """key, term, weight of (key, text): frequency times inverse document frequency."""
    counted = texts.select("key", F.explode(terms(F.col("text"))).alias("term")).groupBy("key", "term")
    weighted = counted.agg(F.count("*").alias("tf")).join(idf, "term", "left")
    weighted = weighted.withColumn("weight", F.col("tf") * F.coalesce("idf", known))
    return weighted.select("key", "term", "weight")


def similarities(distinct: DataFrame, least: float = LEAST) -> DataFrame:
    """header_key, licence, similarity, full for the distinct headers (header_key, header, n) that match a template."""
    spark = distinct.sparkSession
    every = [
        (k, name, plain_text(text), full, [] if full else sorted(names_in(text)), sorted(allowed(name)))
        for k, (name, text, full) in enumerate(TEMPLATES)
    ]
    schema = "key int, licence string, text string, full boolean, needs array<string>, allows array<string>"
    templates = spark.createDataFrame(every, schema)
    held = distinct.select("n", F.explode(F.array_distinct(terms(F.col("header")))).alias("term"))
    own = templates.select(F.lit(1).cast("long").alias("n"), F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    total = (distinct.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] or 0) + len(TEMPLATES)
    df = held.unionByName(own).groupBy("term").agg(F.sum("n").alias("df"))
    # only terms of templates count in a product; the others' weights are in the norms
    idf = durable(df.select("term", (F.log((1.0 + total) / (1 + F.col("df"))) + 1).alias("idf")))
    unknown = F.log(F.lit(1.0 + total)) + 1
    a = vectors(distinct.select(F.col("header_key").alias("key"), F.col("header").alias("text")), idf, unknown)
    b = vectors(templates.select("key", "text"), idf, unknown).withColumnsRenamed({"key": "template", "weight": "own"})
    norms = a.groupBy("key").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    own_norms = b.groupBy("template").agg(F.sqrt(F.sum(F.col("own") * F.col("own"))).alias("own_norm"))
    # all that is broadcast here is bounded by the templates' words
    dots = a.join(F.broadcast(b), "term").groupBy("key", "template").agg(F.sum(F.col("weight") * F.col("own")).alias("dot"))
    both = dots.join(norms, "key").join(F.broadcast(own_norms), "template")
    alike = F.round(F.col("dot") / (F.col("norm") * F.col("own_norm")), 9)
    both = both.withColumn("similarity", alike).where(F.col("similarity") >= least)
    both = both.join(F.broadcast(templates.drop("text").withColumnRenamed("key", "template")), "template")
    told = F.array_intersect(terms(F.col("header")), F.array(*map(F.lit, [*NAMES_OF, *VERSIONS])))
    names = distinct.select(F.col("header_key").alias("key"), told.alias("names"))
    both = both.join(names, "key")
    agree = (F.size(F.array_except("needs", "names")) == 0) & (F.col("full") | (F.size(F.array_except("names", "allows")) == 0))
    best = F.min(F.struct((~F.col("full")).alias("partly"), (-F.col("similarity")).alias("back"), "licence")).alias("best")
    return both.where(agree).groupBy("key").agg(best).select(
        F.col("key").alias("header_key"),
        F.col("best.licence").alias("licence"),
        (-F.col("best.back")).alias("similarity"),
        (~F.col("best.partly")).alias("full"),
    )


def directories(path: Column) -> Column:
    """Every directory above a path, the root "" included, by depth."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def scan(files: DataFrame, least: float = LEAST) -> DataFrame:
    """row, path, licence, similarity, origin (header, inherited, none) of every (row, path, text).

    ``row`` names a file; ``inherited_from`` is the directory whose licence file decided.
    """
    found = headers(files).withColumn("header_key", F.xxhash64("header"))
    slim = durable(found.select("row", "path", "named", "header_key"))
    distinct = durable(found.groupBy("header_key").agg(F.first("header").alias("header"), F.count("*").alias("n")))
    like = durable(similarities(distinct, least))
    best = F.min(F.struct((~F.col("full")).alias("partly"), (-F.col("similarity")).alias("back"), "licence", "path", "named")).alias("best")
    own = slim.join(bounded(like, 64), "header_key").groupBy("row").agg(best)
    own = durable(own.select("row", F.col("best.path").alias("path"), F.col("best.named").alias("named"), F.col("best.licence").alias("licence"), (-F.col("best.back")).alias("similarity")))

    parent = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    first = F.min(F.struct("path", "licence", "similarity")).alias("first")
    by_directory = own.where("named").groupBy(parent.alias("directory")).agg(first)
    by_directory = durable(by_directory.select("directory", F.col("first.licence").alias("passed"), F.col("first.similarity").alias("passed_similarity")))
    names = files.select("row", "path")
    bare = names.join(bounded(own.select("row"), 64), "row", "left_anti")
    above = bare.select("row", F.posexplode(directories(F.col("path"))).alias("depth", "directory"))
    above = above.join(bounded(by_directory, 160), "directory")
    nearest = above.groupBy("row").agg(F.max(F.struct("depth", "directory", "passed", "passed_similarity")).alias("near"))

    mine = own.select("row", "licence", "similarity", F.lit("header").alias("origin"), F.lit(None).cast("string").alias("inherited_from"))
    theirs = nearest.select(
        "row",
        F.col("near.passed").alias("licence"),
        F.col("near.passed_similarity").alias("similarity"),
        F.lit("inherited").alias("origin"),
        F.col("near.directory").alias("inherited_from"),
    )
    decided = durable(mine.unionByName(theirs))
    out = names.join(bounded(decided, 160), "row", "left")
    return out.withColumn("origin", F.coalesce("origin", F.lit("none")))


def tree(docs: DataFrame) -> DataFrame:
    """The documents as a tree of files: by source, by hundreds and by tens of ids; ids that end in 0 are licence files."""
    name = F.when(F.col("doc_id") % 10 == 0, F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    place = [F.coalesce("source", F.lit("none")), F.floor(F.col("doc_id") / 100).cast("string"), F.floor(F.col("doc_id") / 10).cast("string")]
    path = F.concat(place[0], F.lit("/"), place[1], F.lit("/"), place[2], F.lit("/"), name)
    return docs.select("doc_id", F.struct("doc_id", F.xxhash64(text_or_empty())).alias("row"), path.alias("path"), "text")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(tree(table(spark, sf_dir, "documents"))).select(F.col("row.doc_id").alias("doc_id"), "path", "licence", "similarity", "origin", "inherited_from")
