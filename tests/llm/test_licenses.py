import math
import re
from collections import Counter

from kernelweave.llm import licenses


def words(text):
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def units(text, named):
    lines = text.split("\n")
    bare = [re.sub(licenses.MARK_END, "", re.sub(licenses.MARK, "", x)) for x in lines]
    marked = [y if re.search(licenses.MARK, x) else "\x01" for x, y in zip(lines, bare)]
    runs = re.split("[\x01\n]*\x01[\x01\n]*", "\n".join(marked))
    paragraphs = [p for p in re.split(r"\n[ \t]*\n\s*", "\n".join(bare)) if re.search(licenses.TRIGGER, p)]
    sentences = [x for p in paragraphs for x in re.split(r"(?<=[.!?;])\s+", p)]
    every = [x for x in [*bare, *runs, *paragraphs, *sentences] if re.search(licenses.TRIGGER, x)]
    every += ["\n".join(bare)] if named else []
    return {licenses.plain_text(re.sub(r"\s+", " ", x)).strip() for x in every} - {""}


def brute(files):
    found = {}
    for row, path, text in files:
        name = (path or "").rpartition("/")[2].lower()
        named = bool(re.match(licenses.LICENCE_FILE, name))
        found[row] = units((text or "").lower(), named), named
    every = [x for lines, _ in found.values() for x in lines] + [licenses.plain_text(t) for _, t, _ in licenses.TEMPLATES]
    df = Counter(w for u in every for w in set(words(u)))
    idf = {w: math.log((1 + len(every)) / (1 + n)) + 1 for w, n in df.items()}

    def vector(text):
        return {w: n * idf[w] for w, n in Counter(words(text)).items()}

    def cosine(a, b):
        norm = math.sqrt(sum(x * x for x in a.values())) * math.sqrt(sum(x * x for x in b.values()))
        return round(sum(x * b.get(w, 0) for w, x in a.items()) / norm, 9) if norm else 0

    def matches(header):
        told = licenses.names_in(header)
        for name, text, full in licenses.TEMPLATES:
            alike = cosine(vector(header), vector(licenses.plain_text(text)))
            needs = set() if full else licenses.names_in(text)
            if alike >= licenses.LEAST and needs <= told and (full or told <= licenses.allowed(name)):
                yield not full, -alike, name

    own = {}
    for row, path, _ in files:
        near = [m for x in found[row][0] for m in matches(x)]
        if near:
            own[row] = min(near)[2]
    by_directory = {}
    for row, path, _ in sorted(files, key=lambda f: f[1] or ""):
        if row in own and found[row][1]:
            by_directory.setdefault(path.rpartition("/")[0], own[row])
    out = {}
    for row, path, _ in files:
        out[row] = (own[row], "header") if row in own else (None, "none")
        at = path
        while row not in own and at:
            at = at.rpartition("/")[0]
            if at in by_directory:
                out[row] = by_directory[at], "inherited"
                break
    return out


FILES = [
    (1, "a/b/c/x.py", "# Released under the MIT License.\ncode"),
    (2, "a/b/c/y.py", "no words of that kind"),
    (3, "a/LICENSE", "Licensed under the Apache License, Version 2.0."),
    (4, "a/b/LICENSE.md", "This work is licensed under the\nGNU General Public License,\nversion 3."),
    (5, "a/q/z.txt", None),
    (6, "w/z.txt", ""),
    (7, "top.txt", "Our licence fee is due in March, and so is the rent for all the rooms."),
    (8, "a/b/c/d/deep.c", "x " * 50_000 + "\nLicensed under CC BY-NC 4.0.\n" + "y"),
    (9, "ab/n.txt", "nothing"),
    (10, None, "Licensed under CC BY 4.0."),
    (11, None, "nothing"),
    (12, "a/COPYING", "Released under the MIT License."),
    (13, "k/LICENSE", "no licence is named here at all, sorry for that and all the best to you"),
    (14, "k/m.txt", "text"),
]


def test_scan(spark):
    df = spark.createDataFrame(FILES, "row long, path string, text string").repartition(3).selectExpr("*", "1 AS licence", "2 AS n")
    got = {r.row: (r.licence, r.origin) for r in licenses.scan(df).collect()}
    assert got == brute(FILES)
    assert got[2] == ("GPL-3.0", "inherited") and got[5] == ("MIT", "inherited") and got[8][0] == "CC-BY-NC-4.0"


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "row long, path string, text string")).count() == 0


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: (r.licence, r.origin) for r in licenses.op7_licenses(spark, sf).collect()}
    rows = [(r.row.doc_id, r.path, r.text) for r in licenses.tree(docs).collect()]
    assert got == brute(rows)


def comment(text, mark="// "):
    return "\n".join((mark + x).rstrip() for x in text.strip().split("\n"))


APACHE = """Copyright 2021 The Authors

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
ISC = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."
CASES = [
    ("x.c", "/*\n" + comment(APACHE, " * ") + "\n */\nint main;", "Apache-2.0"),
    ("x.py", comment(APACHE, "# ") + "\nimport os", "Apache-2.0"),
    ("x.js", '// Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "Apache-2.0"),
    ("LICENSE", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n", "Apache-2.0"),
    ("COPYING", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.\n Everyone is permitted to copy", "GPL-3.0"),
    ("COPYING", "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007\n", "AGPL-3.0"),
    ("x.txt", "Copyright (c) 2020 Foo Bar. Released under the MIT License. See LICENSE for details.", "MIT"),
    ("LICENSE", f"Copyright (c) 2020 Foo\n\n{ISC}", "ISC"),
    ("LICENSE", "MIT License\n\nCopyright (c) 2020 Foo\n\n" + licenses.FULL[1][1].replace(". ", ".\n\n"), "MIT"),
    ("LICENSE", "Copyright (c) 2020, Foo\n\n" + licenses.BSD.format(third=""), "BSD-2-Clause"),
    ("LICENSE", "Copyright (c) 2020, Foo\n\n" + licenses.BSD.format(third=licenses.THIRD), "BSD-3-Clause"),
    ("x.c", comment("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Lesser General Public License as published\nby the Free Software Foundation, either version 2.1 of the License, or\n(at your option) any later version."), "LGPL-2.1"),
    *[("x.py", f"# SPDX-License-Identifier: {name}", name) for name in ("GPL-2.0", "MPL-2.0", "ISC", "AGPL-3.0", "LGPL-3.0", "LGPL-2.1", "CC-BY-SA-3.0")],
    ("x.py", "# SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"),
    ("x.txt", "Licensed under the GNU Affero General Public License, version 3", "AGPL-3.0"),
    ("x.txt", "Licensed under the GNU Lesser General Public License, version 3", "LGPL-3.0"),
    ("x.py", "# SPDX-License-Identifier: Ruby", None),
    ("x.py", "# SPDX-License-Identifier: EUPL-1.1", None),
    ("x.txt", "Licensed under the Apache License, Version 9.0.", None),
    ("x.txt", "Licensed under the Fancy Public License, version 3.", None),
    ("x.txt", "Licensed under CC BY-NC-SA 2.5.", "CC-BY-NC-SA-2.5"),
]


def test_headers_found_in_the_wild(spark):
    rows = [(k, f"d{k}/{name}", text) for k, (name, text, _) in enumerate(CASES)]
    got = {r.row: r.licence for r in licenses.scan(spark.createDataFrame(rows, "row long, path string, text string")).collect()}
    assert {k: got[k] for k in got if got[k] != CASES[k][2]} == {}


def test_repeated_rows(spark):
    rows = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b.txt", "nothing")]
    got = licenses.scan(spark.createDataFrame(rows + rows[1:], "row long, path string, text string")).collect()
    assert sorted((r.row, r.licence) for r in got) == [(1, "MIT"), (2, "MIT"), (2, "MIT")]
