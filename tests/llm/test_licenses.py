import os
import textwrap

import pytest
from compare import difference
from tests_llm import odd_documents

from trackloom.llm import licenses, queries
from pyspark.sql import functions as F


def test_query_equals_sql(spark, duck, sf_dir):
    assert difference(queries.op4_licenses(spark, sf_dir), duck, queries.SQL["op4_licenses"]) is None


def test_headers_and_nearest_ancestors(spark):
    mit, gpl, apache = (licenses.TEMPLATES[k] for k in ("MIT", "GPL-3.0", "Apache-2.0"))
    rows = [("LICENSE", mit), ("a/LICENSE.txt", f"x\n{gpl}\ny"), ("a/b/c/f.py", "no notice"), ("a/b/COPYING", "none here, only the word license"),
            ("z/f.py", f"code\n# {apache}\ncode"), ("z/y/g.py", None), ("ab/g.py", ""), ("top.txt", "plain"), (None, gpl), (None, "plain")]
    got = {r.path: (r.license, r.origin, r.source) for r in licenses.licenses(spark.createDataFrame(rows, "path string, text string").filter("path is not null")).collect()}
    assert got == {"LICENSE": ("MIT", "header", None), "a/LICENSE.txt": ("GPL-3.0", "header", None), "a/b/c/f.py": ("GPL-3.0", "inherited", "a"),
                   "a/b/COPYING": ("GPL-3.0", "inherited", "a"), "z/f.py": ("Apache-2.0", "header", None), "z/y/g.py": ("MIT", "inherited", ""),
                   "ab/g.py": ("MIT", "inherited", ""), "top.txt": ("MIT", "inherited", "")}
    nowhere = licenses.licenses(spark.createDataFrame(rows, "path string, text string").filter("path is null")).collect()
    assert sorted((r.license or "", r.origin) for r in nowhere) == [("", "none"), ("GPL-3.0", "header")]


def test_odd_rows(spark):
    docs = odd_documents(spark, [(1, licenses.TEMPLATES["MIT"])] * 2).withColumn("path", F.lit("d/f")).withColumn("license", F.lit("clash"))
    rows = licenses.licenses(docs).collect()
    assert len(rows) == 6 and sum(r.license == "MIT" for r in rows) == 2
    assert licenses.licenses(docs.limit(0)).count() == 0


def wrapped(text, sign="", width=70):
    return "\n".join(sign + line for line in textwrap.wrap(text, width))


def found(spark, rows):
    files = spark.createDataFrame(rows, "path string, text string")
    return {r.path: (r.license, r.origin) for r in licenses.licenses(files).collect()}


def test_whole_files_and_header_blocks(spark):
    full = {k: t for k, t in licenses.TEXTS}
    gpl = [t for k, t in licenses.notices() if k == "GPL-3.0" and "published" in t][0]
    rows = [("mit/LICENSE", f"MIT License\n\nCopyright (c) 2019 Jane Roe\n\n{wrapped(full['MIT'])}\n"), ("mit/src/a.py", "x = 1"),
            ("bsd/LICENSE.md", f"Copyright 2020, The Authors.\n\n{wrapped(full['BSD-3-Clause'])}"), ("bsd/b.py", ""),
            ("gpl/x.c", f"/*\n{wrapped(gpl, ' * ')}\n */\nint main() {{ return 0; }}"), ("gpl/y.c", "int y;"),
            ("tag/a.rs", "// SPDX-License-Identifier: MIT\nfn main() {}"), ("tag/b.rs", "# SPDX-License-Identifier:GPL-2.0-only"),
            ("tag/c.rs", "// SPDX-License-Identifier: Other-1.0"),
            ("old/COPYING", "GNU GENERAL PUBLIC LICENSE\n\nterms and conditions"), ("old/z", "z"),
            ("v3/COPYING", "   GNU GENERAL PUBLIC LICENSE\n     Version 3, 29 June 2007\n\nEveryone may copy."), ("v3/z", None),
            ("apa/LICENSE-APACHE", "Apache License\nVersion 2.0, January 2004\n\nTERMS"), ("apa/d/z.py", "z"),
            ("no/LICENSE", "All rights are kept by the owner, who may be asked."), ("no/readme", "see the license, and the copyright of it")]
    assert found(spark, rows) == {
        "mit/LICENSE": ("MIT", "header"), "mit/src/a.py": ("MIT", "inherited"), "bsd/LICENSE.md": ("BSD-3-Clause", "header"),
        "bsd/b.py": ("BSD-3-Clause", "inherited"), "gpl/x.c": ("GPL-3.0", "header"), "gpl/y.c": (None, "none"), "tag/a.rs": ("MIT", "header"),
        "tag/b.rs": ("GPL-2.0", "header"), "tag/c.rs": (None, "none"), "old/COPYING": ("GPL", "header"), "old/z": ("GPL", "inherited"),
        "v3/COPYING": ("GPL-3.0", "header"), "v3/z": ("GPL-3.0", "inherited"), "apa/LICENSE-APACHE": ("Apache-2.0", "header"),
        "apa/d/z.py": ("Apache-2.0", "inherited"), "no/LICENSE": (None, "none"), "no/readme": (None, "none")}


def test_rows_of_fixture_equal_sql(spark, duck):
    rows = [(i, p, t) for i, (p, t) in enumerate([("a/LICENSE", licenses.TEXTS[5][1]), ("a/b", wrapped(licenses.TEXTS[0][1], "# ") + "\nx = 1"),
            ("a/c", " \t \r\n// license\n//\n\x0b\ncopyright\n-- MIT License"), ("q", "MIT License"), (None, "MIT License"), ("e", ""), ("n", None)])]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string")
    duck.register("licence_files", files.toPandas())
    assert difference(licenses.licenses(files), duck, licenses.sql("SELECT * FROM licence_files")) is None


def test_long_line_costs_in_proportion(spark):
    line = "license " + " ".join(f"w{i}" for i in range(150_000))
    assert found(spark, [("a/f", line), ("a/LICENSE", f"{line}\nMIT License"), ("b/f", "license\n" * 200_000), ("c/f", " " * 1_000_000 + "license")]) == {
        "a/f": ("MIT", "inherited"), "a/LICENSE": ("MIT", "header"), "b/f": (None, "none"), "c/f": (None, "none")}


def test_published_texts(spark):
    kept = "/usr/share/common-licenses"
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0",
             "MPL-2.0": "MPL-2.0", "BSD": "BSD-3-Clause"}
    there = [n for n in names if os.path.exists(f"{kept}/{n}")]
    if not there:
        pytest.skip("no published texts here")
    rows = [r for n in there for r in ((f"{n}/LICENSE", open(f"{kept}/{n}", encoding="utf-8").read()), (f"{n}/src/a", "a"))]
    assert found(spark, rows) == {f"{n}/{f}": (names[n], o) for n in there for f, o in (("LICENSE", "header"), ("src/a", "inherited"))}
