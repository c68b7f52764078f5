"""License scans over real licence texts and headers, directories of several levels, ties, null and odd paths."""

import pytest
from pyspark.sql import functions as F

from muster.llm import license_scan

TEXT = {name: text for name, whole, text in license_scan.default_templates() if whole}
APACHE = """/*
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 */
int main() { return 0; }
"""
GPL = """# This program is free software: you can redistribute it and/or modify it
# under the terms of the GNU General Public License as published by the Free
# Software Foundation, either version 3 of the License, or (at your option)
# any later version.
"""
FILES = {
    "LICENSE": TEXT["MIT"].replace("<year> <copyright holders>", "2020 Somebody"),
    "src/a.c": "int x;",
    "src/deep/COPYING": TEXT["GPL-3.0"],
    "src/deep/er/still/b.c": "int y;",
    "p/src/b.c": APACHE,
    "p/src/a.c": "int z;",
    "q/g.py": GPL + "import os\n",
    "q/mit.c": f"/* {TEXT['MIT']} */\nint a;",
    "one.py": "# Released under the MIT License by Somebody.\n",
    "two.py": "# This file is released under the MIT License.\n",
    "x/LICENSE.txt": TEXT["Apache-2.0"],
    "x/y/z/w.c": "",
    "two/LICENSE": TEXT["BSD-3-Clause"],
    "two/COPYING": TEXT["ISC"],
    "two/f.c": None,
    "srcs/not-under-src.c": "int q;",
    "/rooted/LICENSE": TEXT["MPL-2.0"],
    "/rooted/in/f.c": "",
}


def scanned(spark, files, **options):
    rows = [(i, p, t, "x", "y") for i, (p, t) in enumerate(files)]
    df = spark.createDataFrame(rows, "doc_id int, p string, text string, at string, `row` string")
    return license_scan.license_scan(df, F.col("p"), **options)


@pytest.fixture(scope="module")
def found(spark):
    # Prose around them, so that common words weigh little and the licences' words do not.
    prose = [(f"docs/{i}.txt", f"the brown fox number {i} by this file is under a hill of the work and may use any of it to see") for i in range(60)]
    return {r.path: r for r in scanned(spark, [*FILES.items(), *prose, (None, "nothing")]).collect()}


def test_license_files(found):
    for path, name in (("LICENSE", "MIT"), ("src/deep/COPYING", "GPL-3.0"), ("x/LICENSE.txt", "Apache-2.0"), ("two/LICENSE", "BSD-3-Clause"), ("two/COPYING", "ISC"), ("/rooted/LICENSE", "MPL-2.0")):
        r = found[path]
        assert (r.license, r.origin, r.is_license_file, r.line, r.inherited_from) == (name, "file", True, 0, None) and r.cosine > 0.95
    assert sum(r.is_license_file for r in found.values()) == 6


def test_headers(found):
    assert (found["p/src/b.c"].license, found["p/src/b.c"].origin, found["p/src/b.c"].is_license_file) == ("Apache-2.0", "line", False)
    assert (found["q/g.py"].license, found["q/g.py"].origin, found["q/g.py"].line) == ("GPL-3.0", "block", 1)
    assert (found["q/mit.c"].license, found["q/mit.c"].origin, found["q/mit.c"].is_license_file) == ("MIT", "block", False)
    assert (found["one.py"].license, found["two.py"].license) == ("MIT", "MIT")


def test_inheritance(found):
    assert (found["src/a.c"].license, found["src/a.c"].inherited_from) == ("MIT", "")
    assert (found["src/deep/er/still/b.c"].license, found["src/deep/er/still/b.c"].inherited_from) == ("GPL-3.0", "src/deep")
    assert (found["p/src/a.c"].license, found["p/src/a.c"].inherited_from) == ("MIT", "")  # a header says nothing of siblings
    assert (found["x/y/z/w.c"].license, found["x/y/z/w.c"].inherited_from) == ("Apache-2.0", "x")
    assert (found["two/f.c"].license, found["two/f.c"].inherited_from) == ("BSD-3-Clause", "two")  # equally frequent: the first in the alphabet
    assert found["srcs/not-under-src.c"].inherited_from == "" and found["/rooted/in/f.c"].license == "MPL-2.0"
    assert found[""].license == "MIT" and found[""].origin == "directory"


def test_ties_go_to_the_first(spark):
    """Of equal templates the first counts, of equal lines the earlier, and a line before the block that it begins."""
    same = (("A", False, "some notice here"), ("B", False, "some notice here"))
    got = scanned(spark, [("f", "x\n\nsome notice here\n\nsome notice here\nsome notice here\n"), ("f", "x\n\nsome notice here\n\nsome notice here\nsome notice here\n"), ("g", "")], templates=same).collect()
    assert [(r.license, r.origin, r.line) for r in got if r.path == "f"] == [("A", "line", 3)] * 2
    assert [(r.license, r.cosine) for r in got if r.path == "g"] == [(None, None)]


def test_nothing_is_left_out_by_the_first_filter(spark, monkeypatch):
    files = [*FILES.items(), *[(f"n{i}", f"{GPL}\n{'word ' * i}released mit license\nunder the apache license version {i}") for i in range(30)]]
    some = scanned(spark, files).collect()
    monkeypatch.setattr(license_scan, "_candidates", lambda spark, texts, *_: texts.select("at", F.lit(True).alias("header"), F.lit(True).alias("whole")))
    assert sorted(map(str, some)) == sorted(map(str, scanned(spark, files).collect()))
