import pytest

from corpuskit.llm import licenses


@pytest.mark.parametrize(
    "text, want",
    [
        ("SPDX-License-Identifier: MIT", {"MIT"}),
        ("Copyright (c) 2019 the x authors. All rights reserved.\n@license BSD-3-Clause", {"BSD-3-Clause"}),
        ("You may share and change this file if you follow the terms of the Mozilla Public\nLicense, version 2.0.", {"MPL-2.0"}),
        ("Covered by the GNU Lesser General Public License, version 2.1; the full terms sit in the project root.", {"LGPL-2.1"}),
        ("SPDX-License-Identifier: MIT OR Apache-2.0", {"Apache-2.0 OR MIT"}),
        ("License: GPL-3.0-or-later", {"GPL-3.0"}),
        ("License: expat", {"MIT"}),
        ("Looks for MIT and BSD notices in a file.", set()),
        ("Skips GPL-3.0 files and keeps the rest of the ledger.", set()),
        ("Given a sample, emit the commit.", set()),
        ("License: MIT\nLicense: ISC", {"MIT", "ISC"}),
        ("", set()),
        (None, set()),
    ],
)
def test_statements(text, want):
    assert licenses.stated(text) == want


def test_fields():
    assert licenses.named("The MIT License") == "MIT" and licenses.named("2-clause BSD") == "BSD-2-Clause"
    assert licenses.named("MIT OR Apache-2.0") == "Apache-2.0 OR MIT"
    for filler in (None, "", "  ", "n/a", "custom", "NOASSERTION", "see LICENSE", "other", "unknown"):
        assert licenses.named(filler) is None


def test_opening():
    assert licenses.opening("#!/usr/bin/env python\n# -*- coding: utf-8 -*-\n\n# License: MIT\n# more\n\n# not this\nx = 1") == "License: MIT\nmore"
    assert licenses.opening('"""License: ISC\n"""\nx') == "License: ISC"
    assert licenses.opening("/*\n * License: MIT\n */\nx") == "License: MIT"
    assert licenses.opening("x = 1\n# License: MIT") == ""
    assert licenses.own_evidence('import os\n\n__license__ = "Apache 2"\n', None) == {"Apache-2.0"}
    assert licenses.own_evidence("# License: MIT\n", "isc") == {"MIT", "ISC"}


def test_verdicts(spark):
    rows = [
        (1, "o/a", "LICENSE", None, "MIT license\n\nDo as you like.", "z"),
        (2, " O/A", "x.py", None, "x = 1", "z"),
        (3, "o/a", "y.py", "apache 2", "# License: MIT\n", "z"),
        (4, "o/a", "z.py", "MIT", "z = 1", "z"),
        (5, "o/b", "x.py", "n/a", "x = 1", "z"),
        (6, "o/c", "LICENSE-MIT", None, "MIT", "z"),
        (7, "o/c", "COPYING", None, "ISC license", "z"),
        (8, "o/c", "src\\x.py", None, None, "z"),
        (9, None, None, None, "# License: ISC", "z"),
        (10, "o/d", "third_party/x/LICENSE", None, "MIT", "z"),
        (11, "o/d", "x.js", None, "// nothing", "z"),
    ]
    df = spark.createDataFrame(rows, "record_id bigint, repo_name string, path string, license string, text string, verdict string")
    got = {r["record_id"]: r["verdict"] for r in licenses.verdicts(df, ["record_id"]).collect()}
    assert got == {2: "MIT", 3: "CONFLICT", 4: "MIT", 5: "UNKNOWN", 8: "CONFLICT", 9: "ISC", 11: "UNKNOWN"}
    repos = {r["repo"]: (r["verdict"], r["files"], r["conflicts"], r["mixed"]) for r in licenses.by_repository(df).collect()}
    assert repos["o/a"] == ("MIT", 3, 1, True) and repos["o/b"] == ("UNKNOWN", 1, 0, False) and repos["o/c"] == ("CONFLICT", 1, 0, False)
    assert repos[None] == ("ISC", 1, 0, False) and repos["o/d"] == ("UNKNOWN", 1, 0, False)
    assert licenses.by_repository(df.limit(0)).count() == 0
    rolled = {(r["repo"], r["directory"]): (r["files"], r["conflicts"], r["licenses"]) for r in licenses.by_directory(df).collect()}
    assert rolled[("o/a", "")] == (3, 1, ["MIT"]) and rolled[("o/c", "src")] == (1, 1, [])
    assert rolled[("o/c", "")] == (1, 1, [])  # rolled up to the root
    assert licenses.verdicts(df.limit(0), ["record_id"]).count() == 0


def test_directories_roll_up(spark):
    rows = [(1, "o/a", "./a/b/x.py", "MIT", "x"), (2, "o/a", "a\\c\\y.py", "ISC", "y"), (3, "o/a", "z.py", "other", None), (4, "o/a", None, "MIT", "w")]
    df = spark.createDataFrame(rows, "record_id bigint, repo_name string, path string, license string, text string")
    got = {r["directory"]: (r["files"], r["unknowns"], r["licenses"], r["mixed"]) for r in licenses.by_directory(df).collect()}
    assert got == {"": (4, 1, ["ISC", "MIT"], True), "a": (2, 0, ["ISC", "MIT"], True), "a/b": (1, 0, ["MIT"], False), "a/c": (1, 0, ["ISC"], False)}


@pytest.mark.parametrize("license", list(licenses.TEXTS))
def test_texts_without_a_name_tell_the_license(license):
    for t in licenses.TEXTS[license]:
        assert licenses.stated(f"Copyright (c) 2020, the makers\n\n{t}") == {license}
    body = max(licenses.TEXTS[license], key=len)
    assert licenses.license_file_names(f"Copyright 2019 Some One\r\n\r\n{body}\r\n") == {license}
    assert licenses.own_evidence("/*\n * " + body.replace(". ", ".\n * ") + "\n */\nx()", None) == {license}


def test_near_names_are_told_apart():
    for name in licenses.OTHER:
        assert licenses.named(name) is None
        assert licenses.stated(f"Licensed under the {name}") == set()
    for text in licenses.OTHER_TEXTS:
        assert licenses.stated(text) == set()
    for license, names in licenses.NAMES.items():
        for name in names:
            assert licenses.named(name.upper()) == license
            for form in licenses.STATEMENTS:
                assert licenses.stated(form.format(name)) == {license}


def test_a_version_alone_names_nothing():
    for text in ("paperyard v3.0", "jolttail v2.1", "x 2.0", "BSD", "version 2.0 or later"):
        assert licenses.stated(text) == set() and licenses.named(text) is None


def test_a_title_does_not_end_the_reading():
    assert licenses.license_file_names("MIT License\n\nParts are licensed under the Apache License, Version 2.0.\n") == {"MIT", "Apache-2.0"}
    assert licenses.license_file_names("") == set() and licenses.license_file_names(None) == set()
    assert licenses.stated("word " * 200_000) == set()
