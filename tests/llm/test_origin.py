import random

from corpuskit.llm import origin


def test_notices():
    for text in (
        "# AUTO-GENERATED by x, see y\n", "// @generated from schema a.yaml\n", '"""This file was created automatically by tool 1.2; manual changes will be lost."""\n',
        "# Copyright (c) 2020 us.\n\n# Code produced by x v1 - regenerate with `make`\n", "# Automatisch erzeugt mit x. Nicht von Hand bearbeiten.\n",
        "# Machine-written by x on 2024-01-01; edits are overwritten on the next run.\n", "/*\n * Generated by the x compiler. DO NOT EDIT!\n */\n",
    ):
        assert origin.says_tool(origin.leading_comments(text + "x = 1\n")[0]), text
    for text in (
        '"""Written by hand. The stubs next door are generated, this one is not."""\n', '"""Writes the auto-generated report header of a file."""\n',
        '"""Lets a person edit the header; others do not edit it."""\n', '"""Vendored files are skipped here; do not edit the old ones without asking."""\n', "x = 1\n# Generated by me\n",
    ):
        assert not origin.says_tool(origin.leading_comments(text)[0]), text


def test_notice_at_the_end_of_a_long_leading_comment():
    license = "".join(f" * Clause {i} of the license, in one line of its own.\n" for i in range(40))
    doc = "".join(f"Part {i} of the module is told here.\n" for i in range(40))
    for text in (f"/*\n{license} * Code generated by x. DO NOT EDIT.\n */\n", f'"""{doc}\nCode generated by x.\n"""\n'):
        assert origin.says_tool(origin.leading_comments(text + "x = 1\n")[0]), text
    assert not origin.says_tool(origin.leading_comments(f'"""{doc}"""\nx = 1\n')[0])


def test_features_of_odd_texts():
    for t in ("", "\n", "é" * 100_000, "x" * 100_000, "\x00\x01"):
        assert len(origin.features(t)) == len(origin.FEATURES)
    share = origin.FEATURES.index("literal_share")
    assert origin.features("X = [" + ", ".join(str(i * 7919) for i in range(400)) + "]\n")[share] > origin.DATA
    assert origin.features('X = """\n' + '12,ab,0.5\n' * 40 + '"""\n')[share] > origin.DATA
    assert origin.features("def f(a):\n    return a + 1\n" * 20)[share] < 0.5
    documented = 'def f(a):\n    """' + "Says a lot. " * 90 + '"""\n    return a\n'
    assert origin.features(documented)[share] < origin.DATA  # a docstring is no data
    held = "S = '''\nx\n'''\n\n\ndef f(a):\n    return g(a, b) if a else c\n\n\nT = '''\ny\n'''\n"
    assert origin.features(held)[share] < origin.DATA


def _source(r, n=30):
    w = [r.choice("alpha beta gamma delta ridge valley stone river cloud ember".split()) + r.choice("_x _y _z".split()) for _ in range(400)]
    return "".join(f"def {r.choice(w)}({r.choice(w)}):\n    {r.choice(w)} = {r.choice(w)}({r.choice(w)}, {i})\n    return {r.choice(w)}\n\n\n" for i in range(n))


def test_origins(spark):
    r = random.Random(2)
    mini = "!function(){" + ";".join(f"var {r.choice('abcdef')}{i}={{k{i}:{i},q:!0}};{r.choice('abc')}&&{r.choice('xyz')}.w({r.choice('mn')},{i})" for i in range(80)) + "}();"
    original = _source(r)
    rows = [(i, f"o/p{i % 7}", f"src/f{i}.py", f'"""Helps with case {i} of it."""\n' + _source(r)) for i in range(60)]
    rows += [(100 + i, "o/p1", f"src/g{i}.py", "# AUTO-GENERATED by tool\n" + "TABLE = {\n" + "".join(f"    {r.randrange(9999)}: ('k_{r.randrange(99)}', {r.randrange(999)}),\n" for _ in range(60)) + "}\n") for i in range(20)]
    rows += [(200 + i, "o/p1", f"src/h{i}.js", f"/*! lib{i} v1.{i} */\n" + mini.replace("w(", f"w{i}(")) for i in range(10)]
    rows += [
        (300, "o/own", "own/core.py", original), (301, "o/user", "lib/own-1.2.3/core.py", original.replace("return", "return ", 2)), (302, "o/user", "vendor/x.py", _source(r)),
        (303, "o/user", "gen/x.py", _source(r)), (304, "o/user", "src/plain.js", mini), (305, "o/user", "src/table.py", "D = [" + ", ".join(str(r.random()) for _ in range(300)) + "]\n"),
        (306, "o/user", "LICENSE", "MIT"), (307, None, None, "x = 1\n"), (308, "o/user", "src/none.py", None), (309, "o/user", "src/vendors.py", _source(r)), (310, "o/own", "own/other.py", ""),
    ]
    df = spark.createDataFrame([(*x, "z") for x in rows], "record_id bigint, repo_name string, path string, text string, label string")
    got = {x["record_id"]: x["reason"] for x in origin.origins(df).collect()}
    assert {i: got[i] for i in (300, 301, 302, 303, 304, 305, 307, 309, 310)} == {300: None, 301: "copy", 302: "third_party", 303: "output_path", 304: "minified", 305: "data", 307: None, 309: None, 310: None}
    assert all(got[i] is None for i in range(60)) and all(got[100 + i] == "notice" for i in range(20)) and all(got[200 + i] == "minified" for i in range(10))
    assert 306 not in got and 308 not in got
    told = {(x["label"], x["decided"]): x["files"] for x in origin.held_out(df).collect()}
    assert set(told) <= {(0, 0), (1, 1), (2, 2)} and told[(0, 0)] > 20 and (2, 2) in told


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "o/a", "a.py", "x = 1\n"), (2, "o/a", "gen/a.py", "x = 1\n")], "record_id bigint, repo_name string, path string, text string")
    assert {r["record_id"]: r["reason"] for r in origin.origins(df).collect()} == {1: None, 2: "output_path"}
    assert origin.origins(df.limit(0)).count() == 0
    assert origin.held_out(df.limit(0)).count() == 0
