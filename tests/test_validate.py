import hashlib

import pytest
from pyspark.sql import functions as F

from corpuskit.functions import text as T
from corpuskit.operators import evalmetrics, lines, quality, reports, splits, tokens, validate
from corpuskit.plans import corpus

sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
GOOD = "def f(a):\n    return a + 1  # adds one to what it is given and hands it back\n\n\nprint(f(1))\n"
PROSE = "Some words of plain text that go on for a while, so that eight of them are found here.\n"


def one(spark, c, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(c.alias("x")).first()["x"]


def test_manifest_verdicts(spark):
    texts = {1: GOOD, 2: GOOD + "x = (", 3: "short", 4: PROSE, 5: "a 1 2 3 4 5 6 7 8 9 " * 7, 6: " \n" * 50, 7: "# auto-generated\n" + GOOD, 8: None, 9: GOOD, 10: GOOD}
    rows = [(i, "a.py" if i in (1, 2, 7, 9) else "a.txt", sha(t or ""), "z") for i, t in texts.items()]
    rows += [(9, "../a.py", sha(GOOD), "z"), (10, "b.py", "0" * 64, "z"), (11, None, sha("x"), "z"), (12, "a.py", "zz", "z"), (13, "a.py", sha("x"), "z"), (1, "a.py", sha(GOOD), "z")]
    m = spark.createDataFrame(rows, "record_id bigint, stored_path string, content_sha256 string, reason string")
    r = spark.createDataFrame([(i, t, "z") for i, t in texts.items()], "record_id bigint, text string, stored_path string")
    got = {(x["record_id"], x["stored_path"]): x["reason"] for x in validate.manifest_verdicts(m, r, "record_id").collect()}
    want = {1: "accepted", 2: "invalid_python_syntax", 3: "too_small", 4: "accepted", 5: "low_text_signal", 6: "empty_file", 7: "cleaner_generated_file", 8: "missing_file", 9: "accepted"}
    assert {k: got[(k, "a.py" if k in (1, 2, 7, 9) else "a.txt")] for k in want} == want
    assert got[(9, "../a.py")] == "unsafe_path" and got[(10, "b.py")] == "hash_mismatch" and got[(11, None)] == "invalid_metadata" and got[(12, "a.py")] == "invalid_metadata"
    assert got[(13, "a.py")] == "missing_file" and len(got) == 15
    assert validate.manifest_verdicts(m.limit(0), r, "record_id").count() == 0
    off = validate.manifest_verdicts(m.filter("record_id = 4"), r, "record_id", technical_text=False).first()["reason"]
    assert off == "technical_text_disabled"


def test_index_candidates_compete_after_their_own_checks(spark):
    s = "struct<id: string>"
    texts = [(1, GOOD), (2, GOOD), (3, GOOD + "#"), (4, "x = ("), (5, GOOD + "##")]
    rows = [(1, "a.py", sha(GOOD), ("s",)), (2, "b.py", sha(GOOD), ("s",)), (3, "a.py", sha(GOOD + "#"), ("s",)), (4, "c.py", sha("x = ("), ("s",)), (5, "d.py", sha(GOOD + "##"), None), (6, "e.py", sha("y"), ("s",))]
    m = spark.createDataFrame(rows, f"record_id bigint, stored_path string, content_sha256 string, source {s}")
    r = spark.createDataFrame(texts, "record_id bigint, text string")
    got = {x["record_id"]: x["reason"] for x in validate.index_candidates(m, r, "record_id").collect()}
    assert got == {1: "accepted", 2: "duplicate_content", 3: "duplicate_stored_path", 4: "invalid_python_syntax", 5: "invalid_provenance", 6: "missing_file"}


def test_sources_and_documents(spark):
    df = spark.createDataFrame([(1, GOOD), (2, "x = 1\n" * 9), (3, "def f(:\n" * 9), (4, " \n "), (5, None), (6, "x"), (7, "y" * 600_000)], "id bigint, text string")
    got = {x["id"]: x["reason"] for x in validate.instruction_sources(df, ["id"]).collect()}
    assert got == {1: "accepted", 2: "no_python_definitions", 3: "invalid_python_syntax", 4: "missing_content", 5: "missing_content", 6: "too_small", 7: "too_large"}
    docs = spark.createDataFrame([(1, "ab  \r\ncd"), (2, "ab\ncd\n\n"), (3, None), (4, ""), (5, " \n\t"), (6, "z" * 20)], "id bigint, text string")
    got = {x["id"]: (x["reason"], x["duplicate_of"]) for x in validate.document_reasons(docs, "id", F.col("text"), most=15, least_after=3).collect()}
    assert got == {1: ("accepted", None), 2: ("duplicate", 1), 3: ("invalid_utf8", None), 4: ("empty_file", None), 5: ("empty_after_cleaning", None), 6: ("too_large", None)}


def test_verdicts_of_collector_and_validator(spark):
    rows = [(1, "a.py", GOOD), (2, "a.exe", GOOD), (3, "x_pb2.py", GOOD), (4, "a.py", "x"), (5, "a.py", None), (6, "a.py", "# do not edit\n" + GOOD), (7, "a.py", GOOD + "("), (8, None, GOOD), (9, "a.txt", "aaaa\n" * 40)]
    df = spark.createDataFrame(rows, "id bigint, path string, text string")
    got = {x["id"]: x["reason"] for x in validate.collection_reasons(df, "id", "path", "text", (".py", ".txt")).collect()}
    assert got == {1: "accepted", 2: "unsupported_extension", 3: "generated_file", 4: "too_small", 5: "invalid_utf8", 6: "generated_file", 7: "invalid_python_syntax", 8: "unsupported_extension", 9: "accepted"}
    got = {x["id"]: x["reason"] for x in validate.corpus_verdicts(df, "id", "path", "text").collect()}
    assert got[1] == "accepted" and got[7] == "invalid_python_syntax" and got[9] == "low_entropy" and 5 not in got


def test_instruction_problems(spark):
    rows = [(1, "Do it", "", "x", "a"), (2, "Do it ", "", "x", "a"), (3, "D", "", " ", "b"), (4, None, "", "x\0", "a"), (5, "Say it", "", "y", "a"), (5, "Say that", "", "y", "a")]
    df = spark.createDataFrame(rows, "id bigint, i string, g string, o string, c string")
    got = [(x["id"], x["problems"]) for x in validate.instruction_problems(df, "id", "i", "g", "o", F.col("c"), ("a",)).collect()]
    assert sorted(got) == [
        (1, []), (2, ["duplicate_instruction_pair"]), (3, ["instruction_too_short", "invalid_category", "output_too_short"]), (4, ["instruction_too_short", "null_character"]),
        (5, ["duplicate_record_id"]), (5, ["duplicate_record_id"]),
    ]


def test_minimum_comes_after_the_duplicates(spark):
    text = "x = 1\n" * 20
    df = spark.createDataFrame([(1, "a.py", text), (2, "b.py", text), (3, "c.py", text * 9), (4, "d.py", None)], "record_id bigint, path string, text string")
    got = {x["record_id"]: x["reason"] for x in corpus.staged(df, near=False, minimum=500).collect()}
    assert got == {1: "too_few_tokens", 2: "exact_duplicate", 3: "accepted", 4: "invalid_utf8"}


def test_column_and_python_forms_agree(spark):
    texts = ["", "a \t\r\nb\x0b \n\n", "  x \n", "x" * 6000, "y" * 300 + "\n", "# generated by me\n" + "z\n" * 60, "\r\r\x00\x00", "a\x1cb \n c", "äöü   z"]
    df = spark.createDataFrame([(i, t, "p") for i, t in enumerate(texts)], "id bigint, text string, path string")
    got = {x["id"]: x for x in quality.clean_profiles(df, "id", "path", "text").collect()}
    n = T.normalize_source(F.col("text"))
    want = df.select("id", quality.clean_reason(n, F.col("path")).alias("clean"), F.sha2(n, 256).alias("exact"), F.octet_length(n).alias("n_tokens"), T.builder_text(F.col("text")).alias("b"))
    for x in want.collect():
        assert (got[x["id"]]["clean"], got[x["id"]]["exact"], got[x["id"]]["n_tokens"]) == (x["clean"], x["exact"], x["n_tokens"])
        assert x["b"] == lines.builder_text(texts[x["id"]])
    assert one(spark, quality.is_minified(F.lit(""), empty=True)) and not one(spark, quality.is_minified(F.lit("")))
    assert one(spark, quality.quality_sample(F.col("t"), 10), t="abcdefghijklmnop") == "abcde\nlmnop"


def test_lines_and_answers(spark):
    assert lines.clean_line("  Á \x07b\t c\r\n") == ("Á b c", None) and lines.clean_line(" \n") == ("", "empty")
    assert lines.clean_line("ab", least=3)[1] == "too_short" and lines.clean_line("ABCD", lower=True, most=3) == ("abcd", "too_long")
    df = spark.createDataFrame([(1, "a\n\nb"), (2, None), (3, "")], "id bigint, text string")
    assert sorted((x["id"], x["position"], x["line"], x["skipped"]) for x in lines.cleaned_lines(df, ["id"]).collect()) == [(1, 0, "a", None), (1, 1, "", "empty"), (1, 2, "b", None), (3, 0, "", "empty")]
    assert lines.without_comments("x = '#'  # c\ny = (1, # d\n 2)\n") == "x = '#'\ny = (1,\n 2)\n" and lines.without_comments("x = '") == "x = '"
    assert lines.final_text("é  \n", ".json") == "é\n" and lines.final_text("x = 1  \n", ".py") == "x = 1\n" and lines.final_text("<b>y</b>\nNext\n", ".md") == "y\n"
    assert lines.corpus_text("a\tb  \r\n\x0c c\x07\n\n\n\n\n\nd\u2028e\x00\x00") == "a   b\n c\n\n\nd\ne\n" and lines.corpus_text("") == "\n"
    assert one(spark, T.first_license(F.array(F.lit("mine"), F.lit("MIT License"), F.lit("isc")))) == "MIT" and one(spark, T.first_license(F.array(F.lit("x")))) is None
    assert lines.python_in_answer("See:\n```sh\nls\n```\n```python\nx = 1\n```") == "x = 1" and lines.python_in_answer("x = 1") == "x = 1"
    assert lines.python_in_answer("Here it is:\nimport os\nos.x()") == "import os\nos.x()" and lines.python_in_answer("No code at all here.") == ""
    assert lines.character_mix('"""ab"""\n# cd\nx = 1\n') == (5, 9)
    assert one(spark, T.assistant_response(F.col("t")), t="<|assistant|> a <|user|> q <|assistant|>\n x  \ny <|system|> z") == "x\ny"
    assert one(spark, T.plain_signs(F.col("t")), t="‘a’ “b” — c") == "'a' \"b\" - c"
    assert one(spark, T.category_name(F.col("t")), t="readHTTPBody--x") == "read_httpbody_x"


def test_reports(spark):
    df = spark.createDataFrame([("a", "x\ny"), ("a", ""), ("b", "z\n"), ("b", None)], "k string, text string")
    got = {x["k"]: x for x in reports.size_report(df, F.col("k"), "k", "text").collect()}
    assert (got["a"]["files"], got["a"]["lines"], got["a"]["bytes"], got["b"]["files"], got["b"]["lines"]) == (2, 2, 3, 1, 1)
    d = reports.dedup_report(spark.createDataFrame([("x",), (None,), (None,), ("y",), ("x",)], "reason string"), "reason").first()
    assert (d["accepted"], d["duplicates"], d["reasons"], d["duplicate_share"]) == (2, 3, {"x": 2, "y": 1}, 0.6)
    assert reports.dedup_report(spark.createDataFrame([], "reason string"), "reason").first()["duplicate_share"] == 0
    assert [one(spark, reports.estimated_epochs(F.lit(a), F.lit(b))) for a, b in ((10, 5), (0, 5), (10, 0), (0, 0))] == [0.5, 0.0, 1.0, 0.0]
    assert reports.markdown(df.filter("k = 'a'").orderBy("text"), "T") == "# T\n\n| k | text |\n| --- | --- |\n| a |  |\n| a | x y |\n"


def test_evaluation(spark):
    assert evalmetrics.loops([1] * 8, "") and not evalmetrics.loops([1] * 7 + [2], "") and evalmetrics.loops([1, 2, 3] * 8, "") and not evalmetrics.loops([1, 2, 3] * 3, "")
    assert evalmetrics.loops([], " ".join(["a"] * 8 + [f"w{i}" for i in range(14)])) and not evalmetrics.loops([], "a b c")
    df = spark.createDataFrame([(1, 3.0), (1, 2.0), (1, 2.0), (1, 1.0), (2, 0.0)], "g bigint, x double")
    assert sorted((r["g"], r["x"]) for r in evalmetrics.top_k(df, "g", "x", 2).collect()) == [(1, 2.0), (1, 2.0), (1, 3.0), (2, 0.0)]
    assert sum(r["probability"] for r in evalmetrics.softmax(df, "g", "x", 0.5).filter("g = 1").collect()) == pytest.approx(1)
    assert [one(spark, evalmetrics.penalized(F.lit(x), F.lit(True), 2.0)) for x in (4.0, -4.0)] == [2.0, -8.0]
    assert one(spark, evalmetrics.improvement(F.lit(2.0), F.lit(1.0), F.lit(True))) == 0.5
    logs = spark.createDataFrame([(1, "a", 1, 0.5), (1, "a", 2, 0.4), (2, "a", 1, 0.3)], "step int, run string, at int, loss double")
    assert sorted((r["step"], r["loss"]) for r in evalmetrics.loss_history(logs, "step", "run", "at").collect()) == [(1, 0.4), (2, 0.3)]
    rules = "item_id bigint, answer string, check_rules struct<python_syntax: boolean, required_terms: array<string>, required_any: array<array<string>>>"
    items = [(1, "Use a = 1", (True, ["use"], [["x", "a"]])), (2, "a = 1", (True, ["a"], [])), (3, None, (False, ["b"], [["c", "d"]])), (4, None, None)]
    got = {r["item_id"]: (r["passed"], r["failure"]) for r in evalmetrics.answer_checks(spark.createDataFrame(items, rules)).collect()}
    assert got == {1: (False, "invalid python syntax"), 2: (True, ""), 3: (False, "missing terms: b; none of: c/d"), 4: (True, "")}
    asked = [(1, "Write a long function", "Write a long function now"), (2, "q", "def f():\n    pass"), (3, "q", "def f(:"), (4, "q", None), (5, "q", "print(nothing)")]
    got = {r["id"]: r["issues"] for r in evalmetrics.response_issues(spark.createDataFrame(asked, "id bigint, p string, a string"), "id", "p", "a").collect()}
    assert got == {1: ["prompt_echo"], 2: ["unfinished_function"], 3: ["invalid_python_syntax"], 4: [], 5: ["undefined_names"]}


def test_splits_and_tokens(spark):
    assert splits.allocate_by_fraction(10, {"a": 0.55, "b": 0.25, "c": 0.2}) == {"a": 6, "b": 2, "c": 2} and splits.allocate_by_fraction(1, {"a": 0.5, "b": 0.5}) == {"a": 1, "b": 0}
    df = spark.createDataFrame([(i, "ab"[i % 2] if i % 5 else None) for i in range(60)], "id bigint, s string")
    got = splits.shuffled(df, F.col("s"), "id", 1).toPandas()
    for _, part in got.groupby("s", dropna=False):
        assert sorted(part["place"]) == list(range(len(part)))
    parts = [set(splits.epoch_sample(df, "id", 1, 2, k, 3).toPandas()["id"]) for k in range(3)]
    assert set.union(*parts) == set(range(60)) and sum(map(len, parts)) == 60
    w = lambda t, **k: one(spark, tokens.words(F.col("t"), **k), t=t)
    assert w("\n It's  a+b.\r\n\nEnd") == ["It's", "a", "+", "b", ".", "End"]
    assert w("\n It's  a+b.\r\n\nEnd", newline="<NL>", contractions=False, punctuation=False) == ["It", "s", "a", "+", "b", "<NL>", "End"]
    ids = lambda *x: F.array(*[F.lit(v) for v in x])
    assert one(spark, tokens.ended(ids(5, 3))) == [5, 3] and one(spark, tokens.ended(ids(5))) == [5, 3]
    for answer, want in ((ids(8, 9), [6, 7, 8, 9, 3]), (ids(1, 2, 4, 5, 6, 7), [1, 2, 4, 5, 6])):
        i, la = tokens.response_example(ids(5, 6, 7), answer, 5)
        assert one(spark, i) == want
        assert one(spark, la) == ([-100, -100, 8, 9, 3] if want[0] == 6 else want)
    i, la = tokens.response_example(ids(5), ids(8), 5)
    assert one(spark, i) == [5, 8, 3, 0, 0] and one(spark, la) == [-100, 8, 3, -100, -100]
