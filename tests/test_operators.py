import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corpuskit.functions import text as T
from corpuskit.operators import dedup, evalmetrics, htmltext, instructions, pysource, quality, sft, splits, tokens, windows


def one(spark, c, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(c.alias("x")).first()["x"]


def test_text_expressions(spark):
    assert one(spark, T.normalize_source(F.col("t")), t="a\r\nb\rc\x07\td\x00\x00") == "a\nb\nc\td"
    assert one(spark, T.normalize_lines(F.col("t")), t="  a  \n\n\n\n\n\nb \n") == "a\n\n\nb\n"
    assert one(spark, T.normalize_for_dedup(F.col("t")), t="A = 1 # one\n\n b") == "a = 1 b"
    assert one(spark, T.normalize_license(F.col("t")), t="Apache License 2.0") == "Apache-2.0"
    assert one(spark, T.normalize_license(F.col("t")), t="mine") is None
    assert one(spark, T.split_identifier(F.col("t")), t="readHTTPBody_now") == "read httpbody now"
    assert one(spark, T.word_count(F.col("t")), t="a_b  -- c1 ") == 3
    assert one(spark, T.readable_size(F.lit(1536)), t="") == "1.50 KiB"
    assert one(spark, T.readable_size(F.lit(12)), t="") == "12 B"
    assert one(spark, T.truncate_instruction(F.col("t"), 12), t="alpha beta gamma") == "alpha beta…"
    assert one(spark, T.unique_sentences(F.col("t")), t="A b.  C! A b.") == "A b. C!"
    assert one(spark, T.first_fenced_block(F.col("t")), t="x\n```sh\nls\n```\n```python\na = 1\n```") == "a = 1"


def test_packing_is_the_cut_stream(spark):
    r = random.Random(1)
    for length in (1, 4, 7):
        sizes = [r.randint(0, 12) for _ in range(60)]
        df = spark.createDataFrame([(i * 3, n) for i, n in enumerate(sizes)], "id bigint, n bigint")
        got = windows.sequence_spans(df, "id", "id", "n", length).collect()
        stream = [(i * 3, k) for i, n in enumerate(sizes) for k in range(n)]
        seen = {}
        for x in got:
            for k in range(x["end"] - x["start"]):
                seen[x["sequence"] * length + x["start"] + k] = (x["id"], x["from_token"] + k)
        assert [seen[k] for k in range(len(stream))] == stream


def test_sliding_windows_and_shards(spark):
    df = spark.createDataFrame([(1, [1, 2, 3, 4, 5, 6, 7]), (2, [1, 2])], "id bigint, ids array<int>")
    got = [(x["id"], x["inputs"], x["targets"]) for x in windows.sliding_windows(df, "ids", 2, 3).collect()]
    assert got == [(1, [1, 2], [2, 3]), (1, [4, 5], [5, 6])]
    assert one(spark, windows.shard_of_sequence(F.lit(9756), 1025, 10_000_000), t="") == 1
    sizes = spark.createDataFrame([(i, 40) for i in range(10)], "id bigint, n bigint")
    shards = windows.next_fit_shards(sizes, "id", "n", 100).groupBy("shard").agg(F.sum("n").alias("n")).collect()
    assert all(s["n"] <= 100 for s in shards) and sum(s["n"] for s in shards) == 400
    assert windows.until_target(sizes, "id", "n", 100).count() == 3


def test_two_level_duplicates(spark):
    df = spark.createDataFrame([(1, "A b"), (2, "a  b"), (3, "A b"), (4, None), (5, None), (6, "")], "id bigint, text string")
    got = {r["id"]: (r["reason"], r["duplicate_of"]) for r in dedup.two_level(df, "id", F.sha2("text", 256), F.lower(F.regexp_replace("text", " +", " "))).collect()}
    assert got == {1: (None, None), 2: ("normalized_duplicate", 1), 3: ("exact_duplicate", 1), 4: (None, None), 5: (None, None), 6: (None, None)}


def test_greedy_survivors_equal_the_sequential_rule(spark):
    r = random.Random(4)
    edges = {tuple(sorted(r.sample(range(40), 2))) for _ in range(70)}
    accepted, of = set(), {}
    for i in range(45):
        hit = [a for a, b in sorted(edges) if b == i and a in accepted]
        if hit:
            of[i] = min(hit)
        else:
            accepted.add(i)
    got = dedup.greedy_survivors(spark.createDataFrame(sorted(edges), "a bigint, b bigint"), spark.range(45)).collect()
    assert {x["id"] for x in got if x["accepted"]} == accepted
    assert {x["id"]: x["duplicate_of"] for x in got if not x["accepted"]} == of


def test_greedy_survivors_of_large_groups_and_long_chains(spark):
    clique = [(a, b) for b in range(150) for a in range(b)]
    chain = [(i, i + 1) for i in range(1000, 1249)]
    edges, nodes = spark.createDataFrame(clique + chain, "a bigint, b bigint"), spark.range(1300)
    got = {x["id"]: x["duplicate_of"] for x in dedup.greedy_survivors(edges, nodes).collect() if not x["accepted"]}
    assert got == dict.fromkeys(range(1, 150), 0) | {i: i - 1 for i in range(1001, 1250, 2)}
    r = random.Random(5)
    some = spark.createDataFrame(sorted({tuple(sorted(r.sample(range(60), 2))) for _ in range(150)} | {(a + 100, b + 100) for a, b in clique}), "a bigint, b bigint")
    rounds, streamed = (sorted(dedup.greedy_survivors(some, spark.range(300), stream=s).collect()) for s in (0, 10**6))
    assert rounds == streamed
    with pytest.raises(RuntimeError):
        dedup.greedy_survivors(spark.createDataFrame(chain, "a bigint, b bigint"), nodes, most_rounds=3, stream=0)


def test_allocation_and_group_split(spark):
    assert splits.allocate(10, {"a": 0.9, "b": 0.05, "c": 0.05}) == {"a": 8, "b": 1, "c": 1}
    assert splits.allocate(7, {"a": 1, "b": 1, "c": 1}, False) == {"a": 3, "b": 2, "c": 2}
    df = spark.createDataFrame([(i, f"g{i % 20}") for i in range(200)] + [(999, None)], "id bigint, g string")
    out = splits.group_split(df, "g", {"train": 0.8, "test": 0.2})
    per = out.groupBy("g").agg(F.count_distinct("assigned").alias("n")).collect()
    assert len(per) == 21 and all(x["n"] == 1 for x in per)
    assert out.filter("assigned = 'test'").select("g").distinct().count() == splits.allocate(21, {"train": 0.8, "test": 0.2})["test"]
    assert splits.leakage(df.withColumn("s", F.col("id") % 2), "g", F.col("s")).count() == 0


def test_vocabulary_and_encoding(spark):
    df = spark.createDataFrame([(1, "cat dog dog"), (2, "emu dog's cat")], "id bigint, text string")
    v = tokens.vocabulary(df, "id", "text", 7)
    assert [(x["token_id"], x["token"]) for x in v.orderBy("token_id").collect()] == [(5, "cat"), (6, "dog")]
    assert {x["id"]: x["ids"] for x in tokens.encode(df, v, "id", "text").collect()} == {1: [5, 6, 6], 2: [1, 1, 5]}


def test_evaluation_scores(spark):
    a = F.array(*[F.lit(x) for x in "7777"])
    assert one(spark, evalmetrics.repetition_rate(a), t="") == 0.75
    assert one(spark, evalmetrics.coherence(a), t="") == pytest.approx(1 / 3)
    assert one(spark, evalmetrics.longest_run(F.split(F.lit("a,b,b,b,a"), ",")), t="") == 3
    assert one(spark, evalmetrics.keyword_coverage(F.lit("Ab c"), F.array(F.lit("AB"), F.lit("x"))), t="") == 0.5
    runs = spark.createDataFrame([("r", i, x) for i, x in enumerate([3.0, 2.0, 2.5, 2.4, 1.0])], "run string, step int, loss double")
    got = [(x["bad_steps"], x["stop"]) for x in evalmetrics.early_stopping(runs, "run", "step", "loss", 2).orderBy("step").collect()]
    assert got == [(0, False), (0, False), (1, False), (2, True), (0, False)]


def test_quality_metrics(spark):
    import math
    from collections import Counter

    texts = {1: "hello world", 2: "", 3: None, 4: "aaaa", 5: "é€\nx\n" * 5}
    df = spark.createDataFrame(list(texts.items()), "id bigint, text string")
    got = {x["id"]: x["entropy"] for x in quality.entropy(df, "id", "text").collect()}
    for i, t in texts.items():
        if t is not None:
            want = -sum(n / len(t) * math.log2(n / len(t)) for n in Counter(t).values()) if t else 0
            assert got[i] == pytest.approx(want, abs=1e-9)
    rep = {x["id"]: x["repeated_share"] for x in quality.repeated_lines(df, "id", "text").collect()}
    assert rep == {1: 0.0, 2: 0.0, 4: 0.0, 5: 1.0}
    assert one(spark, quality.base64_share(F.col("t")), t="QUJD" * 30) == 1.0


def test_python_operators(spark):
    src = 'import json\n\n\nclass A:\n    def f(self, x: int) -> int:\n        """Adds one to the number."""\n        # note\n        return x + 1\n\n\nasync def g():\n    return h\n'
    df = spark.createDataFrame([(1, src, "a/b.py"), (2, "def broken(:", None), (3, None, None), (4, src, None)], "id bigint, text string, path string")
    defs = {(r["id"], r["symbol"]): r for r in pysource.definitions(df, ["id"]).collect()}
    assert {k[1]: v["kind"] for k, v in defs.items()} == {"A": "class", "A.f": "method", "g": "async_function"}
    dup = pysource.duplicate_symbols(pysource.definitions(df, ["id"]), "id").collect()
    assert all((r["duplicate_of"] is None) == (r["id"] == 1) for r in dup)
    prints = {r["id"]: r for r in pysource.fingerprints(df, ["id"]).collect()}
    assert prints[2]["ast_sha256"] is None and prints[1]["ast_sha256"] == prints[4]["ast_sha256"]
    assert {r["id"]: r["reason"] for r in pysource.global_duplicates(pysource.fingerprints(df, ["id"]), "id").collect()} == {1: None, 2: None, 4: "exact_sha256_duplicate"}
    assert pysource.undefined_names(df.filter("id = 1"), ["id"]).first()["names"] == ["h"]
    cats = pysource.file_categories(df.filter("id = 1"), ["id"]).collect()
    assert {r["category"]: r["is_primary"] for r in cats} == {"OOP": True, "Standard Library": False}
    assert pysource.strip_comments("x = '# no'  # yes\n").strip() == "x = '# no'"


def test_global_duplicates_follow_the_sequential_rule(spark):
    """Keys overlap without being nested; only accepted rows own theirs."""
    r = random.Random(3)
    for _ in range(3):
        rows = [(i, f"s{r.randrange(25)}") for i in range(40)]
        keys = {s: (f"n{r.randrange(14)}", f"t{r.randrange(14)}" if r.random() < 0.9 else None) for s in {s for _, s in rows}}
        seen, want = {}, {}
        for i, s in rows:
            own = [("exact_sha256_duplicate", ("s", s)), ("normalized_duplicate", ("n", keys[s][0])), ("ast_duplicate", ("t", keys[s][1]))]
            hit = next(((name, seen[k]) for name, k in own if k[1] is not None and k in seen), None)
            want[i] = hit or (None, None)
            if hit is None:
                seen |= {k: i for _, k in own if k[1] is not None}
        df = spark.createDataFrame([(i, s, *keys[s]) for i, s in rows], "id bigint, sha256 string, normalized_sha256 string, ast_sha256 string")
        assert {x["id"]: (x["reason"], x["duplicate_of"]) for x in pysource.global_duplicates(df, "id").collect()} == want


SOURCES = """
import json
import numpy as np


class Store(dict):
    size: int = 0

    def find_rows(self, rows: list, *, least=0) -> list:
        \"\"\"Find the rows that count.\"\"\"
        out = []
        for r in rows:
            if r > least:
                out.append(r)
        return out


def save(path, x):
    try:
        with open(path, "w") as f:
            json.dump(x, f)
    except OSError:
        raise


def fact(n):
    return 1 if n in (0, 1) else n * fact(n - 1)


def test_fact():
    assert fact(3) == 6
"""


def test_instruction_pairs(spark):
    df = spark.createDataFrame([(1, SOURCES), (2, "def broken(:"), (3, None)], "id bigint, text string")
    got = {(p["symbol"], p["category"]): p for p in instructions.instruction_pairs(df, ["id"]).collect()}
    assert {c for _, c in got} == set(instructions.CATEGORIES)
    p = lambda s, c: got[s, c]
    assert "out = [r for r in rows if r > least]" not in p("Store.find_rows", "optimization")["output"]
    assert "return [r for r in rows if r > least]" in p("Store.find_rows", "optimization")["output"]
    assert "if r <= least" in p("Store.find_rows", "bug_fixing")["input"] and "not in" in p("fact", "bug_fixing")["input"]
    assert p("Store.find_rows", "documentation")["output"] == "Find the rows that count." and '"""' not in p("Store.find_rows", "documentation")["input"]
    assert p("save", "api_usage")["input"] == "import json" and "`json`" in p("save", "api_usage")["instruction"]
    assert ("test_fact", "unit_testing") in got and ("fact", "unit_testing") not in got
    assert "O(n)" in p("Store.find_rows", "complexity_analysis")["output"] and "calls itself" in p("fact", "complexity_analysis")["output"]
    assert p("Store.find_rows", "type_hints")["input"].startswith("def find_rows(self, rows, *, least=0):")
    assert p("save", "code_completion")["input"] == "def save(path, x):\n    ..."
    capped = instructions.instruction_pairs(df, ["id"], most=12).collect()
    assert len(capped) == 12 and {c["category"] for c in capped} == set(instructions.CATEGORIES)
    assert instructions.action("__len__") == "report the number of contained values" and instructions.action("loadHTTPRows_now") == "load httprows now"
    with pytest.raises(ValueError):
        instructions.check_templates({"explanation": "{nope}"})


def test_file_categories():
    cats = pysource.categories_of(SOURCES, "pkg/find_queue.py")
    assert cats == ["OOP", "Data Structures", "File Handling", "Exception Handling", "Standard Library", "NumPy"]
    assert pysource.categories_of("x = 1", "a.py") == ["Core Python"] and pysource.categories_of("x = 1", "a\\tests\\b.py") == ["Pytest"]
    assert pysource.normalized_name("readBinaryTree-x") == "read_binary_tree_x"


def test_simhash_over_token_classes(spark):
    renamed = SOURCES.replace("find_rows", "pick").replace("rows", "items").replace('"w"', '"a"')
    assert pysource.token_simhash(SOURCES) == pysource.token_simhash(renamed)
    slow = [0] * 64
    tokens = pysource.token_classes(SOURCES)
    for i in range(max(1, len(tokens) - 4)):
        h = int.from_bytes(hashlib.blake2b("\x1f".join(tokens[i : i + 5]).encode(), digest_size=8).digest(), "big")
        slow = [w + (1 if h >> b & 1 else -1) for b, w in enumerate(slow)]
    assert pysource.token_simhash(SOURCES) % 2**64 == sum(1 << b for b, w in enumerate(slow) if w >= 0)
    for odd in ("", "x = (", "'"):
        pysource.token_simhash(odd)
    other = "\n".join(f"def f{i}(a):\n    return a[{i}] if a else {{'k': -a, 's': {i}}}" for i in range(9))
    rows = [(5, SOURCES), (6, renamed), (7, SOURCES + "\n# more\n"), (8, other), (9, SOURCES), (10, "def broken(:")]
    hashes = pysource.source_hashes(spark.createDataFrame(rows, "id bigint, text string"), ["id"])
    got = {r["id"]: (r["reason"], r["duplicate_of"]) for r in pysource.index_duplicates(hashes, "id").collect()}
    assert got == {5: (None, None), 6: ("near_duplicate", 5), 7: ("normalized_duplicate", 5), 8: (None, None), 9: (None, None)}
    assert {(r["a"], r["b"]) for r in pysource.simhash_links(spark.createDataFrame([(1, 0b111), (2, 0), (3, -1)], "id bigint, simhash bigint"), "id").collect()} == {(1, 2)}


def test_html_text(spark):
    page = '<html><body><nav>Menu<i>x</i></nav><h2>Title</h2><p>A &amp; b</p><pre>x = 1\n  y</pre><table><tr><td>c1</td></tr></table><script>no()</script><div class="my-Sidebar"><p>side</p></div><p>end</p></body></html>'
    got = one(spark, htmltext.documentation_text(F.col("t")), t=page)
    assert "## Title" in got and "A & b" in got and "```\nx = 1\n  y\n```" in got and "c1" in got and "end" in got
    assert not any(x in got for x in ("no()", "Menu", "side"))
    assert "lost" not in htmltext.read_html("<nav>a<br>b</nav><p>lost</p>")  # an element without an end tag keeps its region open
    assert one(spark, htmltext.documentation_text(F.col("t")), t="Next\n\n\n\n<b>x</b>  y\n```\n<b>\nNext\n```\n    Next") == "x y\n```\n<b>\nNext\n```\n    Next\n"
    rst = "Title\n\n.. toctree::\n   :maxdepth: 2\n   a/b\n\nText here.\n```\n.. toctree::\n```\n* index of all"
    assert htmltext.clean_documentation(rst) == "Title\n\nText here.\n```\n.. toctree::\n```\n"
    assert one(spark, htmltext.documentation_text(F.col("t")), t="") == "\n"


def test_odd_markup_does_not_end_the_job(spark):
    texts = {
        "a <![} b": "a <![} b\n", "<p>x <![--/@ y</p>": "x\n", "<html><p>a <![} b> c</p>": "a c\n", "<html><p>a <![nope[ b]]> c</p>": "a c\n",
        "<html><p>a <![CDATA[ > ]]> c": "a c\n", "<html><p>a <![} b": "a < ![} b\n", "<html><p>a <!-- b": "a < !-- b\n", "<body>a &#" + "9" * 5000 + ";": "a \ufffd\n", "a &#" + "0" * 5000 + "65;b": "a Ab\n", None: None,
    }
    df = spark.createDataFrame(list(texts.items()), "t string, want string")
    assert {r["t"]: r["got"] for r in df.select("t", htmltext.documentation_text(F.col("t")).alias("got")).collect()} == texts


def test_instruction_records(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 3, "user", "b"), (2, 0, "user", "c")], "c int, t int, role string, text string")
    got = {r["c"]: (r["system"], r["user"]) for r in sft.chat_prompt(turns, "c", "t", "role", "text").collect()}
    assert got == {1: ("s", "b"), 2: (None, "c")}
    assert one(spark, sft.problems(F.lit(" a"), F.lit(" ")), t="") == ["instruction_too_short", "output_too_short"]
    with pytest.raises(ValueError):
        sft.render("{nope}", {})


def test_corpus_build_rejects_near_duplicates_in_order(spark):
    from corpuskit.plans import corpus

    words = [f"w{i}" for i in range(200)]
    swap = lambda *at: " ".join(f"v{i}" if i in at else w for i, w in enumerate(words))
    texts = {1: swap(), 2: swap(199), 3: swap(199).upper(), 4: swap(199), 5: swap(*range(195, 200)), 6: swap(0, 199), 7: swap(0, *range(185, 200)), 8: swap(), 9: "x = 1"}
    df = spark.createDataFrame([(i, "a.txt", t) for i, t in texts.items()], "record_id bigint, path string, text string")
    shingles = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in texts.items() for w in [t.lower().split()] if i < 9}
    want, kept = {}, []
    for i, s in shingles.items():
        near = [k for k in kept if len(s & shingles[k]) >= 0.92 * len(s | shingles[k])]
        want[i] = ("exact_duplicate" if texts[i] == texts[near[0]] else "near_duplicate", near[0]) if near else ("accepted", None)
        kept += [] if near else [i]
    assert [want[i][0] for i in (1, 2, 3, 4, 7, 8)] == ["accepted", "near_duplicate", "near_duplicate", "near_duplicate", "accepted", "exact_duplicate"]
    stages, spans = corpus.build(df, 64)
    assert {x["record_id"]: (x["reason"], x["duplicate_of"]) for x in stages.collect()} == want | {9: ("too_short", None)}
    assert {x["record_id"] for x in spans.collect()} == set(kept)
    assert not corpus.staged(df, near=False).filter("reason = 'near_duplicate'").count()
