from pyspark.sql import functions as F

from corpuskit.operators import index, tokens


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_token_helpers(spark):
    a = lambda *x: F.array(*[F.lit(v) for v in x])
    assert one(spark, tokens.detokenize(a("a", "(", "b", ")", ",", "c", "."))) == "a (b), c."
    assert one(spark, tokens.characters(F.lit("\n a\t\n\nbé "))) == ["a", "<NL>", "b", "é"]
    assert one(spark, tokens.characters(F.lit("a\nb"), None)) == ["a", "b"]
    assert one(spark, tokens.bounded(a(7, 8), True, False, "eos")) == [2, 7, 8, 3]
    assert one(spark, tokens.bounded(F.array().cast("array<int>"), True, True)) == []


def reference(prompt, answer, context):
    whole = [2, *prompt, *answer, 3]
    if len(whole) > context + 1:
        whole = [*whole[:context], 3]
    inputs, labels = whole[:-1], whole[1:]
    labels = [-100 if k < len(prompt) else x for k, x in enumerate(labels)]
    return inputs + [0] * (context - len(inputs)), labels + [-100] * (context - len(labels))


def test_masked_examples(spark):
    for prompt, answer in (([10, 11], [20]), ([10] * 9, [20] * 9), ([10], [20] * 30), ([], [20]), ([10], [])):
        cols = [F.array(*[F.lit(v) for v in x]).cast("array<int>") for x in (prompt, answer)]
        got = tuple(one(spark, c) for c in tokens.masked_example(*cols, 12))
        assert got == reference(prompt, answer, 12)


def test_decode(spark):
    vocab = spark.createDataFrame([(5, "cat"), (6, "dog")], "token_id int, token string")
    df = spark.createDataFrame([(1, [2, 6, 5, 99, 3])], "id bigint, ids array<int>")
    assert tokens.decode(df, vocab, "id", "ids").first()["tokens"] == ["<BOS>", "dog", "cat", "<UNK>", "<EOS>"]


def test_search_and_upsert(spark):
    files = spark.createDataFrame([(1, "a/Parse.py", "r"), (2, "b.py", None), (3, None, "x"), (4, "c.py", "r")], "record_id bigint, path string, repo_name string")
    symbols = spark.createDataFrame([(2, "parse_it"), (2, "other"), (4, "f")], "record_id bigint, symbol string")
    cats = spark.createDataFrame([(1, "cli"), (2, "web"), (2, "cli")], "record_id bigint, category string")
    got = [(r["record_id"], r["categories"], r["symbols"]) for r in index.search(files, symbols, cats, "parse").collect()]
    assert sorted(got) == [(1, ["cli"], None), (2, ["cli", "web"], ["parse_it"])]
    assert [r["record_id"] for r in index.search(files, symbols, cats, "parse", "WEB").collect()] == [2]
    assert index.search(files, symbols, cats, "").count() == 4
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, h string")
    new = spark.createDataFrame([(2, "B"), (3, "c"), (4, "d")], "k int, h string")
    assert sorted(map(tuple, index.upsert(old, new, "k").collect())) == [(1, "a"), (2, "B"), (3, "c"), (4, "d")]
    assert sorted(map(tuple, index.incremental(old, new, "k", "h").collect())) == [(1, "gone"), (2, "changed"), (3, "unchanged"), (4, "new")]
