import random

import pytest

from corpuskit.llm import mixing


def test_pivot_keeps_tokens_and_expectations():
    r = random.Random(3)
    docs = [(i, r.randint(1, 300), r.random()) for i in range(40)]
    counts = dict.fromkeys(range(40), 0)
    for seed in range(400):
        p = mixing.Pivot(seed)
        done = dict((i, x) for d in docs for _, i, x in p.add("s", *d))
        rest = p.residuals()
        assert len(rest) <= 1 and len(done) + len(rest) == 40
        got = sum(docs[i][1] * x for i, x in done.items()) + sum(w * q for _, _, w, q in rest)
        assert got == pytest.approx(sum(w * q for _, w, q in docs))
        for i, x in done.items():
            counts[i] += x
        for _, i, _, q in rest:
            counts[i] += q
    assert all(abs(counts[i] / 400 - q) < 0.12 for i, _, q in docs)


def tables(spark, n=200):
    r = random.Random(5)
    rows = [(i, " ".join("word" for _ in range(r.randint(1, 60))), ["a", "b", "c", None, "untold"][i % 5], "z") for i in range(n)] + [(9001, None, "a", "z"), (9002, "", "a", "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, copies string")
    targets = spark.createDataFrame([("a", 0.2, 3), ("b", 0.5, 2), ("c", 0.29, 9), ("d", 0.01, 2), ("e", None, None)], "source string, target_share double, max_repeats int")
    return docs, targets


def test_shares_are_reached(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    monkeypatch.setattr(mixing, "BUNCH", 7)
    docs, targets = tables(spark)
    result, plan = mixing.mixed(docs.repartition(9), targets)
    got = {r["source"]: r for r in mixing.shares(result, plan).collect()}
    copies = result.toPandas()
    assert len(copies) == 202
    for s, cap in (("a", 3), ("b", 2), ("c", 9)):
        assert copies[copies["source"] == s]["copies"].max() <= cap
    assert abs(got["a"]["chosen_tokens"] - got["a"]["wanted"]) <= 61 and abs(got["c"]["chosen_tokens"] - got["c"]["wanted"]) <= 61
    assert {s for s, r in got.items() if r["falls_short"]} == {"b", "d"}
    assert got["b"]["chosen_tokens"] == 2 * got["b"]["available"]
    assert (copies[~copies["source"].isin(["a", "b", "c"])]["copies"] == 0).all()
    rules = mixing.invariants(result, plan).collect()
    assert {r["source"] for r in rules} == set("abcde") and all(r["beyond_cap"] == r["off_target"] == 0 for r in rules)
    again, _ = mixing.mixed(docs.repartition(3), targets)  # another layout of the rows
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, result.collect()))


def test_nothing(spark):
    docs, targets = tables(spark, 5)
    assert mixing.mixed(docs.limit(0), targets)[0].count() == 0
    assert mixing.shares(*mixing.mixed(docs.limit(0), targets)).count() == 5
    assert mixing.mixed(docs, targets.limit(0))[0].agg({"copies": "sum"}).first()[0] == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "<|endoftext|>"), (5, "é" * 5000)], "id bigint, text string")
    got = {r["id"]: r["tokens"] for r in mixing.token_counts(df, ["id"]).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1 and got[5] >= 2500
