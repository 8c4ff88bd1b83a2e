import itertools
import random

from pyspark.sql import functions as F

from corpuskit.functions.shingles import exact_jaccard
from corpuskit.llm import chosenpath, crosssplit
from corpuskit.llm.chosenpath import _block_pairs, _small_bucket_pairs
from corpuskit.operators import setsim

SCHEMA = "id bigint, text string, side string, rep string, sig string, bucket string, a string, left string"


def corpus(n=120, seed=3):
    """Texts with copies, edits, reorderings, shared openings; ids scattered."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [[r.choice(words) for _ in range(r.randint(20, 90))] for _ in range(n // 3)]
    texts = []
    for b in base:
        texts.append(" ".join(b))
        for _ in range(2):
            c = list(b)
            for _ in range(r.choice([0, 1, 2, 4, 9])):
                c[r.randrange(len(c))] = r.choice(words)
            texts.append(("Shared opening of many files here. " if r.random() < 0.2 else "") + " ".join(c))
    texts += ["", "one two", None, "a b c", "A  B, c!", "x " * 30_000]
    ids = r.sample(range(10_000), len(texts))
    rows = [(i, t, r.choice(["train", "test", None]), "x", "x", "x", "x", "x") for i, t in zip(ids, texts)]
    return rows + [rows[0]]  # a row given twice


def brute(rows, k, t):
    texts = {i: x for i, x, *_ in rows if x}
    return {(a, b) for a, b in itertools.combinations(sorted(texts), 2) if exact_jaccard(texts[a], texts[b], k) >= t}


def test_chosen_path_finds_what_brute_force_finds(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    for k, t in ((3, 0.7), (5, 0.8)):
        links, members = chosenpath.chosen_path_pairs(df, "id", "text", k, t)
        got = [tuple(x) for x in chosenpath.expand_classes(links, members).collect()]
        assert sorted(got) == sorted(brute(rows, k, t))


def test_large_buckets_are_split_and_finished_without_loss(spark, monkeypatch):
    monkeypatch.setattr(chosenpath, "DEPTH", 1)
    monkeypatch.setattr(chosenpath, "BLOCK", 8)
    monkeypatch.setattr(chosenpath, "FAR", 16)
    r = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):  # one group of distinct near copies: every bucket is large
        c = list(base)
        c[r.randrange(60)] = f"v{i}"
        rows.append((i, " ".join(c), "train", "", "", "", "", ""))
    df = spark.createDataFrame(rows, SCHEMA)
    sigs = setsim.signatures(df, "id", "text", 3)
    _, classes = setsim.set_classes(sigs)
    pairs = chosenpath.chosen_path_candidates(classes, 0.7, small=2)
    got = {tuple(x)[:2] for x in setsim.verified(pairs, df, "id", "text", 3, 0.7).collect()}
    assert got == brute(rows, 3, 0.7)


def test_a_crowd_of_distinct_near_copies_keeps_all_its_links(spark):
    r = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(150):  # a crowd, and strangers
        c = list(base)
        c[r.randrange(80)] = f"v{i}"
        rows.append((i, " ".join(c if i % 3 else [f"s{i}x{j}" for j in range(40)]), "", "", "", "", "", ""))
    links, members = chosenpath.chosen_path_pairs(spark.createDataFrame(rows, SCHEMA), "id", "text", 3, 0.7)
    assert {(x["a"], x["b"]) for x in links.collect()} == brute(rows, 3, 0.7)
    assert {x["group_id"] for x in setsim.groups(links, members).collect() if x["links"]} == {1}


def test_bands_find_pairs_across_sides_only(spark):
    rows = corpus(seed=5)
    df = spark.createDataFrame(rows, SCHEMA)
    links, members = crosssplit.banded_pairs(df, "id", "text", F.col("side") == "train", F.col("side") == "test", 3, 0.7)
    side = {i: s for i, _, s, *_ in rows}
    want = {p for p in brute(rows, 3, 0.7) if {side[p[0]], side[p[1]]} == {"train", "test"}}
    got = [tuple(x) for x in crosssplit.expand_across(links, members).distinct().collect()]
    assert sorted(got) == sorted(want)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    links, members = chosenpath.chosen_path_pairs(df, "id", "text")
    assert links.count() == members.count() == setsim.groups(links, members).count() == 0
    links, members = crosssplit.banded_pairs(df, "id", "text", F.col("side") == "train", F.col("side") == "test")
    assert crosssplit.expand_across(links, members).count() == 0


def test_buckets_may_go_on_in_the_next_batch():
    import pandas as pd

    sig = bytes(range(32))
    one = pd.DataFrame({"bucket": [1, 2, 2], "rep": [7, 3, 4], "sig": [sig] * 3})
    two = pd.DataFrame({"bucket": [2, 5], "rep": [1, 9], "sig": [sig] * 2})
    got = pd.concat(_small_bucket_pairs(10)(iter([one, two])))
    assert set(map(tuple, got.values)) == {(3, 4), (1, 3), (1, 4)}


def test_blocks_may_go_on_in_the_next_batch():
    import pandas as pd

    sig = bytes(range(32))
    rows = [(1, 0, 0, False, 7), (1, 0, 0, True, 7), (1, 1, 0, True, 9), (2, 0, 0, False, 3), (2, 0, 0, False, 5), (2, 0, 0, True, 3), (2, 0, 0, True, 8)]
    every = pd.DataFrame([(*r, sig) for r in rows], columns=["bucket", "salt", "far", "right", "rep", "sig"])
    for at in range(1, len(rows)):
        got = pd.concat(_block_pairs(10)(iter([every[:at], every[at:]])))
        assert set(map(tuple, got.values)) == {(3, 5), (3, 8), (5, 8)}


def test_crowds_of_copies_meet_in_blocks(spark, monkeypatch):
    """Two linked classes of many copies each, one side a third of all rows; salting changes no row."""
    from corpuskit import runtime

    monkeypatch.setattr(runtime, "FAR_BLOCK", 16)
    base = [f"w{i}" for i in range(60)]
    one, two = " ".join(base), " ".join([*base[:30], "v", *base[31:]])
    rows = [(i, one if i % 3 else two, "train" if i % 2 else "test", "", "", "", "", "") for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(runtime.salted_join, "__defaults__", (8, False))
    links, members = chosenpath.chosen_path_pairs(df, "id", "text", 3, 0.7)
    assert sorted(tuple(x) for x in chosenpath.expand_classes(links, members).collect()) == sorted(itertools.combinations(range(60), 2))
    links, members = crosssplit.banded_pairs(df, "id", "text", F.col("side") == "train", F.col("side") == "test", 3, 0.7)
    got = sorted(tuple(x) for x in crosssplit.expand_across(links, members).distinct().collect())
    assert got == [(a, b) for a, b in itertools.combinations(range(60), 2) if (a + b) % 2]
