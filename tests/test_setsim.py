import itertools
import random

from corpuskit.functions.shingles import exact_jaccard
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


def test_similar_pairs_are_those_of_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    for k, t in ((3, 0.8), (5, 0.92)):
        links, members = setsim.similar_pairs(df, "id", "text", k, t)
        rep = {r["id"]: r["rep"] for r in members.collect()}
        linked = {(r["a"], r["b"]) for r in links.collect()}
        want = {tuple(sorted((rep[a], rep[b]))) for a, b in brute(rows, k, t) if rep[a] != rep[b]}
        assert linked == want
        assert all(rep[a] == rep[b] or tuple(sorted((rep[a], rep[b]))) in linked for a, b in brute(rows, k, t))


def test_a_text_with_many_partners_is_split(spark, monkeypatch):
    monkeypatch.setattr(setsim, "BLOCK", 4)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[:i], f"v{i}", *base[i + 1 :]]), "", "", "", "", "", "") for i in range(30)]
    links, _ = setsim.similar_pairs(spark.createDataFrame(rows, SCHEMA), "id", "text", 3, 0.8)
    assert {(r["a"], r["b"]) for r in links.collect()} == brute(rows, 3, 0.8)


def test_groups_are_components_of_links(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 9), (5, 6)], "a bigint, b bigint")
    members = spark.createDataFrame([(i, i) for i in (1, 2, 3, 5, 6, 8, 9)] + [(11, 9)], "id bigint, rep bigint")
    got = {r["id"]: (r["class_id"], r["group_id"], r["links"]) for r in setsim.groups(links, members).collect()}
    assert got == {1: (1, 1, 1), 2: (2, 1, 2), 3: (3, 1, 2), 9: (9, 1, 1), 11: (9, 1, 1), 5: (5, 5, 1), 6: (6, 5, 1), 8: (8, 8, 0)}


def test_groups_with_hubs_over_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(setsim, "HUB", 5)
    links = spark.createDataFrame([(0, i) for i in range(1, 40)] + [(50, 51)], "a bigint, b bigint")
    members = spark.createDataFrame([(i, i) for i in [*range(40), 50, 51]], "id bigint, rep bigint")
    got = {r["id"]: (r["group_id"], r["links"]) for r in setsim.groups(links, members).collect()}
    assert got == {i: (0, 39 if i == 0 else 1) for i in range(40)} | {50: (50, 1), 51: (50, 1)}


def test_empty_table(spark):
    links, members = setsim.similar_pairs(spark.createDataFrame([], SCHEMA), "id", "text")
    assert links.count() == members.count() == setsim.groups(links, members).count() == 0
