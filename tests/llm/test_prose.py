import random

import numpy as np

from corpuskit.llm import prose

SENTENCES = [
    "The {} reads each {} before it can pack the {}.", "That is why the {} matters more than the size of the {}.", "We would rather lose a {} than wait for the {} again.",
    "It is easy to forget that a {} keeps its own {} in the end.", "No one had seen a {} fail on such a {} before.", "If you change the {}, start the {} once more and look at both.",
]
GERMAN = ["Der {} liest zuerst jeden {} und prüft, ob er noch gültig ist.", "Wir haben den {} verglichen und keinen Unterschied beim {} gefunden.", "Am Ende bleibt nur ein kleiner Teil übrig, den der {} von Hand behandelt."]
NOUNS = "loader packer ribbon valley engine docket lantern harbor signal cursor basket module".split()


def text(r, n, kinds=SENTENCES):
    return " ".join(r.choice(kinds).format(*(r.choice(NOUNS) for _ in range(3))) for _ in range(n))


def documents():
    r = random.Random(1)
    good, bad = {}, {}
    for i in range(300):
        good[i] = "\n\n".join(text(r, r.randint(2, 5)) for _ in range(r.randint(1, 4)))
    for i in range(300, 400):
        good[i] = text(r, r.randint(3, 8), GERMAN)
    good[400] = "\n".join(text(r, 1) for _ in range(9)).replace(".", "")
    good[401] = "\n".join(text(r, 1).lower()[k : k + 40] for k in (0, 40) for _ in range(1)) + "\n" + text(r, 4)
    good[402] = text(r, 4).upper()
    good[403] = "> " + text(r, 3) + "\n> " + text(r, 3)
    good[404] = text(r, 8) + "\n\n- " + "\n- ".join(NOUNS[:4])
    bad[500] = "\n".join(f"- {r.choice(NOUNS)} {r.choice(NOUNS)}" for _ in range(40))
    bad[501] = "\n".join("| " + " | ".join(r.choice(NOUNS) for _ in range(4)) + " |" for _ in range(30))
    bad[502] = "\n".join(f"{r.choice(NOUNS)}_{r.choice(NOUNS)} = {r.randrange(99)}" for _ in range(30))
    bad[503] = "\n".join(f"2024-01-0{k % 9 + 1}T10:00:00 WARN [{r.choice(NOUNS)}-{k}] {r.choice(NOUNS)}={k}" for k in range(30))
    bad[504] = "\n".join("%064x" % r.getrandbits(256) for _ in range(20))
    bad[505] = " ".join(r.choice(NOUNS) for _ in range(200))
    bad[506] = "\n".join(["Subscribe to the list and do not miss it."] * 30)
    bad[507] = " | ".join(r.choice(["Home", "Menu", "Next", "Login", "Search"]) for _ in range(120))
    bad[508] = text(r, 2) + "\n\n" + "\n".join(f"{k}. {r.choice(NOUNS)} {r.choice(NOUNS)}" for k in range(60))
    bad[509] = "".join(r.choice("€§©±Ã¤â�?") if r.random() < 0.5 else c for c in text(r, 8))
    bad[510] = "\n".join(", ".join(r.choice(NOUNS) for _ in range(9)) for _ in range(12))
    bad[511] = "\n".join(f"{r.choice(NOUNS)}({r.choice(NOUNS)}, {r.choice(NOUNS)}, {k})" for k in range(30))
    bad[512] = "\n".join(f'  File "{r.choice(NOUNS)}/{r.choice(NOUNS)}.py", line {k}, in {r.choice(NOUNS)}\n    {r.choice(NOUNS)}.{r.choice(NOUNS)}()' for k in range(20))
    bad[513] = " ".join(r.choice(NOUNS).title() for _ in range(60)) + "\n\n" + " ".join(r.choice(NOUNS) for _ in range(90))
    return good, bad


def test_prose_is_told_from_the_rest(spark):
    good, bad = documents()
    rows = [(i, t, "x") for i, t in (good | bad).items()] + [(900, None, "x"), (901, "", "x"), (902, " \n ", "x"), (0, good[0], "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, is_prose string")
    got = prose.prose_statistics(df).collect()
    flagged = {r["doc_id"] for r in got if not r["is_prose"]}
    assert flagged == set(bad)
    assert len(got) == len(rows) - 1
    one = next(r for r in got if r["doc_id"] == 500)
    assert max(one["contributions"], key=one["contributions"].get) in ("list_share", "common_share")
    assert next(r for r in got if r["doc_id"] == 901)["word_count"] == 0
    assert prose.prose_statistics(df.limit(0)).count() == 0


def test_the_floor_bounds_the_spread_from_below():
    """Where prose varies more than the floor, the fitted variance stays what the trimmed moments say."""
    from corpuskit.llm.prose import FLOOR, P

    r = np.random.default_rng(3)
    cov = np.diag((2 * FLOOR) ** 2)
    cov[0, 0] = (FLOOR[0] / 10) ** 2
    got = prose.with_floor(cov)
    assert np.isclose(got[0, 0], FLOOR[0] ** 2)
    assert np.allclose(got[1:, 1:], cov[1:, 1:])
    x = r.normal(size=(500, P)) * FLOOR
    assert (np.linalg.eigvalsh(prose.with_floor(np.cov(x.T))) > 0).all()


def test_statistics_of_a_text():
    whole, rows = prose.describe("Is it on? Yes, 12 + 3.\nNo")
    assert whole[0] == 5 and len(rows) == 1
    assert whole[1] == np.mean([2, 2, 2, 3, 2]) and whole[5] == 0.5
    assert prose.describe("x" * 300_000)[0][0] == 1
