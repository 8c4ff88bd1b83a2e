import random

from corpuskit.llm import leaks


def brute(doc, item):
    """Whether some run of 20 or more words of the item is within one error in seven of a part of the document."""
    a, b = leaks.passage_words(item), leaks.passage_words(doc)
    for i in range(len(a)):
        # Edit distance of a[i:j] to the best part of b that begins anywhere; rows over j.
        row = [0] * (len(b) + 1)
        for j in range(i, min(len(a), i + 45)):
            new = [row[0] + 1]
            for k in range(1, len(b) + 1):
                new.append(min(row[k] + 1, new[-1] + 1, row[k - 1] + (a[j] != b[k - 1])))
            row = new
            n = j - i + 1
            if n >= 20 and min(row) * 7 <= n:
                return True
    return False


def test_equals_brute_force():
    r = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    hits = 0
    for _ in range(150):
        item = [r.choice(words) for _ in range(r.randint(15, 60))]
        start = r.randrange(max(1, len(item) - 25))
        part = item[start : start + r.randint(12, 34)]
        for _ in range(r.choice([0, 1, 2, 3, 4, 5])):
            at, how = r.randrange(len(part)), r.random()
            if how < 0.4:
                part[at] = "other"
            elif how < 0.7 and len(part) > 1:
                del part[at]
            else:
                part.insert(at, "more")
        doc = [r.choice(words) for _ in range(r.randint(0, 30))] + part + [r.choice(words) for _ in range(r.randint(0, 30))]
        a, b = leaks.word_hashes(doc), leaks.word_hashes(item)
        places = [[(p, q) for p, x in enumerate(leaks.seeds(a, m)) for q, y in enumerate(leaks.seeds(b, m)) if x == y] for m in leaks.MASKS]
        got = len(item) >= leaks.LEAST and len(places[0]) > 1 and leaks.holds(a, b, [x for ps in places for x in ps])
        want = brute(" ".join(doc), " ".join(item))
        hits += want
        assert got == want
    assert 30 < hits < 130


def test_words_ignore_markup_and_line_starts():
    assert leaks.passage_words("> **Sort** the\n> <b>big</b>&nbsp;list, now!\u200b") == "sort the big list now".split()
    assert leaks.passage_words(None) == leaks.passage_words("--") == []


def test_table(spark):
    text = " ".join(f"word{i}" for i in range(30))
    code = "\n".join(f"step_{i} = run(step_{i - 1}, {i})" for i in range(9))
    docs = [(1, "Start. " + text.upper().replace(" ", ", ") + " end", "z"), (2, text[:100], "z"), (3, None, "z"), (4, "", "z"), (5, "> " + code.replace("\n", "\n> "), "z"), (1, "Start. " + text, "z")]
    items = [(7, text, None), (8, text, "short"), (9, "q", code), (10, None, None), (11, "", "")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame(items, "item_id bigint, prompt string, answer string")
    got = leaks.leaks(d, i)
    assert sorted(map(tuple, got.collect())) == [(1, 7), (1, 8), (5, 9)]
    assert {r["item_id"]: r["documents"] for r in leaks.leaked_items(got).collect()} == {7: 1, 8: 1, 9: 1}
    assert leaks.leaks(d.limit(0), i).count() == leaks.leaks(d, i.limit(0)).count() == 0


def test_filter_lets_every_known_seed_through(spark):
    import numpy as np

    r = np.random.default_rng(2)
    known = r.integers(0, 2**63, 3_000, dtype=np.uint64)
    filter_, bits = leaks.bloom(spark.createDataFrame([(int(x),) for x in known.view(np.int64)], "seed bigint"), len(known))
    assert len(leaks._passes(known, filter_, bits)) == len(known)
    strange = r.integers(0, 2**63, 100_000, dtype=np.uint64)
    assert len(leaks._passes(strange, filter_, bits)) < 100


def test_hot_seeds_and_many_items(spark):
    """A phrase that stands in every document and item, and one leak among them."""
    common = " ".join(f"c{j}" for j in range(8))
    docs = [(k, f"{common} " + " ".join(f"d{k}x{j}" for j in range(25)) + (f" {common}" * 3)) for k in range(40)]
    items = [(k, " ".join(f"w{k}x{j}" for j in range(25)) + f" {common}", None) for k in range(40)]
    docs.append((99, "so " + items[7][1].replace("w7x3 ", "odd ") + " it ends"))
    got = leaks.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, prompt string, answer string"))
    assert [tuple(x) for x in got.collect()] == [(99, 7)]
