import random

from pyspark.sql import functions as F

from corpuskit.operators import tokens, windows


def sequential(sizes, capacity):
    out, shard, used = [], -1, capacity + 1
    for n in sizes:
        if used + n > capacity:
            shard, used = shard + 1, 0
        out.append((shard, used))
        used += n
    return out


def test_next_fit_is_the_sequential_one_over_many_ranges(spark):
    r = random.Random(7)
    for capacity, top in ((20, 9), (50, 60), (5, 1), (1000, 30)):
        sizes = [r.randint(0, top) for _ in range(300)]
        ids = sorted(r.sample(range(-(10**9), 10**12), 300))
        df = spark.createDataFrame(list(zip(ids, sizes, ["x"] * 300)), "id bigint, n bigint, shard string").drop("shard").repartition(5)
        got = {x["id"]: (x["shard"], x["offset"]) for x in windows.next_fit_shards(df, "id", "n", capacity, rows=17).collect()}
        assert [got[i] for i in ids] == sequential(sizes, capacity)
    assert windows.next_fit_shards(df.limit(0), "id", "n", 10).count() == 0


def test_next_fit_with_nulls_and_rows_beyond_the_capacity(spark):
    df = spark.createDataFrame([(1, None), (2, 99), (3, 1), (4, 4), (5, None)], "id bigint, n bigint")
    got = {x["id"]: (x["shard"], x["offset"]) for x in windows.next_fit_shards(df, "id", "n", 5, rows=2).collect()}
    assert [got[i] for i in range(1, 6)] == sequential([0, 99, 1, 4, 0], 5)


def test_next_fit_of_rows_given_twice(spark):
    df = spark.createDataFrame([(1, 3, "a"), (1, 3, "a"), (2, 4, "b"), (2, 4, "b"), (3, 1, "c")], "id bigint, n bigint, t string")
    got = windows.next_fit_shards(df, "id", "n", 7, rows=2).collect()
    assert sorted((x["shard"], x["offset"], x["n"]) for x in got) == [(0, 0, 3), (0, 3, 3), (1, 0, 4), (2, 0, 4), (2, 4, 1)]


def test_running_offsets_with_an_outlying_id(spark):
    rows = [(i, i % 7) for i in range(200)] + [(10**15, 3)]
    got = {x["id"]: x["offset"] for x in windows.running_offsets(spark.createDataFrame(rows, "id bigint, n bigint"), "id", "n", rows=20).collect()}
    at = 0
    for i, n in rows:
        assert got[i] == at
        at += n
    assert windows.running_offsets(spark.createDataFrame([], "id bigint, n bigint"), "id", "n").count() == 0


def test_packed_sequences_are_the_cut_stream(spark):
    r = random.Random(2)
    for length in (1, 5, 8):
        docs = [(i * 3, [r.randrange(100) for _ in range(r.randint(0, 13))]) for i in range(50)] + [(999, None)]
        stream = [(i, k, x) for i, a in docs for k, x in enumerate(a or [])]
        df = spark.createDataFrame(docs, "id bigint, ids array<int>").repartition(4)
        for pad in (False, True):
            got = {x["sequence"]: x for x in windows.packed_sequences(df, "id", "id", "ids", length, pad, -1).collect()}
            want = [stream[at : at + length] for at in range(0, len(stream), length)]
            if not pad and len(want[-1]) < length:
                want.pop()
            assert sorted(got) == list(range(len(want)))
            for k, part in enumerate(want):
                assert got[k]["ids"] == [x for _, _, x in part] + [-1] * (length - len(part)) and got[k]["tokens"] == len(part)
                assert [(d["id"], d["from_token"] + n) for d in got[k]["documents"] for n in range(d["end"] - d["start"])] == [(i, n) for i, n, _ in part]


def test_shards_of_sequences(spark):
    s = windows.in_shards(spark.range(10_514).select(F.col("id").alias("sequence")), 1025, 10_000_000)
    assert [tuple(x) for x in windows.shard_index(s, 1025).orderBy("shard").collect()] == [(0, 9756, 9_999_900, 19_999_800, 0), (1, 758, 776_950, 1_553_900, 9756)]


def test_short_windows_are_padded_or_left_out(spark):
    df = spark.createDataFrame([(1, [1, 2, 3, 4, 5]), (2, [6, 7]), (3, [8]), (4, []), (5, None)], "id bigint, ids array<int>")
    rows = [(x["id"], x["inputs"], x["targets"], x["tokens"]) for x in windows.sliding_windows(df, "ids", 3, 1, "pad").collect()]
    assert rows == [(1, [1, 2, 3], [2, 3, 4], 3), (1, [2, 3, 4], [3, 4, 5], 3), (2, [6, 0, 0], [7, 0, 0], 1)]
    assert windows.sliding_windows(df, "ids", 3, 1).count() == 2


def test_vocabularies_too_large_for_a_table_are_joined(spark):
    df = spark.createDataFrame([(1, "b a b c"), (2, "d, a"), (3, ""), (4, None)], "id bigint, text string")
    v = tokens.vocabulary(df, "id", "text", 8, 1)
    rows = lambda d, c: sorted((x["id"], x[c]) for x in d.collect())
    assert rows(tokens.encode(df, v, "id", "text"), "ids") == rows(tokens.encode(df, v, "id", "text", most=1), "ids")
    e = tokens.encode(df, v, "id", "text")
    assert rows(tokens.decode(e, v, "id", "ids"), "tokens") == rows(tokens.decode(e, v, "id", "ids", most=1), "tokens")
    full = tokens.full_vocabulary(df, "id", "text")
    back = tokens.decode(tokens.encode(df, full, "id", "text"), full, "id", "ids")
    assert rows(back, "tokens") == [(1, ["b", "a", "b", "c"]), (2, ["d", ",", "a"])]
