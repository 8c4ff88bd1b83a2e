"""Clusters of the packing, from the texts on."""


def test_p4_keeps_clusters_whose_least_id_only_seems_alike(spark, tmp_path):
    """The least id agrees with a crowd on most hashes, but is just below the similarity of a cluster."""
    import random

    from corpuskit.llm import queries
    from corpuskit.functions.shingles import MinHasher, exact_jaccard, shingle_set
    from corpuskit.operators import setsim

    r = random.Random(1)
    base = [f"w{i}" for i in range(100)]
    crowd = [" ".join([*base, f"v{i}"]) for i in range(100)]
    hasher = MinHasher(setsim.RUNS + setsim.TRAIL)
    mins = hasher(shingle_set(" ".join(base), 5))
    for n in range(20_000):
        first = [f"y{n}", *base[1:]]
        first[r.randrange(10, 45)], first[r.randrange(55, 90)] = f"a{n}", f"b{n}"
        same = hasher(shingle_set(" ".join(first), 5)) == mins
        if same[: setsim.RUNS].all() and same[setsim.RUNS :].sum() >= 29:
            break
    first = " ".join(first)
    assert same[: setsim.RUNS].all() and 0.75 < max(exact_jaccard(first, c, 5) for c in crowd) < 0.8
    rows = [(i, t, 10, f"repo{i}") for i, t in enumerate([first, *crowd])]
    spark.createDataFrame(rows, "record_id bigint, text string, byte_count bigint, repo_name string").write.parquet(f"{tmp_path}/code_records.parquet")
    settings = [(1, "x", 10_000, 10_000_000, False, False, False)]
    names = "settings_id int, shard_prefix string, context_length int, max_tokens_per_shard bigint, add_bos boolean, add_eos boolean, pad_final_sequence boolean"
    spark.createDataFrame(settings, names).write.parquet(f"{tmp_path}/packing_settings.parquet")
    packed = queries.p4_containers(spark, str(tmp_path)).filter("record_id > 0").collect()
    assert len({x["container"] for x in packed}) == len(packed) == 100
