from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from corpuskit.llm import packing


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(-1, 4), st.integers(-1, 3)), max_size=60))
def test_best_fit_keeps_its_rules(items):
    needs, sources, clusters = ([x[k] for x in items] for k in range(3))
    bins, offsets, left, limits = packing.best_fit(needs, sources, clusters, 50)
    held = defaultdict(list)
    for i, b in enumerate(bins):
        held[b].append(i)
    assert len(held) == len(left)
    for b, own in held.items():
        assert sum(needs[i] for i in own) + left[b] == 50
        spans = sorted((offsets[i], offsets[i] + needs[i]) for i in own)
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        seen = [clusters[i] for i in own if clusters[i] >= 0]
        assert len(seen) == len(set(seen))
        for s in {sources[i] for i in own} - {-1}:
            assert sum(sources[i] == s for i in own) <= limits[s]
    least = max(1, -(-sum(needs) // 50))
    for s, limit in enumerate(limits):
        assert limit <= 1 or sum(x == s for x in sources) > least  # only sources that can't fit otherwise share
    # Without conflicts no two containers could be merged.
    if not any(c >= 0 for c in clusters) and not any(s >= 0 for s in sources):
        small = sorted(50 - x for x in left)
        assert len(small) < 2 or small[0] + small[1] > 50 or small[0] == 0


def _settings(spark, rows):
    return spark.createDataFrame(rows, "settings_id int, shard_prefix string, context_length int, max_tokens_per_shard bigint, add_bos boolean, add_eos boolean")


def test_pack_places_every_item_once(spark):
    rows = [(i, (i * 37) % 150, f"s{i % 3}", i % 5 if i % 2 else None) for i in range(300)] + [(900, None, None, None), (901, 0, "s", None), (901, 0, "s", None), (902, 1000, "s", 3)]
    items = spark.createDataFrame(rows, "id bigint, length bigint, source string, cluster bigint")
    s = _settings(spark, [(1, "a", 100, 1000, False, True), (2, None, 64, None, True, True), (3, "z", 0, 5, True, True), (4, "n", None, 5, None, None)])
    got = packing.pack(items, s, group_items=100).toPandas()
    assert set(got["settings_id"]) == {1, 2}
    for sid, cap, extra in ((1, 100, 1), (2, 64, 2)):
        p = got[got["settings_id"] == sid]
        sums = p.groupby("id")["tokens"].sum()
        for i, n, *_ in rows:
            times = sum(r[0] == i for r in rows)
            assert sums[i] == ((n or 0) + extra) * times
            if (n or 0) + extra <= cap:
                assert (p[p["id"] == i]["piece"] == 0).all()
        per = p.groupby("container").agg(t=("tokens", "sum"), u=("unused", "max"))
        assert ((per["t"] + per["u"]) == cap).all()
    report = {r["settings_id"]: r for r in packing.packing_report(packing.pack(items, s, 100)).collect()}
    assert report[1]["unused_share"] < 0.1 and report[1]["containers"] >= report[1]["least_containers"]
    unique = items.filter("id is not null").dropDuplicates(["id"])
    broken = packing.invariants(packing.pack(unique, s, group_items=100), unique).collect()
    assert {r["settings_id"]: (r["items"], r["bad_containers"], r["needless_splits"], r["repeated_clusters"], r["crowded_sources"]) for r in broken} == {i: (303, 0, 0, 0, 0) for i in (1, 2)}


def test_pack_of_nothing(spark):
    items = spark.createDataFrame([], "id bigint, length bigint, source string, cluster bigint")
    s = _settings(spark, [(1, "a", 100, 1000, False, True)])
    assert packing.pack(items, s).count() == 0
    assert packing.pack(items, _settings(spark, [])).count() == 0


def test_a_source_shares_a_container_only_where_it_must(spark):
    """Nine sources of ten items never share; one with more items than containers shares as little as can be."""
    rows = [(i, 10, f"s{i % 9}", None) for i in range(90)] + [(100 + i, 10, "hot", None) for i in range(60)]
    items = spark.createDataFrame(rows, "id bigint, length bigint, source string, cluster bigint")
    got = packing.pack(items, _settings(spark, [(1, "a", 100, 1000, False, False)])).toPandas()
    got["source"] = got["id"].map({r[0]: r[2] for r in rows})
    most = got.groupby(["source", "container"]).size().groupby("source").max()
    assert most.drop("hot").eq(1).all() and most["hot"] == 4  # 15 containers for 60 items
    assert set(got[got["source"] == "hot"]["source_limit"]) == {4} and got["container"].nunique() == 15
