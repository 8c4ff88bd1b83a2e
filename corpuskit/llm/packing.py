"""Filling containers of fixed capacity with items of varying length.

Conflict-constrained best fit: bins are ordered by residual space and carry
bitmaps of the sources and duplicate clusters they hold; the successor search
goes on from the tightest bin to the next until one is compatible, and a new
container is taken where none is.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items that are packed together in one task; more items make more groups, not larger ones.
GROUP_ITEMS = 5_000
_LOCAL = 1 << 20  # container numbers of a group


def item_length(byte_count: Column, text: Column) -> Column:
    """Length in tokens of one byte each: the UTF-8 size of the text; without a text, a byte_count that can be right, else 0."""
    return F.coalesce(F.octet_length(text), F.when(byte_count > 0, byte_count), F.lit(0)).cast("bigint")


def best_fit(
    needs: list[int], sources: list[int], clusters: list[int], capacity: int
) -> tuple[list[int], list[int], list[int], list[int]]:
    """The better of two orders of ``best_fit_in_order``, and the limit of each source.

    By falling length; and so, but with members of large conflict groups first,
    which wins where such a group has nearly as many members as there are bins.

    A source's limit is 1 unless it has more items than the bins that the items
    need at least; then it is the least that could fit.
    """
    bins = max(1, -(-sum(needs) // capacity))
    of_cluster = Counter(c for c in clusters if c >= 0)
    of_source = Counter(s for s in sources if s >= 0)
    limits = [-(-of_source[s] // bins) for s in range(max(sources, default=-1) + 1)]
    by_length = sorted(range(len(needs)), key=lambda i: (-needs[i], i))

    def crowd(i: int) -> int:
        n = max(of_cluster[clusters[i]], of_source[sources[i]])
        return n if 2 * n > bins else 0

    by_crowd = sorted(by_length, key=lambda i: -crowd(i))
    tries = [best_fit_in_order(o, needs, sources, clusters, limits, capacity) for o in ([by_length] if by_crowd == by_length else [by_length, by_crowd])]
    return *min(tries, key=lambda t: len(t[2])), limits


def best_fit_in_order(
    order: list[int], needs: list[int], sources: list[int], clusters: list[int], limits: list[int], capacity: int
) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each item (each at most the capacity), and the residual space of each bin.

    Items are placed in the given order, each into the tightest open bin that is
    compatible, else into a new one. Two items of a cluster (a number of 0 or
    more; negative: none) never share a bin, nor more items of a source than its
    limit.
    """
    bins: list[int] = [0] * len(needs)
    offsets: list[int] = [0] * len(needs)
    left: list[int] = []
    taken: list[int] = []  # per bin, the bitmap of clusters in it and, above those, of sources at their limit
    held: Counter[tuple[int, int]] = Counter()  # items of a bin and source, where the limit is over 1
    first_source = max(clusters, default=-1) + 1
    at: dict[int, list[int]] = {}  # residual: its open bins
    open_mask = 0  # bit r: some bin has residual r
    for i in order:
        need, source = needs[i], sources[i]
        conflicts = (1 << clusters[i] if clusters[i] >= 0 else 0) | (1 << first_source + source if source >= 0 else 0)
        mask, residual, b = open_mask >> need, need, -1
        while mask and b < 0:
            low = (mask & -mask).bit_length() - 1
            residual += low
            for x in reversed(at[residual]):
                if not taken[x] & conflicts:
                    b = x
                    break
            mask >>= low + 1
            residual += 1
        if b < 0:
            b = len(left)
            left.append(capacity)
            taken.append(0)
        else:
            peers = at[left[b]]
            peers.remove(b)
            if not peers:
                del at[left[b]]
                open_mask &= ~(1 << left[b])
        bins[i], offsets[i] = b, capacity - left[b]
        left[b] -= need
        if source >= 0 and limits[source] > 1:
            held[b, source] += 1
            if held[b, source] < limits[source]:
                conflicts &= ~(1 << first_source + source)
        taken[b] |= conflicts
        at.setdefault(left[b], []).append(b)
        open_mask |= 1 << left[b]
    return bins, offsets, left


def _pack_group(pdf: pd.DataFrame) -> pd.DataFrame:
    first = pdf.iloc[0]
    capacity, extra, group = int(first["capacity"]), int(first["extra"]), int(first["grp"])
    pdf = pdf.sort_values(["id", "length"], kind="stable")
    rows: list[tuple] = []  # id, piece, need
    full: list[tuple] = []
    for i, (rid, length) in enumerate(zip(pdf["id"], pdf["length"])):
        need = int(length) + extra
        piece = 0
        while need > capacity:
            full.append((i, rid, piece, capacity))
            need -= capacity
            piece += 1
        rows.append((i, rid, piece, need))
    source = pd.factorize(pdf["source"])[0]
    cluster = pd.factorize(pdf["cluster"])[0]
    alone = pd.Series(cluster).map(pd.Series(cluster).value_counts()).eq(1)
    cluster[alone.to_numpy()] = -1
    source = source.tolist()
    bins, offsets, left, limits = best_fit([r[3] for r in rows], source, cluster.tolist(), capacity)
    limit = [limits[s] if s >= 0 else None for s in source]
    out = [(rid, piece, len(left) + k, 0, need, 0, limit[i]) for k, (i, rid, piece, need) in enumerate(full)]
    out += [(rid, piece, b, o, need, left[b], limit[i]) for (i, rid, piece, need), b, o in zip(rows, bins, offsets)]
    res = pd.DataFrame(out, columns=["id", "piece", "container", "start", "tokens", "unused", "source_limit"]).astype({"source_limit": "Int32"})
    res.insert(0, "settings_id", first["settings_id"])
    per = max(1, int(first["per_shard"]))
    res["shard"] = [f"{first['prefix']}-{group:06d}-{c // per:04d}" for c in res["container"]]
    res["container"] += group * _LOCAL
    return res


_OUT = "settings_id int, id bigint, piece int, container bigint, start int, tokens int, unused int, source_limit int, shard string"


def pack(items: DataFrame, settings: DataFrame, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Containers of all items under each row of settings.

    ``items``: id, length, source, cluster (null: no conflict). ``settings``:
    settings_id, shard_prefix, context_length, max_tokens_per_shard, add_bos,
    add_eos; its rows are few and are crossed with nothing but groups of items.
    An item takes its length and one token for each of add_bos and add_eos. An
    item longer than a container fills containers of its own and only its last
    piece is packed with others; no other item is split.

    Result: one row per piece, with its container (unique per settings_id), its
    start and size there, the container's unused space, the shard, and
    ``source_limit``: how many items of the item's source a container may hold;
    1 but for sources with more items than containers (null without a source).
    Sources compare as given; null sources conflict with nothing.

    Items are spread over groups by a hash, about ``group_items`` in each, so a
    hot source or cluster is spread too; groups are packed on their own, which
    leaves open at most a few containers per group. Null lengths count as 0,
    negative ones too; settings without a positive context_length give no rows;
    repeated rows are items of their own. Empty tables give empty results.
    """
    n = items.count()
    groups = max(1, -(-n // group_items))
    grp = F.pmod(F.xxhash64("id", "length"), F.lit(groups)).alias("grp")
    base = items.select(
        "id", F.greatest(F.coalesce("length", F.lit(0)), F.lit(0)).alias("length"), "source", "cluster", grp
    ).filter("id is not null")
    flags = F.coalesce("add_bos", F.lit(False)).cast("int") + F.coalesce("add_eos", F.lit(False)).cast("int")
    rows = settings.filter("context_length > 0 and settings_id is not null").select(
        F.col("settings_id").cast("int"),
        F.col("context_length").cast("int").alias("capacity"),
        flags.alias("extra"),
        F.floor(F.coalesce("max_tokens_per_shard", "context_length") / F.col("context_length")).cast("bigint").alias("per_shard"),
        F.coalesce("shard_prefix", F.lit("shard")).alias("prefix"),
    )
    chosen = [r.asDict() for r in rows.collect()]  # a settings table: a handful of rows, written by hand
    if not chosen:
        return items.sparkSession.createDataFrame([], _OUT)
    each = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in r.items()]) for r in chosen])
    return (
        base.select("*", F.explode(each).alias("s"))
        .select("id", "length", "source", "cluster", "grp", "s.*")
        .groupBy("settings_id", "grp")
        .applyInPandas(_pack_group, _OUT)
    )


def packing_report(packed: DataFrame) -> DataFrame:
    """Per settings: containers, the least number that the tokens need, pieces, tokens, unused space and its share, and the widest source limit.

    ``containers - least_containers`` is the price of whole items and conflicts;
    ``shared_sources`` counts the items of sources that had to share containers.
    """
    each = packed.groupBy("settings_id", "container").agg(
        F.count(F.lit(1)).alias("pieces"),
        F.sum("tokens").alias("tokens"),
        F.max("unused").alias("unused"),
        F.max("source_limit").alias("limit"),
        F.count_if(F.col("source_limit") > 1).alias("shared"),
    )
    tokens, unused = F.sum("tokens"), F.sum("unused")
    capacity = F.max(F.col("unused") + F.col("tokens"))
    return each.groupBy("settings_id").agg(
        F.count(F.lit(1)).alias("containers"),
        F.ceil(tokens / capacity).alias("least_containers"),
        F.sum("pieces").alias("pieces"),
        tokens.alias("tokens"),
        unused.alias("unused"),
        (unused / (unused + tokens)).alias("unused_share"),
        F.max("limit").alias("widest_source_limit"),
        F.sum("shared").alias("shared_sources"),
    )


def invariants(packed: DataFrame, items: DataFrame) -> DataFrame:
    """Per settings: items and tokens placed, and how often each rule is broken (0 throughout).

    ``items``: id (unique), length, source, cluster as they were packed. Rules:
    no container over its capacity or with overlapping pieces, none with two of
    a cluster or more of a source than its limit, no item split that fits.
    """
    p = packed.join(items.select("id", "source", "cluster"), "id")
    whole = packed.groupBy("settings_id", "container").agg(
        F.sum("tokens").alias("t"), F.max("unused").alias("u"), F.max(F.col("start") + F.col("tokens")).alias("end")
    )
    capacity = whole.groupBy("settings_id").agg(F.max(F.col("t") + F.col("u")).alias("capacity"))
    bad_bins = whole.join(F.broadcast(capacity), "settings_id").groupBy("settings_id").agg(  # a row for each of the settings
        F.count_if((F.col("t") + F.col("u") != F.col("capacity")) | (F.col("end") != F.col("t"))).alias("bad_containers")
    )
    per = packed.groupBy("settings_id", "id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("pieces"))
    placed = per.join(F.broadcast(capacity), "settings_id").groupBy("settings_id").agg(
        F.count(F.lit(1)).alias("items"), F.sum("t").alias("tokens"), F.count_if((F.col("pieces") > 1) & (F.col("t") <= F.col("capacity"))).alias("needless_splits")
    )
    twice = p.filter("cluster is not null").groupBy("settings_id", "container", "cluster").agg(F.count_distinct("id").alias("n"))
    twice = twice.groupBy("settings_id").agg(F.count_if(F.col("n") > 1).alias("repeated_clusters"))
    over = p.filter("source is not null").groupBy("settings_id", "container", "source").agg(F.count(F.lit(1)).alias("n"), F.max("source_limit").alias("limit"))
    over = over.groupBy("settings_id").agg(F.count_if(F.col("n") > F.col("limit")).alias("crowded_sources"))
    out = placed.join(bad_bins, "settings_id").join(twice, "settings_id", "left").join(over, "settings_id", "left")
    return out.fillna(0, ["repeated_clusters", "crowded_sources"])
