"""Train, validation and test splits without leakage between groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.operators.windows import running_offsets
from corpuskit.runtime import sized


def allocate(total: int, ratios: dict[str, float], at_least_one: bool = True) -> dict[str, int]:
    """Whole counts by largest remainder; ties go to the larger ratio, then to the earlier name.

    With ``at_least_one`` every split of a positive ratio gets one where the
    total allows it, taken from the largest.
    """
    scale = sum(ratios.values()) or 1.0
    exact = {k: total * r / scale for k, r in ratios.items()}
    out = {k: int(v) for k, v in exact.items()}
    names = list(ratios)
    by_rest = sorted(names, key=lambda k: (-(exact[k] - out[k]), -ratios[k], names.index(k)))
    for k in by_rest[: total - sum(out.values())]:
        out[k] += 1
    if at_least_one and total >= sum(r > 0 for r in ratios.values()):
        for k in names:
            if ratios[k] > 0 and not out[k]:
                out[max(names, key=lambda x: out[x])] -= 1
                out[k] = 1
    return out


def group_split(df: DataFrame, group: str, ratios: dict[str, float], seed: int = 42) -> DataFrame:
    """df with ``assigned``: whole groups ordered by a seeded hash are cut at the allocated counts.

    Only the distinct groups are ranked, not the rows. The rank is computed in
    two levels (ranges of the hash, then within them), so no task sees all
    groups. Null groups are one group.
    """
    key = F.coalesce(F.col(group).cast("string"), F.lit(""))
    groups = df.select(key.alias("_g")).distinct().select("_g", F.sha2(F.concat(F.lit(f"{seed}\x00"), "_g"), 256).alias("_h"))
    ranked, n = ranks(groups, "_h", "_g")
    counts = allocate(n, ratios)
    bound, label = 0, F.lit(None).cast("string")
    for name, c in counts.items():
        label = F.coalesce(label, F.when(F.col("_rank") < bound + c, name))
        bound += c
    ranked, _ = sized(ranked.select("_g", label.alias("assigned")))
    return df.withColumn("_g", key).join(ranked, "_g", "left").drop("_g")


def ranks(df: DataFrame, hash_hex: str, tie: str, buckets: int = 4096) -> tuple[DataFrame, int]:
    """df with ``_rank`` from 0 in order of a uniform hex hash, and the number of rows; no global sort in one task."""
    width = 65536 // buckets
    b = df.withColumn("_b", F.floor(F.conv(F.substring(hash_hex, 1, 4), 16, 10).cast("int") / width).cast("int"))
    counts = {r["_b"]: r["count"] for r in b.groupBy("_b").count().collect()}  # at most ``buckets`` rows
    starts, at = [], 0
    for k in range(buckets):
        starts.append(at)
        at += counts.get(k, 0)
    w = Window.partitionBy("_b").orderBy(hash_hex, tie)
    start = F.element_at(F.array(*[F.lit(x) for x in starts]), F.col("_b") + 1)
    return b.withColumn("_rank", start + F.row_number().over(w) - 1).drop("_b"), at


def leakage(df: DataFrame, group: str, split: Column) -> DataFrame:
    """Groups whose rows lie in more than one split."""
    return (
        df.filter(F.col(group).isNotNull() & split.isNotNull())
        .groupBy(group)
        .agg(F.count_distinct(split).alias("splits"), F.count(F.lit(1)).alias("rows"))
        .filter("splits > 1")
    )


def allocate_by_fraction(total: int, ratios: dict[str, float]) -> dict[str, int]:
    """Whole counts by largest remainder; ties go to the earlier name, and a split may stay empty."""
    exact = [total * r for r in ratios.values()]
    out = [int(x) for x in exact]
    for k in sorted(range(len(out)), key=lambda k: (-(exact[k] - out[k]), k))[: max(0, total - sum(out))]:
        out[k] += 1
    return dict(zip(ratios, out))


def shuffled(df: DataFrame, by: Column, id_col: str, seed: int) -> DataFrame:
    """df with ``place`` from 0 within each split, in order of a seeded hash of the id.

    The order of all rows is that of (split, hash, id); it is numbered in ranges,
    so that no task sorts a whole split.
    """
    key = F.struct(by.alias("s"), F.sha2(F.concat(F.lit(f"{seed}\x00"), F.col(id_col).cast("string")), 256).alias("h"), F.col(id_col).alias("i"))
    numbered = running_offsets(df.withColumn("_key", key).withColumn("_one", F.lit(1)), "_key", "_one", "_all")
    sizes = numbered.groupBy(F.col("_key.s").alias("_s")).agg(F.min("_all").alias("_first"))
    j = numbered.join(sizes, F.col("_key.s").eqNullSafe(F.col("_s")))
    return j.withColumn("place", F.col("_all") - F.col("_first")).drop("_key", "_one", "_all", "_first", "_s")


def epoch_sample(df: DataFrame, id_col: str, seed: int, epoch: int, rank: int, workers: int, start: int = 0) -> DataFrame:
    """(id, place): the ids that worker ``rank`` of ``workers`` reads in an epoch, in its order, from its ``start``-th on."""
    one = shuffled(df.select(id_col), F.lit(0), id_col, seed + epoch)
    mine = one.filter(F.pmod(F.col("place"), F.lit(workers)) == rank).select(id_col, F.floor(F.col("place") / workers).alias("place"))
    return mine.filter(F.col("place") >= start)


def worker_of(shard: Column, workers: int) -> Column:
    """The worker that reads a shard."""
    return F.pmod(shard, F.lit(workers))
