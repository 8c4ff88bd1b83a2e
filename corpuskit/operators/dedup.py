"""Order-dependent deduplication: the first row in a documented order wins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.runtime import cut


def first_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, first): the least order value of each key, with a combine on the map side; hot keys cost one row a partition."""
    return df.groupBy(*keys).agg(F.min(order).alias("first"))


def duplicates_by(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """df with ``duplicate_of``: the first id with the same key, null for the first itself and for null keys."""
    firsts = first_by(df.filter(F.col(key).isNotNull()), [key], id_col)
    joined = df.join(firsts, key, "left")
    return joined.withColumn("duplicate_of", F.when(F.col("first") != F.col(id_col), F.col("first"))).drop("first")


def two_level(df: DataFrame, id_col: str, exact: Column, loose: Column) -> DataFrame:
    """(id, reason, duplicate_of): exact_duplicate or normalized_duplicate of an earlier kept row, else null.

    The kept row of a class of equal loose keys is its first; a later row with
    the same exact key as the kept one is an exact duplicate, any other a
    normalized one. Null keys are nobody's duplicate.
    """
    keyed = df.select(F.col(id_col), exact.alias("_exact"), loose.alias("_loose"))
    kept = keyed.filter("_loose is not null").groupBy("_loose").agg(F.min(F.struct(id_col, "_exact")).alias("k"))
    j = keyed.join(kept, "_loose", "left")
    later = F.col("k")[id_col] < F.col(id_col)
    reason = F.when(later, F.when(F.col("k._exact").eqNullSafe(F.col("_exact")), "exact_duplicate").otherwise("normalized_duplicate"))
    return j.select(id_col, reason.alias("reason"), F.when(later, F.col("k")[id_col]).alias("duplicate_of"))


def groups(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """Per key that occurs more than once: the kept id, the number of rows, the excess."""
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.min(id_col).alias("canonical"), F.count(F.lit(1)).alias("rows"))
        .filter("rows > 1")
        .withColumn("excess", F.col("rows") - 1)
    )


#: At most so many undecided edges are finished in one task, as a stream.
STREAM_EDGES = 1_000_000


def _rejected_in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rejected ids of all edges, given in order of b: the edges that decide an a come before those from it."""
    rejected: set[int] = set()
    for batch in batches:
        new = []
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
            if a not in rejected and b not in rejected:
                rejected.add(b)
                new.append(b)
        yield pd.DataFrame({"b": pd.Series(new, dtype="int64")})


def greedy_survivors(edges: DataFrame, nodes: DataFrame, id_col: str = "id", most_rounds: int = 100, stream: int = STREAM_EDGES) -> DataFrame:
    """(id, accepted, duplicate_of): rows in order of id; a row is rejected if an accepted earlier row is linked to it.

    ``edges`` has (a, b), a < b; ``duplicate_of`` is the least accepted neighbour.
    In each round rows without open earlier neighbours are accepted and all rows
    linked to them rejected, so a group of mutually linked rows takes one round;
    a chain takes one for every two rows. When at most ``stream`` edges are open,
    one task decides them in order. Raises if rows are open after
    ``most_rounds``. Rows without edges are accepted and take no part.
    """
    edges = cut(edges.select("a", "b").distinct())
    rejected = edges.select("b").limit(0)
    live = edges
    for _ in range(most_rounds + 1):
        n = live.count()
        if n <= stream:
            break
        firsts = live.select("a").distinct().join(live.select(F.col("b").alias("a")), "a", "left_anti")
        losers = cut(live.join(firsts, "a", "left_semi").select("b").distinct())
        rejected = cut(rejected.union(losers))
        # What an accepted row is linked to is decided, so its edges go as well.
        live = cut(live.join(losers, "b", "left_anti").join(losers.select(F.col("b").alias("a")), "a", "left_anti").select("a", "b"))
    else:
        raise RuntimeError(f"{n} edges are undecided after {most_rounds} rounds")
    if n:
        rejected = cut(rejected.union(live.repartition(1).sortWithinPartitions("b").mapInPandas(_rejected_in_order, "b bigint")))
    lost = rejected.select(F.col("b").alias("a"))
    by = edges.join(rejected, "b", "left_semi").join(lost, "a", "left_anti").groupBy("b").agg(F.min("a").alias("duplicate_of"))
    return nodes.select(id_col).join(by.withColumnRenamed("b", id_col), id_col, "left").select(
        id_col, F.col("duplicate_of").isNull().alias("accepted"), "duplicate_of"
    )
