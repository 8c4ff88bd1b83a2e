"""Set-similarity join of a table with itself, over sets of word runs.

One row per distinct set, candidates from min-wise bands, exact Jaccard
similarity on the texts, connected groups of the links. The signature table has
about 180 bytes a record, whatever the length of the text; texts are moved only
for records of surviving candidate pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.shingles import MinHasher, exact_set, jaccard, shingle_set
from corpuskit.runtime import BLOCK, BROADCAST_ROWS, cut, salted_join, sized

#: Min-wise minima of four bytes, and those that travel along as single bytes for estimates.
RUNS, TRAIL = 12, 32
#: Edges of one class that meet in one task of a round of ``groups``.
HUB = 65_536


def agreement_floor(threshold: float, coords: int = TRAIL) -> int:
    """Least number of agreeing coordinates; 4.5 standard deviations below the threshold."""
    return max(1, math.floor(coords * threshold - 4.5 * math.sqrt(coords * threshold * (1 - threshold))))


def signatures(df: DataFrame, id_col: str, text_col: str, k: int, runs: int = RUNS, trail: int = TRAIL) -> DataFrame:
    """(id, set_hi, set_lo, heads binary, sig binary) of each text of at least k words.

    ``set_hi, set_lo`` are 128 bits that name the set, ``heads`` has 4 bytes a
    minimum, ``sig`` one; null and short texts give no row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        hasher = MinHasher(runs + trail)
        for b in batches:
            out: list[tuple] = []
            for i, text in zip(b["_id"], b["_text"]):
                s = shingle_set(text, k)
                if not len(s):
                    continue
                m = hasher(s)
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                hi, lo = (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)
                out.append((i, hi, lo, m[:runs].tobytes(), (m[runs:] & 255).astype(np.uint8).tobytes()))
            yield pd.DataFrame(out, columns=["id", "set_hi", "set_lo", "heads", "sig"])

    return (
        df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        .filter("_id is not null and _text is not null")
        .mapInPandas(run, "id bigint, set_hi bigint, set_lo bigint, heads binary, sig binary")
    )


def set_classes(sigs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members: id, rep) and (classes: rep, heads, sig); rep is the least id with the same set.

    Only sets that occur more than once are looked up; rows given twice count once.
    """
    again, n = sized(
        sigs.groupBy("set_hi", "set_lo")
        .agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("c"))
        .filter("c > 1")
        .drop("c")
    )
    tagged = sigs.join(again, ["set_hi", "set_lo"], "left").drop("set_hi", "set_lo")
    if n > BROADCAST_ROWS:
        tagged = cut(tagged)
    alone, twins = tagged.filter("rep is null"), tagged.filter("rep is not null")
    members = alone.select("id", F.col("id").alias("rep")).union(twins.select("id", "rep").distinct())
    classes = alone.select(F.col("id").alias("rep"), "heads", "sig").union(
        twins.filter("id = rep").dropDuplicates(["rep"]).select("rep", "heads", "sig")
    )
    return members, classes


def bytes_at(c: str, start: Column, n: int) -> Column:
    return F.substring(F.col(c), start, F.lit(n))


def agreeing(a: str, b: str, trail: int = TRAIL) -> Column:
    """Number of equal bytes of two trails, in the JVM."""
    same = F.transform(
        F.sequence(F.lit(1), F.lit(trail)),
        lambda j: F.when(F.substring(F.col(a), j, F.lit(1)) == F.substring(F.col(b), j, F.lit(1)), 1).otherwise(0),
    )
    return F.aggregate(same, F.lit(0), lambda x, y: x + y)


def banded_candidates(
    classes: DataFrame, sides: DataFrame, threshold: float, bands: int = 16, width: int = 2
) -> DataFrame:
    """Distinct candidate pairs (a < b) of classes with members on opposite sides.

    ``sides`` has (rep, left boolean, right boolean). ``heads`` of the classes
    must hold bands x width minima. Only buckets met from both sides give pairs.
    """
    least = agreement_floor(threshold)
    band = F.explode(
        F.transform(
            F.sequence(F.lit(0), F.lit(bands - 1)),
            lambda i: F.xxhash64(i, bytes_at("heads", i * (4 * width) + 1, 4 * width)),
        )
    ).alias("bucket")
    rows = classes.join(sides, "rep").filter("left or right").select("rep", "sig", "left", "right", band)
    lt = rows.filter("left").select("bucket", F.col("rep").alias("x"), F.col("sig").alias("sig_x"))
    rt = rows.filter("right").select("bucket", F.col("rep").alias("y"), F.col("sig").alias("sig_y"))
    return (
        salted_join(rt, lt, "bucket", "y", "x")
        .filter("x <> y")
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "sig_x", "sig_y")
        .filter(agreeing("sig_x", "sig_y") >= least)
        .select("a", "b")
        .distinct()
    )


def verified(pairs: DataFrame, df: DataFrame, id_col: str, text_col: str, k: int, threshold: float) -> DataFrame:
    """Pairs (a, b, similarity) whose exact Jaccard similarity reaches the threshold.

    Only texts of records that are in a pair are moved. The text of b goes along
    with its pair; that of a is sent once for each block of its pairs, so a
    record of many partners is spread over tasks without repeating its text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left: frozenset = frozenset()
        for batch in batches:
            out: list[tuple] = []
            for a, b, text, head in zip(batch["a"], batch["b"], batch["text"], batch["head"]):
                if head:  # the text of a comes before those of its block
                    left = exact_set(text, k)
                    continue
                similarity = jaccard(left, exact_set(text, k))
                if similarity >= threshold:
                    out.append((a, b, similarity))
            yield pd.DataFrame(out, columns=["a", "b", "similarity"])

    pairs = cut(pairs.select("a", "b").distinct())
    ids, _ = sized(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(ids, "id", "left_semi")
    texts = cut(texts)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    own = texts.withColumnRenamed("id", "a").join(blocks, "a").select("a", F.lit(0).cast("bigint").alias("b"), "text", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("salt"), F.lit(True).alias("head"))
    hot, n = sized(blocks.filter("blocks > 1"))
    salted = pairs.join(hot, "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("blocks"))) if n else pairs.withColumn("salt", F.lit(0))
    salted = salted.select("a", "b", F.coalesce("salt", F.lit(0)).cast("int").alias("salt"))
    other = salted_join(salted, texts.withColumnRenamed("id", "b"), "b", "a", "b").select("a", "b", "text", "salt", F.lit(False).alias("head"))
    return (
        own.union(other)
        .repartition(parts, "a", "salt")
        .sortWithinPartitions("a", "salt", F.desc("head"))
        .mapInPandas(run, "a bigint, b bigint, similarity double")
        .dropDuplicates(["a", "b"])  # rows given twice have their text twice
    )


def similar_pairs(
    df: DataFrame, id_col: str, text_col: str, k: int = 5, threshold: float = 0.8, bands: int = 16, width: int = 2
) -> tuple[DataFrame, DataFrame]:
    """Near-duplicates of a table: (links between classes: a < b, similarity) and (members: id, rep).

    Candidates share one of ``bands`` bands of ``width`` minima, links are those
    of exact Jaccard similarity of at least ``threshold``; a pair of similarity
    t is missed with probability (1 - t**width)**bands (8e-8 at 0.8). Hot bands
    are compared in blocks. Null texts and those of fewer than k words are in no
    class; equal sets are one class, represented by its least id; repeated ids
    count once. An empty table gives empty results. Other columns don't matter.
    """
    members, classes = set_classes(cut(signatures(df, id_col, text_col, k, runs=bands * width)))
    every = classes.select("rep").withColumns({"left": F.lit(True), "right": F.lit(True)})
    pairs = banded_candidates(classes, every, threshold, bands, width)
    return verified(pairs, df, id_col, text_col, k, threshold), members


def groups(class_pairs: DataFrame, members: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, class_id, group_id, links): one row per record of at least k words.

    ``class_id`` is the least id with the same set, ``links`` the number of
    other classes its class is linked with, ``group_id`` the least class id of
    its connected component, found by neighbour minima with pointer jumping
    (rounds grow as the logarithm of the longest chain). Only linked classes
    take part in the rounds.
    """
    edges = cut(class_pairs.select("a", "b").union(class_pairs.select("b", "a")).distinct())
    # Edges to a class of many links are spread over blocks, once for all rounds.
    hot, n = sized(edges.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / F.lit(HUB)).cast("int").alias("blocks")).filter("blocks > 1"))
    if n:
        salt = F.coalesce(F.pmod(F.xxhash64("a"), F.col("blocks")), F.lit(0)).cast("int")
        edges = cut(edges.join(hot, "b", "left").select("a", "b", salt.alias("salt")))

    def neighbours(labels: DataFrame) -> DataFrame:
        g = labels.select(F.col("a").alias("b"), F.col("group_id").alias("g"))
        if not n:
            return edges.join(g, "b")
        g = g.join(hot, "b", "left").select("b", "g", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("salt"))
        return edges.join(g, ["b", "salt"])

    labels = cut(edges.groupBy("a").agg(F.count(F.lit(1)).alias("links"), F.least(F.min("b"), F.col("a")).alias("group_id")))
    for _ in range(most_rounds):
        low = neighbours(labels).groupBy("a").agg(F.min("g").alias("g"))
        step = labels.join(low, "a").select(
            "a", "links", F.col("group_id").alias("old"), F.least("group_id", "g").alias("group_id")
        )
        jump = labels.select(F.col("a").alias("group_id"), F.col("group_id").alias("far"))
        step = cut(
            step.join(jump, "group_id", "left").select(
                "a", "links", "old", F.least("group_id", F.coalesce("far", "group_id")).alias("group_id")
            )
        )
        labels = step.drop("old")
        if step.filter("group_id <> old").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return members.join(labels.withColumnRenamed("a", "rep"), "rep", "left").select(
        "id",
        F.col("rep").alias("class_id"),
        F.coalesce("group_id", "rep").alias("group_id"),
        F.coalesce("links", F.lit(0)).alias("links"),
    )
