"""Near-duplicate records with small edits, by a chosen-path join over sets of word runs.

Sets are split recursively by sampled shared tokens, small buckets compared by
brute force, large ones split again; several independent runs make up for what
one misses. Candidates are verified by exact Jaccard similarity of the texts.
The signature table has about 180 bytes a record, whatever the length of the
text; texts are moved only for records of surviving candidate pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.operators.setsim import RUNS, TRAIL, agreeing, agreement_floor, bytes_at, set_classes, signatures, verified
from corpuskit.runtime import BLOCK, cut, salted_join, sized

#: A bucket of at most so many sets is compared pairwise.
SMALL = 64
#: Fresh coordinates by which a large bucket is split, and the deepest split.
FAN, DEPTH = 2, 5
#: Right rows of a bucket that meet a block of left ones in one task.
FAR = 16_384
#: Levels at which crowds of similar sets are taken out of large buckets.
CROWDS = (0, 2)


def _small_bucket_pairs(least: int):
    """Pairs of a partition's buckets (rows sorted by bucket) whose trails agree on at least ``least`` bytes."""

    def flush(ids: list[np.ndarray], sigs: list, out_a: list, out_b: list) -> None:
        i = np.concatenate(ids)
        if len(i) < 2:
            return
        m = np.frombuffer(b"".join(sigs), np.uint8).reshape(len(i), -1)
        for x in range(len(i) - 1):
            hit = np.flatnonzero((m[x + 1 :] == m[x]).sum(1) >= least)
            if len(hit):
                out_a.append(np.full(len(hit), i[x]))
                out_b.append(i[x + 1 + hit])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ids, sigs = None, [], []
        for b in batches:
            if b.empty:
                continue
            out_a: list[np.ndarray] = []
            out_b: list[np.ndarray] = []
            keys, rid, sig = b["bucket"].to_numpy(), b["rep"].to_numpy(), b["sig"].tolist()
            ends = [*(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
            at = 0
            for end in ends:
                if keys[at] != key and ids:
                    flush(ids, sigs, out_a, out_b)
                    ids, sigs = [], []
                key = keys[at]
                ids.append(rid[at:end])
                sigs.extend(sig[at:end])
                at = end
            if out_a:
                yield _ordered(np.concatenate(out_a), np.concatenate(out_b))
        out_a, out_b = [], []
        if ids:
            flush(ids, sigs, out_a, out_b)
        if out_a:
            yield _ordered(np.concatenate(out_a), np.concatenate(out_b))

    return run


def _ordered(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})[a != b].drop_duplicates()


def _alike(rest: DataFrame, threshold: float) -> DataFrame:
    """Rows of large buckets with ``alike``: surely similar to the bucket's least rep."""
    sure = math.ceil(TRAIL * (threshold + (1 - threshold) / 3))
    leaders, _ = sized(rest.groupBy("bucket").agg(F.min(F.struct("rep", "sig")).alias("l")))
    alike = agreeing("sig", "l.sig") >= sure
    return cut(rest.join(leaders, "bucket").select("bucket", "rep", "sig", alike.alias("alike")))


def _block_pairs(least: int):
    """Pairs of left and right rows of a block whose trails agree on at least ``least`` bytes; left rows come first in each block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ids, sigs, left, own = None, [], [], np.empty((0, TRAIL), np.uint8), np.empty(0, np.int64)
        for b in batches:
            if b.empty:
                continue
            out_a: list[np.ndarray] = []
            out_b: list[np.ndarray] = []
            keys = list(zip(b["bucket"].tolist(), b["salt"].tolist(), b["far"].tolist()))
            rep, far = b["rep"].to_numpy(), b["right"].to_numpy()
            m = np.frombuffer(b"".join(b["sig"]), np.uint8).reshape(len(b), -1)
            at = 0
            while at < len(b):
                if keys[at] != key:
                    key, ids, sigs = keys[at], [], []
                end = at
                while end < len(b) and keys[end] == key and far[end] == far[at]:
                    end += 1
                if not far[at]:
                    ids.append(rep[at:end])
                    sigs.append(m[at:end])
                    left, own = np.concatenate(sigs), np.concatenate(ids)
                elif ids:
                    block, others = m[at:end], rep[at:end]
                    for x in range(len(left)):
                        hit = np.flatnonzero((block == left[x]).sum(1) >= least)
                        if len(hit):
                            out_a.append(np.full(len(hit), own[x]))
                            out_b.append(others[hit])
                at = end
            if out_a:
                yield _ordered(np.concatenate(out_a), np.concatenate(out_b))

    return run


def _within_buckets(left: DataFrame, right: DataFrame, least: int) -> DataFrame:
    """Candidate pairs of left and right rows of a bucket, compared in blocks of at most about BLOCK x FAR rows.

    Blocks are spread over a given number of tasks by their own key, so that few
    bytes of a crowded bucket don't end up as the work of one.
    """
    spark = left.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    count = lambda df, block, name: df.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias(name))
    blocks, _ = sized(count(left, BLOCK, "blocks").join(count(right, FAR, "fars"), "bucket"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    place = lambda c: F.pmod(F.xxhash64("rep"), F.col(c)).cast("int")
    lt = left.join(blocks, "bucket").select("bucket", "rep", "sig", place("blocks").alias("salt"), every("fars").alias("far"), F.lit(False).alias("right"))
    rt = right.join(blocks, "bucket").select("bucket", "rep", "sig", every("blocks").alias("salt"), place("fars").alias("far"), F.lit(True).alias("right"))
    return (
        lt.union(rt)
        .repartition(parts, "bucket", "salt", "far")
        .sortWithinPartitions("bucket", "salt", "far", "right")
        .mapInPandas(_block_pairs(least), "a bigint, b bigint")
    )


def chosen_path_candidates(classes: DataFrame, threshold: float, small: int = SMALL) -> DataFrame:
    """Distinct candidate pairs (a < b) of classes by the chosen-path join.

    Level 0 splits all sets by RUNS independent min-wise tokens. A bucket of at
    most ``small`` sets is compared by brute force on the trails; a larger one
    is split again by FAN fresh tokens chosen by its own path, down to DEPTH.
    What is still large then (truly similar sets, mostly) is compared in blocks
    spread over many tasks; no bucket is capped and no set dropped.

    Splitting can't part truly similar sets. At the levels in CROWDS the sets
    that are like the first one of their large bucket are compared with the
    whole bucket at once and leave it.

    A pair of similarity t is missed by level 0 with probability (1-t)**RUNS
    (5e-8 at 0.7); each deeper level misses a pair of one bucket with (1-t)**FAN.
    """
    least = agreement_floor(threshold)
    runs = F.explode(F.sequence(F.lit(0), F.lit(RUNS - 1))).alias("i")
    rows = classes.select("rep", "heads", "sig", runs).select(
        F.xxhash64("i", bytes_at("heads", F.col("i") * 4 + 1, 4)).alias("bucket"), "rep", "sig"
    )
    found: list[DataFrame] = []
    for depth in range(DEPTH + 1):
        # Large buckets are counted with a combine on the map side; their rows need no shuffle here.
        sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
        large, n = sized(sizes.filter(F.col("size") > small).select("bucket"))
        found.append(
            cut(
                (rows.join(large, "bucket", "left_anti") if n else rows)
                .repartition("bucket")
                .sortWithinPartitions("bucket")
                .mapInPandas(_small_bucket_pairs(least), "a bigint, b bigint")
            )
        )
        if not n:
            break
        rest = rows.join(large, "bucket")
        if depth in CROWDS:
            rest = _alike(rest, threshold)
            found.append(_within_buckets(rest.filter("alike"), rest, least))
            rest = rest.filter("not alike").select("bucket", "rep", "sig")
        if depth == DEPTH:
            found.append(_within_buckets(rest, rest, least))
            break
        place = F.pmod(F.xxhash64("bucket") + F.col("j"), F.lit(TRAIL)).cast("int") + 1  # FAN different ones
        rows = cut(
            rest.select("*", F.explode(F.sequence(F.lit(1), F.lit(FAN))).alias("j"))
            .select("*", place.alias("p"))
            .select(F.xxhash64("bucket", "p", bytes_at("sig", F.col("p"), 1)).alias("bucket"), "rep", "sig")
        )
    return reduce(DataFrame.union, found).distinct()


def chosen_path_pairs(
    df: DataFrame, id_col: str, text_col: str, k: int = 5, threshold: float = 0.8
) -> tuple[DataFrame, DataFrame]:
    """Near-duplicates of a table: (links between classes: a, b, similarity) and (members: id, rep).

    Null and short texts (fewer than k words) are in no class; equal sets are
    one class, represented by its least id; repeated ids count once a row. An
    empty table gives empty results. Other columns don't matter.
    """
    members, classes = set_classes(cut(signatures(df, id_col, text_col, k)))
    pairs = chosen_path_candidates(classes, threshold, SMALL)
    return verified(pairs, df, id_col, text_col, k, threshold), members


def expand_classes(class_pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of records (record_id_a < record_id_b): of linked classes, and within a class; large classes meet in blocks."""
    ma = members.select(F.col("rep").alias("a"), F.col("id").alias("x"))
    mb = members.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    one = salted_join(ma, class_pairs.select("a", "b"), "a", "x", "b", both=True)
    across = salted_join(one.select("b", "x"), mb, "b", "x", "y", both=True).select("x", "y")
    several, _ = sized(members.filter("id <> rep").select("rep").distinct())
    twins = members.join(several, "rep", "left_semi")
    within = salted_join(
        twins.select("rep", F.col("id").alias("x")), twins.select("rep", F.col("id").alias("y")), "rep", "x", "y", both=True
    ).filter("x < y").select("x", "y")
    return across.union(within).select(
        F.least("x", "y").alias("record_id_a"), F.greatest("x", "y").alias("record_id_b")
    )
