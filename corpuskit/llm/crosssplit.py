"""Same or near-same records across splits, by min-wise bands met from both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.operators.setsim import banded_candidates, set_classes, signatures, verified
from corpuskit.runtime import cut, salted_join


def banded_pairs(
    df: DataFrame,
    id_col: str,
    text_col: str,
    left: Column,
    right: Column,
    k: int = 5,
    threshold: float = 0.8,
    bands: int = 16,
    width: int = 2,
) -> tuple[DataFrame, DataFrame]:
    """Near-duplicates between two sides of a table: (class links) and (members: id, rep, left, right).

    ``left`` and ``right`` are conditions on rows; rows of neither are ignored.
    Nulls count as false. Class links include no class with itself. Null texts
    and those of fewer than k words are in no pair; rows given twice count once;
    an empty table gives empty results. Other columns don't matter.
    """
    flags = df.select(
        F.col(id_col).alias("id"), F.coalesce(left, F.lit(False)).alias("left"), F.coalesce(right, F.lit(False)).alias("right")
    ).filter("left or right")
    flags = flags.groupBy("id").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    kept = df.filter(F.coalesce(left, F.lit(False)) | F.coalesce(right, F.lit(False)))
    sigs = cut(signatures(kept, id_col, text_col, k, runs=bands * width))
    members, classes = set_classes(sigs)
    members = cut(members.join(flags, "id"))
    sides = members.groupBy("rep").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    pairs = banded_candidates(classes, sides, threshold, bands, width)
    return verified(pairs, kept, id_col, text_col, k, threshold), members


def expand_across(class_pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of records on opposite sides, of linked classes and within a class; large classes meet in blocks."""
    lt = members.filter("left").select(F.col("rep").alias("l"), F.col("id").alias("x"))
    rt = members.filter("right").select(F.col("rep").alias("r"), F.col("id").alias("y"))
    links = class_pairs.select(F.col("a").alias("l"), F.col("b").alias("r"))
    links = links.union(links.select("r", "l"))
    one = salted_join(lt, links, "l", "x", "r", both=True)
    across = salted_join(one.select("r", "x"), rt, "r", "x", "y", both=True).select("x", "y")
    within = salted_join(lt.withColumnRenamed("l", "rep"), rt.withColumnRenamed("r", "rep"), "rep", "x", "y", both=True).select("x", "y")
    return (
        across.union(within)
        .filter("x <> y")
        .select(F.least("x", "y").alias("record_id_a"), F.greatest("x", "y").alias("record_id_b"))
    )


def report(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """(split, repo_name, records, pairs): held-out records that occur in train, and their pairs, per split and repository.

    ``records``: record_id, split, repo_name. Splits and repositories are
    compared without outer blanks and letter case; null repositories are a group.
    """
    ids = pairs.select(F.explode(F.array("record_id_a", "record_id_b")).alias("record_id"))
    known = records.select("record_id", F.lower(F.trim("split")).alias("split"), F.lower(F.trim("repo_name")).alias("repo_name"))
    per = ids.join(known, "record_id").filter("split <> 'train'").groupBy("split", "repo_name", "record_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("split", "repo_name").agg(F.count(F.lit(1)).alias("records"), F.sum("n").alias("pairs"))
