"""The corpus build as one plan: normalize, filter, deduplicate, count, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.functions import text as T
from corpuskit.operators import dedup, quality, setsim, windows
from corpuskit.runtime import cut, sized

#: Word runs and similarity of the near-duplicate step.
NEAR_K, NEAR_SIMILARITY = 5, 0.92


def staged(df: DataFrame, id_col: str = "record_id", near: bool = True, minimum: int = 0) -> DataFrame:
    """Every record with ``reason`` (accepted, or why not), ``duplicate_of`` and ``n_tokens`` (bytes) of the normalized text.

    In order of id, duplicates are exact, normalized or (with ``near``) near
    ones of an accepted record. What is left and has fewer than ``minimum``
    tokens is too_few_tokens; that comes last, so a record that others are
    duplicates of may still be too short.
    """
    stages = _without_twins(df, id_col)
    if near:
        stages = _without_near(df, cut(stages), id_col)
    short = (F.col("reason") == "accepted") & (F.col("n_tokens") < minimum)
    return stages.withColumn("reason", F.when(short, "too_few_tokens").otherwise(F.col("reason"))) if minimum else stages


def _without_near(df: DataFrame, stages: DataFrame, id_col: str) -> DataFrame:
    """stages with near_duplicate as the reason of accepted records that are like an earlier accepted one, and of the copies of those."""
    accepted, _ = sized(stages.filter("reason = 'accepted'").select(id_col))
    # Words of two or more letters, digits and _ that don't begin with a digit.
    words = F.array_join(F.regexp_extract_all(T.normalize_for_dedup(T.normalize_source(F.col("text"))), F.lit("([a-z_][a-z0-9_]+)"), 1), " ")
    links, members = setsim.similar_pairs(
        df.join(accepted, id_col, "left_semi").select(id_col, words.alias("words")), id_col, "words", NEAR_K, NEAR_SIMILARITY
    )
    kept = dedup.greedy_survivors(links, members.select(F.col("rep").alias("id")).distinct()).withColumnRenamed("id", "rep")
    near = members.join(kept, "rep").select("id", F.coalesce("duplicate_of", F.when(F.col("id") != F.col("rep"), F.col("rep"))).alias("near_of"))
    near = cut(near.filter("near_of is not null"))
    # A copy of a rejected record is as near to the accepted one.
    own = F.when(F.col("reason") == "accepted", F.col(id_col)).otherwise(F.col("duplicate_of"))
    j = stages.withColumn("_id", own).join(near.withColumnRenamed("id", "_id"), "_id", "left")
    reason = F.when(F.col("near_of").isNotNull(), "near_duplicate").otherwise(F.col("reason"))
    return j.select(id_col, reason.alias("reason"), F.coalesce("near_of", "duplicate_of").alias("duplicate_of"), "n_tokens")


def _without_twins(df: DataFrame, id_col: str) -> DataFrame:
    """One pass over the texts; what follows joins rows of two hashes."""
    base = cut(quality.clean_profiles(df, id_col, "path", "text"))
    twins = dedup.two_level(base.filter("clean = 'accepted'"), id_col, F.col("exact"), F.col("loose"))
    return base.join(twins.dropDuplicates([id_col]), id_col, "left").select(  # rows given twice have their verdict twice
        id_col,
        F.coalesce(F.when(F.col("clean") != "accepted", F.col("clean")), "reason", F.lit("accepted")).alias("reason"),
        "duplicate_of",
        "n_tokens",
    )


def build(df: DataFrame, length: int, id_col: str = "record_id", near: bool = True) -> tuple[DataFrame, DataFrame]:
    """(staged records, spans of the accepted ones in sequences of ``length`` tokens)."""
    stages = cut(staged(df, id_col, near))
    accepted = stages.filter("reason = 'accepted'").select(id_col, (F.col("n_tokens") + 1).alias("size"))
    return stages, windows.sequence_spans(accepted, id_col, id_col, "size", length)
