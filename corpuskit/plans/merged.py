"""The merged pretraining corpus: manifest rows revalidated, deduplicated over all sources, encoded, packed and sharded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.operators import bpe, pysource, tokens, validate, windows
from corpuskit.runtime import cut


def staged(manifest: DataFrame, records: DataFrame, key: str = "record_id", syntax: bool = True) -> DataFrame:
    """(key, stored_path, position, reason, duplicate_of) of each distinct manifest row.

    Order is source type, source id and path (nulls first), then the key;
    ``position`` is the place in it and ``duplicate_of`` the position of the
    accepted row that a row repeats. Reasons are those of ``manifest_verdicts``
    and then of ``global_duplicates``.
    """
    verdicts = validate.manifest_verdicts(manifest, records, key, syntax)
    empty = lambda c: F.coalesce(F.min(c), F.lit(""))
    origin = manifest.groupBy(key, "stored_path").agg(F.struct(empty("source.type").alias("t"), empty("source.id").alias("s")).alias("_from"))
    same = [verdicts[c].eqNullSafe(origin[c]) for c in (key, "stored_path")]
    rows = verdicts.join(origin, same[0] & same[1], "left").select(verdicts[key], verdicts["stored_path"], "reason", "_from")
    order = F.struct(F.col("_from.t"), F.col("_from.s"), F.coalesce("stored_path", F.lit("")).alias("p"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"))
    placed = cut(windows.running_offsets(rows.withColumns({"_k": order, "_1": F.lit(1)}), "_k", "_1", "position").drop("_k", "_1", "_from"))
    kept = placed.filter("reason = 'accepted'").select(key, "position").join(records.select(key, "text"), key)
    twins = pysource.global_duplicates(cut(pysource.fingerprints(kept, ["position"])), "position").withColumnRenamed("reason", "_why")
    return placed.join(twins, "position", "left").select(key, "stored_path", "position", F.coalesce("_why", "reason").alias("reason"), "duplicate_of")


def build(
    manifest: DataFrame, records: DataFrame, vocabulary: str, length: int = 1025, most_tokens: int = 10_000_000, key: str = "record_id", eos: int = 0, pad_final: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(staged rows, token counts per accepted row, sequences with shard and position): the whole build over a public BPE vocabulary."""
    stages = cut(staged(manifest, records, key))
    accepted = stages.filter("reason = 'accepted'").select(key, "position")
    encoded = bpe.encode(accepted.join(records.select(key, "text"), key), "position", "text", vocabulary)
    ids = cut(encoded.select("position", tokens.ended(F.col("ids"), eos).alias("ids")))
    sequences = windows.packed_sequences(ids, "position", "position", "ids", length, pad_final)
    return stages, ids.select("position", F.size("ids").cast("bigint").alias("tokens")), windows.in_shards(sequences, length, most_tokens)
