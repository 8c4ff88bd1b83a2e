"""Incremental ingest of code records: filter, deduplicate by content, split, write."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpuskit.functions import text as T
from corpuskit.operators import quality


def accepted(df: DataFrame, need_license: bool = False) -> DataFrame:
    """The columns of an accepted record; works on batches and streams alike."""
    t = T.normalize_source(F.col("text"))
    lic = T.normalize_license(F.col("license"))
    h = F.sha2(t, 256)
    return (
        df.withColumn("reason", quality.code_record_reason(t, F.col("path"), lic, need_license=need_license))
        .filter("reason = 'accepted'")
        .select(
            "record_id",
            t.alias("text"),
            F.trim("repo_name").alias("repo_name"),
            F.regexp_replace("path", r"\\", "/").alias("path"),
            lic.alias("license"),
            h.alias("content_hash"),
            F.octet_length(t).cast("bigint").alias("byte_count"),
            T.hash_split(h).alias("split"),
        )
    )


def ingest(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, need_license: bool = False, files_per_batch: int = 1000) -> StreamingQuery:
    """Reads new parquet files under ``source`` and appends accepted records of unseen content, partitioned by split.

    The state store keeps the content hashes, so a record is taken once over
    all runs of the same checkpoint folder; a run ends when no file is left.
    """
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    kept = accepted(raw, need_license).dropDuplicates(["content_hash"])
    return (
        kept.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .option("path", sink)
        .partitionBy("split")
        .trigger(availableNow=True)
        .start()
    )


def event_windows(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Counts and sums per window and type; on a stream, rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def packed_stream(ids: DataFrame, stream: str, order: str, length: int) -> DataFrame:
    """(stream, sequence, ids): sequences of ``length`` ids out of a stream's rows; what is left of a batch is carried over to the next.

    ``ids`` has the key of its stream, an order within a batch and an array of
    ids. Works on streaming DataFrames; the state is at most ``length`` - 1 ids
    and the number of the next sequence, per stream.
    """

    def pack(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, number = state.get if state.exists else ([], 0)
        rows = pd.concat(list(batches)).sort_values(order)
        buffer = [*held, *(int(x) for a in rows["ids"] if a is not None for x in a)]
        whole = len(buffer) // length
        state.update((buffer[whole * length :], number + whole))
        yield pd.DataFrame({stream: [key[0]] * whole, "sequence": range(number, number + whole), "ids": [buffer[k * length : (k + 1) * length] for k in range(whole)]})

    kind = ids.schema[stream].dataType.simpleString()
    return ids.select(stream, order, "ids").groupBy(stream).applyInPandasWithState(
        pack, f"`{stream}` {kind}, sequence bigint, ids array<int>", "held array<int>, number bigint", "append", GroupStateTimeout.NoTimeout
    )


def until_bytes(rows: DataFrame, stream: str, order: str, size: str, target: int) -> DataFrame:
    """Rows of each stream, batch after batch and in order within one, up to and with the one that reaches the target; later ones are left out."""

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total = state.get[0] if state.exists else 0
        part = pd.concat(list(batches)).sort_values(order)
        before = total + part[size].cumsum() - part[size]
        state.update((min(target, total + int(part[size].sum())),))
        yield part[before < target]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.groupBy(stream).applyInPandasWithState(keep, schema, "total bigint", "append", GroupStateTimeout.NoTimeout)
