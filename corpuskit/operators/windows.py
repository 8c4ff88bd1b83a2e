"""Fixed-length sequences out of a token stream, sliding windows, shards."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.runtime import cut

#: Rows of one range of a running sum, about; more rows make more ranges.
RANGE_ROWS = 1_000_000


def ranged(df: DataFrame, order: str, rows: int = RANGE_ROWS) -> DataFrame:
    """df in ranges of the order of about ``rows`` rows, their number as ``_r``; cut by sampled quantiles, so that values may lie anyhow."""
    parts = max(1, -(-df.count() // rows), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Equal values meet in one range. The cut keeps the ranges as they are, whatever reads them.
    return cut(df.repartitionByRange(parts, order).withColumn("_r", F.spark_partition_id()))


def running_offsets(df: DataFrame, order: str, size: str, out: str = "offset", rows: int = RANGE_ROWS) -> DataFrame:
    """df with ``out``: the sum of ``size`` over the rows before, in order of ``order``; two levels, no single-task sort.

    Only one row per range meets in one task. An empty table stays empty; null
    sizes count as 0.
    """
    base = ranged(df, order, rows)
    totals = base.groupBy("_r").agg(F.coalesce(F.sum(size), F.lit(0)).alias("_t"))
    before = F.coalesce(F.sum("_t").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select("_r", before.alias("_s"))
    w = Window.partitionBy("_r").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        base.join(F.broadcast(starts), "_r")  # one row per range
        .withColumn(out, (F.col("_s") + F.coalesce(F.sum(size).over(w), F.lit(0))).cast("bigint"))
        .drop("_r", "_s")
    )


def sequence_spans(df: DataFrame, id_col: str, order: str, size: str, length: int) -> DataFrame:
    """(sequence, id, start, end, from_token): what each document gives to each sequence of ``length`` tokens.

    The stream of all documents is cut every ``length`` tokens; documents
    without tokens give nothing.
    """
    at = F.col("offset")
    last = at + F.col(size) - 1
    spans = running_offsets(df.filter(F.col(size) > 0), order, size).select(
        id_col, "offset", size, F.explode(F.sequence(F.floor(at / length), F.floor(last / length))).alias("sequence")
    )
    begin = F.greatest(at, F.col("sequence") * length)
    end = F.least(at + F.col(size), (F.col("sequence") + 1) * length)
    return spans.select(
        "sequence", id_col, (begin - F.col("sequence") * length).alias("start"), (end - F.col("sequence") * length).alias("end"), (begin - at).alias("from_token")
    )


def shard_of_sequence(sequence: Column, length: int, most_tokens: int) -> Column:
    return F.floor(sequence / max(1, most_tokens // length))


def packed_sequences(
    df: DataFrame, id_col: str, order: str, ids: str, length: int, pad_final: bool = False, pad: int = 0
) -> DataFrame:
    """(sequence, ids array<int> of ``length``, tokens, documents array<struct<id, start, end, from_token>>) of the stream of all documents.

    The stream is cut every ``length`` ids; sequences don't overlap. The last,
    incomplete one is left out, or filled with ``pad`` if ``pad_final``.
    Documents without ids, or with null ones, give nothing; those that span
    sequences are sliced where they lie, so only their parts are shuffled.
    """
    base = df.filter(F.size(ids) > 0).select(F.col(id_col).alias("_id"), F.col(order).alias("_o"), F.col(ids).alias("_ids"), F.size(ids).cast("bigint").alias("_n"))
    at = running_offsets(base, "_o", "_n")
    first, last = F.floor(F.col("offset") / length), F.floor((F.col("offset") + F.col("_n") - 1) / length)
    parts = at.select("_id", "offset", "_n", "_ids", F.explode(F.sequence(first, last)).alias("sequence"))
    begin = F.greatest("offset", F.col("sequence") * length)
    end = F.least(F.col("offset") + F.col("_n"), (F.col("sequence") + 1) * length)
    piece = F.struct(
        (begin - F.col("sequence") * length).cast("int").alias("start"),
        F.col("_id").alias("id"),
        (end - F.col("sequence") * length).cast("int").alias("end"),
        (begin - F.col("offset")).cast("int").alias("from_token"),
        F.slice("_ids", (begin - F.col("offset") + 1).cast("int"), (end - begin).cast("int")).alias("part"),
    )
    rows = parts.select("sequence", piece.alias("p")).groupBy("sequence").agg(F.array_sort(F.collect_list("p")).alias("ps"))  # at most ``length`` pieces
    flat = F.flatten(F.transform("ps", lambda p: p["part"]))
    documents = F.transform("ps", lambda p: F.struct(p["id"].alias("id"), p["start"].alias("start"), p["end"].alias("end"), p["from_token"].alias("from_token")))
    out = rows.select("sequence", flat.alias("ids"), F.size(flat).alias("tokens"), documents.alias("documents"))
    if not pad_final:
        return out.filter(F.col("tokens") == length)
    return out.withColumn("ids", F.concat("ids", F.array_repeat(F.lit(pad), F.lit(length) - F.col("tokens"))))


def in_shards(sequences: DataFrame, length: int, most_tokens: int) -> DataFrame:
    """sequences with ``shard`` and ``position`` in it: a shard takes as many whole sequences as ``most_tokens`` allows, at least one."""
    per = max(1, most_tokens // length)
    return sequences.withColumns({"shard": F.floor(F.col("sequence") / per), "position": F.col("sequence") % per})


def shard_index(sharded: DataFrame, length: int) -> DataFrame:
    """(shard, sequences, tokens, bytes, first_sequence) of each shard of 16-bit ids."""
    n = F.count(F.lit(1))
    return sharded.groupBy("shard").agg(
        n.alias("sequences"), (n * length).alias("tokens"), (n * length * 2).alias("bytes"), F.min("sequence").alias("first_sequence")
    )


def sliding_windows(df: DataFrame, ids: str, context: int, stride: int, short: str = "skip", pad: int = 0, pad_target: int | None = None) -> DataFrame:
    """df's rows exploded to (start, inputs, targets, tokens) of ``context`` ids, targets shifted by one.

    Rows of at most ``context`` ids give none, or with ``short`` = "pad" one
    window filled with ``pad`` (its targets with ``pad_target`` if given, such as
    an index that a loss ignores); ``tokens`` is its number of own inputs. Rows
    of fewer than two ids give none.
    """
    n = F.size(ids)
    whole = F.when(n > context, F.sequence(F.lit(0), n - context - 1, F.lit(stride)))
    starts = whole.when((n > 1) & F.lit(short == "pad"), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    fill = lambda a, x=pad: F.concat(a, F.array_repeat(F.lit(x), F.lit(context) - F.size(a)))
    inputs = F.slice(ids, F.col("start") + 1, F.least(F.lit(context), n - 1 - F.col("start")))
    return df.select("*", F.explode(starts).alias("start")).select(
        *[c for c in df.columns if c != ids],
        "start",
        fill(inputs).alias("inputs"),
        fill(F.slice(ids, F.col("start") + 2, context), pad if pad_target is None else pad_target).alias("targets"),
        F.size(inputs).alias("tokens"),
    )


def _next_fit_map(sizes: np.ndarray, capacity: int) -> tuple[int, list[int], list[int]]:
    """What a range of rows makes of the filling it begins with: (total, lows, outs).

    A filling u of at most capacity - total leaves as u + total; any other meets
    its first border in the range and leaves as the outs entry of the largest
    low below u. Fillings that meet a common border agree from there on, so the
    entries are few.
    """
    upto = np.cumsum(sizes)
    start, n = upto - sizes, len(sizes)
    after = np.maximum(np.searchsorted(upto, start + capacity, "right"), np.arange(n) + 1).tolist()
    last = list(range(n))  # the last border of the filling that begins a shard at each row
    for i in range(n - 1, -1, -1):
        if after[i] < n:
            last[i] = last[after[i]]
    total = int(upto[-1])
    entries = int(np.searchsorted(upto, capacity, "right"))  # rows that may be the first border of some filling
    lows: list[int] = []
    outs: list[int] = []
    for j in range(min(entries, n - 1), -1, -1):
        out = total - int(start[last[j]])
        if not outs or outs[-1] != out:
            lows.append(capacity - int(upto[j]))
            outs.append(out)
    return total, lows, outs


def next_fit_shards(df: DataFrame, order: str, size: str, capacity: int, rows: int = RANGE_ROWS) -> DataFrame:
    """df with ``shard`` and ``offset`` in it: rows in order fill a shard until the next one would exceed the capacity; rows are never split.

    Next fit is sequential, but what a range of rows makes of the filling it
    begins with is a step function of few steps: each range gives its own in
    parallel, the functions are applied one after another (a few numbers per
    range on the driver), and the ranges are filled in parallel from the true
    beginnings. Null sizes count as 0; a row beyond the capacity has a shard of
    its own. An empty table stays empty.
    """
    base = ranged(df, order, rows)
    base = cut(base.withColumn("_row", F.monotonically_increasing_id()))  # rows may share a value of the order
    narrow = base.select("_r", "_row", order, F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("_n"))

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        total, lows, outs = _next_fit_map(pdf.sort_values([order, "_row"])["_n"].to_numpy(), capacity)
        return pd.DataFrame({"_r": [pdf["_r"].iat[0]], "total": [total], "lows": [lows], "outs": [outs]})

    filling: dict[int, int] = {}
    used = capacity + 1  # before the first row: it begins a shard
    for r in narrow.groupBy("_r").applyInPandas(summed, "_r int, total bigint, lows array<bigint>, outs array<bigint>").orderBy("_r").toLocalIterator():
        filling[r["_r"]] = used
        used = used + r["total"] if used + r["total"] <= capacity else r["outs"][bisect_left(r["lows"], used) - 1]

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([order, "_row"])
        used, number, shards, offsets = filling[int(pdf["_r"].iat[0])], 0, [], []
        for n in pdf["_n"].tolist():
            if used + n > capacity:
                number, used = number + 1, 0
            shards.append(number)
            offsets.append(used)
            used += n
        return pd.DataFrame({"_r": pdf["_r"], "_row": pdf["_row"], "_own": shards, "offset": offsets})

    filled = cut(narrow.groupBy("_r").applyInPandas(fill, "_r int, _row bigint, _own bigint, offset bigint"))
    begun = filled.groupBy("_r").agg(F.max("_own").alias("_m"))
    before = F.coalesce(F.sum("_m").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = filled.join(F.broadcast(begun.select("_r", before.alias("_s"))), "_r")  # one row per range
    return base.drop("_r").join(numbered.select("_row", (F.col("_own") + F.col("_s") - 1).alias("shard"), "offset"), "_row").drop("_row")


def until_target(df: DataFrame, order: str, size: str, target: int) -> DataFrame:
    """The rows in order up to and with the one that reaches the target."""
    return cut(running_offsets(df, order, size, "_before")).filter(F.col("_before") < target).drop("_before")
