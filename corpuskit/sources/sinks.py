"""Sinks: packed shards, JSON lines, one-row reports."""

from __future__ import annotations

import gzip
import hashlib
import json
import os
import re
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_packed(df: DataFrame, folder: str, shard: str, order: str, ids: str, overwrite: bool = False) -> DataFrame:
    """One ``<shard>.bin`` per value of ``shard`` with its rows' ids as little-endian 16 bits; returns (shard, sequences, bytes, sha256).

    The folder is one that all executors share. A file is written under another
    name and renamed, so a repeated task leaves a whole file. Ids that don't fit
    into 16 bits raise. Size shards so that one fits into a task. A folder with
    shards in it is refused unless ``overwrite``.
    """
    if not overwrite and os.path.isdir(folder) and any(x.endswith(".bin") for x in os.listdir(folder)):
        raise FileExistsError(f"{folder} holds shards")
    os.makedirs(folder, exist_ok=True)

    def save(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        name = str(pdf[shard].iat[0])
        a = np.concatenate([np.asarray(x, np.int64) for x in pdf[ids]])
        if len(a) and (a.min() < 0 or a.max() > 65535):
            raise ValueError(f"shard {name}: ids beyond 16 bits")
        part = os.path.join(folder, f".{name}.{uuid.uuid4().hex}.partial")
        a.astype("<u2").tofile(part)
        os.replace(part, os.path.join(folder, f"{name}.bin"))
        digest = hashlib.sha256(a.astype("<u2").tobytes()).hexdigest()
        return pd.DataFrame({"shard": [name], "sequences": [len(pdf)], "bytes": [2 * len(a)], "sha256": [digest]})

    return df.select(shard, order, ids).groupBy(shard).applyInPandas(save, "shard string, sequences bigint, bytes bigint, sha256 string")


def write_jsonl(df: DataFrame, path: str, compress: bool = False) -> None:
    """Rows as JSON lines with sorted keys; all or nothing."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("compression", "gzip" if compress else "none").json(path)


def write_report(df: DataFrame, path: str) -> dict:
    """A one-row report as JSON with sorted keys, replaced at once."""
    row = df.limit(2).collect()
    if len(row) != 1:
        raise ValueError("a report has one row")
    out = row[0].asDict(recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.partial"
    with open(part, "w") as f:
        json.dump(out, f, sort_keys=True, default=str)
    os.replace(part, path)
    return out


def write_metrics_csv(df: DataFrame, path: str) -> None:
    """A one-row report as metric, value lines."""
    stacked = df.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in df.columns]), F.array(*[F.col(c).cast("string") for c in df.columns]))).alias("metric", "value"))
    stacked.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_index(shards: DataFrame, folder: str, length: int) -> dict:
    """The index of a folder of packed shards (as ``write_packed`` returns them): index.json, replaced at once. One row per shard file comes to the driver."""
    rows = sorted((r.asDict() for r in shards.collect()), key=lambda r: r["shard"])
    index = {"sequence_length": length, "dtype": "uint16", "sequences": sum(r["sequences"] for r in rows), "tokens": sum(r["bytes"] for r in rows) // 2, "shards": rows}
    part = os.path.join(folder, f".index.{uuid.uuid4().hex}.partial")
    with open(part, "w") as f:
        json.dump(index, f, sort_keys=True, indent=1)
    os.replace(part, os.path.join(folder, "index.json"))
    return index


def write_jsonl_shards(df: DataFrame, folder: str, order: str, capacity: int) -> DataFrame:
    """Rows as gzipped JSON lines in shards of at most ``capacity`` uncompressed bytes, in order; returns (shard, records, bytes).

    A row is never split. Numbers go on from those in the folder, which all
    executors share; a repeated task leaves a whole file.
    """
    from corpuskit.operators.windows import next_fit_shards

    os.makedirs(folder, exist_ok=True)
    there = [int(m[1]) for x in os.listdir(folder) if (m := re.fullmatch(r"shard-(\d+)\.jsonl\.gz", x))]
    after = max(there, default=-1) + 1
    lines = df.select(F.col(order).alias("_order"), F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])).alias("_line"))
    sized = lines.withColumn("_n", (F.octet_length("_line") + 1).cast("bigint"))

    def save(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_order")
        name = f"shard-{int(pdf['shard'].iat[0]) + after:06d}.jsonl.gz"
        raw = "".join(x + "\n" for x in pdf["_line"]).encode()
        part = os.path.join(folder, f".{name}.{uuid.uuid4().hex}.partial")
        with open(part, "wb") as f:
            f.write(gzip.compress(raw, mtime=0))
        os.replace(part, os.path.join(folder, name))
        return pd.DataFrame({"shard": [name], "records": [len(pdf)], "bytes": [len(raw)]})

    return next_fit_shards(sized, "_order", "_n", capacity).groupBy("shard").applyInPandas(save, "shard string, records bigint, bytes bigint")


def write_manifest(manifest: DataFrame, path: str) -> None:
    """Provenance rows as JSON lines with sorted keys, in order of stored_path over all files."""
    manifest.select(*sorted(manifest.columns)).orderBy("stored_path").write.mode("overwrite").json(path)


def write_cleaned(df: DataFrame, path: str, by: str = "content_type") -> None:
    """Cleaned texts as a table partitioned by kind, in place of a file each; all or nothing."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)
