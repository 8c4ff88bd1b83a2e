"""Stages that are skipped where their output of the same inputs and settings is there."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def content_fingerprint(df: DataFrame, *columns: str) -> str:
    """A digest of the columns of all rows, whatever their order or layout: how many there are, and sums of two hashes of them."""
    one = df.select(F.xxhash64(*columns).alias("x"), F.hash(*columns).cast("bigint").alias("h"))
    n, x, h = one.agg(F.count(F.lit(1)), F.sum(F.col("x").cast("decimal(38,0)")), F.sum("h")).first()
    return hashlib.sha256(f"{n}\0{x}\0{h}".encode()).hexdigest()


def stage(spark: SparkSession, folder: str, fingerprint: str, settings: dict, make: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """(the stage's table, whether it was made anew): ``make`` runs unless ``folder`` holds what the same fingerprint and settings gave.

    A table counts as there only with its mark, which is written last; the
    folder is one that all executors share.
    """
    mark = os.path.join(folder, "stage.json")
    wanted = {"fingerprint": fingerprint, "settings": hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":")).encode()).hexdigest()}
    table = os.path.join(folder, "table")
    if os.path.exists(mark) and os.path.exists(os.path.join(table, "_SUCCESS")):
        with open(mark) as f:
            if json.load(f) == wanted:
                return spark.read.parquet(table), False
    os.makedirs(folder, exist_ok=True)
    if os.path.exists(mark):
        os.remove(mark)
    make().write.mode("overwrite").parquet(table)
    part = f"{mark}.{uuid.uuid4().hex}.partial"
    with open(part, "w") as f:
        json.dump(wanted, f, sort_keys=True)
    os.replace(part, mark)
    return spark.read.parquet(table), True
