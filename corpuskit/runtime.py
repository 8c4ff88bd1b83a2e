"""Session helpers: test session, lineage cuts, salted equi-joins."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one side of a salted join that meet in one task per key.
BLOCK = 256


def local_session(cpus: str = "8", app: str = "corpuskit") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder the session names.

    The folder is ``spark.checkpoint.dir``. Where that is unset a temporary one
    is made, but only for a local master: executors of a cluster share no such folder.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="corpuskit-"))
    return df.checkpoint(eager=True)


#: A table of at most so many rows of a few numbers (some 32 MB) may be broadcast.
BROADCAST_ROWS = 1_000_000


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> tuple[DataFrame, int]:
    """A narrow table and its number of rows; marked for broadcast only if that number is at most ``most``."""
    df = cut(df)
    n = df.count()
    return (F.broadcast(df) if n <= most else df), n


#: Rows of the other side of a doubly salted join that meet in one task per key.
FAR_BLOCK = 16_384


def _hot(df: DataFrame, key: str, block: int, name: str) -> DataFrame:
    """(key, name): number of blocks of each key of more than ``block`` rows."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > block)
    return counts.select(key, F.ceil(F.col("_n") / F.lit(block)).cast("int").alias(name))


def salted_join(
    left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, block: int = BLOCK, both: bool = False
) -> DataFrame:
    """Inner equi-join on ``key`` that spreads hot keys over many tasks.

    The left rows of a key are cut into blocks of about ``block`` rows, the
    right rows are repeated for each block. With ``both`` the right rows are cut
    into blocks of FAR_BLOCK as well and the left rows repeated for each, so
    that no task holds more than about block x FAR_BLOCK pairs of a key. No row
    is lost or doubled.
    """
    hot = _hot(left, key, block, "_blocks")
    if both:
        hot = hot.join(_hot(right, key, FAR_BLOCK, "_far"), key, "full")
    else:
        hot = hot.withColumn("_far", F.lit(1))
    hot, n = sized(hot.select(key, F.coalesce("_blocks", F.lit(1)).alias("_blocks"), F.coalesce("_far", F.lit(1)).alias("_far")))
    # A given number of partitions: few bytes of a hot key are much work, so partitions must not be merged by size.
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if not n:
        return left.repartition(parts, key).join(right.repartition(parts, key), key)

    def placed(df: DataFrame, own: str, other: str, row: str, mine: str, theirs: str) -> DataFrame:
        place = F.coalesce(F.pmod(F.xxhash64(row), F.col(own)), F.lit(0)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1))
        out = df.join(hot, key, "left").withColumn(mine, place).withColumn(theirs, every)
        return out.drop("_blocks", "_far").repartition(parts, key, "_salt", "_salt_far")

    lt = placed(left, "_blocks", "_far", left_id, "_salt", "_salt_far")
    rt = placed(right, "_far", "_blocks", right_id, "_salt_far", "_salt")
    return lt.join(rt, [key, "_salt", "_salt_far"]).drop("_salt", "_salt_far")


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)
