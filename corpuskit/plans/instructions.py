"""The instruction dataset: Python sources cleaned, turned into pairs, deduplicated, validated and split by file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.operators import instructions, sft, splits, validate
from corpuskit.runtime import cut


def build(
    df: DataFrame, id_col: str = "record_id", group: str = "record_id", most: int | None = 16, ratios: dict[str, float] | None = None, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """(sources: id, reason) and (records: id, pair_id, category, symbol, instruction, input, output, problems, split, place).

    Of equal pairs the first by (id, symbol, category) stays. Records with
    problems keep their codes and are in no split. Groups lie in one split each;
    ``place`` is a record's place in its split by a seeded hash.
    """
    sources = cut(validate.instruction_sources(df, [id_col]))
    accepted = df.join(sources.filter("reason = 'accepted'").select(id_col), id_col, "left_semi")
    keep = list(dict.fromkeys((id_col, group)))
    pairs = instructions.instruction_pairs(accepted, keep, most=most, seed=seed).withColumn("pair_id", sft.pair_hash(F.col("instruction"), F.col("input"), F.col("output")))
    rest = [c for c in (group, "category", "symbol", "instruction", "input", "output") if c != id_col]
    first = F.min(F.struct(id_col, "symbol", "category", *[c for c in rest if c not in ("symbol", "category")])).alias("r")
    once = cut(pairs.groupBy("pair_id").agg(first).select("pair_id", f"r.{id_col}", *[f"r.{c}" for c in rest]))
    checked = validate.instruction_problems(once, "pair_id", "instruction", "input", "output", F.col("category"), instructions.CATEGORIES)
    code = validate.dedented_python_parses(F.when(F.col("category").isin(*instructions.PYTHON_CATEGORIES), F.col("output")))
    bad = F.when(~F.coalesce(code, F.lit(True)), F.array(F.lit("invalid_python_syntax"))).otherwise(F.array().cast("array<string>"))
    marked = cut(once.join(checked, "pair_id").withColumn("problems", F.array_sort(F.concat("problems", bad))))
    parts = splits.group_split(marked, group, ratios or {"train": 0.8, "validation": 0.1, "test": 0.1}, seed)
    split = F.when(F.size("problems") == 0, F.col("assigned"))
    return sources, splits.shuffled(parts.withColumn("split", split).drop("assigned"), F.col("split"), "pair_id", seed)
