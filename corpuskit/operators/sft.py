"""Instruction records: templates, validation, duplicates, lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions import text as T

TEMPLATE = "### Instruction:\n{instruction}\n\n### Input:\n{input}\n\n### Response:\n{output}"


def render(template: str, fields: dict[str, Column]) -> Column:
    """The template with {field} replaced; unknown fields raise, null values count as empty."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    if bad := set(parts[1::2]) - set(fields):
        raise ValueError(f"unknown fields: {sorted(bad)}")
    cols = [F.lit(p) if i % 2 == 0 else F.coalesce(fields[p], F.lit("")) for i, p in enumerate(parts)]
    return F.concat(*cols)


def chat_prompt(turns: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """(conversation, system, user): the last system and the last user turn."""
    last = lambda r: F.max(F.when(F.col(role) == r, F.struct(F.col(turn).alias("t"), F.col(text).alias("x"))))["x"]
    return turns.groupBy(conversation).agg(last("system").alias("system"), last("user").alias("user"))


def pair_hash(instruction: Column, given: Column, output: Column) -> Column:
    blank = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[ \\t]+(?=\\n|\\z)", ""), "\\A\\s+|\\s+\\z", "")
    return T.text_hash(blank(instruction), blank(given), blank(T.normalize_source(F.coalesce(output, F.lit("")))))


def problems(instruction: Column, output: Column, least=3, most=100_000) -> Column:
    """All codes that apply, sorted."""
    i, o = F.trim(F.coalesce(instruction, F.lit(""))), F.coalesce(output, F.lit(""))
    return F.array_sort(
        F.array_compact(
            F.array(
                F.when(F.length(i) < least, "instruction_too_short"),
                F.when(F.length(i) > most, "instruction_too_long"),
                F.when(F.trim(o) == "", "output_too_short"),
                F.when(F.length(o) > most, "output_too_large"),
                F.when(F.contains(F.concat(i, o), F.lit("\x00")), "null_character"),
            )
        )
    )


def value_counts(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Values that occur more than once."""
    return df.filter(value.isNotNull()).groupBy(value.alias(name)).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def length_statistics(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    aggs = []
    for c in columns:
        n = F.length(c)
        aggs += [F.avg(n).alias(f"{c}_mean"), F.median(n).alias(f"{c}_median"), F.min(n).alias(f"{c}_least"), F.max(n).alias(f"{c}_most")]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("records"), *aggs)


def converted(df: DataFrame, order: str, instruction: str, given: str, output: str) -> DataFrame:
    """(order, instruction, input, output): trimmed triples with an instruction and an output, the first of equal ones in order."""
    t = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"(?U)\A\s+|\s+\z", "")
    rows = df.select(F.col(order).alias("_o"), t(instruction).alias("instruction"), t(given).alias("input"), t(output).alias("output"))
    full = rows.filter("instruction <> '' and output <> ''")
    return full.groupBy("instruction", "input", "output").agg(F.min("_o").alias(order)).select(order, "instruction", "input", "output")
