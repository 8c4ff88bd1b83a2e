"""Corpus, license, source and readiness reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def corpus_statistics(df: DataFrame, id_col: str, tokens: str, kind: str) -> DataFrame:
    """One row: documents, tokens, mean, median, ids of the smallest (first of ties) and largest (last of ties), five size buckets."""
    n = F.col(tokens)
    bounds = [128, 512, 2048, 8192]
    buckets = [F.count_if(n < bounds[0]).alias("under_128")]
    buckets += [F.count_if((n >= a) & (n < b)).alias(f"under_{b}") for a, b in zip(bounds, bounds[1:])]
    buckets.append(F.count_if(n >= bounds[-1]).alias("from_8192"))
    return df.agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum(n).alias("tokens"),
        F.avg(n).alias("mean_tokens"),
        F.floor(F.median(n)).cast("bigint").alias("median_tokens"),
        F.min(F.struct(n.alias("n"), F.col(id_col).alias("i")))["i"].alias("smallest"),
        F.max(F.struct(n.alias("n"), F.col(id_col).alias("i")))["i"].alias("largest"),
        *buckets,
        F.count_distinct(kind).alias("kinds"),
    )


def share_by(df: DataFrame, key: Column, name: str, weight: Column | None = None) -> DataFrame:
    """(name, n, share): rows (or a weight) per key and their share of all; the total is one row, joined back."""
    value = F.count(F.lit(1)) if weight is None else F.sum(weight)
    per = df.groupBy(key.alias(name)).agg(value.alias("n"))
    total = per.agg(F.sum("n").alias("_t"))
    return per.join(F.broadcast(total)).select(name, "n", (F.col("n") / F.col("_t")).alias("share"))


def readiness(df: DataFrame, kind: Column, tokens: str, duplicates: str, minimum=200_000, python=(0.45, 0.75), text=(0.2, 0.55), most_duplicates=0.15) -> DataFrame:
    """One row: ratios and the sorted list of gates that fail."""
    total = F.sum(tokens)
    one = df.agg(
        total.alias("tokens"),
        (F.sum(F.when(kind == "python_code", F.col(tokens)).otherwise(0)) / total).alias("python_ratio"),
        (F.sum(F.when(kind == "technical_text", F.col(tokens)).otherwise(0)) / total).alias("text_ratio"),
        F.avg(F.col(duplicates).cast("double")).alias("duplicate_rate"),
    )
    gates = F.array_compact(
        F.array(
            F.when(F.col("tokens") < minimum, "token_target"),
            F.when(~F.col("python_ratio").between(*python), "python_ratio"),
            F.when(~F.col("text_ratio").between(*text), "technical_text_ratio"),
            F.when(F.col("duplicate_rate") > most_duplicates, "duplicate_rate"),
        )
    )
    return one.withColumn("failures", F.array_join(gates, ",")).withColumn("passed", F.size(gates) == 0)


def source_report(manifest: DataFrame) -> DataFrame:
    """Per source id: files, bytes, packages, repositories, first and last collection."""
    at = F.try_to_timestamp(F.col("collection_timestamp"))
    return manifest.groupBy(F.col("source.id").alias("source_id")).agg(
        F.count_distinct("stored_path").alias("files"),
        F.count(F.lit(1)).alias("rows"),
        F.sum("size_bytes").alias("bytes"),
        F.count_distinct("source.package").alias("packages"),
        F.count_distinct("source.repository_url").alias("repositories"),
        F.min(at).alias("first_collected"),
        F.max(at).alias("last_collected"),
    )


def size_report(df: DataFrame, by: Column, name: str, text: str) -> DataFrame:
    """Per category: files, least, mean and most bytes and lines, total bytes and lines; a last line without line feed counts."""
    size = F.octet_length(text)
    rows = F.regexp_count(text, F.lit("\n")) + F.when(F.col(text).endswith("\n") | (F.col(text) == ""), 0).otherwise(1)
    one = df.filter(F.col(text).isNotNull()).select(by.alias(name), size.alias("_b"), rows.alias("_l"))
    aggs = [F.count(F.lit(1)).alias("files")]
    for c, label in (("_b", "bytes"), ("_l", "lines")):
        aggs += [F.sum(c).alias(label), F.min(c).alias(f"least_{label}"), F.avg(c).alias(f"mean_{label}"), F.max(c).alias(f"most_{label}")]
    return one.groupBy(name).agg(*aggs)


def dedup_report(df: DataFrame, reason: str) -> DataFrame:
    """One row: accepted, duplicates, their share of both (six digits), and a map of reasons to counts; null reasons are accepted."""
    per = df.groupBy(reason).agg(F.count(F.lit(1)).alias("n"))
    duplicate = F.col(reason).isNotNull()
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    kinds = F.map_from_entries(F.array_sort(F.collect_list(F.when(duplicate, F.struct(reason, "n")))))  # one entry per reason
    one = per.agg(n(~duplicate).alias("accepted"), n(duplicate).alias("duplicates"), kinds.alias("reasons"))
    return one.withColumn("duplicate_share", F.round(F.coalesce(F.try_divide("duplicates", F.col("accepted") + F.col("duplicates")), F.lit(0.0)), 6))


def estimated_epochs(total: Column, target: Column) -> Column:
    """How often the tokens at hand must be read to reach a target; 1 if there is none to reach, 0 without tokens."""
    return F.when(F.coalesce(target, F.lit(0)) <= 0, F.when(total > 0, 1.0).otherwise(0.0)).when(total > 0, target / total).otherwise(0.0)


def record_report(df: DataFrame, instruction: str, output: str, category: str) -> DataFrame:
    """Per category: records, those with an empty instruction or output, and mean, median, least and most length of the outputs."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    n = F.length(F.coalesce(F.col(output), F.lit("")))
    return df.groupBy(category).agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(blank(instruction)).alias("empty_instructions"),
        F.count_if(blank(output)).alias("empty_outputs"),
        F.count_if(~blank(instruction) & ~blank(output)).alias("usable"),
        F.avg(n).alias("output_mean"),
        F.median(n).alias("output_median"),
        F.min(n).alias("output_least"),
        F.max(n).alias("output_most"),
    )


def tokenization_report(tokens: DataFrame, token: str) -> DataFrame:
    """One row over exploded tokens: all, words, punctuation, other signs, and distinct ones."""
    word, sign = F.col(token).rlike(r"^[\p{L}\p{M}\p{N}]"), F.col(token).rlike(r"^\p{P}$")
    per = tokens.groupBy(token).agg(F.count(F.lit(1)).alias("n"))
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), n(word).alias("words"), n(sign).alias("punctuation"), n(~word & ~sign).alias("other"), F.count(F.lit(1)).alias("unique_tokens")
    )


def document_index_report(df: DataFrame, text: str, tokens: Column) -> DataFrame:
    """One row: documents, tokens, tokens per document, characters per token, tokens per byte."""
    one = df.filter(F.col(text).isNotNull()).select(tokens.alias("t"), F.length(text).alias("c"), F.octet_length(text).alias("b"))
    t = F.sum("t")
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return one.agg(
        F.count(F.lit(1)).alias("documents"), t.alias("tokens"), ratio(t, F.count(F.lit(1))).alias("tokens_per_document"), ratio(F.sum("c"), t).alias("chars_per_token"), ratio(t, F.sum("b")).alias("tokens_per_byte"),
    )


def markdown(df: DataFrame, title: str, most: int = 1000) -> str:
    """A report table as Markdown; a report has at most ``most`` rows, more raise."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(cell(x) for x in r) + " |" for r in rows)]) + "\n"
