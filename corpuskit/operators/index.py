"""The source index: files, categories and symbols as tables, search, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.runtime import sized


def search(
    files: DataFrame, symbols: DataFrame, categories: DataFrame, text: str, category: str | None = None, limit: int = 100, most_symbols: int = 20
) -> DataFrame:
    """Files whose path, repository or a symbol contains the text (as a LIKE pattern), with their categories and matching symbols.

    ``limit`` is a result page, in order of path and id; ``most_symbols`` of a
    file are shown, the first in order. An empty text matches all files.
    """
    pattern = f"%{text.lower()}%"
    hit = lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))).like(pattern)
    found = symbols.filter(hit("symbol")).select("record_id", "symbol")
    by_symbol = found.select("record_id").distinct().withColumn("_by_symbol", F.lit(True))
    out = files.join(by_symbol, "record_id", "left").filter(hit("path") | hit("repo_name") | F.col("_by_symbol").isNotNull()).drop("_by_symbol")
    if category is not None:
        out = out.join(categories.filter(F.lower("category") == category.lower()).select("record_id"), "record_id", "left_semi")
    page, _ = sized(out.orderBy(F.coalesce("path", F.lit("")), "record_id").limit(limit))
    kinds = categories.join(page.select("record_id"), "record_id").groupBy("record_id").agg(F.array_sort(F.collect_set("category")).alias("categories"))
    names = found.join(page.select("record_id"), "record_id").groupBy("record_id").agg(
        F.slice(F.array_sort(F.collect_set("symbol")), 1, most_symbols).alias("symbols")
    )
    return page.join(kinds, "record_id", "left").join(names, "record_id", "left")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``old`` with those of ``new`` in place of equal keys and beside the rest; columns are those of ``old``."""
    kept = old.join(new.select(key), key, "left_anti")
    return kept.unionByName(new.select(*old.columns))


def incremental(old: DataFrame, scan: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, state): new, changed, unchanged or gone, of a scan against the last manifest."""
    a = old.select(key, F.col(digest).alias("_old"))
    b = scan.select(key, F.col(digest).alias("_new"), F.lit(True).alias("_there"))
    j = a.withColumn("_was", F.lit(True)).join(b, key, "full")
    state = F.when(F.col("_was").isNull(), "new").when(F.col("_there").isNull(), "gone").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("changed")
    return j.select(key, state.alias("state"))


def build_index(manifest: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, categories, symbols) of the manifest rows that the index accepts; one row per file, (file, category), (file, symbol).

    Files: record_id, stored_path, source_id, license, functions, classes and
    estimated_pairs (functions and classes).
    """
    from corpuskit.operators import pysource, validate
    from corpuskit.runtime import cut

    verdict = validate.index_candidates(manifest, records, "record_id").filter("reason = 'accepted'").select("record_id", "stored_path")
    first = manifest.groupBy("record_id", "stored_path").agg(F.min("source.id").alias("source_id"), F.min("license").alias("license"))
    kept = cut(verdict.join(first, ["record_id", "stored_path"]))
    texts = kept.select("record_id", F.col("stored_path").alias("path")).join(records.select("record_id", "text"), "record_id")
    symbols = cut(pysource.definitions(texts, ["record_id"]))
    categories = cut(pysource.file_categories(texts, ["record_id"]))
    functions = F.count_if(F.col("kind") != "class").alias("functions")
    counts = symbols.groupBy("record_id").agg(functions, F.count_if(F.col("kind") == "class").alias("classes"))
    files = kept.join(counts, "record_id", "left").fillna(0, ["functions", "classes"]).withColumn("estimated_pairs", F.col("functions") + F.col("classes"))
    return files, categories, symbols


def population_report(files: DataFrame) -> DataFrame:
    """Per license: files, functions, classes and estimated pairs; blank licenses are <unspecified>."""
    key = F.coalesce(F.nullif(F.trim("license"), F.lit("")), F.lit("<unspecified>")).alias("license")
    return files.groupBy(key).agg(F.count(F.lit(1)).alias("files"), *[F.sum(c).alias(c) for c in ("functions", "classes", "estimated_pairs")])


def reloaded(files: DataFrame, categories: DataFrame) -> DataFrame:
    """(stored_path, categories, primary): what a reload of the index gives for each file."""
    per = categories.groupBy("record_id").agg(F.array_sort(F.collect_set("category")).alias("categories"), F.max(F.when(F.col("is_primary"), F.col("category"))).alias("primary"))
    return files.join(per, "record_id").select("stored_path", "categories", "primary")


def search_conversations(turns: DataFrame, conversation: str, turn: str, title: str, text: str, updated: str, query: str) -> DataFrame:
    """(conversation, updated): conversations whose title or messages hold the text, letter case aside, the latest first."""
    per = turns.groupBy(conversation).agg(
        F.max(title).alias("_title"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(turn, text))), lambda s: s[text]), " ").alias("_texts"), F.max(updated).alias(updated)
    )
    whole = F.lower(F.concat_ws(" ", "_title", "_texts"))
    return per.filter(F.contains(whole, F.lit(query.strip().lower()))).select(conversation, updated).orderBy(F.desc(updated), conversation)
