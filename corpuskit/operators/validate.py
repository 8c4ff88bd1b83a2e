"""Validators: verdicts of records against manifests, limits, syntax and each other; the first reason that holds counts unless said otherwise."""

from __future__ import annotations

import ast
import textwrap
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions import text as T
from corpuskit.operators import quality
from corpuskit.operators.pysource import BAD
from corpuskit.operators.quality import first_reason

_HASH = r"(?i)^[0-9a-f]{64}$"


def parses(text: str) -> bool:
    """Whether Python's parser accepts a text."""
    try:
        ast.parse(text)
    except BAD:
        return False
    return True


def _each(c: Column, fn) -> Column:
    @F.pandas_udf("boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        warnings.simplefilter("ignore")
        for s in batches:
            yield s.map(lambda x: None if x is None else fn(x)).astype("boolean")

    return run(c)


def python_parses(c: Column) -> Column:
    """Whether each text parses as Python; null for null."""
    return _each(c, parses)


def dedented_python_parses(c: Column) -> Column:
    return _each(c, lambda x: parses(textwrap.dedent(x)))


def has_definitions(c: Column) -> Column:
    """Whether a text that parses defines a function or class; false for others, null for null."""

    def fn(text: str) -> bool:
        try:
            return any(isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) for n in ast.walk(ast.parse(text)))
        except BAD:
            return False

    return _each(c, fn)


def has_text_signal(t: Column) -> Column:
    """At least eight parts between blanks that hold a letter, and at most a twentieth of unprintable characters other than line feeds and tabs."""
    words = F.size(F.filter(F.split(F.regexp_replace(t, "_", " "), "(?U)\\s+"), lambda x: x.rlike(r"\p{L}")))
    strange = F.regexp_count(t, F.lit(r"[\p{C}\p{Z}&&[^\n\t ]]"))
    return (words >= 8) & (strange <= F.lit(0.05) * F.length(t))


def unsafe_path(path: Column) -> Column:
    """Absolute, or with a part that leads upwards; backslashes count as slashes."""
    p = F.regexp_replace(path, r"\\", "/")
    return p.rlike(r"^(/|[A-Za-z]:)") | p.rlike(r"(^|/)\.\.(/|$)")


def manifest_verdicts(manifest: DataFrame, texts: DataFrame, key: str, syntax: bool = True, technical_text: bool = True, least=80, most=2_000_000) -> DataFrame:
    """(key, stored_path, reason) of each distinct manifest row against the text it refers to.

    In order: invalid_metadata, unsafe_path, missing_file, too_small, too_large,
    hash_mismatch, empty_file, invalid_python_syntax (only with ``syntax``),
    cleaner_<reason>, technical_text_disabled, low_text_signal, accepted.
    ``texts`` has (key, text); rows given again count once.
    """
    rows = manifest.select(key, "stored_path", "content_sha256").distinct()
    j = rows.join(texts.select(key, "text"), key, "left")
    t, path = F.col("text"), F.col("stored_path")
    python = T.content_type(path) == "python_code"
    clean = quality.clean_reason(T.normalize_source(t), path, 0, most)
    checks = [
        ("invalid_metadata", F.col(key).isNull() | path.isNull() | ~F.coalesce(F.col("content_sha256").rlike(_HASH), F.lit(False))),
        ("unsafe_path", unsafe_path(path)),
        ("missing_file", t.isNull()),
        ("too_small", F.octet_length(t) < least),
        ("too_large", F.octet_length(t) > most),
        ("hash_mismatch", F.lower("content_sha256") != F.sha2(t, 256)),
        ("empty_file", F.regexp_replace(t, "(?U)\\s+", "") == ""),
    ]
    if syntax:
        checks.append(("invalid_python_syntax", python & ~python_parses(t)))
    early = first_reason(*checks)
    late = F.when(clean != "accepted", F.concat(F.lit("cleaner_"), clean)).otherwise(
        first_reason(("technical_text_disabled", ~python & F.lit(not technical_text)), ("low_text_signal", ~python & ~has_text_signal(t)), otherwise="accepted")
    )
    return j.select(key, "stored_path", F.coalesce(early, late).alias("reason"))


def index_candidates(manifest: DataFrame, texts: DataFrame, key: str, syntax: bool = True, least=1, most=2_000_000) -> DataFrame:
    """(key, stored_path, reason) of manifest rows that want to enter the source index, in order of path and key.

    invalid_provenance, unsafe_stored_path, missing_file, hash_mismatch,
    size_out_of_bounds, invalid_python_syntax; then, among those left,
    duplicate_stored_path and duplicate_content (the first row wins), accepted.
    """
    rows = manifest.select(key, "stored_path", "content_sha256", F.col("source.id").alias("_source")).distinct()
    j = rows.join(texts.select(key, "text"), key, "left")
    t, size = F.col("text"), F.octet_length("text")
    checks = [
        ("invalid_provenance", F.col("_source").isNull() | F.col(key).isNull() | F.col("stored_path").isNull()),
        ("unsafe_stored_path", unsafe_path(F.col("stored_path"))),
        ("missing_file", t.isNull()),
        ("hash_mismatch", ~F.coalesce(F.lower("content_sha256") == F.sha2(t, 256), F.lit(False))),
        ("size_out_of_bounds", ~size.between(least, most)),
    ]
    if syntax:
        checks.append(("invalid_python_syntax", (T.content_type(F.col("stored_path")) == "python_code") & ~python_parses(t)))
    own = j.select(key, "stored_path", F.sha2(t, 256).alias("_h"), first_reason(*checks).alias("_own"))
    place = F.struct(F.col("stored_path"), F.col(key))
    left = own.filter("_own is null")
    by_path = left.groupBy("stored_path").agg(F.min(place).alias("_p"))
    # Only rows that keep their path compete for their content.
    firsts = left.join(by_path, "stored_path").filter(place == F.col("_p"))
    by_content = firsts.groupBy("_h").agg(F.min(place).alias("_c"))
    seen = left.join(by_path, "stored_path").join(by_content, "_h", "left")
    reason = first_reason(("duplicate_stored_path", place != F.col("_p")), ("duplicate_content", place != F.col("_c")), otherwise="accepted")
    return own.filter("_own is not null").select(key, "stored_path", F.col("_own").alias("reason")).union(seen.select(key, "stored_path", reason.alias("reason")))


def document_reasons(df: DataFrame, id_col: str, text: Column, least=1, most=2_000_000, least_after=1) -> DataFrame:
    """(id, reason, duplicate_of) of documents that are cleaned and kept once.

    invalid_utf8 (null), empty_file, too_small, too_large, empty_after_cleaning,
    too_small_after_cleaning, duplicate (of the first id with the same cleaned
    text), accepted. Cleaning is ``functions.text.builder_text``.
    """
    size = F.octet_length("_t")
    base = df.select(F.col(id_col), text.alias("_t")).withColumn("_c", T.builder_text(F.col("_t")))
    own = first_reason(
        ("invalid_utf8", F.col("_t").isNull()),
        ("empty_file", size == 0),
        ("too_small", size < least),
        ("too_large", size > most),
        ("empty_after_cleaning", F.col("_c") == "\n"),
        ("too_small_after_cleaning", F.octet_length("_c") < least_after),
    )
    keyed = base.select(id_col, own.alias("_own"), F.sha2("_c", 256).alias("_h"))
    firsts = keyed.filter("_own is null").groupBy("_h").agg(F.min(id_col).alias("_first"))
    j = keyed.join(firsts, "_h", "left")
    later = F.col("_own").isNull() & (F.col("_first") < F.col(id_col))
    return j.select(
        id_col, F.coalesce("_own", F.when(later, "duplicate").otherwise("accepted")).alias("reason"), F.when(later, F.col("_first")).alias("duplicate_of")
    )


def instruction_sources(df: DataFrame, keep: list[str], text: str = "text", least=20, most=500_000) -> DataFrame:
    """``keep`` and ``reason``: missing_content, too_small, too_large, invalid_python_syntax, no_python_definitions, accepted."""
    t = F.col(text)
    reason = first_reason(
        ("missing_content", F.coalesce(F.regexp_replace(t, "(?U)\\s+", "") == "", F.lit(True))),
        ("too_small", F.octet_length(t) < least),
        ("too_large", F.octet_length(t) > most),
        ("invalid_python_syntax", ~python_parses(t)),
        ("no_python_definitions", ~has_definitions(t)),
        otherwise="accepted",
    )
    return df.select(*keep, reason.alias("reason"))


def collection_reasons(df: DataFrame, id_col: str, path: str, text: str, suffixes: tuple[str, ...], syntax: bool = True, least=16, most=1_000_000, lines=8, extra: tuple[tuple[str, Column], ...] = ()) -> DataFrame:
    """(id, reason): the collector's verdict on candidates; ``extra`` are a user's own (reason, condition) checks, which come last.

    unsupported_extension, generated_file (by name), too_small, too_large,
    invalid_utf8 (null text), generated_file (a mark in the first ``lines``
    lines), invalid_python_syntax (with ``syntax``), accepted.
    """
    t = F.col(text)
    head = F.lower(F.array_join(F.slice(quality.lines(t), 1, lines), "\n"))
    checks = [
        ("unsupported_extension", ~F.coalesce(T.suffix(F.col(path)).isin(*suffixes), F.lit(False))),
        ("generated_file", quality.holds_any(F.lower(F.coalesce(F.col(path), F.lit(""))), quality.GENERATED_NAMES)),
        ("too_small", F.octet_length(t) < least),
        ("too_large", F.octet_length(t) > most),
        ("invalid_utf8", t.isNull()),
        ("generated_file", quality.holds_any(head, quality.GENERATED_MARKERS)),
    ]
    if syntax:
        checks.append(("invalid_python_syntax", (T.content_type(F.col(path)) == "python_code") & ~python_parses(t)))
    return df.select(id_col, first_reason(*checks, *extra, otherwise="accepted").alias("reason"))


def corpus_verdicts(df: DataFrame, id_col: str, path: str, text: str) -> DataFrame:
    """(id, reason): the validator's verdict, invalid_python_syntax before the quality reasons; one pass over the texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        warnings.simplefilter("ignore")
        for b in batches:
            rows = [(not python or parses(t), *quality.text_measures(t)) for t, python in zip(b["_text"], b["_python"])]
            out = pd.DataFrame(rows, columns=["valid", "entropy", "base64", "hex", "repeated", "score"])
            yield pd.concat([b[[id_col, "_python"]].reset_index(drop=True), out], axis=1)

    kept = df.select(id_col, (T.content_type(F.col(path)) == "python_code").alias("_python"), F.col(text).alias("_text")).filter("_text is not null")
    kept = kept.withColumn("_python", F.coalesce("_python", F.lit(False)))
    kind = kept.schema[id_col].dataType.simpleString()
    m = kept.mapInPandas(run, f"`{id_col}` {kind}, _python boolean, valid boolean, entropy double, base64 double, hex double, repeated double, score int")
    content = F.when(F.col("_python"), "python_code").otherwise("technical_text")
    reason = quality.quality_reason({c: F.col(c) for c in ("entropy", "base64", "hex", "repeated", "score")}, content)
    return m.select(id_col, F.when(~F.col("valid"), "invalid_python_syntax").otherwise(reason).alias("reason"))


def instruction_problems(df: DataFrame, key: str, instruction: str, given: str, output: str, category: Column, categories: tuple[str, ...], least=3, most=100_000) -> DataFrame:
    """(key, problems): all codes that apply to each record, sorted; none for a sound one.

    invalid_category, instruction_too_short, instruction_too_long,
    output_too_short, output_too_large, null_character, missing_provenance (a
    null key), duplicate_record_id, duplicate_instruction_pair (of a record
    earlier by key). Duplicates are counted with a combine on the map side.
    """
    from corpuskit.operators.sft import pair_hash

    i, o = F.trim(F.coalesce(F.col(instruction), F.lit(""))), F.coalesce(F.col(output), F.lit(""))
    base = df.select(F.col(key), i.alias("_i"), o.alias("_o"), category.alias("_cat"), pair_hash(F.col(instruction), F.col(given), F.col(output)).alias("_pair"))
    firsts = base.groupBy("_pair").agg(F.min(key).alias("_first"))
    times = base.groupBy(key).agg(F.count(F.lit(1)).alias("_times"))
    j = base.join(firsts, "_pair", "left").join(times, key, "left")
    codes = F.array(
        F.when(~F.coalesce(F.col("_cat").isin(*categories), F.lit(False)), "invalid_category"),
        F.when(F.length("_i") < least, "instruction_too_short"),
        F.when(F.length("_i") > most, "instruction_too_long"),
        F.when(F.trim("_o") == "", "output_too_short"),
        F.when(F.length("_o") > most, "output_too_large"),
        F.when(F.contains(F.concat("_i", "_o"), F.lit("\x00")), "null_character"),
        F.when(F.col(key).isNull(), "missing_provenance"),
        F.when(F.col("_times") > 1, "duplicate_record_id"),
        F.when(F.col("_first") < F.col(key), "duplicate_instruction_pair"),
    )
    return j.select(key, F.array_sort(F.array_compact(codes)).alias("problems"))


def balance(df: DataFrame, kind: Column, tokens: str, least: int, most: int, python=(0.45, 0.75), text=(0.2, 0.55)) -> DataFrame:
    """One row: tokens, files, fractions, and whether target, limit and balance are met; ``ready`` if all are."""
    total = F.sum(tokens)
    of = lambda name: F.coalesce(F.try_divide(F.sum(F.when(kind == name, F.col(tokens)).otherwise(0)), total), F.lit(0.0))
    one = df.agg(total.alias("tokens"), F.count(F.lit(1)).alias("files"), of("python_code").alias("python_fraction"), of("technical_text").alias("text_fraction"))
    met = F.coalesce(F.col("tokens") >= least, F.lit(False))
    exceeded = F.coalesce(F.col("tokens") > most, F.lit(False))
    even = F.col("python_fraction").between(*python) & F.col("text_fraction").between(*text)
    return one.withColumns({"target_met": met, "target_exceeded": exceeded, "balance_met": even, "ready": met & ~exceeded & even})
