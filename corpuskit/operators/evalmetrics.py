"""Scores of generated texts and answers, comparisons, embedding statistics."""

from __future__ import annotations

import ast
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def repetition_rate(a: Column) -> Column:
    """1 - distinct / all; 0 for empty arrays."""
    return F.when(F.size(a) > 0, 1 - F.size(F.array_distinct(a)) / F.size(a)).otherwise(0.0)


def coherence(a: Column) -> Column:
    """Distinct pairs of neighbours / pairs; 0 below two items."""
    n = F.size(a)
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(a, i, 2), "\x00"))
    return F.when(n > 1, F.size(F.array_distinct(pairs)) / (n - 1)).otherwise(0.0)


def longest_run(a: Column) -> Column:
    """Most equal items in a row."""
    start = F.struct(F.lit(None).cast("string").alias("x"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(acc["x"].eqNullSafe(x), acc["run"] + 1).otherwise(1)
        return F.struct(x.alias("x"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(a, start, step)["best"]


def keyword_coverage(t: Column, keywords: Column) -> Column:
    """Share of the keywords that the text contains, letter case aside; 1 without keywords."""
    low = F.lower(F.coalesce(t, F.lit("")))
    held = F.size(F.filter(keywords, lambda k: F.contains(low, F.lower(k))))
    return F.when(F.coalesce(F.size(keywords), F.lit(0)) > 0, held / F.size(keywords)).otherwise(1.0)


def answer_checks(items: DataFrame, syntax: bool = True) -> DataFrame:
    """(item_id, terms_ok, any_ok, syntax_ok, passed, failure) of each item's answer against its rules.

    Null answers fail rules that ask for words. ``syntax_ok`` is false where the
    rules ask for Python and the answer's Python doesn't parse or is missing
    (without ``syntax`` it isn't asked). ``failure`` names the failed rules,
    joined by "; ", empty if none.
    """
    low = F.lower(F.regexp_replace(F.coalesce("answer", F.lit("")), "\\s+", " "))
    terms = F.coalesce(F.col("check_rules.required_terms"), F.array().cast("array<string>"))
    groups = F.coalesce(F.col("check_rules.required_any"), F.array().cast("array<array<string>>"))
    has = lambda k: F.contains(low, F.lower(k))
    missing = F.filter(terms, lambda k: ~has(k))
    unmet = F.filter(groups, lambda g: ~F.exists(g, has))
    asked = F.coalesce(F.col("check_rules.python_syntax"), F.lit(False)) & F.lit(syntax)
    ok = ~asked | F.coalesce(_answer_parses(F.coalesce("answer", F.lit(""))), F.lit(False)) if syntax else F.lit(True)
    j = items.select("item_id", (F.size(missing) == 0).alias("terms_ok"), (F.size(unmet) == 0).alias("any_ok"), ok.alias("syntax_ok"), missing.alias("_m"), unmet.alias("_u"))
    said = F.array_compact(
        F.array(
            F.when(~F.col("terms_ok"), F.concat(F.lit("missing terms: "), F.array_join("_m", ", "))),
            F.when(~F.col("any_ok"), F.concat(F.lit("none of: "), F.array_join(F.transform("_u", lambda g: F.array_join(g, "/")), ", "))),
            F.when(~F.col("syntax_ok"), F.lit("invalid python syntax")),
        )
    )
    passed = F.col("terms_ok") & F.col("any_ok") & F.col("syntax_ok")
    return j.select("item_id", "terms_ok", "any_ok", "syntax_ok", passed.alias("passed"), F.array_join(said, "; ").alias("failure"))


def _answer_parses(c: Column) -> Column:
    from corpuskit.operators.lines import python_in_answer
    from corpuskit.operators.validate import parses

    @F.pandas_udf("boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: bool(code := python_in_answer(x)) and parses(code))

    return run(c)


def weighted_loss(df: DataFrame, by: list[str], loss: str, weight: str) -> DataFrame:
    """Per group: weighted mean loss, perplexity exp(min(20, loss))."""
    mean = F.sum(F.col(loss) * F.col(weight)) / F.sum(weight)
    return df.groupBy(*by).agg(F.sum(weight).alias("weight"), mean.alias("loss"), F.exp(F.least(F.lit(20.0), mean)).alias("perplexity"))


def comparison(df: DataFrame, key: str, variant: Column, base: str, other: str, value: str) -> DataFrame:
    """Per key: means of two variants and the relative change; 0 where the base is 0."""
    per = df.groupBy(key).agg(F.avg(F.when(variant == base, F.col(value))).alias("base"), F.avg(F.when(variant == other, F.col(value))).alias("candidate"))
    change = F.when(F.col("base") == 0, 0.0).otherwise((F.col("candidate") - F.col("base")) / F.abs("base"))
    return per.withColumn("relative_change", change)


def early_stopping(df: DataFrame, run: str, step: str, loss: str, patience: int, least_gain: float = 0.0) -> DataFrame:
    """df with ``best`` so far, ``bad_steps`` since it and ``stop``, per run in order of step."""
    w = Window.partitionBy(run).orderBy(step)
    before = F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, -1))
    better = before.isNull() | (F.col(loss) < before - least_gain)
    marked = df.withColumn("best", F.min(loss).over(w)).withColumn("_g", F.sum(better.cast("int")).over(w))
    bad = F.row_number().over(Window.partitionBy(run, "_g").orderBy(step)) - 1
    return marked.withColumn("bad_steps", bad).withColumn("stop", F.col("bad_steps") >= patience).drop("_g")


def embedding_statistics(df: DataFrame, vector: str, by: str) -> DataFrame:
    """Per label: vectors, components, their least, most and mean, population deviation and L2 norm, mean norm of a vector, zero vectors."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    per = df.select(by, norm.alias("norm"), F.posexplode(vector).alias("i", "x"))
    x = F.col("x").cast("double")
    return per.groupBy(by).agg(
        F.count(F.lit(1)).alias("components"),
        F.min(x).alias("least"),
        F.max(x).alias("most"),
        F.avg(x).alias("mean"),
        F.stddev_pop(x).alias("deviation"),
        F.avg("norm").alias("mean_norm"),
        F.sqrt(F.sum(x * x)).alias("l2"),
        F.count_if(F.col("i") == 0).alias("vectors"),
        F.count_if((F.col("i") == 0) & (F.col("norm") == 0)).alias("zero_vectors"),
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def top_p(df: DataFrame, group: str, probability: str, tie: str, p: float) -> DataFrame:
    """Rows of each group in falling order up to and with the one that reaches the cumulative probability p."""
    w = Window.partitionBy(group).orderBy(F.desc(probability), tie).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_before", F.coalesce(F.sum(probability).over(w), F.lit(0.0))).filter(F.col("_before") < p).drop("_before")


def pass_rates(df: DataFrame, by: str, passed: Column) -> DataFrame:
    """Per category: items, passed ones and their share."""
    n = F.count(F.lit(1))
    return df.groupBy(by).agg(n.alias("items"), F.count_if(passed).alias("passed"), (F.count_if(passed) / n).alias("rate"))


#: Signs of Markdown.
MARKDOWN_SIGNS = ("# ", "- ", "* ", "1. ", "**", "`")


def generation_scores(df: DataFrame, by: str, answer: str, terms: Column) -> DataFrame:
    """Per group: answers, mean coverage of the wanted terms, shares with Markdown and with fenced code, mean length."""
    a = F.coalesce(F.col(answer), F.lit(""))
    marked, fenced = F.lit(False), F.contains(a, F.lit("```"))
    for sign in MARKDOWN_SIGNS:
        marked = marked | F.contains(a, F.lit(sign))
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("answers"),
        F.avg(keyword_coverage(a, terms)).alias("following"),
        F.avg(marked.cast("double")).alias("markdown_rate"),
        F.avg(fenced.cast("double")).alias("fence_rate"),
        F.avg(F.length(a)).alias("mean_chars"),
    )


def latency_summary(df: DataFrame, by: str, seconds: str, tokens: str) -> DataFrame:
    """Per group: runs, mean, least and most seconds, and tokens a second over all (null without time)."""
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("runs"), F.avg(seconds).alias("mean_seconds"), F.min(seconds).alias("least_seconds"), F.max(seconds).alias("most_seconds"),
        F.try_divide(F.sum(tokens), F.sum(seconds)).alias("tokens_per_second"),
    )


def improvement(base: Column, other: Column, lower_is_better: Column) -> Column:
    """Relative improvement; the sign is turned where less is better, 0 where the base is 0."""
    change = F.when(base == 0, 0.0).otherwise((other - base) / F.abs(base))
    return F.when(lower_is_better, -change).otherwise(change)


def overall_improvement(compared: DataFrame, key: str, lower: tuple[str, ...]) -> DataFrame:
    """compared (key, base, candidate) with ``improvement``, and ``overall``, their mean over all keys."""
    each = compared.withColumn("improvement", improvement(F.col("base"), F.col("candidate"), F.col(key).isin(*lower)))
    return each.join(F.broadcast(each.agg(F.avg("improvement").alias("overall"))))  # one row


def loss_history(logs: DataFrame, step: str, run: str, order: str) -> DataFrame:
    """One row per (step, run) of repeated logs, the latest by ``order``."""
    other = [c for c in logs.columns if c not in (step, run)]
    latest = F.max(F.struct(F.col(order).alias("_order"), *[F.col(c) for c in other])).alias("_last")
    return logs.groupBy(step, run).agg(latest).select(step, run, *[F.col(f"_last.{c}").alias(c) for c in other])


def top_k(df: DataFrame, group: str, logit: str, k: int) -> DataFrame:
    """Rows of each group whose logit is at least its k-th largest; ties at that value are kept."""
    return df.withColumn("_k", F.rank().over(Window.partitionBy(group).orderBy(F.desc(logit)))).filter(F.col("_k") <= k).drop("_k")


def softmax(df: DataFrame, group: str, logit: str, temperature: float = 1.0) -> DataFrame:
    """df with ``probability``: softmax of logit / temperature per group, the largest logit taken out first."""
    if temperature <= 0:
        raise ValueError("temperature must be above 0")
    w = Window.partitionBy(group)
    e = F.exp((F.col(logit) - F.max(logit).over(w)) / temperature)
    return df.withColumn("_e", e).withColumn("probability", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def penalized(logit: Column, seen: Column, penalty: float) -> Column:
    """Logits of tokens seen before, divided by the penalty if positive and multiplied by it if not."""
    return F.when(seen, F.when(logit > 0, logit / penalty).otherwise(logit * penalty)).otherwise(logit)


def loops(items: list, text: str) -> bool:
    """Whether a text repeats itself: an item 8 times in a row, a run of 2 to 12 items 4 times (the longest that comes 3 times counts), or one word in 35 % of 20 or more."""
    run = best = 0
    for x, y in zip(items, [None, *items]):
        run = run + 1 if x == y and run else 1
        best = max(best, run)
    if best >= 8:
        return True
    for length in range(12, 1, -1):
        counts = Counter(zip(*(items[k:] for k in range(length))))
        if counts and (most := max(counts.values())) >= 3:
            if most >= 4:
                return True
            break
    words = Counter(re.findall(r"\b\w+\b", text))
    n = words.total()
    top = max(words.values(), default=0)
    return n >= 20 and top >= 8 and top / n >= 0.35


def repetition_loops(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, looping): ``loops`` over the word tokens of each text that isn't null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({id_col: b[id_col], "looping": [loops(re.findall(r"\w+|[^\w\s]", t), t) for t in b["_text"]]})

    kept = df.select(id_col, F.col(text).alias("_text")).filter("_text is not null")
    return kept.mapInPandas(run, f"`{id_col}` {kept.schema[id_col].dataType.simpleString()}, looping boolean")


def response_issues(df: DataFrame, id_col: str, prompt: str, answer: str) -> DataFrame:
    """(id, issues): prompt_echo, repeated_markers, repetition_loop, invalid_python_syntax, undefined_names, unfinished_function, sorted; null answers have none.

    The last three are asked of answers that hold Python.
    """
    from corpuskit.operators.lines import python_in_answer
    from corpuskit.operators.pysource import BAD, undefined_of

    def issues(asked: str | None, said: str) -> list[str]:
        out = []
        if asked and len(asked.strip()) >= 12 and said.strip().startswith(asked.strip()):
            out.append("prompt_echo")
        if any(said.count(m) > 1 for m in ("### Instruction:", "### Response:", "<|user|>", "<|assistant|>")):
            out.append("repeated_markers")
        if loops(re.findall(r"\w+|[^\w\s]", said), said):
            out.append("repetition_loop")
        code = python_in_answer(said)
        if code:
            try:
                tree = ast.parse(code)
                if undefined_of(tree):
                    out.append("undefined_names")
                bodies = [n.body for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
                if any(all(isinstance(x, ast.Pass) or (isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant)) for x in b) for b in bodies):
                    out.append("unfinished_function")
            except BAD:
                out.append("invalid_python_syntax")
        return sorted(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({id_col: b[id_col], "issues": [issues(p, a) if a is not None else [] for p, a in zip(b["_prompt"], b["_answer"])]})

    kept = df.select(id_col, F.col(prompt).alias("_prompt"), F.col(answer).alias("_answer"))
    return kept.mapInPandas(run, f"`{id_col}` {kept.schema[id_col].dataType.simpleString()}, issues array<string>")
