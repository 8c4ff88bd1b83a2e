"""Word tokens, vocabulary, encoding and token statistics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.functions import text as T
from corpuskit.operators.windows import running_offsets
from corpuskit.runtime import cut

SPECIALS = ("<PAD>", "<UNK>", "<BOS>", "<EOS>", "<NL>")


def token_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, token), one row per word token."""
    return df.select(id_col, F.posexplode(T.tokens(F.lower(text_col))).alias("pos", "token"))


def frequencies(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return token_rows(df, id_col, text_col).groupBy("token").agg(F.count(F.lit(1)).alias("frequency"))


def vocabulary(df: DataFrame, id_col: str, text_col: str, size: int, minimum: int = 2) -> DataFrame:
    """(token_id, token, frequency) of the ``size`` commonest tokens, specials first; ties by token.

    The limit is the vocabulary's size, a setting; it is taken before the ids
    are numbered, so only ``size`` rows meet in one task.
    """
    top = (
        frequencies(df, id_col, text_col)
        .filter(F.col("frequency") >= minimum)
        .orderBy(F.desc("frequency"), "token")
        .limit(size - len(SPECIALS))
    )
    w = Window.orderBy(F.desc("frequency"), "token")
    return top.select((F.row_number().over(w) - 1 + len(SPECIALS)).alias("token_id"), "token", "frequency")


def full_vocabulary(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(token_id, token, frequency) of all tokens, however many: ids are consecutive within blocks of a hash, and no task sees them all."""
    f = frequencies(df, id_col, text_col)
    blocks = F.pmod(F.xxhash64("token"), F.lit(4096)).cast("bigint")
    place = F.row_number().over(Window.partitionBy("_b").orderBy("token")).cast("bigint")
    return f.withColumn("_b", blocks).select((F.lit(len(SPECIALS)) + (place - 1) * 4096 + F.col("_b")).alias("token_id"), "token", "frequency")


#: A vocabulary of at most so many tokens goes to the tasks as a table; a larger one is joined.
TABLE_TOKENS = 500_000


def _words(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.filter(F.col(text_col).isNotNull()).select(id_col, T.tokens(F.lower(text_col)).alias("_words"))


def _mapped(df: DataFrame, id_col: str, column: str, table: dict, out: str, kind: str, missing) -> DataFrame:
    """Arrays mapped through a table that each task holds once; nothing is shuffled."""
    shared = df.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for b in batches:
            yield pd.DataFrame({id_col: b[id_col], out: [[known.get(x, missing) for x in a] for a in b[column]]})

    kept = df.select(id_col, column).filter(F.size(column) > 0)
    return kept.mapInPandas(run, f"`{id_col}` {kept.schema[id_col].dataType.simpleString()}, {out} array<{kind}>")


def encode(df: DataFrame, vocab: DataFrame, id_col: str, text_col: str, most: int = TABLE_TOKENS) -> DataFrame:
    """(id, ids array): tokens outside the vocabulary become <UNK>; texts without tokens give no row.

    A vocabulary of at most ``most`` tokens is a table in each task; a larger
    one is joined to the tokens, which are gathered again by position.
    """
    vocab = cut(vocab.select("token", "token_id"))
    kind = vocab.schema["token_id"].dataType.simpleString()
    if vocab.count() <= most:
        table = {r["token"]: r["token_id"] for r in vocab.toLocalIterator()}  # bounded by the count above
        return _mapped(_words(df, id_col, text_col), id_col, "_words", table, "ids", kind, 1)
    rows = token_rows(df, id_col, text_col).join(vocab, "token", "left")
    pairs = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("token_id", F.lit(1)).alias("token_id"))))
    return rows.groupBy(id_col).agg(F.transform(pairs, lambda p: p["token_id"]).alias("ids"))


def token_statistics(df: DataFrame, count_col: str) -> DataFrame:
    """One row: documents, total, mean, median, 95th percentile by rank, least, most.

    The percentile is the value whose 0-based rank is round((n - 1) * 0.95),
    half to even. Values are counted first; then only counts of the distinct
    values are added up, in ranges, so that no task sorts them all.
    """
    n = df.count()
    per_value = df.filter(F.col(count_col).isNotNull()).groupBy(F.col(count_col).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    before = running_offsets(per_value, "v", "c", "_before")

    def at(rank: int) -> Column:
        return F.max(F.when((F.col("_before") <= rank) & (F.col("_before") + F.col("c") > rank), F.col("v")))

    ranks = before.agg(at(round((n - 1) * 0.95)).alias("p95"), at((n - 1) // 2).alias("_low"), at(n // 2).alias("_high"))
    one = df.agg(F.count(F.lit(1)).alias("documents"), F.sum(count_col).alias("total"), F.avg(count_col).alias("mean"), F.min(count_col).alias("least"), F.max(count_col).alias("most"))
    both = one.join(F.broadcast(ranks))  # one row each
    return both.select("documents", "total", "mean", F.floor((F.col("_low") + F.col("_high")) / 2).cast("bigint").alias("median"), "least", "most", "p95")


def decode(df: DataFrame, vocab: DataFrame, id_col: str, ids: str, most: int = TABLE_TOKENS) -> DataFrame:
    """(id, tokens array<string>): the tokens of the ids in order; ids outside the vocabulary become <UNK>, specials their names."""
    vocab = cut(vocab.select("token", "token_id"))
    if vocab.count() <= most:
        table = dict(enumerate(SPECIALS)) | {r["token_id"]: r["token"] for r in vocab.toLocalIterator()}  # bounded by the count above
        return _mapped(df, id_col, ids, table, "tokens", "string", SPECIALS[1])
    names = F.array(*[F.lit(s) for s in SPECIALS])
    rows = df.select(id_col, F.posexplode(ids).alias("pos", "token_id")).join(vocab, "token_id", "left")
    special = F.when(F.col("token_id").between(0, len(SPECIALS) - 1), F.get(names, F.col("token_id").cast("int")))
    pairs = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("token", special, F.lit(SPECIALS[1])).alias("token"))))
    return rows.groupBy(id_col).agg(F.transform(pairs, lambda p: p["token"]).alias("tokens"))


def detokenize(tokens: Column) -> Column:
    """Tokens joined by blanks, none before closing and after opening punctuation."""
    text = F.array_join(tokens, " ")
    text = F.regexp_replace(text, r" (?=[.,;:!?)\]}%])", "")
    return F.regexp_replace(text, r"(?<=[(\[{]) ", "")


def characters(t: Column, newline: str | None = SPECIALS[4]) -> Column:
    """Non-blank characters; runs of line ends become one newline token, none at the start."""
    lined = F.regexp_replace(F.regexp_replace(t, r"\A[\r\n\s]+", ""), r"[\r\n]+", "\n")
    chars = F.filter(F.split(lined, ""), lambda c: (c != "") & (~c.rlike(r"(?U)^[\s&&[^\n]]$")))
    if newline is None:
        return F.filter(chars, lambda c: c != "\n")
    return F.transform(chars, lambda c: F.when(c == "\n", newline).otherwise(c))


def bounded(ids: Column, bos: bool, eos: bool, boundary: str = "none") -> Column:
    """Ids with BOS and EOS as the flags or the boundary (eos, eos_bos) ask; empty arrays stay empty."""
    head = F.array(F.lit(2)) if bos or boundary == "eos_bos" else F.array().cast("array<int>")
    tail = F.array(F.lit(3)) if eos or boundary in ("eos", "eos_bos") else F.array().cast("array<int>")
    return F.when(F.size(ids) > 0, F.concat(head, ids, tail)).otherwise(ids)


def masked_example(prompt: Column, answer: Column, context: int, pad: int = 0, ignore: int = -100) -> tuple[Column, Column]:
    """(inputs, labels) of ``context`` ids: BOS prompt answer EOS, cut to context + 1 with EOS last, labels of the prompt ignored, padded."""
    whole = F.concat(F.array(F.lit(2)), prompt, answer, F.array(F.lit(3)))
    cut = F.when(F.size(whole) > context + 1, F.concat(F.slice(whole, 1, context), F.array(F.lit(3)))).otherwise(whole)
    masked = F.least(F.size(prompt), F.size(cut) - 1)  # labels are shifted by one, so BOS's label is the prompt's first id
    labels = F.concat(F.array_repeat(F.lit(ignore), masked), F.slice(cut, masked + 2, context))
    fill = lambda a, x: F.concat(a, F.array_repeat(F.lit(x), F.greatest(F.lit(0), F.lit(context) - F.size(a))))
    return fill(F.slice(cut, 1, F.size(cut) - 1), pad), fill(labels, ignore)


def words(t: Column, newline: str | None = None, contractions: bool = True, punctuation: bool = True) -> Column:
    """Word tokens with options: a token for runs of line ends (none at the start), words split at apostrophes, punctuation left out.

    Signs that are no punctuation stay even where that is left out.
    """
    inner = r"(?:'[\p{L}\p{M}\p{N}]+)*" if contractions else ""
    line = r"[\r\n]+|" if newline is not None else ""
    found = F.regexp_extract_all(F.regexp_replace(t, r"(?U)\A\s+", ""), F.lit(rf"(?U){line}[\p{{L}}\p{{M}}\p{{N}}]+{inner}|[^\s\p{{L}}\p{{M}}\p{{N}}]"), F.lit(0))
    if not punctuation:
        found = F.filter(found, lambda x: ~x.rlike(r"^\p{P}$"))
    if newline is not None:
        found = F.transform(found, lambda x: F.when(x.rlike(r"^[\r\n]"), newline).otherwise(x))
    return found


def ended(ids: Column, eos: int = 3) -> Column:
    """Ids with an end token, unless they end in one; empty arrays stay empty."""
    return F.when(F.size(ids) == 0, ids).when(F.element_at(ids, -1) == eos, ids).otherwise(F.concat(ids, F.array(F.lit(eos))))


def response_example(prompt: Column, answer: Column, context: int, eos: int = 3, pad: int = 0, ignore: int = -100) -> tuple[Column, Column]:
    """(inputs, labels) of ``context`` ids that keep the answer: it is cut to context, the prompt to the last ids that fit before it; labels of the prompt are ignored."""
    said = F.slice(ended(answer, eos), 1, context)
    room = F.lit(context) - F.size(said)
    given = F.when(room > 0, F.slice(prompt, F.greatest(F.lit(1), F.size(prompt) - room + 1), F.greatest(room, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    inputs = F.concat(given, said)
    labels = F.concat(F.array_repeat(F.lit(ignore), F.size(given)), said)
    fill = lambda a, x: F.concat(a, F.array_repeat(F.lit(x), F.lit(context) - F.size(a)))
    return fill(inputs, pad), fill(labels, ignore)


def vocabulary_use(df: DataFrame, ids: str, size: int) -> DataFrame:
    """One row: tokens, distinct ids used, and their share of a vocabulary of ``size``."""
    per = df.select(F.explode(ids).alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("used"), (F.count(F.lit(1)) / F.lit(size)).alias("utilization"))
