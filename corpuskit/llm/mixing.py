"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.runtime import cut, sized

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how byte_bpe_50k splits a text before it merges.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Documents of a source that the first step rounds together, and residuals that one step of the reduction tree combines.
BUNCH, FAN_IN = 4_096, 256
#: A vocabulary file of at most so many bytes is sent to the tasks.
VOCABULARY_BYTES = 64 << 20

_encoders: dict[int, object] = {}


def _encoder(raw: bytes):
    """The encoder of a vocabulary file's content, made once a process."""
    key = xxhash.xxh3_64_intdigest(raw)
    if key not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        _encoders[key] = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def token_counts(df: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` and ``tokens``, the number of tokens of the whole text; 0 for null and empty texts.

    The vocabulary file is read by the driver and sent along, so that executors need no copy of it.
    """
    raw = Path(vocabulary).read_bytes()
    if len(raw) > VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary} has {len(raw)} bytes; at most {VOCABULARY_BYTES} are sent to tasks")
    shared = df.sparkSession.sparkContext.broadcast(raw)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(shared.value).encode_ordinary
        for b in batches:
            yield b.drop(columns="_text").assign(tokens=[len(encode(t)) if t else 0 for t in b["_text"]])

    kept = df.select(*keep, F.col(text).alias("_text"))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != "_text")
    return kept.mapInPandas(run, out + ", tokens bigint")


def _uniform(seed: int, *ids: int) -> float:
    """A number of [0, 1) that depends on nothing but its arguments."""
    return xxhash.xxh3_64_intdigest(repr((seed, *ids))) / 2**64


class Pivot:
    """Streaming pivotal rounding within sources; at most one fractional document a source is held.

    A pair of fractional documents exchanges mass, weighted by tokens so that
    the expected tokens of the pair stay exactly what they were, until one of
    them is integral; the direction is random with the probabilities that keep
    every document's expectation.
    """

    EPS = 1e-12

    def __init__(self, seed: int):
        self.seed = seed
        self.held: dict[str, tuple[int, int, float]] = {}

    def add(self, source: str, i: int, w: int, p: float) -> Iterator[tuple[str, int, int]]:
        """Documents that became integral: (source, id, 0 or 1)."""
        if p <= self.EPS or p >= 1 - self.EPS:
            yield source, i, round(p)
            return
        if source not in self.held:
            self.held[source] = i, w, p
            return
        j, v, q = self.held.pop(source)
        a = min((1 - p) * w, q * v)  # tokens that can go from j to i
        b = min(p * w, (1 - q) * v)
        if _uniform(self.seed, i, j) < b / (a + b):
            p, q = p + a / w, q - a / v
        else:
            p, q = p - b / w, q + b / v
        done_i, done_j = (min(x, 1 - x) <= self.EPS for x in (p, q))
        if done_i:
            yield source, i, round(p)
        if done_j:
            yield source, j, round(q)
        if not done_i:
            self.held[source] = i, w, p
        elif not done_j:
            self.held[source] = j, v, q

    def residuals(self) -> list[tuple[str, int, int, float]]:
        return [(s, *x) for s, x in self.held.items()]


_STEP = "source string, id bigint, extra int, w bigint, p double"


def _rounded(rows: Iterator[tuple[str, int, int, float]], seed: int) -> pd.DataFrame:
    pivot = Pivot(seed)
    out = [(s, i, x, None, None) for r in rows for s, i, x in pivot.add(*r)]
    out += [(s, i, None, w, p) for s, i, w, p in pivot.residuals()]
    res = pd.DataFrame(out, columns=["source", "id", "extra", "w", "p"])
    return res.astype({"extra": "Int32", "w": "Int64", "p": "Float64", "id": "int64"})


def _combiner(seed: int):
    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        return _rounded(zip(pdf["source"], pdf["id"], pdf["w"], pdf["p"]), seed)

    return combine


def planned(sizes: DataFrame, targets: DataFrame, total: int | None) -> DataFrame:
    """Per target source: tokens and documents at hand, tokens wanted and the expected copies of each of its documents.

    Null shares and caps count as 0; sources without documents have 0 copies.
    """
    per = sizes.groupBy("source").agg(F.sum("tokens").alias("available"), F.count(F.lit(1)).alias("documents"))
    if total is None:
        total = sizes.agg(F.sum("tokens")).first()[0] or 0
    wanted = F.coalesce("target_share", F.lit(0.0)) * F.lit(float(total))
    cap = F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).cast("double")
    copies = F.when(F.col("available") > 0, F.least(wanted / F.col("available"), cap)).otherwise(0.0)
    return targets.join(per, "source", "left").select(
        "source",
        "target_share",
        "max_repeats",
        F.coalesce("available", F.lit(0)).cast("bigint").alias("available"),
        F.coalesce("documents", F.lit(0)).alias("documents"),
        wanted.alias("wanted"),
        copies.alias("copies"),
    )


def mixed(
    df: DataFrame,
    targets: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    total: int | None = None,
    seed: int = 5,
    vocabulary: str = VOCABULARY,
) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, tokens, copies) of every document, and the plan of the sources.

    Each source is to have its target_share of ``total`` tokens (default: the
    tokens of all documents). Its documents get the same expected number of
    copies, wanted tokens / available tokens, at most max_repeats; whole copies
    are given to each document and the fraction by pivotal rounding, so tokens
    reached differ from those wanted by less than one document a source. A
    source that its cap holds below its share falls short; its missing tokens
    are not given to others.

    Documents without source, or of sources without target, get 0 copies, as do
    those of null targets or caps. Texts without tokens get the whole copies
    only. Ids are taken as unique; target sources are.

    The documents of a source are rounded in bunches of about BUNCH by a hash of
    their ids, so the result doesn't follow the layout of files; the one
    fractional document that each bunch leaves goes through a tree of FAN_IN.
    """
    sizes = cut(token_counts(df.select(F.col(doc_id).alias("id"), F.col(source).alias("source"), text), ["id", "source"], text, vocabulary))
    plan = cut(planned(sizes, targets, total))
    whole = F.floor(F.col("copies") + 1e-9).cast("int")
    shares_of, _ = sized(
        plan.filter("source is not null").select("source", "documents", whole.alias("whole"), F.greatest(F.col("copies") - whole, F.lit(0.0)).alias("p"))
    )
    drawn = sizes.join(shares_of, "source").filter("tokens > 0 and p > 0 and id is not null")
    left = drawn.select("source", "id", F.col("tokens").alias("w"), "p", F.ceil(F.col("documents") / F.lit(BUNCH)).alias("bunches"))
    settled = None
    level = 0
    while True:
        bunch = F.pmod(F.xxhash64("id", F.lit(seed + level)), F.col("bunches")).alias("bunch")
        step = left.select("source", "id", "w", "p", bunch).groupBy("source", "bunch").applyInPandas(_combiner(seed + level), _STEP)
        step = cut(step)
        done = step.filter("extra is not null").select("source", "id", "extra")
        settled = done if settled is None else settled.union(done)
        rest = step.filter("extra is null").select("source", "id", "w", "p")
        counts, _ = sized(rest.groupBy("source").agg(F.count(F.lit(1)).alias("n")))
        most = counts.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            break
        level += 1
        left = rest.join(counts, "source").select("source", "id", "w", "p", F.ceil(F.col("n") / F.lit(FAN_IN)).alias("bunches"))
    # The last fraction of a source is drawn.
    draw = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    settled = settled.union(rest.select("source", "id", (draw < F.col("p")).cast("int").alias("extra")))
    chosen = settled.filter("extra = 1").select("id", "extra")
    copies = (F.coalesce("whole", F.lit(0)) + F.coalesce("extra", F.lit(0))).cast("int")
    out = sizes.join(shares_of.select("source", "whole"), "source", "left").join(chosen, "id", "left")
    return out.select(F.col("id").alias(doc_id), F.col("source").alias(source), "tokens", copies.alias("copies")), plan


def shares(result: DataFrame, plan: DataFrame, source: str = "source") -> DataFrame:
    """Per target source: wanted and reached tokens and shares, copies, and whether it falls short by more than a document."""
    got = result.groupBy(F.col(source).alias("source")).agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("chosen_tokens"),
        F.sum("copies").alias("chosen_copies"),
        F.max("copies").alias("most_repeats"),
        F.max("tokens").alias("_longest"),
    )
    got = cut(got)
    every = got.agg(F.sum("chosen_tokens")).first()[0] or 0
    chosen = F.coalesce("chosen_tokens", F.lit(0))
    return plan.join(got, "source", "left").select(
        "source",
        "target_share",
        "max_repeats",
        "documents",
        "available",
        "wanted",
        chosen.alias("chosen_tokens"),
        F.coalesce("chosen_copies", F.lit(0)).alias("chosen_copies"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        (chosen / F.lit(float(every))).alias("reached_share") if every else F.lit(None).cast("double").alias("reached_share"),
        (F.col("wanted") - chosen > F.coalesce("_longest", F.lit(0))).alias("falls_short"),
    )


def invariants(result: DataFrame, plan: DataFrame, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """Per target source its documents, and 1 where a rule is broken (0 throughout).

    Rules: no document beyond the cap, the copies of two documents differ by one
    at most, the tokens reached are within a document of what share and cap allow.
    """
    per = result.groupBy(F.col(source).alias("source")).agg(
        F.max("copies").alias("most"), F.min("copies").alias("least"), F.sum(F.col("tokens") * F.col("copies")).alias("chosen"), F.max("tokens").alias("longest")
    )
    j = plan.join(per, "source", "left").fillna(0, ["most", "least", "chosen", "longest"])
    cap = F.coalesce("max_repeats", F.lit(0))
    allowed = F.col("copies") * F.col("available")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return j.select(
        "source",
        "documents",
        flag(F.col("most") > cap).alias("beyond_cap"),
        flag(F.col("most") - F.col("least") > 1).alias("uneven"),
        flag(F.abs(F.col("chosen") - allowed) > F.col("longest")).alias("off_target"),
    )
