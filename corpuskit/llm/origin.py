"""Generated, minified, vendored and data files told from hand-written source."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.llm import crosssplit
from corpuskit.llm.licenses import repository_key
from corpuskit.llm.syntax import language_column
from corpuskit.runtime import cut, sized

#: Directories that hold third-party or installed code, and those that only tool output has.
VENDOR_DIRS = (
    "vendor", "_vendor", "vendored", "third_party", "thirdparty", "third-party", "3rdparty", "extern", "external", "externals", "deps",
    "node_modules", "bower_components", "jspm_packages", "site-packages", "dist-packages", "pods",
)
OUTPUT_DIRS = ("gen", "_gen", "generated", "_generated", "__generated__", "autogen", "autogenerated", "auto_generated", "generated-sources", "dist", "build", "__pycache__")
#: Endings of names that only tool output has.
OUTPUT_NAMES = r"(_pb2?|_pb2_grpc|_grpc_pb)\.(py|js|mjs)$|(\.(min|bundle|generated|g|chunk)|-min)\.(js|mjs|py|json)$|^(package-lock\.json|npm-shrinkwrap\.json)$"
#: Near-sameness of two records of this table, as its description has it for pairs of records.
COPY_K, COPY_SIMILARITY = 3, 0.7
#: At most about so many labelled rows fit the forest.
FIT_ROWS = 20_000
TREES, TREE_DEPTH, SEED = 32, 8, 11
#: Classes of the forest, by header notices that its features don't see.
HAND, TOOL, BUNDLE = 0, 1, 2
#: Probability of the class BUNDLE from which a file counts as minified; chosen on held-out labels (see ``held_out``).
MINIFIED = 0.25
#: Share of literals, docstrings apart, from which a file is data.
DATA = 0.87

_NOTICE = re.compile(
    r"""(?ix)
    ^\W*(?:(?:this|the\ following)\s+(?:file|code|module|script|source)\s+(?:was|is|has\s+been)\s+)?
    (?:@generated|auto(?:matically)?[-\s]*(?:generated|created|written|produced|built)|generated\s+(?:by|from|with|using|on|code|file|automatically)
      |machine[-\s](?:written|generated|made)|(?:created|written|produced)\s+automatically|code\s+(?:produced|generated|emitted|written)\s+by
      |(?:produced|emitted|built|compiled|bundled|minified)\s+(?:by|with|from)|output\s+of|automatisch\s+(?:erzeugt|generiert|erstellt)
      |(?:archivo|código)?\s*generad[oa]\s|(?:fichier|code)?\s*généré\s)
  | @generated\b
    """
)
_BANNER = re.compile(r"^\s*/\*!\s*\S+\s+v?\d+\.\d")
_LEAD = re.compile(r"[ \t]*(?:#[^\n\r]*|//[^\n\r]*|/\*[\s\S]*?\*/|[rRuU]?\"\"\"[\s\S]*?\"\"\"|[rRuU]?'''[\s\S]*?'''|(?:\"[^\"\n\r]*\"|'[^'\n\r]*')(?=[ \t]*[\r\n])|)[ \t]*(?:\r\n|[\n\r]|\Z)")


def leading_comments(text: str) -> tuple[list[str], str]:
    """Comments and docstring before the first code, and the rest of the text."""
    out, at = [], 1 if text.startswith("﻿") else 0
    while at < len(text):
        m = _LEAD.match(text, at)
        if not m or m.end() == at:
            break
        out.append(m[0].strip())
        at = m.end()
    return [x for x in out if x], text[at:]


def says_tool(comments: list[str]) -> bool:
    """Whether a leading comment states that a tool wrote the file; a mention within a sentence is none."""
    for c in comments:
        body = re.sub(r"^[\s#/*!\"'rRuU-]*", "", c)
        if any(_NOTICE.match(p.strip(" *#/!\"'\t")) for p in re.split(r"\n|(?<=[.!])\s+(?=[A-Z@])", body)):
            return True
    return False


FEATURES = (
    "compression", "token_entropy", "identifier_length", "short_identifiers", "comment_density", "line_length", "longest_line",
    "blank_share", "digit_share", "literal_share", "tokens_per_line", "repetition",
)
_IDENT = re.compile(r"[A-Za-z_$][\w$]*")
_COMMENT = re.compile(r"(?m)^[ \t]*(?:#|//|\*|/\*)[^\n]*")
_TRIPLE = re.compile(r"\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''")
_LITERAL = re.compile(
    r'"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\'|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`(?:[^`\\]|\\[\s\S])*`|(?<![\w$])-?\d[\d._eExXa-fA-F+]*'
)
_NEUTRAL = str.maketrans("", "", " \t\n\r\f\v,[](){}:;=\"'`+-")


def _without_docstrings(body: str) -> str:
    """The text without the triple-quoted strings that stand alone on their lines."""
    out, at = [], 0
    for m in _TRIPLE.finditer(body):
        if not body[body.rfind("\n", 0, m.start()) + 1 : m.start()].strip(" \trRuU"):
            out.append(body[at : m.start()])
            at = m.end()
    return "".join([*out, body[at:]]) if out else body


def features(body: str) -> list[float]:
    """The statistics of a text without its leading comments; zeros for an empty one.

    ``literal_share`` leaves out docstrings, separators and brackets.
    """
    n = len(body)
    if not n:
        return [0.0] * len(FEATURES)
    raw = body.encode(errors="replace")
    names = _IDENT.findall(body)
    counts = Counter(names)
    total = len(names) or 1
    lines = body.split("\n")
    code = _without_docstrings(body)
    bare = _LITERAL.sub("", code)
    literal = len(code) - len(bare)
    return [
        len(zlib.compress(raw, 1)) / len(raw),
        -sum(c / total * math.log2(c / total) for c in counts.values()),
        sum(map(len, names)) / total,
        sum(c for w, c in counts.items() if len(w) < 3) / total,
        sum(map(len, _COMMENT.findall(body))) / n,
        n / len(lines),
        math.log1p(max(map(len, lines))),
        (body.count(" ") + body.count("\n") + body.count("\t")) / n,
        (len(raw) - len(raw.translate(None, b"0123456789"))) / n,
        literal / max(1, literal + len(bare.translate(_NEUTRAL))),
        total / len(lines),
        len(counts) / total,
    ]


def described(df: DataFrame) -> DataFrame:
    """(record_id, by_path, notice, label, f array<double>) of each record with text; f is null where the language is neither Python nor JavaScript.

    ``label`` is the class that the leading comments tell: TOOL for a notice,
    BUNDLE for a bundler's banner, HAND for any other; null without comments.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, text, lang, by_path in zip(b["record_id"], b["_text"], b["_lang"], b["by_path"]):
                comments, body = leading_comments(text)
                notice = says_tool(comments)
                source = lang in ("python", "javascript")
                label = None if not source or not comments else BUNDLE if _BANNER.match(text) else TOOL if notice else HAND
                rows.append((i, by_path, notice, label, features(body) if source else None))
            out = pd.DataFrame(rows, columns=["record_id", "by_path", "notice", "label", "f"])
            yield out.astype({"label": "Int32"})

    return (
        df.filter("record_id is not null and text is not null")
        .select("record_id", F.col("text").alias("_text"), language_column(F.col("path"), F.col("text")).alias("_lang"), _by_path(F.col("path")).alias("by_path"))
        .mapInPandas(run, "record_id bigint, by_path string, notice boolean, label int, f array<double>")
    )


def _assembled(df: DataFrame) -> DataFrame:
    cols = [F.col("f")[j].alias(name) for j, name in enumerate(FEATURES)]
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(df.select("*", *cols)).drop(*FEATURES)


def fit_forest(table: DataFrame, most: int = FIT_ROWS) -> RandomForestClassificationModel | None:
    """A random forest on at most about ``most`` source files, labelled by header notices that the features don't see.

    Files whose leading comments state a tool, those with a bundler's banner and
    those with other leading comments are the classes; files without any have no
    label and take no part. Classes are weighted to balance. None if only one
    class occurs.
    """
    rows = table.filter("f is not null and label is not null")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # three classes
    if len(counts) < 2:
        return None
    total = sum(counts.values())
    if total > most:
        rows = rows.filter(F.pmod(F.xxhash64("record_id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * most / total)))
    weight = F.lit(1.0)
    for label, n in counts.items():
        weight = F.when(F.col("label") == label, total / (len(counts) * n)).otherwise(weight)
    sample = cut(_assembled(rows.select("f", F.col("label").cast("double").alias("label"), weight.alias("weight"))))
    if sample.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=TREE_DEPTH, seed=SEED, weightCol="weight", subsamplingRate=0.8)
    return forest.fit(sample)


def with_probabilities(table: DataFrame, forest: RandomForestClassificationModel | None) -> DataFrame:
    """``p_tool`` and ``p_bundle`` of each file with features; null for others and without a forest."""
    if forest is None:
        return table.withColumns({"p_tool": F.lit(None).cast("double"), "p_bundle": F.lit(None).cast("double")})
    scored = forest.transform(_assembled(table.filter("f is not null"))).withColumn("_p", vector_to_array("probability"))
    scored = scored.select(*table.columns, F.try_element_at("_p", F.lit(TOOL + 1)).alias("p_tool"), F.try_element_at("_p", F.lit(BUNDLE + 1)).alias("p_bundle"))
    rest = table.filter("f is null").withColumns({"p_tool": F.lit(None).cast("double"), "p_bundle": F.lit(None).cast("double")})
    return scored.union(rest)


def held_out(df: DataFrame) -> DataFrame:
    """(label, decided, files): classes that a forest fit on half of the labelled files gives to the other half.

    The headers that gave the labels are no part of what the forest sees, so
    this is its recall on files whose notice is stripped. ``decided`` is BUNDLE
    from MINIFIED on, else TOOL from 0.5 on, else HAND.
    """
    table = cut(described(df).filter("label is not null"))
    half = F.pmod(F.xxhash64("record_id", F.lit(SEED)), F.lit(2)) == 0
    scored = with_probabilities(table.filter(~half), fit_forest(table.filter(half)))
    decided = F.when(F.col("p_bundle") >= MINIFIED, BUNDLE).when(F.col("p_tool") >= 0.5, TOOL).otherwise(HAND)
    return scored.groupBy("label", decided.alias("decided")).agg(F.count(F.lit(1)).alias("files"))


def _path(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"\\", "/"))


def _in_dirs(path: Column, dirs: tuple[str, ...]) -> Column:
    names = "|".join(re.escape(d) for d in dirs)
    return F.coalesce(_path(path).rlike(rf"(^|/)({names})/"), F.lit(False))


def _by_path(path: Column) -> Column:
    """output_path or third_party, where the path tells; else null."""
    output = _in_dirs(path, OUTPUT_DIRS) | F.coalesce(F.regexp_extract(_path(path), r"([^/]*)$", 1).rlike(OUTPUT_NAMES), F.lit(False))
    return F.when(output, "output_path").when(_in_dirs(path, VENDOR_DIRS), "third_party")


def copies(df: DataFrame) -> DataFrame:
    """record_ids in a directory named after the project of another repository that holds the same or nearly the same file.

    Names are settled on paths alone; then texts of the records that claim a
    project, and of the projects they name, are read once and set aside.
    """
    project = F.regexp_extract(repository_key(F.col("repo_name")), r"([^/]+)$", 1)
    directory = F.split(F.regexp_extract(_path(F.col("path")), r"^(.*)/[^/]*$", 1), "/")
    named = F.array_distinct(F.transform(directory, lambda d: F.regexp_replace(d, r"[-_@]v?\d+(\.\d+)*$", "")))
    known = df.filter("record_id is not null")
    base = cut(known.select("record_id", project.alias("project"), named.alias("parts")))
    # A part other than the record's own project can only name another repository; one row per name keeps the join from growing.
    parts = base.select("record_id", "project", F.explode("parts").alias("part")).filter("part <> '' and not (part <=> project)")
    projects = base.filter("project <> ''").select(F.col("project").alias("part")).distinct()
    claims, n = sized(parts.select("record_id", "part").join(projects, "part").dropDuplicates(["record_id", "part"]))
    if not n:
        return claims.select("record_id")
    claimed = claims.select(F.col("part").alias("project")).distinct().withColumn("_named", F.lit(True))
    claimants = claims.select("record_id").distinct().withColumn("_claims", F.lit(True))
    marks, _ = sized(
        base.select("record_id", "project")
        .join(claimants, "record_id", "left")
        .join(claimed, "project", "left")
        .filter("_named or _claims")
        .select("record_id", "project", F.coalesce("_named", F.lit(False)).alias("_named"), F.coalesce("_claims", F.lit(False)).alias("_claims"))
        .distinct()
    )
    kept = cut(known.filter("text is not null").select("record_id", "text").join(marks.drop("project"), "record_id"))
    links, members = crosssplit.banded_pairs(kept, "record_id", "text", F.col("_named"), F.col("_claims"), COPY_K, COPY_SIMILARITY)
    pairs = cut(crosssplit.expand_across(links, members))
    both = pairs.select(F.col("record_id_a").alias("record_id"), F.col("record_id_b").alias("twin")).union(
        pairs.select("record_id_b", "record_id_a")
    )
    held = both.join(claims, "record_id").select("record_id", "twin", F.col("part").alias("project")).distinct()
    origin = marks.select(F.col("record_id").alias("twin"), "project")
    return held.join(origin, ["twin", "project"]).select("record_id").distinct()


def origins(df: DataFrame) -> DataFrame:
    """(record_id, reason, p_tool, p_bundle, literal_share) of each record with text that is no license file; reason is null for hand-written source.

    Reasons, the first that holds: notice (the file says that a tool wrote it),
    output_path, third_party, data (DATA or more of the text stands in literals),
    minified (the forest's class of bundled files has MINIFIED or more), copy.
    Null paths and repositories give no evidence of their own. Where the labels
    are of one class only there is no forest, and no file is called minified.
    """
    path = F.col("path")
    licence = F.coalesce(_path(path).rlike(r"(^|/)(licen[sc]e|copying)[^/]*$"), F.lit(False))
    df = df.filter(~licence).select("record_id", "text", "path", "repo_name")
    table = cut(described(df))
    scored = with_probabilities(table, fit_forest(table))
    copied, _ = sized(copies(df).withColumn("copied", F.lit(True)))
    share = F.col("f")[FEATURES.index("literal_share")]
    reason = (
        F.when(F.col("notice"), "notice")
        .when(F.col("by_path").isNotNull(), F.col("by_path"))
        .when(share >= DATA, "data")
        .when(F.col("p_bundle") >= MINIFIED, "minified")
        .when(F.col("copied"), "copy")
    )
    return scored.join(copied, "record_id", "left").select("record_id", reason.alias("reason"), "p_tool", "p_bundle", share.alias("literal_share"))
