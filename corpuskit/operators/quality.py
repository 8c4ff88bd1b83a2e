"""Ordered quality filters: the first reason that holds is a row's verdict."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions import text as T

#: Terms of technical prose; marks of generated files; parts of rejected paths; signs of Python.
TECHNICAL_TERMS = (
    "api", "argument", "async", "class", "cli", "code", "config", "dataset", "debug", "dependency", "exception", "function", "install", "json",
    "module", "package", "parameter", "python", "return", "schema", "server", "test", "token", "training", "type", "validation", "yaml",
)
GENERATED_MARKERS = ("@generated", "auto-generated", "autogenerated", "automatically generated", "generated by", "do not edit")
GENERATED_NAMES = ("_pb2.py", "_pb2_grpc.py", ".lock", "package-lock.json")
REJECTED_PARTS = (
    ".git", "__pycache__", ".pytest_cache", ".ruff_cache", ".mypy_cache", ".tox", ".venv", "venv", "env", "node_modules", "vendor", "vendors",
    "dist", "build", "site-packages",
)
PYTHON_SIGNS = ("def ", "class ", "import ", "from ", "async def ", "if __name__", "try:", "for ", "while ", "return ", "print(")


def first_reason(*checks: tuple[str, Column], otherwise: str | None = None) -> Column:
    """The name of the first check that is true; null conditions count as false."""
    out = None
    for name, holds in checks:
        out = F.when(holds, name) if out is None else out.when(holds, name)
    return out.otherwise(F.lit(otherwise))


def holds_any(c: Column, needles: tuple[str, ...] | list[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(c, F.lit(n))
    return out


def lines(t: Column) -> Column:
    return F.split(t, "\n")


def is_minified(t: Column, empty: bool = False) -> Column:
    """A line of over 5,000 characters, or at most three lines of over 1,000 on average; ``empty`` says whether an empty text is."""
    sizes = F.transform(lines(F.regexp_replace(t, "\\n\\z", "")), F.length)
    total = F.aggregate(sizes, F.lit(0), lambda a, x: a + x)
    long = (F.array_max(sizes) > 5000) | ((F.size(sizes) <= 3) & (total / F.size(sizes) > 1000))
    return long | (t == "") if empty else long


def matched_share(t: Column, pattern: str) -> Column:
    """Share of characters within matches."""
    found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    return F.aggregate(found, F.lit(0), lambda a, x: a + F.length(x)) / F.greatest(F.lit(1), F.length(t))


#: What counts as base64, as a hex dump, as a mark of code and as a call.
BASE64 = r"\b[A-Za-z0-9+/]{80,}={0,2}\b"
HEX = r"\b(?:[0-9a-fA-F]{2}\s*){40,}\b"
CODE_MARK = r"(?m)`[^`]+`|```|::|^\s{4,}\S"
CALL = r"\b[a-zA-Z_][a-zA-Z0-9_]*\("

_BASE64, _HEX, _MARK, _CALL = (re.compile(p) for p in (BASE64, HEX, CODE_MARK, CALL))
_TERM = re.compile(rf"\b(?:{'|'.join(TECHNICAL_TERMS)})\b")


def base64_share(t: Column) -> Column:
    return matched_share(t, BASE64)


def hex_share(t: Column) -> Column:
    return matched_share(t, HEX)


def technical_score(t: Column) -> Column:
    """Distinct technical terms, and at most three each of code marks and calls."""
    low = F.lower(t)
    score = F.lit(0)
    for term in TECHNICAL_TERMS:
        score = score + low.rlike(rf"\b{term}\b").cast("int")
    return score + F.least(F.lit(3), F.regexp_count(t, F.lit(CODE_MARK))) + F.least(F.lit(3), F.regexp_count(t, F.lit(CALL)))


def text_entropy(text: str) -> float:
    """Shannon entropy of the characters in bits; 0 for an empty text."""
    if not text:
        return 0.0
    if text.isascii():
        counts = np.bincount(np.frombuffer(text.encode(), np.uint8))
    else:
        counts = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)[1]
    counts = counts[counts > 0].astype(np.float64)
    return float(np.log2(len(text)) - (counts * np.log2(counts)).sum() / len(text))


def text_repeated_share(text: str) -> float:
    """Share of the non-blank lines that occur more than three times."""
    lines = Counter(x for x in map(str.strip, text.split("\n")) if x)
    return sum(n for n in lines.values() if n > 3) / max(1, lines.total())


def _least_three(pattern: re.Pattern, text: str) -> int:
    return sum(1 for _, _ in zip(range(3), pattern.finditer(text)))


def text_measures(text: str) -> tuple[float, float, float, float, int]:
    """(entropy, base64, hex, repeated, score) of a text."""
    n = max(1, len(text))
    within = lambda p: sum(m.end() - m.start() for m in p.finditer(text)) / n
    score = len(set(_TERM.findall(text.lower()))) + _least_three(_MARK, text) + _least_three(_CALL, text)
    return text_entropy(text), within(_BASE64), within(_HEX), text_repeated_share(text), score


def measures(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, entropy, base64, hex, repeated, score) of each text that isn't null, in one pass without a shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [text_measures(t) for t in b["_text"]]
            out = pd.DataFrame(rows, columns=["entropy", "base64", "hex", "repeated", "score"])
            out.insert(0, id_col, b[id_col].to_numpy())
            yield out

    kept = df.select(id_col, F.col(text_col).alias("_text")).filter("_text is not null")
    kind = kept.schema[id_col].dataType.simpleString()
    return kept.mapInPandas(run, f"`{id_col}` {kind}, entropy double, base64 double, hex double, repeated double, score int")


def _of_text(df: DataFrame, id_col: str, text_col: str, name: str, fn) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({id_col: b[id_col], name: [fn(t) for t in b["_text"]]})

    kept = df.select(id_col, F.col(text_col).alias("_text")).filter("_text is not null")
    return kept.mapInPandas(run, f"`{id_col}` {kept.schema[id_col].dataType.simpleString()}, {name} double")


def entropy(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, entropy): Shannon entropy of the characters in bits; 0 for empty texts, no row for null ones."""
    return _of_text(df, id_col, text_col, "entropy", text_entropy)


def repeated_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, repeated_share): share of the non-blank lines that occur more than three times; no row for null texts."""
    return _of_text(df, id_col, text_col, "repeated_share", text_repeated_share)


def quality_sample(t: Column, most: int = 200_000) -> Column:
    """Texts of over ``most`` characters as their first and last halves of that size with a line feed between."""
    half = most // 2
    ends = F.concat(F.substring(t, 1, half), F.lit("\n"), F.right(t, F.lit(most - half)))
    return F.when(F.length(t) > most, ends).otherwise(t)


def quality_reason(metrics: dict[str, Column], content: Column, minimum_entropy=2.5, most=0.35, minimum_score=2) -> Column:
    return first_reason(
        ("low_entropy", metrics["entropy"] < minimum_entropy),
        ("base64_blob", metrics["base64"] > most),
        ("hex_dump", metrics["hex"] > most),
        ("repeated_sequences", metrics["repeated"] > most),
        ("low_technical_content", (content == "technical_text") & (metrics["score"] < minimum_score)),
        otherwise="accepted",
    )


def clean_reason(t: Column, path: Column, least=80, most=2_000_000) -> Column:
    """Verdict of the corpus cleaner on a normalized text; a null text is one that could not be decoded."""
    head = F.lower(F.array_join(F.slice(lines(t), 1, 10), "\n"))
    size = F.octet_length(t)
    return first_reason(
        ("too_short", size < least),
        ("too_large", size > most),
        ("generated_file", holds_any(F.lower(F.coalesce(path, F.lit(""))), GENERATED_NAMES)),
        ("invalid_utf8", t.isNull()),
        ("empty_file", F.trim(F.regexp_replace(t, "\\s+", "")) == ""),
        ("generated_file", holds_any(head, GENERATED_MARKERS)),
        ("minified_file", is_minified(t)),
        otherwise="accepted",
    )


def code_record_reason(t: Column, path: Column, license_id: Column, least=200, most=250_000, need_license=True) -> Column:
    """Verdict of the code-record filter on a normalized text; ``license_id`` is the normalized license."""
    p = F.coalesce(F.regexp_replace(path, r"\\", "/"), F.lit(""))
    low = F.lower(p)
    first = F.lower(F.element_at(lines(t), 1))
    python = (T.suffix(path) == ".py") & path.isNotNull() | (F.startswith(first, F.lit("#!")) & F.contains(first, F.lit("python")))
    bad = F.arrays_overlap(F.split(low, "/"), F.array(*[F.lit(x) for x in REJECTED_PARTS])) | holds_any(low, ["generated", "minified", ".min.py", "bundle.py"])
    head = F.lower(F.substring(t, 1, 2000))
    return first_reason(
        ("missing_content", t.isNull()),
        ("empty_content", F.regexp_replace(t, "\\s+", "") == ""),
        ("too_small", F.octet_length(t) < least),
        ("too_large", F.octet_length(t) > most),
        ("not_python", ~F.coalesce(python, F.lit(False))),
        ("rejected_path", bad),
        ("autogenerated", holds_any(head, GENERATED_MARKERS[1:])),
        ("binary_like", F.contains(t, F.lit("�"))),
        ("minified", is_minified(t, empty=True)),
        ("low_python_signal", ~holds_any(t, PYTHON_SIGNS)),
        ("unknown_license", license_id.isNull() & F.lit(need_license)),
        otherwise="accepted",
    )


def filtered_code_records(df: DataFrame, validation_percent: float = 2) -> DataFrame:
    """All records with reason, and license, content_hash, byte_count and split of the normalized text."""
    t = T.normalize_source(F.col("text"))
    h = F.sha2(t, 256)
    lic = T.normalize_license(F.col("license"))
    return df.select(
        "record_id",
        code_record_reason(t, F.col("path"), lic).alias("reason"),
        lic.alias("license"),
        h.alias("content_hash"),
        F.octet_length(t).cast("bigint").alias("byte_count"),
        T.hash_split(h, validation_percent).alias("split"),
    )


_CONTROL = re.compile("[\x00-\x08\x0b-\x1f]")
_COMMENT = re.compile("#[^\n]*")


def normalized(text: str) -> str:
    """``functions.text.normalize_source`` of one text."""
    text = text.replace("\r\n", "\n").replace("\r", "\n").rstrip("\x00")
    return _CONTROL.sub("", text)


def text_clean_reason(text: str, size: int, path: str, least=80, most=2_000_000) -> str:
    """``clean_reason`` of one normalized text."""
    if size < least:
        return "too_short"
    if size > most:
        return "too_large"
    if any(x in path.lower() for x in GENERATED_NAMES):
        return "generated_file"
    if not text.strip():
        return "empty_file"
    head = "\n".join(text.split("\n", 10)[:10]).lower()
    if any(x in head for x in GENERATED_MARKERS):
        return "generated_file"
    sizes = [len(x) for x in text.removesuffix("\n").split("\n")]
    if max(sizes) > 5000 or (len(sizes) <= 3 and sum(sizes) / len(sizes) > 1000):
        return "minified_file"
    return "accepted"


def clean_profiles(df: DataFrame, id_col: str, path_col: str, text_col: str, tokens=None) -> DataFrame:
    """(id, clean, exact, loose, n_tokens) of every record in one pass over the texts, however many steps use them.

    ``clean`` is the cleaner's verdict on the normalized text (invalid_utf8 for
    a null one), ``exact`` and ``loose`` its SHA-256 as it is and without
    comments, letter case and blanks, ``n_tokens`` its bytes or what ``tokens``
    (a function of the text) counts.
    """

    def digest(t: str) -> str:
        return hashlib.sha256(t.encode(errors="replace")).hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, path, text in zip(b["_id"], b["_path"], b["_text"]):
                if text is None:
                    named = any(x in (path or "").lower() for x in GENERATED_NAMES)
                    rows.append((i, "generated_file" if named else "invalid_utf8", None, None, None))
                    continue
                t = normalized(text)
                size = len(t.encode(errors="replace"))
                loose = " ".join(_COMMENT.sub("", t).lower().split())
                rows.append((i, text_clean_reason(t, size, path or ""), digest(t), digest(loose), size if tokens is None else tokens(t)))
            yield pd.DataFrame(rows, columns=[id_col, "clean", "exact", "loose", "n_tokens"]).astype({"n_tokens": "Int64"})

    kept = df.select(F.col(id_col).alias("_id"), F.col(path_col).alias("_path"), F.col(text_col).alias("_text"))
    kind = kept.schema["_id"].dataType.simpleString()
    return kept.mapInPandas(run, f"`{id_col}` {kind}, clean string, exact string, loose string, n_tokens bigint")
