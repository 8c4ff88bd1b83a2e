"""Cleaners of texts line by line, and by kind of file."""

from __future__ import annotations

import ast
import io
import re
import tokenize
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.operators.htmltext import clean_documentation, joined
from corpuskit.operators.pysource import BAD
from corpuskit.operators.quality import normalized


def clean_line(line: str, form: str | None = "NFC", lower: bool = False, least: int = 1, most: int | None = None) -> tuple[str, str | None]:
    """(line, why it is skipped): Unicode form, control characters out, blanks collapsed; empty, too_short or too_long if skipped."""
    line = line.rstrip("\r\n")
    if form:
        line = unicodedata.normalize(form, line)
    line = "".join(c for c in line if c in "\n\t" or unicodedata.category(c)[0] != "C")
    line = " ".join((line.lower() if lower else line).split())
    why = "empty" if not line else "too_short" if len(line) < least else "too_long" if most is not None and len(line) > most else None
    return line, why


def cleaned_lines(df: DataFrame, keep: list[str], text: str = "text", form: str | None = "NFC", lower: bool = False, least: int = 1, most: int | None = None) -> DataFrame:
    """``keep``, ``position``, ``line`` and ``skipped`` (why, or null) of every line of each text; null texts give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [[clean_line(x, form, lower, least, most) for x in t.split("\n")] for t in b["_text"]]
            at = [k for k, rows in enumerate(found) for _ in rows]
            out = b[keep].iloc[at].reset_index(drop=True)
            out["position"] = [n for rows in found for n in range(len(rows))]
            out["line"] = [x for rows in found for x, _ in rows]
            out["skipped"] = [why for rows in found for _, why in rows]
            yield out

    kept = df.select(*keep, F.col(text).alias("_text")).filter("_text is not null")
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != "_text")
    return kept.mapInPandas(run, f"{head}, position int, line string, skipped string")


def without_comments(source: str) -> str:
    """Python without comments, everything else where it stands; unchanged where it can't be tokenized."""
    try:
        spots = [t for t in tokenize.generate_tokens(io.StringIO(source).readline) if t.type == tokenize.COMMENT]
    except (tokenize.TokenError, *BAD):
        return source
    lines = source.split("\n")
    for t in reversed(spots):
        row, column = t.start
        lines[row - 1] = lines[row - 1][:column].rstrip() + lines[row - 1][t.end[1] :]
    return "\n".join(lines)


def builder_text(text: str, comments: bool = True) -> str:
    """``functions.text.builder_text`` of one text; without comments if asked for Python."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if not comments:
        text = without_comments(text)
    return "\n".join(x.rstrip() for x in text.split("\n")).strip() + "\n"


def corpus_text(text: str) -> str:
    """LF line ends and no control characters, tabs as blanks to the next fourth column, no blanks at line ends, at most three line feeds in a row, one at the end.

    Lines end at every line boundary of Unicode here, so form feeds, line
    separators and the like become line feeds.
    """
    lines = [x.rstrip() for x in normalized(text).expandtabs(4).splitlines()]
    return re.sub(r"\n{4,}", "\n\n\n", "\n".join(lines)).strip() + "\n"


def corpus_texts(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: None if x is None else corpus_text(x))

    return run(text)


def final_text(text: str, suffix: str) -> str:
    """NFC, then Python as the builder has it, documentation cleaned, and anything else without blanks at line ends."""
    text = unicodedata.normalize("NFC", text)
    if suffix == ".py":
        return builder_text(text)
    if suffix in (".md", ".rst", ".txt", ".html", ".htm"):
        return clean_documentation(text, suffix.startswith(".htm"))
    return joined(text.replace("\r\n", "\n").replace("\r", "\n").split("\n"))


def final_texts(text: Column, suffix: Column) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for t, s in batches:
            yield pd.Series([None if x is None else final_text(x, k or "") for x, k in zip(t, s)])

    return run(text, suffix)


_FENCE = re.compile(r"```([^\n`]*)\n(.*?)```", re.S)
_CODE_LINE = re.compile(r"^(?:import |from |def |class |async def |@)")


def python_in_answer(answer: str) -> str:
    """Python of an answer: the first full fenced block tagged python, py or nothing; else the answer if it parses, else from its first line of code on."""
    for tag, body in _FENCE.findall(answer):
        if tag.strip().lower() in ("", "py", "python") and body.strip():
            return body.strip()
    if answer.strip():
        try:
            ast.parse(answer)
            return answer.strip()
        except BAD:
            pass
    rows = answer.split("\n")
    first = next((k for k, x in enumerate(rows) if _CODE_LINE.match(x)), None)
    return "" if first is None else "\n".join(rows[first:]).strip()


def character_mix(source: str) -> tuple[int, int]:
    """(characters of comments and docstrings, of code) of a Python text, blanks left out; a text that doesn't parse is all code."""
    solid = lambda x: len("".join(x.split()))
    try:
        said = sum(solid(t.string) for t in tokenize.generate_tokens(io.StringIO(source).readline) if t.type == tokenize.COMMENT)
        for n in ast.walk(ast.parse(source)):
            if isinstance(n, (ast.Module, ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                said += solid(ast.get_docstring(n, clean=False) or "")
    except (tokenize.TokenError, *BAD):
        said = 0
    return said, max(0, solid(source) - said)


def character_mixes(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, ``said`` and ``code`` characters of each Python text; null texts give none."""
    from corpuskit.operators.pysource import map_texts

    return map_texts(df, keep, text, lambda t: [character_mix(t)], ["said", "code"], "said bigint, code bigint")
