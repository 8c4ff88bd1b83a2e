"""Source files that do not parse, by language-specific lexers with a pushdown stack."""

from __future__ import annotations

import gc
import json
import tomllib
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.jsparse import SyntaxFault, parse
from corpuskit.llm.lexers import json_grammar, lexical_fault

LANGUAGES = ("python", "javascript", "json", "toml")
_EXTENSIONS = {".py": "python", ".js": "javascript", ".mjs": "javascript", ".json": "json", ".toml": "toml"}


def language(path: str | None, text: str | None) -> str | None:
    """The language that a path names; files without extension count by their #! line."""
    if path is None:
        return None
    name = path.replace("\\", "/").rsplit("/", 1)[-1]
    dot = name.rfind(".")
    if dot < 0:
        return "python" if text and text.startswith("#!") else None
    return _EXTENSIONS.get(name[dot:].lower())


def language_column(path: Column, text: Column) -> Column:
    """``language`` as a column expression."""
    name = F.regexp_extract(F.regexp_replace(path, r"\\", "/"), r"([^/]*)\z", 1)
    by_ext = F.lower(F.regexp_extract(name, r"(\.[^.]*)\z", 1))
    known = F.create_map(*[F.lit(x) for kv in _EXTENSIONS.items() for x in kv])
    return F.when(path.isNull(), None).when(
        ~name.contains("."), F.when(F.substring(text, 1, 2) == "#!", "python")
    ).otherwise(F.try_element_at(known, by_ext))


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _parser_refuses(text: str, lang: str) -> bool:
    """The language's own parser, asked about texts that the lexer and its stack have passed."""
    try:
        if lang == "python":
            compile(text.removeprefix("\ufeff"), "record", "exec", 0, True)
        elif lang == "json":
            json.loads(text, parse_constant=_no_constant)
        else:
            tomllib.loads(text.removeprefix("\ufeff"))
    except (RecursionError, MemoryError):
        # Deeper than the parser can follow: JSON is told by a pushdown automaton, the others by their lexer, which has passed them.
        return lang == "json" and not json_grammar(text)
    except (SyntaxError, ValueError, OverflowError):
        return True
    return False


def fault(text: str | None, lang: str | None) -> str | None:
    """Why a text is not valid in its language; null if it is, or if there is no text or language.

    The lexer of the language with its stack of open delimiters comes first and
    settles literals, delimiters, premature ends and merge markers; texts that
    pass are put to the grammar: that of Python 3.13, JSON and TOML by their
    parsers ("grammar"), JavaScript's by our own ("unexpected token" and the
    like). Depth is no limit. Empty texts are valid, but for JSON, which needs
    a value.
    """
    if text is None or lang not in LANGUAGES:
        return None
    if lang == "javascript":
        try:
            parse(text)
        except SyntaxFault as e:
            return e.reason
        return None
    return lexical_fault(text, lang) or ("grammar" if _parser_refuses(text, lang) else None)


def with_faults(df: DataFrame, keep: list[str], path: str = "path", text: str = "text") -> DataFrame:
    """``keep`` columns of each record that has a language, with ``language`` and ``fault`` (null if valid).

    Rows without path, text or known language are left out. Any number of rows
    may be alike; an empty table gives an empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        warnings.simplefilter("ignore")
        for b in batches:
            gc.disable()  # syntax trees are many small objects without cycles
            try:
                faults = [fault(t, lang) for t, lang in zip(b["_text"], b["language"])]
            finally:
                gc.enable()
            yield b.drop(columns="_text").assign(fault=faults)

    kept = df.select(
        *[F.col(c) for c in keep], language_column(F.col(path), F.col(text)).alias("language"), F.col(text).alias("_text")
    ).filter("language is not null and _text is not null")
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != "_text")
    return kept.mapInPandas(run, out + ", fault string")


def rates(checked: DataFrame, by: list[str]) -> DataFrame:
    """Files, invalid files and their share, per ``by`` columns."""
    bad = F.count("fault")
    files = F.count(F.lit(1))
    return checked.groupBy(*by).agg(files.alias("files"), bad.alias("invalid"), (bad / files).alias("rate"))
