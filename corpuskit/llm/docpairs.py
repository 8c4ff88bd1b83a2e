"""Functions paired with their documentation."""

from __future__ import annotations

import ast
import gc
import re
import warnings
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.jsparse import SyntaxFault, parse
from corpuskit.llm.lexers import scan_python
from corpuskit.llm.syntax import language_column

_WORDS = re.compile(r"[^\W\d_]+")
_NAME_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+")
_TAGS = re.compile(r"(?:@param(?:\s+\{[^}]*\})?\s+\[?|:param\s+(?:\w+\s+)?)(\w+)")
_IDENTIFIER = re.compile(r"[^\W\d]\w*(?=\()|\w*[^\W_]_\w+|[a-z]+[A-Z]\w*")  # names that can't be taken for plain words
_LINE = re.compile(r"\r\n|\n|\r")
#: Openings of placeholders (in any letter case), and words that say nothing about a function.
PLACEHOLDERS = ("TODO", "FIXME", "TBD", "XXX")
EMPTY_WORDS = frozenset("the a an of and to for this function method that it".split())
_PLACEHOLDER = re.compile(rf"(?i)(?:{'|'.join(PLACEHOLDERS)})(?![a-z])")
#: Lines between a comment and a function beyond which they are no candidates.
REACH = 3
#: Weights of a link: by the lines between, for parameter tags that fit and that don't, for words of the name and for the name itself.
NEAR, TAGS, STRANGE_TAGS, NAME_WORDS, NAME = (4.0, 1.2, 0.8, 0.5), 4.0, 3.0, 1.0, 2.0
#: Links below this weight are implausible.
LEAST = 2.5


class Function(NamedTuple):
    symbol: str
    name: str
    first: int  # first line (0-based) with decorators
    last: int
    params: tuple[str, ...]
    docstring: str | None


class Comment(NamedTuple):
    text: str
    end: int  # its last line


def trivial(description: str, name: str) -> bool:
    """Fewer than four words, a placeholder, or only the function's own name and empty words."""
    text = description.strip()
    words = _WORDS.findall(text)
    if len(words) < 4 or _PLACEHOLDER.match(text):
        return True
    own = {w.lower() for w in _NAME_WORDS.findall(name)} | {name.lower()} | EMPTY_WORDS
    return all(w.lower() in own for w in words)


_RISKY = re.compile(r"\b(?:nonlocal|global|__debug__|__future__)\b|\bimport[ \t]*\*|\byield\b|\bawait\b")


_DEFINES = re.compile(r"(?:async\s+)?(def|class)\s+([^\W\d]\w*)")


def _python_by_lines(text: str) -> list[Function]:
    """Functions of a text whose trees are too deep to be built, by its logical lines; SyntaxError where the lexer finds a fault."""
    fault, spans = scan_python(text)
    if fault:
        raise SyntaxError(fault)
    code = list(text)
    for a, b in spans:
        comment = text[a] == "#"
        for at in range(a, b):
            code[at] = " " if comment else "s"
    code, logical, depth, first, at = "".join(code), [], 0, 0, 0
    for m in re.finditer(r"[(\[{]|[)\]}]|(?<!\\)(?:\r\n|\n|\r)|\Z", code):
        if m[0] and m[0] in "([{":
            depth += 1
        elif m[0] and m[0] in ")]}":
            depth -= 1
        elif not depth or not m[0]:
            if code[at : m.start()].strip():
                logical.append((at, m.start()))
            at = m.end()
    starts = [0, *(m.end() for m in _LINE.finditer(text))]
    found: list[Function] = []
    scopes: list[tuple[int, str, int | None]] = []  # indentation, name, place among the functions
    decorated = None
    for k, (a, b) in enumerate(logical):
        line = code[a:b]
        bare = line.lstrip(" \t\f\\\r\n")
        indent = len(line.expandtabs(8)) - len(bare.expandtabs(8))
        first, last = bisect_right(starts, a + len(line) - len(bare)) - 1, bisect_right(starts, b) - 1
        while scopes and scopes[-1][0] >= indent:
            scopes.pop()
        for _, _, place in scopes:
            if place is not None:
                found[place] = found[place]._replace(last=last)
        m = _DEFINES.match(bare)
        if not m:
            decorated = (first if decorated is None else decorated) if bare.startswith("@") else None
            continue
        name, place = m[2], None
        if m[1] == "def":
            head = text[a + len(line) - len(bare) : b]
            colon = max(_header_end(code[a + len(line) - len(bare) : b]), 0)
            rest = head[colon + 1 :].strip()
            arguments = ast.parse(f"{head[: colon + 1]} pass").body[0].args
            params = tuple(x.arg for x in (*arguments.posonlyargs, *arguments.args, *arguments.kwonlyargs, arguments.vararg, arguments.kwarg) if x)
            doc = rest if rest and not rest.startswith("#") else text[slice(*logical[k + 1])].strip() if k + 1 < len(logical) else ""
            try:
                value = ast.literal_eval(doc) if doc[:1] in "\"'rRuU" else None
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                value = None
            place = len(found)
            symbol = ".".join([*(n for _, n, _ in scopes), name])
            found.append(Function(symbol, name, first if decorated is None else decorated, last, params, value if isinstance(value, str) else None))
        scopes.append((indent, name, place))
        decorated = None
    return sorted(found, key=lambda f: (f.first, f.symbol))


def _header_end(head: str) -> int:
    """Place of the colon that ends the header of a definition, strings and comments being masked."""
    depth = 0
    for at, c in enumerate(head):
        depth += (c in "([{") - (c in ")]}")
        if c == ":" and not depth:
            return at
    return -1


def _python(text: str) -> tuple[list[Function], list[str]]:
    """Functions and lines; SyntaxError also for what only the compiler refuses.

    The compiler itself is asked where a statement could break its rules
    (return outside a function, break outside a loop, repeated parameters, ...).
    """
    text = text.removeprefix("﻿")
    try:
        tree = ast.parse(text)
    except (RecursionError, MemoryError):
        return _python_by_lines(text), _LINE.split(text.replace("\f", " "))
    found: list[Function] = []
    risky = False
    words = _RISKY.findall(text)
    outside = bool(words)
    stack: list[tuple[ast.AST, str, bool, bool]] = [(tree, "", False, False)]
    while stack:
        node, scope, within, loop = stack.pop()
        # Definitions stand in statement lists only, so expressions need no visit.
        for name in ("body", "orelse", "finalbody", "handlers", "cases"):
            for child in getattr(node, name, None) or ():
                if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    a = child.args
                    params = tuple(x.arg for x in (*a.posonlyargs, *a.args, *a.kwonlyargs, a.vararg, a.kwarg) if x)
                    risky |= len(set(params)) < len(params)
                    first = min([child.lineno, *(d.lineno for d in child.decorator_list)]) - 1
                    doc = ast.get_docstring(child, clean=False)
                    found.append(Function(f"{scope}{child.name}", child.name, first, child.end_lineno - 1, params, doc))
                    stack.append((child, f"{scope}{child.name}.", True, False))
                elif isinstance(child, ast.ClassDef):
                    stack.append((child, f"{scope}{child.name}.", False, False))
                elif hasattr(child, "body") or hasattr(child, "cases"):
                    stack.append((child, scope, within, loop or isinstance(child, (ast.For, ast.While, ast.AsyncFor))))
                elif isinstance(child, ast.Return):
                    risky |= not within
                elif isinstance(child, (ast.Break, ast.Continue)):
                    risky |= not loop
                elif outside and not within:
                    risky |= any(isinstance(x, (ast.Yield, ast.YieldFrom, ast.Await)) for x in ast.walk(child))
    if risky or any(w not in ("yield",) for w in words):
        try:
            compile(text, "record", "exec", 0, True)
        except (RecursionError, MemoryError):
            pass  # too deep for the compiler, not against its rules
    return sorted(found, key=lambda f: (f.first, f.symbol)), _LINE.split(text.replace("\f", " "))


def _python_comments(text: str, lines: list[str], ends: set[int], far: bool) -> list[Comment]:
    """The comment blocks that end on one of the lines; what looks like one within a string is none."""

    def is_comment(k: int) -> bool:
        return 0 <= k < len(lines) and lines[k].lstrip().startswith("#")

    found = [end for end in sorted(ends) if is_comment(end) and not is_comment(end + 1)]
    # Right above a definition only a line that itself closes a string can deceive; farther off any may.
    if found and (far or any('"' in lines[end] or "'" in lines[end] for end in found)):
        spans = scan_python(text)[1]
        starts = [0, *(m.end() for m in _LINE.finditer(text))]
        real = {bisect_right(starts, a) - 1 for a, _ in spans if text[a] == "#"}
    else:
        real = None
    out = []
    for end in found:
        if real is not None and end not in real:
            continue
        at = end
        while at > 0 and is_comment(at - 1) and (real is None or at - 1 in real):
            at -= 1
        out.append(Comment("\n".join(x.strip().lstrip("#").strip() for x in lines[at : end + 1]), end))
    return out


def _javascript(text: str) -> tuple[list[Function], list[str], list[Comment]]:
    tokens, functions = parse(text)
    starts = [0, *(m.end() for m in _LINE.finditer(text))]
    lines = _LINE.split(text)

    def line_of(at: int) -> int:
        lo, hi = 0, len(starts)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if starts[mid] <= at else (lo, mid)
        return lo

    found = [Function(f.symbol, f.symbol.rsplit(".", 1)[-1], line_of(f.start), line_of(f.end), f.params, None) for f in functions]
    comments: list[Comment] = []
    slashes: list[str] = []
    before = -2
    for a, b in tokens.comments:
        first, last = line_of(a), line_of(b - 1)
        if text[starts[first] : a].strip() or text[b : starts[last] + len(lines[last])].strip():
            continue  # code stands beside it
        body = text[a:b]
        if body.startswith("//"):
            slashes = [*slashes, body.lstrip("/").strip()] if before == first - 1 and slashes else [body.lstrip("/").strip()]
            if comments and len(slashes) > 1:
                comments.pop()
            comments.append(Comment("\n".join(slashes), last))
            before = first
        else:
            slashes = []
            inner = body[2:-2].strip("*!")
            comments.append(Comment("\n".join(x.strip().lstrip("*").strip() for x in inner.split("\n")).strip(), last))
    return sorted(found, key=lambda f: f.first), lines, comments


def _weight(f: Function, c: Comment, names: set[str]) -> float:
    """Plausibility of a link by nearness, parameter tags and names; ``names`` are those of all functions of the file.

    A comment right above a function stays plausible even with strange tags; one
    farther off needs tags or names of the function to be taken at all.
    """
    gap = f.first - c.end - 1
    score = NEAR[min(gap, len(NEAR) - 1)]
    tags = set(_TAGS.findall(c.text))
    if tags:
        fit = len(tags & set(f.params)) / len(tags)
        score += TAGS * fit if fit else -min(STRANGE_TAGS, score - LEAST if gap == 0 else STRANGE_TAGS)
    own = {w.lower() for w in _NAME_WORDS.findall(f.name)}
    said = set(_WORDS.findall(c.text.lower()))
    score += NAME_WORDS * len(own & said) / len(own) if own else 0.0
    said_names = names & set(_IDENTIFIER.findall(c.text))
    if f.name in said_names:
        score += NAME
    elif said_names and gap:
        score -= NAME  # it speaks of another function
    return score


def assign(functions: list[Function], comments: list[Comment], reach: int = REACH) -> dict[int, int]:
    """Heaviest bipartite assignment of comments to functions: index of function to index of comment.

    Candidates stand at most ``reach`` lines apart; links under LEAST are left
    out. Functions enter one by one, each along the best alternating path, which
    is found by label correction as the matching so far is the heaviest one.
    """
    by_end: dict[int, list[int]] = {}
    for j, c in enumerate(comments):
        by_end.setdefault(c.end, []).append(j)
    names = {f.name for f in functions}
    edges: list[dict[int, float]] = []
    for f in functions:
        near = (j for gap in range(reach + 1) for j in by_end.get(f.first - 1 - gap, ()))
        edges.append({j: w for j in near if (w := _weight(f, comments[j], names)) >= LEAST})
    owner: dict[int, int] = {}
    held: dict[int, int] = {}  # the other way round
    for i, own in enumerate(edges):
        gain = dict(own)  # comment: best gain of a path that ends by taking it
        before = {j: i for j in own}  # comment: the function that takes it on that path
        queue = list(own)
        for j in queue:  # grows while better paths are found
            k = owner.get(j)
            if k is None:
                continue
            base = gain[j] - edges[k][j]
            for j2, w in edges[k].items():
                if j2 != j and base + w > gain.get(j2, 0.0) + 1e-9:
                    gain[j2], before[j2] = base + w, k
                    queue.append(j2)
        best, end = 0.0, None
        for j, g in gain.items():
            k = owner.get(j)
            total = g if k is None else g - edges[k][j]  # the present owner may go without
            if total > best + 1e-9:
                best, end = total, j
        if end is not None:
            held.pop(owner.get(end), None)
        while end is not None:
            k = before[end]
            owner[end], held[k], end = k, end, held.get(k)
    return held


def pairs(text: str, lang: str, reach: int = REACH) -> list[tuple[str, str, str, str, int, int]]:
    """(symbol, description, origin, code, first line, last line) of the documented functions; none if the text is not valid."""
    try:
        if lang == "python":
            functions, lines = _python(text)
            ends = {f.first - 1 - gap for f in functions if f.docstring is None for gap in range(reach + 1)}
            comments = _python_comments(text.removeprefix("\ufeff"), lines, ends, reach > 0)
        else:
            functions, lines, comments = _javascript(text)
    except (SyntaxError, SyntaxFault, ValueError):
        return []
    bare = [f for f in functions if f.docstring is None]
    links = assign(bare, comments, reach) if comments else {}
    linked = {id(bare[i]): comments[j] for i, j in links.items()}
    out = []
    for f in functions:
        doc, origin = f.docstring, "docstring"
        if doc is None:
            c = linked.get(id(f))
            if c is None:
                continue
            doc, origin = c.text, "comment"
        if not trivial(doc, f.name):
            out.append((f.symbol, doc.strip(), origin, "\n".join(lines[f.first : f.last + 1]), f.first + 1, f.last + 1))
    return out


_OUT = "symbol string, description string, origin string, code string, first_line int, last_line int"


def documented(df: DataFrame, keep: list[str], path: str = "path", text: str = "text", reach: int = REACH) -> DataFrame:
    """``keep`` columns and one row per documented function of a valid Python or JavaScript record.

    Documentation is the docstring or else the comment that the assignment gives
    to the function; comments end at most ``reach`` lines above it (0: on the
    line directly above).

    Null texts and paths, other languages and texts that don't parse give no
    rows; repeated records give repeated rows. Texts are read whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        warnings.simplefilter("ignore")
        for b in batches:
            gc.disable()
            try:
                found = [pairs(t, lang, reach) for t, lang in zip(b["_text"], b["_language"])]
            finally:
                gc.enable()
            at = [k for k, f in enumerate(found) for _ in f]
            rows = [x for f in found for x in f]
            out = b[keep].iloc[at].reset_index(drop=True)
            cols = ["symbol", "description", "origin", "code", "first_line", "last_line"]
            yield pd.concat([out, pd.DataFrame(rows, columns=cols)], axis=1)

    kept = df.select(
        *[F.col(c) for c in keep], language_column(F.col(path), F.col(text)).alias("_language"), F.col(text).alias("_text")
    ).filter("_language in ('python', 'javascript') and _text is not null")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name[0] != "_")
    return kept.mapInPandas(run, f"{schema}, {_OUT}")
