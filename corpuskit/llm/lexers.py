"""Lexers of Python, JSON and TOML with a pushdown stack of open delimiters; none of them recurses, so any depth is followed."""

from __future__ import annotations

import re

_MARK = re.compile(r"(?m)^(?:<{7}|={7}|>{7}|\|{7})(?=[ \r\n]|\Z)")
_PAIRS = {")": "(", "]": "[", "}": "{"}

# Python: quotes, comments and brackets; what stands between them is passed over.
_PY = re.compile(r"""(?P<quote>\"\"\"|'''|"|')|(?P<comment>\#[^\n\r]*)|(?P<open>[(\[{])|(?P<close>[)\]}])""")
_PY_END = {
    '"': re.compile(r'(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"'),
    "'": re.compile(r"(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'"),
    '"""': re.compile(r'(?:[^"\\]|\\[\s\S]|"(?!""))*"""'),
    "'''": re.compile(r"(?:[^'\\]|\\[\s\S]|'(?!''))*'''"),
}
#: A formatted string whose fields hold neither quotes nor braces, as a whole.
_PY_PLAIN = {
    '"': re.compile(r'(?:[^"\\\n\r{}]|\\[^\n\r{}N]|\{\{|\}\}|\{[^"\'{}\n\r\\#()\[\]]*\})*"'),
    "'": re.compile(r"(?:[^'\\\n\r{}]|\\[^\n\r{}N]|\{\{|\}\}|\{[^\"'{}\n\r\\#()\[\]]*\})*'"),
}
_PY_PREFIX = re.compile(r"(?i)(?<!\w)(?:f|fr|rf)\Z")
_FIELD = re.compile(r"""(?P<quote>\"\"\"|'''|"|')|(?P<comment>\#[^\n\r]*)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<colon>:)""")


def _format_text(text: str, at: int, quote: str, raw: bool, spec: bool) -> tuple[int, str]:
    """From inside the literal part of a formatted string: the place behind, and what ends it: a quote, a field, the end of a spec, or nothing."""
    n, one = len(text), len(quote) == 1
    while at < n:
        c = text[at]
        if c == "\\":
            if not raw and text.startswith("\\N{", at):
                end = text.find("}", at)
                at = end + 1 if end >= 0 else n
            elif at + 1 < n and text[at + 1] in "{}":
                at += 1
            else:
                at += 3 if text.startswith("\r\n", at + 1) else 2
        elif c == "{":
            if not spec and text.startswith("{{", at):
                at += 2
            else:
                return at + 1, "field"
        elif c == "}":
            if spec:
                return at + 1, "spec end"
            at += 2 if text.startswith("}}", at) else 1
        elif text.startswith(quote, at):
            return at + len(quote), "quote"
        elif one and c in "\n\r":
            return at, ""
        else:
            at += 1
    return at, ""


def scan_python(text: str) -> tuple[str | None, list[tuple[int, int]]]:
    """(fault, spans of string literals and comments). What is no fault here may still be one of the grammar."""
    marks = [m.start() for m in _MARK.finditer(text)]
    spans: list[tuple[int, int]] = []
    #: Open brackets, and of a formatted string ("text" | "field" | "spec", quote, raw, start).
    stack: list[str | tuple[str, str, bool, int]] = []
    at, n, code_end, next_mark = 0, len(text), 0, 0
    while True:
        top = stack[-1] if stack else ""
        if isinstance(top, tuple) and top[0] != "field":
            at, what = _format_text(text, at, top[1], top[2], top[0] == "spec")
            code_end = at
            if what == "quote" and top[0] == "text":
                stack.pop()
                spans.append((top[3], at))
            elif what == "field":
                stack.append(("field", *top[1:]))
            elif what == "spec end":
                del stack[-2:]  # the spec and its field
            else:
                return "unterminated literal", spans
            continue
        m = (_FIELD if isinstance(top, tuple) else _PY).search(text, at)
        start = m.start() if m else n
        while next_mark < len(marks) and marks[next_mark] < at:
            next_mark += 1
        if next_mark < len(marks) and marks[next_mark] < start:
            return "merge conflict", spans
        if m is None:
            break
        kind, at = m.lastgroup, m.end()
        if kind == "comment":
            spans.append((start, at))
            continue
        if kind == "quote":
            q = m[0]
            prefix = _PY_PREFIX.search(text, max(0, start - 3), start)
            if prefix:
                end = _PY_PLAIN[q].match(text, at) if len(q) == 1 else None
                if end is None:
                    stack.append(("text", q, "r" in prefix[0].lower(), start))
                    continue
            else:
                end = _PY_END[q].match(text, at)
                if end is None:
                    return "unterminated literal", spans
            at = end.end()
            spans.append((start, at))
        elif kind == "open":
            stack.append(m[0])
        elif kind == "colon":
            stack.append(("spec", *top[1:]))
        elif not stack:
            return "unbalanced delimiter", spans
        elif isinstance(top, tuple):
            if m[0] != "}":
                return "unbalanced delimiter", spans
            stack.pop()
        elif stack.pop() != _PAIRS[m[0]]:
            return "unbalanced delimiter", spans
        code_end = at
    if stack:
        return "premature end", spans
    rest = re.sub(r"#[^\n\r]*", "", text[code_end:]).rstrip()
    return ("premature end" if rest.endswith(":") else None), spans


_TOML = re.compile(
    r'''(?P<lit>"""(?:[^"\\]|\\[\s\S]|"{1,2}(?!"))*"{3,5}|\'\'\'(?:[^']|'{1,2}(?!'))*'{3,5}|"(?!"")(?:[^"\\\n\r]|\\[^\n\r])*"|'(?!'')[^'\n\r]*'|\#[^\n\r]*)|(?P<open>[\[{])|(?P<close>[\]}])|(?P<quote>["'])|(?P<mark>^(?:<{7}|={7}|>{7}|\|{7})(?=[ \r\n]|\Z))''',
    re.M,
)
_JSON = re.compile(r'(?P<lit>"(?:[^"\\\x00-\x1f]|\\.)*")|(?P<open>[\[{])|(?P<close>[\]}])|(?P<quote>["\'])|(?P<mark>^(?:<{7}|={7}|>{7}|\|{7})(?=[ \r\n]|\Z))', re.M)


def _scan(pattern: re.Pattern, text: str) -> str | None:
    stack: list[str] = []
    for m in pattern.finditer(text):
        kind = m.lastgroup
        if kind == "open":
            stack.append(m[0])
        elif kind == "close":
            if not stack or stack.pop() != _PAIRS[m[0]]:
                return "unbalanced delimiter"
        elif kind == "quote":
            return "unterminated literal"
        elif kind == "mark":
            return "merge conflict"
    return "premature end" if stack else None


def lexical_fault(text: str, lang: str) -> str | None:
    """What the lexer of Python, JSON or TOML and its stack of open delimiters find wrong, if anything."""
    if lang == "python":
        return scan_python(text.removeprefix("﻿"))[0]
    return _scan(_TOML if lang == "toml" else _JSON, text)


_JSON_TOKEN = re.compile(r'[ \t\n\r]*(?:(?P<p>[\[\]{},:])|(?P<s>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<v>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null))')


def json_grammar(text: str) -> bool:
    """Whether a text is strict JSON, by a pushdown automaton; for depths that the recursive parser can't follow."""
    stack: list[str] = []
    want, at, n = "value", 0, len(text.rstrip(" \t\n\r"))
    while at < n:
        m = _JSON_TOKEN.match(text, at)
        if m is None or m.end() == at:
            return False
        at, p = m.end(), m["p"]
        if want in ("value", "value or ]") and (m["s"] is not None or m["v"] is not None):
            want = "after"
        elif want in ("value", "value or ]") and p in ("[", "{"):
            stack.append(p)
            want = "value or ]" if p == "[" else "key or }"
        elif (want == "value or ]" and p == "]") or (want == "key or }" and p == "}"):
            stack.pop()
            want = "after"
        elif want in ("key", "key or }") and m["s"] is not None:
            want = "colon"
        elif want == "colon" and p == ":":
            want = "value"
        elif want == "after" and stack and p == ",":
            want = "value" if stack[-1] == "[" else "key"
        elif want == "after" and stack and p == {"[": "]", "{": "}"}[stack[-1]]:
            stack.pop()
        else:
            return False
    return want == "after" and not stack
