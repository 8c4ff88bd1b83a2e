"""JavaScript: a lexer with a pushdown stack, and a recursive-descent syntax check.

``lex`` finds unterminated literals, unbalanced delimiters, premature ends and
merge markers; ``parse`` checks the grammar of the tokens (scripts and modules,
automatic semicolons included) and lists the functions it meets.
"""

from __future__ import annotations

import re
import sys
from typing import NamedTuple

RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for"
    " function if import in instanceof new null return super switch this throw true try typeof var void while with".split()
)
_ID = r"[A-Za-z_$ª-῿‌‍⁰-⿿、-퟿豈-﷏ﷰ-﻾＀-￯]"
_TOKEN = re.compile(
    rf"""
    (?P<ws>[ \t\v\f ﻿ - 　]+)
  | (?P<nl>(?:\r\n|[\n\r  ])+)
  | (?P<com>//[^\n\r  ]*|/\*(?:[^*]|\*(?!/))*\*/)
  | (?P<id>\#?(?:{_ID}|\\u[0-9a-fA-F]{{4}}|\\u\{{[0-9a-fA-F]+\}})(?:{_ID}|[0-9]|\\u[0-9a-fA-F]{{4}}|\\u\{{[0-9a-fA-F]+\}})*)
  | (?P<num>(?:0[xX][0-9a-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+|[0-9][0-9_]*(?:\.[0-9_]*)?(?:[eE][+-]?[0-9_]+)?|\.[0-9][0-9_]*(?:[eE][+-]?[0-9_]+)?)n?)
  | (?P<str>"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')
  | (?P<p>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?![0-9])|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{{}}()\[\];,<>+\-*/%&|^!~?:=.@])
    """,
    re.X,
)
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)")
_REGEX = re.compile(r"/(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*")
_MARKER = re.compile(r"(?m)^(?:<{7}|={7}|>{7}|\|{7})(?:[ \r\n]|\Z)")
_OPERAND_ENDS = frozenset(["id", "num", "str", "regex", "tmpl", "`t", ")", "]", "}", "this", "super", "null", "true", "false"])
_CLOSES = {")": "(", "]": "[", "}": "{"}


class SyntaxFault(Exception):
    """reason: why the text is not valid; at: character offset."""

    def __init__(self, reason: str, at: int):
        super().__init__(reason)
        self.reason, self.at = reason, at


class Tokens(NamedTuple):
    kinds: list[str]  # the token itself for punctuators and reserved words, else id, num, str, ...
    values: list[str]
    starts: list[int]
    after_line: list[bool]  # whether a line break stands before the token
    mates: dict[int, int]  # index of an opening bracket: index of its closing one
    comments: list[tuple[int, int]]


def lex(text: str) -> Tokens:
    kinds: list[str] = []
    values: list[str] = []
    starts: list[int] = []
    lines: list[bool] = []
    mates: dict[int, int] = {}
    comments: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    at, n, fresh = 0, len(text), True
    if text.startswith("#!"):
        at = len(text.split("\n", 1)[0])
    match, add = _TOKEN.match, kinds.append

    def put(kind: str, value: str, start: int) -> None:
        nonlocal fresh
        add(kind)
        values.append(value)
        starts.append(start)
        lines.append(fresh)
        fresh = False

    def template(start: int, kind: str) -> int:
        t = _TEMPLATE.match(text, start + 1)
        if not t:
            raise SyntaxFault("unterminated literal", start)
        if t[1] == "`":
            put("tmpl" if kind == "`h" else "`t", "", start)
        else:
            put(kind, "", start)
            stack.append(("${", len(kinds) - 1))
        return t.end()

    while at < n:
        m = match(text, at)
        if m is None:
            c = text[at]
            if c == "`":
                at = template(at, "`h")
                continue
            if c in "\"'":
                raise SyntaxFault("unterminated literal", at)
            raise SyntaxFault("illegal character", at)
        kind, start, end = m.lastgroup, at, m.end()
        if kind == "ws":
            pass
        elif kind == "nl":
            fresh = True
        elif kind == "id":
            v = m[0]
            put(v if v in RESERVED else "id", v, start)
        elif kind == "com":
            comments.append((start, end))
            if "\n" in m[0]:
                fresh = True
        elif kind == "p":
            v = m[0]
            if v[0] == "/" and (not kinds or kinds[-1] not in _OPERAND_ENDS or (kinds[-1] in ")}" and _regex_after(kinds, mates, fresh))):
                r = _REGEX.match(text, at)
                if text.startswith("/*", at) or not r:
                    raise SyntaxFault("unterminated literal", at)
                put("regex", "", start)
                at = r.end()
                continue
            if v in "([{":
                stack.append((v, len(kinds)))
            elif v in ")]}":
                if not stack:
                    raise SyntaxFault("unbalanced delimiter", at)
                o, i = stack.pop()
                if o == "${":
                    if v != "}":
                        raise SyntaxFault("unbalanced delimiter", at)
                    at = template(at, "`m")
                    continue
                if o != _CLOSES[v]:
                    raise SyntaxFault("unbalanced delimiter", at)
                mates[i] = len(kinds)
            elif v == "/" and text.startswith("/*", at):
                raise SyntaxFault("unterminated literal", at)
            elif fresh and v in ("<<", ">>>", "===") and _MARKER.match(text, at):
                raise SyntaxFault("merge conflict", at)
            put(v, v, start)
        else:
            if kind == "num" and end < n and (text[end].isalnum() or text[end] in "_$"):
                raise SyntaxFault("illegal number", at)
            put(kind, m[0] if kind == "str" else "", start)
        at = end
    if stack:
        raise SyntaxFault("premature end", n)
    put("eof", "", n)
    return Tokens(kinds, values, starts, lines, mates, comments)


def _regex_after(kinds: list[str], mates: dict[int, int], fresh: bool) -> bool:
    """Whether a slash after a closing bracket begins a pattern: after the head of a statement, or a block on a line of its own."""
    if kinds[-1] == "}":
        return fresh
    for o, c in reversed(mates.items()):
        if c == len(kinds) - 1:
            return o > 0 and kinds[o - 1] in ("if", "while", "for", "with")
    return False


class Function(NamedTuple):
    symbol: str
    start: int  # of the statement or member that defines it, with export, static and the like
    end: int
    params: tuple[str, ...]


_ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_BINARY = frozenset("?? || && | ^ & == != === !== < > <= >= << >> >>> + - * / % ** in instanceof".split())
_PREFIX = frozenset("delete void typeof + - ~ !".split())
_KEYS = frozenset(["id", "str", "num"])
_TARGETS = frozenset(["name", "member", "pattern"])


class _Parser:
    def __init__(self, t: Tokens):
        self.k, self.v, self.s, self.nl, self.mates = t.kinds, t.values, t.starts, t.after_line, t.mates
        self.i = 0
        self.functions: list[Function] = []
        self.scope: list[str] = []
        self.in_function = self.in_loop = self.in_switch = 0
        self.no_in = False

    def fail(self) -> None:
        at = self.s[self.i]
        raise SyntaxFault("premature end" if self.k[self.i] == "eof" else "unexpected token", at)

    def eat(self, kind: str) -> None:
        if self.k[self.i] != kind:
            self.fail()
        self.i += 1

    def end_statement(self) -> None:
        k = self.k[self.i]
        if k == ";":
            self.i += 1
        elif k != "}" and k != "eof" and not self.nl[self.i]:
            self.fail()

    # Statements

    def program(self) -> None:
        while self.k[self.i] != "eof":
            self.statement()

    def block(self) -> None:
        self.eat("{")
        while self.k[self.i] != "}":
            if self.k[self.i] == "eof":
                self.fail()
            self.statement()
        self.i += 1

    def paren(self) -> None:
        self.eat("(")
        self.expression()
        self.eat(")")

    def statement(self, start: int | None = None) -> None:
        k, i = self.k[self.i], self.i
        at = self.s[i] if start is None else start
        if k == "id":
            v = self.v[i]
            nk, nv = self.k[i + 1], self.v[i + 1]
            if v == "let" and nk in ("id", "[", "{"):
                self.i += 1
                self.declarations(at)
                return self.end_statement()
            if v == "async" and nk == "function" and not self.nl[i + 1]:
                self.i += 1
                return self.function(at, True)
            if nk == ":":
                self.i += 2
                return self.statement()
            self.expression(at)
            return self.end_statement()
        if k == "{":
            return self.block()
        if k == ";":
            self.i += 1
        elif k in ("const", "var"):
            self.i += 1
            self.declarations(at, k == "const")
            self.end_statement()
        elif k == "if":
            self.i += 1
            self.paren()
            self.statement()
            if self.k[self.i] == "else":
                self.i += 1
                self.statement()
        elif k == "return":
            if not self.in_function:
                self.fail()
            self.i += 1
            self.optional_expression()
            self.end_statement()
        elif k == "function":
            self.function(at, True)
        elif k == "class":
            self.klass(at, True)
        elif k == "for":
            self.for_()
        elif k == "while":
            self.i += 1
            self.paren()
            self.loop_body()
        elif k == "do":
            self.i += 1
            self.loop_body()
            self.eat("while")
            self.paren()
            if self.k[self.i] == ";":
                self.i += 1
        elif k in ("break", "continue"):
            self.i += 1
            if self.k[self.i] == "id" and not self.nl[self.i]:
                self.i += 1
            elif not (self.in_loop or (k == "break" and self.in_switch)):
                self.fail()
            self.end_statement()
        elif k == "throw":
            self.i += 1
            if self.nl[self.i]:
                self.fail()
            self.expression()
            self.end_statement()
        elif k == "try":
            self.i += 1
            self.block()
            if self.k[self.i] == "catch":
                self.i += 1
                if self.k[self.i] == "(":
                    self.i += 1
                    self.binding()
                    self.eat(")")
                self.block()
                if self.k[self.i] == "finally":
                    self.i += 1
                    self.block()
            else:
                self.eat("finally")
                self.block()
        elif k == "switch":
            self.switch()
        elif k == "import" and self.k[i + 1] not in ("(", "."):
            self.import_()
        elif k == "export":
            self.export()
        elif k == "debugger":
            self.i += 1
            self.end_statement()
        elif k == "with":
            self.i += 1
            self.paren()
            self.statement()
        else:
            self.expression(at)
            self.end_statement()

    def loop_body(self) -> None:
        self.in_loop += 1
        self.statement()
        self.in_loop -= 1

    def for_(self) -> None:
        self.i += 1
        if self.k[self.i] == "id" and self.v[self.i] == "await":
            self.i += 1
        self.eat("(")
        k = self.k[self.i]
        self.no_in = True
        if k == ";":
            pass
        elif k in ("const", "var") or (k == "id" and self.v[self.i] == "let" and self.k[self.i + 1] in ("id", "[", "{")):
            self.i += 1
            self.declarations(None)
        else:
            self.expression()
        self.no_in = False
        if self.k[self.i] == "in" or (self.k[self.i] == "id" and self.v[self.i] == "of"):
            self.i += 1
            self.expression()
        else:
            self.eat(";")
            if self.k[self.i] != ";":
                self.expression()
            self.eat(";")
            if self.k[self.i] != ")":
                self.expression()
        self.eat(")")
        self.loop_body()

    def switch(self) -> None:
        self.i += 1
        self.paren()
        self.eat("{")
        self.in_switch += 1
        while self.k[self.i] != "}":
            if self.k[self.i] == "case":
                self.i += 1
                self.expression()
            else:
                self.eat("default")
            self.eat(":")
            while self.k[self.i] not in ("case", "default", "}"):
                if self.k[self.i] == "eof":
                    self.fail()
                self.statement()
        self.in_switch -= 1
        self.i += 1

    def declarations(self, at: int | None, constant: bool = False) -> None:
        while True:
            name = self.v[self.i] if self.k[self.i] == "id" else None
            self.binding()
            if self.k[self.i] == "=":
                self.i += 1
                self.assignment(name, at)
            elif constant:
                self.fail()
            if self.k[self.i] != ",":
                return
            self.i += 1

    def module_name(self) -> None:
        if self.k[self.i] not in _KEYS and self.k[self.i] not in RESERVED:
            self.fail()
        self.i += 1

    def module_names(self) -> None:
        self.eat("{")
        while self.k[self.i] != "}":
            self.module_name()
            if self.k[self.i] == "id" and self.v[self.i] == "as":
                self.i += 1
                self.module_name()
            if self.k[self.i] != "}":
                self.eat(",")
        self.i += 1

    def from_(self) -> None:
        if self.v[self.i] != "from":
            self.fail()
        self.i += 1
        self.eat("str")
        if self.k[self.i] == "with" or (self.v[self.i] == "assert" and not self.nl[self.i]):
            self.i += 1
            self.object()
        self.end_statement()

    def import_(self) -> None:
        self.i += 1
        if self.k[self.i] == "str":
            self.i += 1
            return self.end_statement()
        if self.k[self.i] == "id":
            self.i += 1
            if self.k[self.i] == ",":
                self.i += 1
            else:
                return self.from_()
        if self.k[self.i] == "*":
            self.i += 1
            if self.v[self.i] != "as":
                self.fail()
            self.i += 1
            self.eat("id")
        else:
            self.module_names()
        self.from_()

    def export(self) -> None:
        at = self.s[self.i]
        self.i += 1
        k, v = self.k[self.i], self.v[self.i]
        if k == "default":
            self.i += 1
            k = self.k[self.i]
            if k == "function" or (self.v[self.i] == "async" and self.k[self.i + 1] == "function"):
                self.i += k != "function"
                self.function(at, False)
            elif k == "class":
                self.klass(at, False)
            else:
                self.assignment()
                self.end_statement()
        elif k == "{":
            self.module_names()
            if v == "{" and self.v[self.i] == "from":
                self.from_()
            else:
                self.end_statement()
        elif k == "*":
            self.i += 1
            if self.v[self.i] == "as":
                self.i += 1
                self.module_name()
            self.from_()
        elif k in ("const", "var", "function", "class") or v in ("let", "async"):
            self.statement(at)
        else:
            self.fail()

    # Bindings, functions, classes

    def binding(self) -> None:
        k = self.k[self.i]
        if k == "id" and self.v[self.i][0] != "#":
            self.i += 1
        elif k == "[":
            self.i += 1
            while self.k[self.i] != "]":
                if self.k[self.i] == ",":
                    self.i += 1
                    continue
                if self.k[self.i] == "...":
                    self.i += 1
                self.binding()
                self.default()
                if self.k[self.i] != "]":
                    self.eat(",")
            self.i += 1
        elif k == "{":
            self.i += 1
            while self.k[self.i] != "}":
                if self.k[self.i] == "...":
                    self.i += 1
                    self.binding()
                elif self.k[self.i] == "id" and self.k[self.i + 1] != ":":
                    self.i += 1
                    self.default()
                else:
                    self.key()
                    self.eat(":")
                    self.binding()
                    self.default()
                if self.k[self.i] != "}":
                    self.eat(",")
            self.i += 1
        else:
            self.fail()

    def default(self) -> None:
        if self.k[self.i] == "=":
            self.i += 1
            self.assignment()

    def params(self) -> tuple[str, ...]:
        self.eat("(")
        names = []
        while self.k[self.i] != ")":
            if self.k[self.i] == "...":
                self.i += 1
            if self.k[self.i] == "id":
                names.append(self.v[self.i])
            self.binding()
            self.default()
            if self.k[self.i] != ")":
                self.eat(",")
        self.i += 1
        return tuple(names)

    def body(self, name: str | None, at: int | None, params: tuple[str, ...] | None = None) -> None:
        """Parameters (unless given) and body of a function; it is listed if it has a name."""
        kept = self.in_loop, self.in_switch, self.no_in
        self.in_loop = self.in_switch = 0
        self.no_in = False
        place = len(self.functions)
        if params is None:
            params = self.params()
        if name:
            self.scope.append(name)
        symbol = ".".join(self.scope)
        self.in_function += 1
        self.block()
        self.in_function -= 1
        if name:
            self.scope.pop()
            if at is not None:
                self.functions.insert(place, Function(symbol, at, self.s[self.i - 1] + 1, params))
        self.in_loop, self.in_switch, self.no_in = kept

    def function(self, at: int, named: bool) -> None:
        """At the word function; a declaration needs a name unless it is a default export."""
        self.eat("function")
        if self.k[self.i] == "*":
            self.i += 1
        name = None
        if self.k[self.i] == "id":
            name = self.v[self.i]
            self.i += 1
        elif named:
            self.fail()
        self.body(name, at)

    def klass(self, at: int, named: bool) -> None:
        self.eat("class")
        name = None
        if self.k[self.i] == "id":
            name = self.v[self.i]
            self.i += 1
        elif named:
            self.fail()
        if self.k[self.i] == "extends":
            self.i += 1
            self.operand()
        self.eat("{")
        if name:
            self.scope.append(name)
        while self.k[self.i] != "}":
            if self.k[self.i] == ";":
                self.i += 1
            else:
                self.member()
        self.i += 1
        if name:
            self.scope.pop()

    def key(self) -> str | None:
        k = self.k[self.i]
        if k == "[":
            self.i += 1
            kept, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = kept
            self.eat("]")
            return None
        if k not in _KEYS and k not in RESERVED:
            self.fail()
        v = self.v[self.i]
        self.i += 1
        return v[1:-1] if k == "str" else v

    def modifiers(self, words: tuple[str, ...]) -> None:
        while self.k[self.i] == "id" and self.v[self.i] in words and self.k[self.i + 1] not in ("(", "=", ";", "}", ",", ":"):
            self.i += 1
        if self.k[self.i] == "*":
            self.i += 1

    def member(self) -> None:
        at = self.s[self.i]
        if self.v[self.i] == "static" and self.k[self.i + 1] == "{":
            self.i += 1
            return self.body(None, None, ())
        self.modifiers(("static", "async", "get", "set", "accessor"))
        name = self.key()
        if self.k[self.i] == "(":
            return self.body(name, at)
        if self.k[self.i] == "=":
            self.i += 1
            self.assignment(name, at)
        self.end_statement()

    # Expressions

    def expression(self, at: int | None = None) -> None:
        self.assignment(None, at)
        while self.k[self.i] == ",":
            self.i += 1
            self.assignment()

    def optional_expression(self) -> None:
        k = self.k[self.i]
        if k not in (";", "}", "eof") and not self.nl[self.i]:
            self.expression()

    def arrow(self, name: str | None, at: int | None) -> bool:
        """Parses an arrow function if one begins here."""
        i = self.i
        if self.k[i] == "id" and self.v[i] == "async" and not self.nl[i + 1] and self.k[i + 1] in ("id", "("):
            i += 1
        if self.k[i] == "id" and self.k[i + 1] == "=>":
            params: tuple[str, ...] = (self.v[i],)
            self.i = i + 1
        elif self.k[i] == "(" and self.k[self.mates[i] + 1] == "=>":
            self.i = i
            params = self.params()
        else:
            return False
        if self.nl[self.i]:
            self.fail()
        self.eat("=>")
        if self.k[self.i] == "{":
            self.body(name, at, params)
            return True
        place = len(self.functions)
        if name:
            self.scope.append(name)
        symbol = ".".join(self.scope)
        self.assignment()
        if name:
            self.scope.pop()
            if at is not None:
                self.functions.insert(place, Function(symbol, at, self.s[self.i - 1] + 1, params))
        return True

    def assignment(self, name: str | None = None, at: int | None = None) -> None:
        k, i = self.k[self.i], self.i
        if (k == "id" or k == "(") and self.arrow(name, at):
            return
        if k == "id" and self.v[i] == "yield" and self.in_function:
            self.i += 1
            if self.k[self.i] == "*":
                self.i += 1
            if self.k[self.i] not in (")", "]", "}", ",", ";", ":", "eof") and not self.nl[self.i]:
                self.assignment()
            return
        kind = self.unary()
        k = self.k[self.i]
        if k in _ASSIGN:
            if kind not in _TARGETS or (kind == "pattern" and k != "="):
                self.fail()
            self.i += 1
            simple = kind == "name" and k == "="
            return self.assignment(self.v[i] if simple else None, at if simple else None)
        while k in _BINARY:
            if k == "in" and self.no_in:
                return
            self.i += 1
            self.unary()
            k = self.k[self.i]
        if k == "?":
            self.i += 1
            kept, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = kept
            self.eat(":")
            self.assignment()

    def unary(self) -> str:
        k = self.k[self.i]
        if k in _PREFIX:
            self.i += 1
            self.unary()
            return "value"
        if k == "++" or k == "--":
            self.i += 1
            if self.unary() not in ("name", "member"):
                self.fail()
            return "value"
        if k == "id" and self.v[self.i] == "await" and not self.nl[self.i + 1] and (
            self.k[self.i + 1] in ("id", "num", "str", "tmpl", "`h", "new", "this", "function", "class", "import", "{", "super", "!")
            or (self.k[self.i + 1] in "([" and self.in_function)
        ):
            self.i += 1
            self.unary()
            return "value"
        kind = self.operand()
        k = self.k[self.i]
        if (k == "++" or k == "--") and not self.nl[self.i]:
            if kind not in ("name", "member"):
                self.fail()
            self.i += 1
            return "value"
        return kind

    def operand(self) -> str:
        kind = self.primary()
        while True:
            k = self.k[self.i]
            if k == ".":
                self.i += 1
                if self.k[self.i] != "id" and self.k[self.i] not in RESERVED:
                    self.fail()
                self.i += 1
                kind = "member"
            elif k == "(":
                self.arguments()
                kind = "value"
            elif k == "[":
                self.i += 1
                kept, self.no_in = self.no_in, False
                self.expression()
                self.no_in = kept
                self.eat("]")
                kind = "member"
            elif k == "?.":
                self.i += 1
                if self.k[self.i] == "id" or self.k[self.i] in RESERVED:
                    self.i += 1
                elif self.k[self.i] not in ("(", "["):
                    self.fail()
                kind = "value"
            elif k == "tmpl" or k == "`h":
                self.template()
                kind = "value"
            else:
                return kind

    def template(self) -> None:
        k = self.k[self.i]
        self.i += 1
        if k == "`h":
            kept, self.no_in = self.no_in, False
            while True:
                self.expression()
                k = self.k[self.i]
                if k != "`m" and k != "`t":
                    self.fail()
                self.i += 1
                if k == "`t":
                    break
            self.no_in = kept

    def arguments(self) -> None:
        self.eat("(")
        kept, self.no_in = self.no_in, False
        while self.k[self.i] != ")":
            if self.k[self.i] == "...":
                self.i += 1
            self.assignment()
            if self.k[self.i] != ")":
                self.eat(",")
        self.no_in = kept
        self.i += 1

    def primary(self) -> str:
        k, i = self.k[self.i], self.i
        if k == "id":
            v = self.v[i]
            if v == "async" and self.k[i + 1] == "function" and not self.nl[i + 1]:
                self.i += 1
                self.function(self.s[i], False)
                return "value"
            self.i += 1
            if v[0] == "#" and self.k[self.i] != "in":
                self.i -= 1
                self.fail()
            return "name"
        if k in ("num", "str", "regex", "this", "null", "true", "false"):
            self.i += 1
            return "value"
        if k == "(":
            self.i += 1
            kept, self.no_in = self.no_in, False
            self.assignment()
            several = self.k[self.i] == ","
            while self.k[self.i] == ",":
                self.i += 1
                self.assignment()
            self.no_in = kept
            self.eat(")")
            return "value" if several or self.k[self.i - 2] not in ("id", "]") else "member"
        if k == "[":
            self.i += 1
            kept, self.no_in = self.no_in, False
            while self.k[self.i] != "]":
                if self.k[self.i] == ",":
                    self.i += 1
                    continue
                if self.k[self.i] == "...":
                    self.i += 1
                self.assignment()
                if self.k[self.i] != "]":
                    self.eat(",")
            self.no_in = kept
            self.i += 1
            return "pattern"
        if k == "{":
            self.object()
            return "pattern"
        if k == "tmpl" or k == "`h":
            self.template()
            return "value"
        if k == "function":
            self.function(self.s[i], False)
            return "value"
        if k == "class":
            self.klass(self.s[i], False)
            return "value"
        if k == "new":
            self.i += 1
            if self.k[self.i] == ".":
                self.i += 1
                self.eat("id")
                return "value"
            self.operand()
            return "value"
        if k == "super":
            self.i += 1
            if self.k[self.i] not in (".", "[", "("):
                self.fail()
            return "value"
        if k == "import":
            self.i += 1
            if self.k[self.i] == ".":
                self.i += 1
                self.eat("id")
            elif self.k[self.i] != "(":
                self.fail()
            return "value"
        self.fail()
        return ""

    def object(self) -> None:
        self.eat("{")
        kept, self.no_in = self.no_in, False
        while self.k[self.i] != "}":
            k, at = self.k[self.i], self.s[self.i]
            if k == "...":
                self.i += 1
                self.assignment()
            elif k == "id" and self.k[self.i + 1] in (",", "}", "="):
                self.i += 1
                self.default()
            else:
                self.modifiers(("async", "get", "set"))
                name = self.key()
                if self.k[self.i] == "(":
                    self.body(name, at)
                else:
                    self.eat(":")
                    self.assignment()
            if self.k[self.i] != "}":
                self.eat(",")
        self.no_in = kept
        self.i += 1


#: Frames of the interpreter that a text may take; some 100 bytes each. Engines give up at far less nesting.
MOST_FRAMES = 5_000_000


def parse(text: str) -> tuple[Tokens, list[Function]]:
    """Tokens and functions of a valid text; SyntaxFault otherwise.

    Nesting takes frames on the heap, of which a text may have MOST_FRAMES, that
    is about 600,000 levels; a text nested deeper than that is refused.
    """
    tokens = lex(text)
    usual = sys.getrecursionlimit()
    try:
        parser = _Parser(tokens)
        try:
            parser.program()
        except RecursionError:
            sys.setrecursionlimit(min(MOST_FRAMES, usual + 12 * len(tokens.kinds)))
            parser = _Parser(tokens)
            parser.program()
    except RecursionError:
        raise SyntaxFault("nesting", len(text)) from None
    finally:
        sys.setrecursionlimit(usual)
    return tokens, parser.functions
