"""Instruction records out of Python files: eleven kinds of pairs per definition, chosen by a seeded rank where a file has a limit."""

from __future__ import annotations

import ast
import hashlib
import re
import textwrap
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from corpuskit.operators.pysource import BAD, map_texts, walk_definitions

#: The kinds of pairs, in order, and those whose output is Python.
CATEGORIES = (
    "code_generation", "explanation", "bug_fixing", "refactoring", "documentation", "unit_testing", "optimization", "complexity_analysis", "type_hints",
    "code_completion", "api_usage",
)
PYTHON_CATEGORIES = frozenset(CATEGORIES) - {"explanation", "documentation", "complexity_analysis"}
#: Fields that a template may name.
TEMPLATE_FIELDS = ("api", "base_instruction", "description", "kind", "name", "qualified_name", "signature")
TEMPLATES = {
    "code_generation": "{base_instruction}",
    "explanation": "Explain what the {kind} `{qualified_name}` does.",
    "bug_fixing": "Find and mend the bug in `{qualified_name}`.",
    "refactoring": "Put `{qualified_name}` into its normal form.",
    "documentation": "Write the docstring of `{qualified_name}`.",
    "unit_testing": "Write the test `{qualified_name}`.",
    "optimization": "Make `{qualified_name}` faster without changing what it returns.",
    "complexity_analysis": "How do time and space of `{qualified_name}` grow?",
    "type_hints": "Add type hints to `{qualified_name}`.",
    "code_completion": "Complete the body of `{qualified_name}`.",
    "api_usage": "Show how `{qualified_name}` uses `{api}`.",
}
#: What the special methods do.
SPECIAL_METHODS = {
    "__init__": "initialize an instance",
    "__call__": "make instances callable",
    "__enter__": "enter a managed context",
    "__exit__": "leave a managed context",
    "__iter__": "iterate over the available values",
    "__next__": "return the next available value",
    "__len__": "report the number of contained values",
    "__getitem__": "retrieve an item by key or index",
    "__setitem__": "store an item by key or index",
    "__str__": "produce a readable string representation",
    "__repr__": "produce a developer-facing representation",
}


def action(name: str) -> str:
    """What a name says in words: camel case and underscores are split, special methods have texts of their own."""
    if name in SPECIAL_METHODS:
        return SPECIAL_METHODS[name]
    words = re.findall(r"[^\W_]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", name))
    return " ".join(words).lower() or "provide the defined behavior"


def check_templates(templates: dict[str, str]) -> dict[str, str]:
    """The default templates with the given ones in place; unknown categories and fields raise."""
    for category, template in templates.items():
        fields = set(re.findall(r"\{(\w*)\}", template))
        if category not in CATEGORIES or not fields <= set(TEMPLATE_FIELDS):
            raise ValueError(f"template {category}: {sorted(fields - set(TEMPLATE_FIELDS)) or 'unknown category'}")
    return TEMPLATES | templates


@dataclass
class Element:
    symbol: str
    kind: str
    node: ast.AST
    code: str  # as written, without the decorators' indentation
    doc: str | None
    imports: dict[str, str]  # bound name: statement that binds it

    @property
    def is_class(self) -> bool:
        return self.kind == "class"

    def own(self) -> Iterator[ast.AST]:
        """Nodes of the definition, those of definitions inside it left out."""
        todo = list(ast.iter_child_nodes(self.node))
        while todo:
            n = todo.pop()
            yield n
            if not isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                todo.extend(ast.iter_child_nodes(n))

    def signature(self) -> str:
        return self.symbol if self.is_class else f"{self.symbol}({ast.unparse(self.node.args)})"


# Single edits, by the type of the node that they break.

_OPPOSITE = {
    ast.Lt: ast.GtE, ast.GtE: ast.Lt, ast.Gt: ast.LtE, ast.LtE: ast.Gt, ast.Eq: ast.NotEq, ast.NotEq: ast.Eq, ast.In: ast.NotIn, ast.NotIn: ast.In,
    ast.Is: ast.IsNot, ast.IsNot: ast.Is,
}
_SWAPPED = {ast.Add: ast.Sub, ast.Sub: ast.Add}


def _edit(node: ast.AST) -> tuple[str, object] | None:
    """The attribute and its new value that break this node, if it is one that can be broken."""
    match node:
        case ast.Compare(ops=[first, *rest]) if type(first) in _OPPOSITE:
            return "ops", [_OPPOSITE[type(first)](), *rest]
        case ast.Constant(value=bool(value)):
            return "value", not value
        case ast.BinOp(op=op) if type(op) in _SWAPPED:
            return "op", _SWAPPED[type(op)]()
    return None


def _unparsed_with(changes: list[tuple[ast.AST, str, object]], node: ast.AST) -> str:
    """The definition's text with some attributes changed; the tree is as before afterwards."""
    kept = [(n, name, getattr(n, name)) for n, name, _ in changes]
    try:
        for n, name, value in changes:
            setattr(n, name, value)
        return ast.unparse(node)
    finally:
        for n, name, value in kept:
            setattr(n, name, value)


def with_a_bug(node: ast.AST) -> str | None:
    """The definition with its first comparison, truth value or sum (from the outside in, left to right) turned round."""
    todo = [node]
    while todo:
        n = todo.pop()
        if edit := _edit(n):
            return _unparsed_with([(n, *edit)], node)
        todo.extend(reversed(list(ast.iter_child_nodes(n))))
    return None


def _documented_body(body: list[ast.stmt]) -> tuple[list[ast.stmt], list[ast.stmt]]:
    """The docstring statement, if any, and the rest."""
    first = bool(body) and isinstance(body[0], ast.Expr) and isinstance(body[0].value, ast.Constant) and isinstance(body[0].value.value, str)
    return body[:first], body[first:]


def as_comprehension(node: ast.AST) -> str | None:
    """A function that fills an empty list by one loop of appends and returns it, with a list comprehension in their place."""
    if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
        return None
    doc, rest = _documented_body(node.body)
    match rest:
        case [
            ast.Assign(targets=[ast.Name(id=made)], value=ast.List(elts=[])) | ast.AnnAssign(target=ast.Name(id=made), value=ast.List(elts=[])),
            ast.For(body=[step], orelse=[]) | ast.AsyncFor(body=[step], orelse=[]),
            ast.Return(value=ast.Name(id=given)),
        ] if made == given:
            loop = rest[1]
        case _:
            return None
    tests = []
    if isinstance(step, ast.If) and not step.orelse and len(step.body) == 1:
        tests, step = [step.test], step.body[0]
    match step:
        case ast.Expr(value=ast.Call(func=ast.Attribute(value=ast.Name(id=target), attr="append"), args=[item], keywords=[])) if target == made:
            part = ast.comprehension(target=loop.target, iter=loop.iter, ifs=tests, is_async=int(isinstance(loop, ast.AsyncFor)))
        case _:
            return None
    return _unparsed_with([(node, "body", [*doc, ast.Return(value=ast.ListComp(elt=item, generators=[part]))])], node)


def _hints(node: ast.AST) -> list[ast.arg]:
    a = node.args
    return [x for x in (*a.posonlyargs, *a.args, *a.kwonlyargs, a.vararg, a.kwarg) if x is not None]


def _without_hints(node: ast.AST) -> str | None:
    hinted = [(x, "annotation", None) for x in _hints(node) if x.annotation]
    if not hinted and node.returns is None:
        return None
    return _unparsed_with([*hinted, (node, "returns", None)], node)


def _with_body(node: ast.AST, body: list[ast.stmt]) -> str:
    return _unparsed_with([(node, "body", body)], node)


def loop_depth(e: Element) -> int:
    """The deepest nesting of loops, definitions inside left out."""
    deepest, todo = 0, [(e.node, 0)]
    while todo:
        n, depth = todo.pop()
        if n is not e.node and isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            continue
        depth += isinstance(n, (ast.For, ast.AsyncFor, ast.While))
        deepest = max(deepest, depth)
        todo.extend((c, depth) for c in ast.iter_child_nodes(n))
    return deepest


def _complexity(e: Element) -> str | None:
    if e.is_class:
        return None
    depth = loop_depth(e)
    recursive = any(isinstance(n, ast.Call) and getattr(n.func, "id", getattr(n.func, "attr", None)) == e.node.name for n in e.own())
    if not depth and not recursive:
        return None
    collects = any(isinstance(n, (ast.ListComp, ast.SetComp, ast.DictComp, ast.List, ast.Set, ast.Dict)) for n in e.own())
    time = ("O(n)" if depth == 1 else f"O(n^{depth})") if depth else "as its recurrence says"
    said = f"Loops are nested {depth} deep, so time grows as {time}." if depth else f"It calls itself; time grows {time}."
    if depth and recursive:
        said += " It also calls itself."
    return f"{said} Space is {'O(n), as it builds collections' if collects else 'O(1) but for the call stack and what it returns'}."


def _explanation(e: Element) -> str:
    said = [f"`{e.node.name}` is a {e.kind.replace('_', ' ')}."]
    if e.doc:
        said.append(f"It is documented as: {' '.join(e.doc.split()).split('. ')[0].rstrip('.')}.")
    else:
        said.append(f"Its name says that it is to {action(e.node.name)}.")
    if e.is_class:
        methods = [n.name for n in e.node.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
        if methods:
            said.append(f"Its methods are {', '.join(f'`{m}`' for m in methods)}.")
        if e.node.bases:
            said.append(f"It derives from {', '.join(f'`{ast.unparse(b)}`' for b in e.node.bases)}.")
    else:
        if given := ast.unparse(e.node.args):
            said.append(f"It takes `{given}`.")
        if e.node.returns is not None:
            said.append(f"It returns `{ast.unparse(e.node.returns)}`.")
        raised = {ast.unparse(n.exc).split("(")[0] for n in e.own() if isinstance(n, ast.Raise) and n.exc is not None}
        if raised:
            said.append(f"It may raise {', '.join(f'`{x}`' for x in sorted(raised))}.")
    if e.node.decorator_list:
        said.append(f"It is decorated with {', '.join(f'`{ast.unparse(d)}`' for d in e.node.decorator_list)}.")
    return " ".join(dict.fromkeys(said))


def _request(e: Element) -> str:
    """What the definition is to do: its docstring's first paragraph, or else its signature and name."""
    if e.doc and e.doc.strip():
        return " ".join(re.split(r"\n\s*\n", e.doc.strip())[0].split())
    kind = e.kind.replace("_", " ")
    fields = [n.target.id for n in getattr(e.node, "body", ()) if isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name)] if e.is_class else []
    held = f" with the fields {', '.join(f'`{f}`' for f in fields)}" if fields else ""
    return f"Write the {kind} `{e.signature()}`{held}. Use it to {action(e.node.name)}."


def _test(e: Element) -> tuple[str, str] | None:
    name = e.node.name.lower()
    return ("", e.code) if name.startswith("test" if e.is_class else "test_") or name == "test" else None


def _api(e: Element) -> tuple[str, str] | None:
    name = used_import(e)
    return (e.imports[name], e.code) if name else None


def used_import(e: Element) -> str | None:
    """The first imported name, in order of the imports, that the definition reads."""
    if not e.imports:
        return None
    read = {n.id for n in ast.walk(e.node) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load)}
    return next((n for n in e.imports if n in read), None)


def _documentation(e: Element) -> tuple[str, str] | None:
    return (_with_body(e.node, _documented_body(e.node.body)[1] or [ast.Pass()]), e.doc) if e.doc and e.doc.strip() else None


def _refactoring(e: Element) -> tuple[str, str] | None:
    normal = ast.unparse(e.node)
    return (e.code, normal) if normal.strip() != e.code.strip() else None


def _given(first: str | None, second: str | None) -> tuple[str, str] | None:
    return None if first is None or second is None else (first, second)


#: (input, output) of each kind of pair, or none where it doesn't apply.
PAYLOADS: dict[str, Callable[[Element], tuple[str, str] | None]] = {
    "code_generation": lambda e: ("", e.code),
    "explanation": lambda e: (e.code, _explanation(e)),
    "bug_fixing": lambda e: _given(with_a_bug(e.node), e.code),
    "refactoring": _refactoring,
    "documentation": _documentation,
    "unit_testing": _test,
    "optimization": lambda e: _given(e.code, as_comprehension(e.node)),
    "complexity_analysis": lambda e: _given(e.code, _complexity(e)),
    "type_hints": lambda e: None if e.is_class else _given(_without_hints(e.node), e.code),
    "code_completion": lambda e: (_with_body(e.node, [ast.Expr(ast.Constant(...))]), e.code),
    "api_usage": _api,
}


def elements(source: str) -> list[Element]:
    """The definitions of a text; SyntaxError and the like where it doesn't parse."""
    tree = ast.parse(source)
    lines = source.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    imports: dict[str, str] = {}
    for n in ast.walk(tree):
        if isinstance(n, (ast.Import, ast.ImportFrom)):
            for a in n.names:
                imports.setdefault(a.asname or a.name.split(".")[0], ast.unparse(n))
    out = []
    for symbol, kind, node in walk_definitions(tree):
        first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        out.append(Element(symbol, kind, node, textwrap.dedent("\n".join(lines[first - 1 : node.end_lineno])), ast.get_docstring(node), imports))
    return out


def _instruction(e: Element, category: str, templates: dict[str, str]) -> str:
    name = used_import(e) if category == "api_usage" else None
    fields = {
        "api": name or "Python", "base_instruction": _request(e), "description": " ".join((e.doc or "").split()), "kind": e.kind.replace("_", " "), "name": e.node.name,
        "qualified_name": e.symbol, "signature": e.signature(),
    }
    return re.sub(r"\{(\w+)\}", lambda m: fields[m[1]], templates[category])


def chosen(candidates: list[tuple[str, str, tuple]], most: int | None) -> list[tuple]:
    """Of (rank, category, row): all, or at most ``most``: the first in rank of each category, categories in order, then by rank."""
    if most is None or len(candidates) <= most:
        return [row for _, _, row in candidates]
    ranked = sorted(candidates, key=lambda c: c[0])
    firsts = [next((c for c in ranked if c[1] == category), None) for category in CATEGORIES]
    picked = [c for c in firsts if c is not None][:most]
    picked += [c for c in ranked if c not in picked][: most - len(picked)]
    return [row for _, _, row in sorted(picked, key=lambda c: c[0])]


def instruction_pairs(
    df: DataFrame, keep: list[str], text: str = "text", most: int | None = None, seed: int = 42, templates: dict[str, str] | None = None
) -> DataFrame:
    """(category, symbol, instruction, input, output, content_sha256) records of each file's functions, methods and classes.

    ``most`` is the number of records that a file may give, a setting of the
    data set (by default all): the best ranked of each category first, then by
    rank, a hash of seed, content, symbol, line and category. ``templates`` are
    texts with the fields of TEMPLATE_FIELDS. Null texts and those that don't
    parse give none.
    """
    texts = check_templates(templates or {})

    def fn(source: str) -> list[tuple]:
        try:
            found = elements(source)
        except BAD:
            return []
        digest = hashlib.sha256(source.encode(errors="replace")).hexdigest()
        candidates = []
        for e in found:
            for category, payload in PAYLOADS.items():
                try:
                    got = payload(e)
                except BAD:
                    continue
                if got is not None:
                    rank = hashlib.sha256(f"{seed}\0{digest}\0{e.symbol}\0{e.node.lineno}\0{category}".encode(errors="replace")).hexdigest()
                    candidates.append((rank, category, (category, e.symbol, _instruction(e, category, texts), *got, digest)))
        return chosen(candidates, most)

    cols = ["category", "symbol", "instruction", "input", "output", "content_sha256"]
    return map_texts(df, keep, text, fn, cols, ", ".join(f"{c} string" for c in cols))
