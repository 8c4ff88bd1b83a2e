"""Operators on Python source that need its parser: definitions, fingerprints, comment stripping, categories, SimHash."""

from __future__ import annotations

import ast
import builtins
import gc
import hashlib
import io
import re
import sys
import tokenize
import warnings
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.operators.dedup import greedy_survivors
from corpuskit.runtime import cut, salted_join

_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
BAD = (SyntaxError, ValueError, RecursionError, MemoryError)


def map_texts(df: DataFrame, keep: list[str], text: str, fn: Callable[[str], list[tuple]], columns: list[str], schema: str) -> DataFrame:
    """``keep`` columns and the rows that ``fn`` makes of each text; null texts give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        warnings.simplefilter("ignore")
        for b in batches:
            gc.disable()
            try:
                found = [fn(t) for t in b["_text"]]
            finally:
                gc.enable()
            at = [k for k, rows in enumerate(found) for _ in rows]
            left = b[keep].iloc[at].reset_index(drop=True)
            yield pd.concat([left, pd.DataFrame([r for rows in found for r in rows], columns=columns)], axis=1)

    kept = df.select(*keep, F.col(text).alias("_text")).filter("_text is not null")
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != "_text")
    return kept.mapInPandas(run, f"{head}, {schema}")


def walk_definitions(tree: ast.AST) -> Iterator[tuple[str, str, ast.AST]]:
    """(qualified name, kind, node) of the definitions, outer ones first."""
    todo = [(tree, "", False)]
    while todo:
        node, scope, in_class = todo.pop(0)
        for child in ast.iter_child_nodes(node):
            if isinstance(child, _DEFS):
                is_class = isinstance(child, ast.ClassDef)
                kind = "class" if is_class else ("async_" if isinstance(child, ast.AsyncFunctionDef) else "") + ("method" if in_class else "function")
                yield scope + child.name, kind, child
                todo.append((child, f"{scope}{child.name}.", is_class))
            elif isinstance(child, ast.stmt) or hasattr(child, "body"):
                todo.append((child, scope, in_class))


def definitions(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """(symbol, kind, first_line, last_line, definition_sha256, has_docstring) of each definition; none for texts that don't parse."""

    def fn(source: str) -> list[tuple]:
        try:
            tree = ast.parse(source)
        except BAD:
            return []
        rows = source.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        out = []
        for name, kind, node in walk_definitions(tree):
            first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            body = "\n".join(rows[first - 1 : node.end_lineno])
            digest = hashlib.sha256(body.encode(errors="replace")).hexdigest()
            out.append((name, kind, first, node.end_lineno, digest, ast.get_docstring(node) is not None))
        return out

    cols = ["symbol", "kind", "first_line", "last_line", "definition_sha256", "has_docstring"]
    return map_texts(df, keep, text, fn, cols, "symbol string, kind string, first_line int, last_line int, definition_sha256 string, has_docstring boolean")


def duplicate_symbols(symbols: DataFrame, id_col: str) -> DataFrame:
    """symbols with ``duplicate_of``: the least (id, line) with the same kind and definition; null for that one itself."""
    me = F.struct(F.col(id_col), F.col("first_line"))
    firsts = symbols.groupBy("kind", "definition_sha256").agg(F.min(me).alias("first"))
    return symbols.join(firsts, ["kind", "definition_sha256"]).withColumn("duplicate_of", F.when(F.col("first") != me, F.col("first"))).drop("first")


def strip_comments(source: str) -> str:
    """The source without comments; unchanged where it can't be tokenized."""
    try:
        kept = [t for t in tokenize.generate_tokens(io.StringIO(source).readline) if t.type != tokenize.COMMENT]
        return tokenize.untokenize(kept)
    except (tokenize.TokenError, *BAD, IndexError):
        return source


def fingerprints(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """(sha256, normalized_sha256, ast_sha256): of the text, of its comment-free lines with blanks collapsed, of its syntax tree (null if it doesn't parse)."""

    def fn(source: str) -> list[tuple]:
        bare = strip_comments(source.replace("\r\n", "\n").replace("\r", "\n"))
        lines = [" ".join(x.split()) for x in bare.split("\n") if x.strip()]
        try:
            tree = hashlib.sha256(ast.dump(ast.parse(source)).encode(errors="replace")).hexdigest()
        except BAD:
            tree = None
        return [(hashlib.sha256(source.encode(errors="replace")).hexdigest(), hashlib.sha256("\n".join(lines).encode(errors="replace")).hexdigest(), tree)]

    cols = ["sha256", "normalized_sha256", "ast_sha256"]
    return map_texts(df, keep, text, fn, cols, "sha256 string, normalized_sha256 string, ast_sha256 string")


#: Reasons of the keys of a text, in order.
KEY_REASONS = {"sha256": "exact_sha256_duplicate", "normalized_sha256": "normalized_duplicate", "ast_sha256": "ast_duplicate"}


def global_duplicates(prints: DataFrame, id_col: str) -> DataFrame:
    """(id, reason, duplicate_of): rows in order of id; one is rejected for the first of its keys that an accepted earlier row has.

    Equal texts share all keys, so each class of equal texts stands or falls
    with its least id; classes of equal normalized texts and of equal trees
    overlap, and which rows of those are accepted is settled in order. A key of
    many rows is an edge to each from its least row only where that row is
    accepted, which takes as many rounds as acceptance alternates.
    """
    classes = prints.groupBy("sha256").agg(F.min(id_col).alias("id"), F.first("normalized_sha256").alias("n"), F.first("ast_sha256").alias("t"))
    classes = cut(classes)
    keyed = classes.select("id", F.explode(F.array(F.concat(F.lit("n"), "n"), F.concat(F.lit("t"), "t"))).alias("key")).filter("key is not null")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key")
    keyed = cut(keyed.join(shared, "key"))
    accepted = keyed.select("id").limit(0)
    owners = keyed.select("key", F.col("id").alias("owner")).limit(0)
    open_ = keyed
    # A row that is the least open one of all its keys has no accepted row before it and is accepted; it owns its keys, and their other rows are rejected.
    while not open_.isEmpty():
        least = open_.groupBy("key").agg(F.min("id").alias("low"))
        marked = open_.join(least, "key")
        first = cut(marked.groupBy("id").agg(F.bool_and(F.col("id") == F.col("low")).alias("all_least")).filter("all_least").select("id"))
        accepted = cut(accepted.union(first))
        taken = cut(open_.join(first, "id", "left_semi").select("key", F.col("id").alias("owner")))
        owners = cut(owners.union(taken))
        lost = open_.join(taken.select("key"), "key", "left_semi").select("id").distinct()
        open_ = cut(open_.join(lost, "id", "left_anti"))
    # A copy of a rejected text meets owners of its keys that came after the first one, so rows are looked at one by one.
    named = lambda mark, name: owners.filter(F.col("key").startswith(mark)).select(F.substring("key", 2, 1_000).alias(f"_{name}"), F.col("owner").alias(name))
    rows = prints.select(id_col, "sha256", F.col("normalized_sha256").alias("_by_n"), F.col("ast_sha256").alias("_by_t"))
    rows = rows.join(named("n", "by_n"), "_by_n", "left").join(named("t", "by_t"), "_by_t", "left")
    standing = classes.select("sha256", F.col("id").alias("_first")).join(accepted.select(F.col("id").alias("_first"), F.lit(True).alias("_in")), "_first", "left")
    alone = classes.join(keyed.select("id").distinct(), "id", "left_anti").select(F.col("id").alias("_first"), F.lit(True).alias("_alone"))
    rows = rows.join(standing.join(alone, "_first", "left"), "sha256")
    stands = F.coalesce("_in", "_alone", F.lit(False))
    before = lambda c: F.col(c) < F.col(id_col)
    reason = (
        F.when(stands & (F.col(id_col) == F.col("_first")), None)
        .when(stands, KEY_REASONS["sha256"])
        .when(before("by_n"), KEY_REASONS["normalized_sha256"])
        .otherwise(KEY_REASONS["ast_sha256"])
    )
    of = F.when(stands & (F.col(id_col) == F.col("_first")), None).when(stands, F.col("_first")).when(before("by_n"), F.col("by_n")).otherwise(F.col("by_t"))
    return rows.select(id_col, reason.alias("reason"), of.alias("duplicate_of"))


#: Categories of a file in order, and their order of precedence for the primary one.
CATEGORY_NAMES = (
    "Core Python", "OOP", "Algorithms", "Data Structures", "File Handling", "Exception Handling", "Standard Library", "NumPy", "Pandas", "Matplotlib", "Pytest",
)
PRIMARY_ORDER = (
    "Pytest", "NumPy", "Pandas", "Matplotlib", "Algorithms", "Data Structures", "File Handling", "Exception Handling", "OOP", "Standard Library", "Core Python",
)
#: Words of names that tell a category, modules and methods that do.
ALGORITHM_TERMS = (
    "algorithm", "algorithms", "binary_search", "breadth_first", "bfs", "depth_first", "dfs", "dijkstra", "dynamic_programming", "fibonacci", "knapsack",
    "merge_sort", "quicksort", "quick_sort", "search", "sort", "traverse",
)
STRUCTURE_TERMS = ("binary_tree", "deque", "graph", "hash_map", "heap", "linked_list", "node", "priority_queue", "queue", "stack", "tree", "trie")
STRUCTURE_MODULES = ("collections", "heapq", "queue")
FILE_MODULES = ("csv", "io", "os", "pathlib", "pickle", "shutil", "tempfile")
FILE_METHODS = ("open", "read", "read_bytes", "read_text", "write", "write_bytes", "write_text")


def normalized_name(name: str) -> str:
    """Lower-case words joined by underscores; a capital after a small letter begins a word."""
    return "_".join(re.findall(r"[^\W_]+", re.sub(r"(?<=[a-z\u00df-\u00f6\u00f8-\u00ff])(?=[A-Z\u00c0-\u00d6\u00d8-\u00de])", "_", name))).lower()


def _says(names: set[str], terms: tuple[str, ...]) -> bool:
    return bool(re.search(rf"(?:^|[_ ])(?:{'|'.join(terms)})(?:$|[_ ])", " ".join(names)))


def categories_of(source: str, path: str) -> list[str]:
    """The categories of a file that parses, in the order of CATEGORY_NAMES; Core Python where no other holds."""
    parts = path.replace("\\", "/").split("/")
    imports: set[str] = set()
    names = {normalized_name(p) for p in parts}
    seen: set[str] = set()
    for n in ast.walk(ast.parse(source)):
        match n:
            case ast.Import(names=modules):
                imports |= {m.name.split(".")[0] for m in modules}
            case ast.ImportFrom(module=str(module)):
                imports.add(module.split(".")[0])
            case ast.ClassDef(name=name) | ast.FunctionDef(name=name) | ast.AsyncFunctionDef(name=name):
                names.add(normalized_name(name))
                seen |= {"OOP"} if isinstance(n, ast.ClassDef) else set()
            case ast.Try() | ast.Raise():
                seen.add("Exception Handling")
            case ast.Call(func=ast.Name(id="open")):
                seen.add("File Handling")
            case ast.Call(func=ast.Attribute(attr=method)) if method in FILE_METHODS:
                seen.add("File Handling")
    low = [p.lower() for p in parts]
    rules = {
        "Algorithms": _says(names, ALGORITHM_TERMS),
        "Data Structures": not imports.isdisjoint(STRUCTURE_MODULES) or _says(names, STRUCTURE_TERMS),
        "File Handling": not imports.isdisjoint(FILE_MODULES),
        "Standard Library": not imports.isdisjoint(sys.stdlib_module_names),
        "NumPy": "numpy" in imports,
        "Pandas": "pandas" in imports,
        "Matplotlib": "matplotlib" in imports,
        "Pytest": "pytest" in imports or "tests" in low or parts[-1].startswith("test_"),
    }
    seen |= {name for name, holds in rules.items() if holds}
    return [c for c in CATEGORY_NAMES if c in seen] or ["Core Python"]


def file_categories(df: DataFrame, keep: list[str], text: str = "text", path: str = "path") -> DataFrame:
    """(category, is_primary): one row per category of each file that parses; null paths count as empty."""

    def fn(given: str) -> list[tuple]:
        name, _, source = given.partition("\0")
        try:
            found = categories_of(source, name)
        except BAD:
            return []
        primary = next(c for c in PRIMARY_ORDER if c in found)
        return [(c, c == primary) for c in found]

    both = df.select(*keep, F.concat(F.regexp_replace(F.coalesce(F.col(path), F.lit("")), "\\x00", ""), F.lit("\0"), F.col(text)).alias("_both"))
    return map_texts(both, keep, "_both", fn, ["category", "is_primary"], "category string, is_primary boolean")


_SILENT = {tokenize.ENCODING, tokenize.ENDMARKER, tokenize.INDENT, tokenize.DEDENT, tokenize.NEWLINE, tokenize.NL, tokenize.COMMENT}
_CLASS = {tokenize.NAME: "NAME", tokenize.NUMBER: "NUMBER", tokenize.STRING: "STRING"}


def token_classes(source: str) -> list[str]:
    """Tokens that say something, names, numbers and strings by their kind only; the words where the text can't be tokenized."""
    try:
        stream = list(tokenize.generate_tokens(io.StringIO(source).readline))
    except (tokenize.TokenError, *BAD):
        return source.split()
    return [f"{t.type}:{_CLASS.get(t.type, t.string)}" for t in stream if t.type not in _SILENT]


def token_simhash(source: str, k: int = 5) -> int:
    """64-bit SimHash (signed) over runs of k token classes: a bit is set where at least half of the runs' BLAKE2b hashes have it."""
    tokens = token_classes(source)
    runs = ["\x1f".join(tokens[i : i + k]) for i in range(max(1, len(tokens) - k + 1))]
    counts = Counter(runs)
    hashes = np.array([int.from_bytes(hashlib.blake2b(r.encode(errors="replace"), digest_size=8).digest(), "big") for r in counts], np.uint64)
    weights = np.array(list(counts.values()), np.int64)
    bits = (hashes[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    ones = (bits.astype(np.int64) * weights[:, None]).sum(0)
    return int(np.bitwise_or.reduce((2 * ones >= weights.sum()).astype(np.uint64) << np.arange(64, dtype=np.uint64)).astype(np.int64))


def source_hashes(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """(sha256, ast_sha256, simhash) of each text that parses."""

    def fn(source: str) -> list[tuple]:
        try:
            tree = ast.dump(ast.parse(source))
        except BAD:
            return []
        digest = lambda x: hashlib.sha256(x.encode(errors="replace")).hexdigest()
        return [(digest(source), digest(tree), token_simhash(source))]

    return map_texts(df, keep, text, fn, ["sha256", "ast_sha256", "simhash"], "sha256 string, ast_sha256 string, simhash bigint")


def simhash_links(hashes: DataFrame, id_col: str, most: int = 3) -> DataFrame:
    """(a, b, distance), a < b: distinct texts with an equal 16-bit band and at most ``most`` differing bits. One row per text: copies are left out before."""
    bands = F.array(*[F.xxhash64(F.lit(n), F.shiftrightunsigned("simhash", 16 * n).bitwiseAND(65535)) for n in range(4)])
    keyed = hashes.select(F.col(id_col).alias("x"), "simhash", F.explode(bands).alias("band"))
    right = keyed.select("band", F.col("x").alias("y"), F.col("simhash").alias("other"))
    distance = F.bit_count(F.col("simhash").bitwiseXOR(F.col("other")))
    near = salted_join(keyed, right, "band", "x", "y", both=True).filter("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"), distance.alias("distance"))
    return near.filter(F.col("distance") <= most).distinct()


def index_duplicates(hashes: DataFrame, id_col: str, most: int = 3) -> DataFrame:
    """(id, reason, duplicate_of): normalized_duplicate of an earlier text with the same tree, near_duplicate by SimHash of an accepted one.

    Rows in order of id. Equal texts are no duplicates of each other here (their
    hashes don't tell them apart); a class of equal trees follows its first row.
    """
    texts = cut(hashes.groupBy("sha256", "ast_sha256").agg(F.min(id_col).alias("id"), F.first("simhash").alias("simhash")))
    firsts = texts.groupBy("ast_sha256").agg(F.min(F.struct("id", "simhash")).alias("f")).select("ast_sha256", F.col("f.id").alias("first"), F.col("f.simhash").alias("simhash"))
    firsts = cut(firsts)
    reps = firsts.select(F.col("first").alias("id"), "simhash")
    kept = greedy_survivors(simhash_links(reps, "id", most), reps).withColumnRenamed("id", "first")
    verdict = texts.select("sha256", "id", "ast_sha256").join(firsts.drop("simhash"), "ast_sha256").join(kept, "first")
    reason = F.when(F.col("duplicate_of").isNotNull(), "near_duplicate").when(F.col("id") != F.col("first"), "normalized_duplicate")
    of = F.coalesce("duplicate_of", F.when(F.col("id") != F.col("first"), F.col("first")))
    return hashes.select(id_col, "sha256").join(verdict.select("sha256", reason.alias("reason"), of.alias("of")), "sha256").select(id_col, "reason", F.col("of").alias("duplicate_of"))


_KNOWN = frozenset(dir(builtins)) | {"__file__", "__name__", "__doc__"}


def undefined_of(tree: ast.AST) -> list[str]:
    """Names that a tree loads but nothing in it or the builtins defines."""
    loads: set[str] = set()
    stores = set(_KNOWN)
    for n in ast.walk(tree):
        match n:
            case ast.Name(id=name, ctx=ast.Load()):
                loads.add(name)
            case ast.Name(id=name) | ast.arg(arg=name) | ast.ExceptHandler(name=str(name)):
                stores.add(name)
            case ast.FunctionDef(name=name) | ast.AsyncFunctionDef(name=name) | ast.ClassDef(name=name):
                stores.add(name)
            case ast.MatchAs(name=str(name)) | ast.MatchStar(name=str(name)) | ast.MatchMapping(rest=str(name)):
                stores.add(name)
            case ast.alias(name=name, asname=other):
                stores.add((other or name).split(".")[0])
    return sorted(loads - stores)


def undefined_names(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """(names array<string>): names that a text loads but nothing in it or the builtins defines; none for texts that don't parse."""

    def fn(source: str) -> list[tuple]:
        try:
            return [(undefined_of(ast.parse(source)),)]
        except BAD:
            return []

    return map_texts(df, keep, text, fn, ["names"], "names array<string>")


def is_python(path: Column, text: Column | None = None) -> Column:
    """.py files and, where the text is given, files without extension whose first line is a #! one; null paths are none."""
    named = F.endswith(F.lower(path), F.lit(".py"))
    if text is not None:
        bare = ~F.contains(F.regexp_extract(F.regexp_replace(path, r"\\", "/"), r"([^/]*)\z", 1), F.lit("."))
        named = named | (bare & F.startswith(text, F.lit("#!")))
    return F.coalesce(named, F.lit(False))
