"""Readers: source trees, JSON lines, packed shards."""

from __future__ import annotations

import fnmatch
import gzip
import hashlib
import io
import json
import os
import re
import stat
import zipfile
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Directories that no scan enters.
SKIPPED_DIRS = (".git", "__pycache__", ".pytest_cache", ".ruff_cache", ".mypy_cache", ".tox", ".venv", "venv", "node_modules", "build", "dist")


def glob_column(path: Column, patterns: list[str]) -> Column:
    """Whether a path matches one of the glob patterns, as a regular expression in the JVM; ``**/x`` also means x itself."""
    alts = []
    for p in patterns:
        alts.append(fnmatch.translate(p))
        if p.startswith("**/"):
            alts.append(fnmatch.translate(p[3:]))
            alts.append(fnmatch.translate("*/" + p[3:]))
    out = F.lit(False)
    for a in alts:
        out = out | path.rlike(re.sub(r"\(\?>", "(?:", a).replace(r"\Z", r"\z"))
    return out


def looks_binary(content: Column) -> Column:
    """A NUL byte anywhere, or under 85 % of text-like bytes among the first 4,096."""
    hexed = F.hex(content)
    head = F.substring(hexed, 1, 8192)
    n = F.length(head) / 2
    texty = F.regexp_count(F.regexp_replace(head, "(..)", "$1 "), F.lit("(?:09|0A|0D|[2-6][0-9A-F]|7[0-9A-E]|[89A-F][0-9A-F]) "))
    nul = F.regexp_replace(hexed, "(..)", "$1 ").rlike("(^| )00 ")
    return F.when(n == 0, False).otherwise(nul | (texty / n < 0.85))


def scan_tree(
    spark: SparkSession, root: str, source_id: str, include: list[str] | None = None, exclude: list[str] | None = None, most_bytes: int = 2_000_000
) -> DataFrame:
    """(source_id, relative_path, content, size): files under a root, in no directory that is skipped, neither too large nor binary."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    prefix = re.escape(root.rstrip("/"))
    rel = F.regexp_replace(F.col("path"), f"^(?:file:(?://)?)?{prefix}/", "")
    df = df.select(F.lit(source_id).alias("source_id"), rel.alias("relative_path"), "content", F.col("length").alias("size"))
    parts = "|".join(re.escape(d) for d in SKIPPED_DIRS)
    df = df.filter(F.col("size") <= most_bytes).filter(~F.lower("relative_path").rlike(f"(^|/)({parts})/"))
    if include:
        df = df.filter(glob_column(F.col("relative_path"), include))
    if exclude:
        df = df.filter(~glob_column(F.col("relative_path"), exclude))
    return df.filter(~looks_binary(F.col("content")))


def decoded(content: Column) -> Column:
    """UTF-8 text without byte order mark; null where the bytes are not valid UTF-8."""
    return F.regexp_replace(F.try_validate_utf8(content.cast("string")), "^\ufeff", "")


def read_jsonl_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a line that is no object of the schema raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The schema's fields and ``broken`` (the raw line of one that can't be read, else null); blank lines are skipped."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}
    return lines.select(F.from_json("value", schema + ", broken string", opts).alias("r")).select("r.*")


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """(instruction, input, output): JSON lines whose output may be called output, response or text."""
    text = "instruction string, input string, output string, response string, text string"
    df = read_jsonl_lenient(spark, path, text).filter("broken is null")
    full = lambda c: F.when(F.trim(c) != "", F.col(c))
    return df.select(F.coalesce("instruction", F.lit("")).alias("instruction"), F.coalesce("input", F.lit("")).alias("input"), F.coalesce(full("output"), full("response"), full("text")).alias("output")).filter("output is not null")


def read_text_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(output): paragraphs of text files, split at blank lines."""
    whole = spark.read.option("wholetext", True).text(path)
    parts = F.explode(F.split("value", r"(?:\r?\n[ \t]*){2,}"))
    return whole.select(F.regexp_replace(parts, r"\A\s+|\s+\z", "").alias("output")).filter("output <> ''")


def read_packed(spark: SparkSession, path: str, length: int) -> DataFrame:
    """(shard, sequence, ids): sequences of little-endian 16-bit ids; a file of another size raises."""

    def run(batches):
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                ids = np.frombuffer(content, "<u2")
                if len(ids) % length:
                    raise ValueError(f"{name}: {len(ids)} ids are no sequences of {length}")
                rows = ids.reshape(-1, length).astype(np.int32)
                yield pd.DataFrame({"shard": name.rsplit("/", 1)[-1], "sequence": np.arange(len(rows), dtype=np.int64), "ids": list(rows)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path).select("path", "content")
    return files.mapInPandas(run, "shard string, sequence bigint, ids array<int>")


def scan_sources(spark: SparkSession, roots: dict[str, str], suffixes: tuple[str, ...] = (".py", ".md", ".rst", ".txt"), include: list[str] | None = None, exclude: list[str] | None = None, most_bytes: int = 2_000_000) -> DataFrame:
    """(source_id, relative_path, content, size, content_type) of the files with one of the suffixes under each root, sources in order of their ids."""
    parts = [scan_tree(spark, root, source, include, exclude, most_bytes) for source, root in sorted(roots.items())]
    out = reduce(DataFrame.unionByName, parts)
    suffix = F.lower(F.regexp_extract("relative_path", r"[^./](\.[^./]+)\z", 1))
    return out.filter(suffix.isin(*suffixes)).withColumn("content_type", F.when(suffix == ".py", "python_code").otherwise("technical_text"))


def with_sections(df: DataFrame, path: str) -> DataFrame:
    """df with ``section``, the first part of the path, and ``repository``, the second one where the section is github."""
    parts = F.split(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "^/+", ""), "/")
    several = F.size(parts) > 1
    return df.withColumn("section", F.when(several, parts[0])).withColumn("repository", F.when(several & (F.size(parts) > 2) & (parts[0] == "github"), F.get(parts, F.lit(1))))


def manual_files(files: DataFrame, manifest: DataFrame, path: str = "stored_path") -> DataFrame:
    """Files that no other source owns, as those of the source manual_raw."""
    owned = manifest.filter(F.col(path).isNotNull()).select(path).distinct()
    return files.join(owned, path, "left_anti").withColumn("source_id", F.lit("manual_raw"))


def discover_imports(root: str) -> list[dict[str, str]]:
    """Folders and zip files right under a root, by name, as sources; hidden ones are left out."""
    found = []
    for name in sorted(os.listdir(root)):
        path = os.path.join(root, name)
        kind = "directory" if os.path.isdir(path) else "zip" if name.lower().endswith(".zip") else None
        if kind and not name.startswith("."):
            found.append({"source_id": os.path.splitext(name)[0] if kind == "zip" else name, "type": kind, "location": path})
    return found


def zip_candidates(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".py",), least: int = 16, most: int = 1_000_000) -> DataFrame:
    """(archive, member, size, content, reason) of the files in zip archives; content is null where there is a reason against them.

    archive_read_error (of the archive or a member), unsafe_archive_path,
    archive_symlink, unsupported_extension, generated_file, too_small, too_large.
    """
    from corpuskit.operators.quality import GENERATED_NAMES

    def verdict(info: zipfile.ZipInfo) -> str | None:
        name = info.filename.replace("\\", "/")
        if name.startswith("/") or re.match("[A-Za-z]:", name) or ".." in name.split("/"):
            return "unsafe_archive_path"
        if stat.S_ISLNK(info.external_attr >> 16):
            return "archive_symlink"
        if not name.lower().endswith(suffixes):
            return "unsupported_extension"
        if any(x in name.lower() for x in GENERATED_NAMES):
            return "generated_file"
        return "too_small" if info.file_size < least else "too_large" if info.file_size > most else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                rows: list[tuple] = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for info in sorted(z.infolist(), key=lambda i: i.filename):
                            if info.is_dir():
                                continue
                            why, data = verdict(info), None
                            if why is None:
                                try:
                                    data = z.read(info)
                                except (zipfile.BadZipFile, OSError, RuntimeError, zlib.error, NotImplementedError):
                                    why = "archive_read_error"
                            rows.append((name, info.filename, info.file_size, data, why))
                except (zipfile.BadZipFile, OSError):
                    rows.append((name, None, None, None, "archive_read_error"))
                yield pd.DataFrame(rows, columns=["archive", "member", "size", "content", "reason"]).astype({"size": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInPandas(run, "archive string, member string, size bigint, content binary, reason string")


def _whole_files(spark: SparkSession, path: str, fn, schema: str, columns: list[str]) -> DataFrame:
    """Rows that ``fn`` makes of each file (name, content); a file is read by one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                yield pd.DataFrame(fn(name, content), columns=columns)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def read_jsonl_numbered(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(file, line, record, error): objects of JSON lines as text, with the number of their physical line; blank lines are skipped.

    A line that is no object has an error (invalid_json, no_object) and no
    record; with ``strict`` it raises with its file and line. .gz files are unpacked.
    """

    def fn(name: str, content: bytes) -> list[tuple]:
        text = (gzip.decompress(content) if name.endswith(".gz") else content).decode("utf-8-sig", errors="replace")
        rows = []
        for n, line in enumerate(text.split("\n"), 1):
            if not line.strip():
                continue
            try:
                error = None if isinstance(json.loads(line), dict) else "no_object"
            except ValueError:
                error = "invalid_json"
            if error and strict:
                raise ValueError(f"{name}:{n}: {error}")
            rows.append((name, n, None if error else line.strip(), error))
        return rows

    return _whole_files(spark, path, fn, "file string, line int, record string, error string", ["file", "line", "record", "error"])


def read_example_files(spark: SparkSession, path: str) -> DataFrame:
    """(instruction, input, output) of JSON files: a list of records, an object with examples, data or records, or one record; output may be called response or text."""

    def fn(name: str, content: bytes) -> list[tuple]:
        data = json.loads(content.decode("utf-8-sig"))
        if isinstance(data, dict):
            data = next((data[k] for k in ("examples", "data", "records") if isinstance(data.get(k), list)), [data])
        rows = []
        for r in data:
            if not isinstance(r, dict):
                raise ValueError(f"{name}: a record is no object")
            said = next((r[k] for k in ("output", "response", "text") if isinstance(r.get(k), str) and r[k].strip()), None)
            if said is not None:
                rows.append((r.get("instruction") or "", r.get("input") or "", said))
        return rows

    return _whole_files(spark, path, fn, "instruction string, input string, output string", ["instruction", "input", "output"])


def marker_texts(df: DataFrame, question: str = "<|user|>", answer: str = "<|assistant|>") -> DataFrame:
    """(text): records that are a text, or an instruction and a response joined by markers; records that are both or neither raise."""
    full = lambda c: F.coalesce(F.regexp_replace(c, "(?U)\\s+", "") != "", F.lit(False))
    pair = full("instruction") & full("response")
    joined = F.concat(F.lit(question + "\n"), F.trim("instruction"), F.lit("\n" + answer + "\n"), F.trim("response"))
    wrong = F.raise_error(F.lit("a record is a text, or an instruction and a response"))
    return df.select(F.when(full("text") & ~full("instruction") & ~full("response"), F.col("text")).when(~full("text") & pair, joined).otherwise(wrong).alias("text"))


def full_pairs(df: DataFrame) -> DataFrame:
    """Records with an instruction and a response that aren't blank, trimmed."""
    t = lambda c: F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")
    return df.withColumns({"instruction": t("instruction"), "response": t("response")}).filter("instruction <> '' and response <> ''")


def strings_of_json(c: Column) -> Column:
    """All strings within a JSON value, in order; none for what isn't JSON."""

    def walk(x) -> Iterator[str]:
        todo = [x]
        while todo:
            v = todo.pop()
            if isinstance(v, str):
                yield v
            elif isinstance(v, (list, dict)):
                todo.extend(reversed(list(v.values()) if isinstance(v, dict) else v))

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def strings(x: str | None) -> list[str]:
            try:
                return list(walk(json.loads(x))) if x is not None else []
            except (ValueError, RecursionError):
                return []

        for s in batches:
            yield s.map(strings)

    return run(c)


def within_bytes(df: DataFrame, order: str, text: str, budget: int) -> DataFrame:
    """Texts in order up to ``budget`` bytes in all; the last one is cut, never within a character."""
    from corpuskit.operators.windows import running_offsets

    sized = df.filter(F.col(text).isNotNull()).withColumn("_n", F.octet_length(text).cast("bigint"))
    before = running_offsets(sized, order, "_n", "_before").filter(F.col("_before") < budget)
    room = F.lit(budget) - F.col("_before")
    # The bytes that fit, without those of a character that doesn't: hex digits of its lead and continuation bytes are taken off.
    raw = F.hex(F.substring(F.encode(text, "UTF-8"), F.lit(1), room.cast("int")))
    whole = F.regexp_replace(raw, "(?:[CDEF][0-9A-F])(?:[89AB][0-9A-F])*$", "")
    last = F.regexp_extract(raw, "((?:[CDEF][0-9A-F])(?:[89AB][0-9A-F])*)$", 1)
    wanted = F.when(F.startswith(last, F.lit("F")), 8).when(F.startswith(last, F.lit("E")), 6).when(last != "", 4).otherwise(0)
    cut_text = F.decode(F.unhex(F.when(F.length(last) == wanted, raw).otherwise(whole)), "UTF-8")
    return before.withColumn(text, F.when(F.col("_n") <= room, F.col(text)).otherwise(cut_text)).drop("_n", "_before")


def read_indexed(spark: SparkSession, folder: str) -> DataFrame:
    """(sequence, ids): sequences of packed shards numbered through, after the index file of their folder; sizes that differ from it raise."""
    with open(os.path.join(folder, "index.json")) as f:
        index = json.load(f)
    length, first, at = index["sequence_length"], {}, 0
    for shard in index["shards"]:  # one entry per file
        path = os.path.join(folder, f"{shard['shard']}.bin")
        if os.path.getsize(path) != shard["bytes"]:
            raise ValueError(f"{path} has not the {shard['bytes']} bytes of the index")
        first[f"{shard['shard']}.bin"] = at
        at += shard["sequences"]
    starts = F.create_map(*[F.lit(x) for kv in first.items() for x in kv]) if first else F.create_map()
    return read_packed(spark, folder, length).select((F.element_at(starts, F.col("shard")) + F.col("sequence")).alias("sequence"), "ids")


def shard_problems(folder: str) -> list[str]:
    """What is wrong with a folder of packed shards against its index: missing or strange files, sizes, digests, totals. Empty if it is ready to be read."""
    path = os.path.join(folder, "index.json")
    if not os.path.exists(path):
        return ["index.json is missing"]
    with open(path) as f:
        index = json.load(f)
    wrong = []
    for shard in index["shards"]:
        file = os.path.join(folder, f"{shard['shard']}.bin")
        if not os.path.exists(file):
            wrong.append(f"{shard['shard']} is missing")
            continue
        if os.path.getsize(file) != shard["bytes"] or shard["bytes"] != 2 * shard["sequences"] * index["sequence_length"]:
            wrong.append(f"{shard['shard']} has another size")
        with open(file, "rb") as f:
            if "sha256" in shard and hashlib.file_digest(f, "sha256").hexdigest() != shard["sha256"]:
                wrong.append(f"{shard['shard']} has another digest")
    named = {f"{s['shard']}.bin" for s in index["shards"]}
    wrong += [f"{x} is not in the index" for x in sorted(os.listdir(folder)) if x.endswith(".bin") and x not in named]
    if index["sequences"] != sum(s["sequences"] for s in index["shards"]):
        wrong.append("the number of sequences differs")
    return wrong
