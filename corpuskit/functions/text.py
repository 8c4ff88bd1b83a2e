"""Scalar text expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folded spellings of licenses and their identifiers.
LICENSE_ALIASES = {
    "mit": "MIT",
    "mitlicense": "MIT",
    "apache20": "Apache-2.0",
    "apache2": "Apache-2.0",
    "apachelicense20": "Apache-2.0",
    "bsd2clause": "BSD-2-Clause",
    "bsd2": "BSD-2-Clause",
    "bsd3clause": "BSD-3-Clause",
    "bsd3": "BSD-3-Clause",
    "isc": "ISC",
    "isclicense": "ISC",
    "unlicense": "Unlicense",
    "theunlicense": "Unlicense",
    "mpl20": "MPL-2.0",
    "mozillapubliclicense20": "MPL-2.0",
}
#: Words as the vocabulary counts them: letters, marks and digits with inner apostrophes, or one other sign.
TOKEN = r"(?U)[\p{L}\p{M}\p{N}]+(?:'[\p{L}\p{M}\p{N}]+)*|[^\s\p{L}\p{M}\p{N}]"


def lookup(c: Column, table: dict[str, str]) -> Column:
    """The value of a small fixed table; null where it has none."""
    keys = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.try_element_at(keys, c)


def normalize_source(t: Column) -> Column:
    """LF line ends, no trailing NULs, no control characters but tab and line feed."""
    t = F.regexp_replace(t, "\r\n?", "\n")
    t = F.regexp_replace(t, "\\x00+\\z", "")
    return F.regexp_replace(t, "[\\x00-\\x08\\x0B-\\x1F]", "")


def normalize_lines(t: Column) -> Column:
    """Lines without trailing blanks, at most three line feeds in a row, one at the end."""
    t = F.regexp_replace(normalize_source(t), "[ \\t]+(?=\\n|\\z)", "")
    t = F.regexp_replace(t, "\\n{4,}", "\n\n\n")
    return F.concat(F.regexp_replace(t, "\\A\\s+|\\s+\\z", ""), F.lit("\n"))


def normalize_for_dedup(t: Column) -> Column:
    """Without # comments and letter case, blanks collapsed."""
    t = F.lower(F.regexp_replace(t, "(?d)#.*", ""))
    return F.trim(F.regexp_replace(t, "(?U)\\s+", " "))


def collapse_blanks(t: Column) -> Column:
    return F.trim(F.regexp_replace(t, "(?U)\\s+", " "))


def normalize_license(c: Column) -> Column:
    return lookup(F.regexp_replace(F.lower(c), "[^a-z0-9]+", ""), LICENSE_ALIASES)


def first_license(names: Column) -> Column:
    """The first of an array of spellings that is known; null if none is."""
    return F.get(F.filter(F.transform(names, normalize_license), lambda x: x.isNotNull()), F.lit(0))


def file_name(path: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(path, r"\\", "/"), r"([^/]*)\z", 1)


def suffix(path: Column) -> Column:
    """The last extension of the file name, lower case, with its dot; empty if none."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.](\.[^.]+)\z", 1))


def content_type(path: Column) -> Column:
    return F.when(suffix(path) == ".py", "python_code").otherwise("technical_text")


def language_of_suffix(path: Column) -> Column:
    names = {".py": "Python", ".md": "Markdown", ".rst": "reStructuredText", ".txt": "Text", ".js": "JavaScript", ".json": "JSON", ".toml": "TOML"}
    return F.coalesce(lookup(suffix(path), names), F.lit("Other"))


def split_identifier(c: Column) -> Column:
    """Words of an identifier, lower case, joined by underscores."""
    c = F.regexp_replace(c, "(?<=[a-z0-9])(?=[A-Z])", "_")
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def word_count(t: Column) -> Column:
    """Parts between blanks that hold a letter or digit, underscores counting as blanks."""
    parts = F.split(F.regexp_replace(t, "_", " "), "(?U)\\s+")
    return F.size(F.filter(parts, lambda x: x.rlike("[\\p{L}\\p{N}]")))


def tokens(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0))


def ngrams(words: Column, k: int) -> Column:
    """Distinct runs of k words, joined by blanks; none for shorter arrays."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.array_join(F.slice(words, i, k), " "))
    return F.when(F.size(words) >= k, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def text_hash(*parts: Column) -> Column:
    """SHA-256 of the parts, separated by NUL."""
    joined = parts[0]
    for p in parts[1:]:
        joined = F.concat(joined, F.lit("\x00"), p)
    return F.sha2(joined, 256)


def truncate_instruction(c: Column, most: int) -> Column:
    """At most ``most`` characters; cut at a blank and marked with an ellipsis."""
    head = F.substring(c, 1, most - 1)
    cut = F.regexp_replace(head, "\\s+\\S*\\z", "")
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.rtrim(cut), F.lit("…")))


def unique_sentences(c: Column) -> Column:
    """Sentences without repeats, in order."""
    parts = F.transform(F.split(c, "(?<=[.!?])\\s+"), collapse_blanks)
    return F.array_join(F.array_distinct(F.filter(parts, lambda x: x != "")), " ")


def readable_size(n: Column) -> Column:
    out = F.format_string("%.2f GiB", n / F.lit(1024.0**3))
    for unit, k in (("MiB", 2), ("KiB", 1)):
        out = F.when(n < F.lit(1024 ** (k + 1)), F.format_string(f"%.2f {unit}", n / F.lit(1024.0**k))).otherwise(out)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(out)


def first_fenced_block(c: Column) -> Column:
    """The first non-empty fenced block tagged python, py or nothing; empty if none."""
    fence = F.lit(r"(?s)```([^\n`]*)\n(.*?)```")
    tags, bodies = F.regexp_extract_all(c, fence, F.lit(1)), F.regexp_extract_all(c, fence, F.lit(2))
    bare = lambda x: F.regexp_replace(x, "\\A\\s+|\\s+\\z", "")
    wanted = F.zip_with(tags, bodies, lambda t, x: F.when(F.lower(F.trim(t)).isin("", "py", "python"), bare(x)))
    full = F.filter(wanted, lambda x: x != "")
    return F.coalesce(F.try_element_at(full, F.lit(1)), F.lit(""))


def hash_bucket(h: Column, buckets: int = 10_000) -> Column:
    """A number from the first eight hex digits of a hash."""
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % buckets


def hash_split(h: Column, validation_percent: float = 2) -> Column:
    return F.when(hash_bucket(h) < int(validation_percent * 100), "validation").otherwise("train")


def builder_text(t: Column) -> Column:
    """LF line ends, no blanks at line ends, none around the text, one line feed at the end."""
    t = F.regexp_replace(F.regexp_replace(t, "\r\n?", "\n"), r"(?U)[\s\x1c-\x1f&&[^\n]]+(?=\n|\z)", "")
    return F.concat(F.regexp_replace(t, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", ""), F.lit("\n"))


#: Typographic quotes and dashes and their plain forms.
QUOTES = {"'": "‘’‚‛′", '"': "“”„‟″"}
DASHES = {"-": "‐‑‒–—―−"}


def plain_signs(t: Column, quotes: bool = True, dashes: bool = True) -> Column:
    """Typographic quotes and dashes in their plain forms."""
    for plain, signs in {**(QUOTES if quotes else {}), **(DASHES if dashes else {})}.items():
        t = F.translate(t, signs, plain * len(signs))
    return t


#: The markers of a conversation.
MARKERS = ("<|system|>", "<|user|>", "<|assistant|>")


def assistant_response(t: Column, stops: tuple[str, ...] = (), assistant: str = MARKERS[2]) -> Column:
    """What follows the last assistant marker, up to the first other marker or stop; no blanks at line ends, no blank lines around."""
    import re

    last = F.substring_index(F.regexp_replace(t, r"(?U)\A\s+|\s+\z", ""), assistant, -1)
    ends = "|".join(re.escape(m) for m in dict.fromkeys((*stops, *MARKERS)))
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(last, rf"(?s)\A(.*?)(?:(?:{ends}).*)?\z", 1), r"[ \t]+(?=\n|\z)", ""), r"(?U)\A\s+|\s+\z", "")


def category_name(c: Column) -> Column:
    """An identifier as lower-case words joined by underscores; a capital after a small letter begins a word."""
    c = F.regexp_replace(c, r"(?<=\p{Ll})(?=\p{Lu})", "_")
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")


def canonical_json(*columns: str) -> Column:
    """The columns as JSON with sorted keys and no blanks; nulls are left out."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))


def fingerprint(*columns: str) -> Column:
    """SHA-256 of the canonical JSON of the columns."""
    return F.sha2(canonical_json(*columns), 256)
