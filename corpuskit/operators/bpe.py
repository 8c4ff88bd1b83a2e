"""Byte-level BPE with a public vocabulary: NFC texts to ids and back, whole texts, in order of nothing but their rows."""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A vocabulary file of at most so many bytes is sent to the tasks.
VOCABULARY_BYTES = 64 << 20
#: Fixed value: how byte_bpe_50k splits a text before it merges.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

_made: dict[str, object] = {}


def _encoding(raw: bytes):
    key = hashlib.sha256(raw).hexdigest()
    if key not in _made:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        _made[key] = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _made[key]


def _vocabulary(df: DataFrame, path: str):
    raw = Path(path).read_bytes()
    if len(raw) > VOCABULARY_BYTES:
        raise ValueError(f"{path} has {len(raw)} bytes; at most {VOCABULARY_BYTES} are sent to tasks")
    return df.sparkSession.sparkContext.broadcast(raw)


def encode(df: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """(id, ids) of each text in NFC; an empty text has no ids, a null one no row. Signs of special tokens are plain text."""
    shared = _vocabulary(df, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(shared.value)
        for b in batches:
            yield pd.DataFrame({id_col: b[id_col], "ids": [enc.encode_ordinary(unicodedata.normalize("NFC", t)) for t in b["_text"]]})

    kept = df.select(id_col, F.col(text_col).alias("_text")).filter("_text is not null")
    return kept.mapInPandas(run, f"`{id_col}` {kept.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, id_col: str, ids: str, path: str) -> DataFrame:
    """(id, text) of each array of ids; bytes that are no UTF-8 become replacement characters, unknown ids raise."""
    shared = _vocabulary(df, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(shared.value)
        for b in batches:
            yield pd.DataFrame({id_col: b[id_col], "text": [enc.decode(list(x), errors="replace") for x in b[ids]]})

    kept = df.select(id_col, ids).filter(F.col(ids).isNotNull())
    return kept.mapInPandas(run, f"`{id_col}` {kept.schema[id_col].dataType.simpleString()}, text string")
