"""Evaluation texts leaking into training text, by spaced-seed hashing."""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.shingles import mix, word_hashes
from corpuskit.runtime import cut, salted_join

#: Masks over consecutive words; zeros are ignored. A passage of at least 20
#: words with at most one error in seven has a run of 5 clean words, so the
#: first mask alone misses none; the others meet passages with a changed word
#: inside and give more starting points.
MASKS = ("11111", "1101101", "11010011")
LEAST, PER_ERROR = 20, 7
#: A qualifying passage of 40 words or more has a qualifying half, so no more errors need be followed.
MOST_ERRORS = 5

_TAG = re.compile(r"</?(?:b|i|u|s|em|strong|code|pre|p|br|span|div|a|li|ul|ol|h[1-6]|sub|sup|mark|tt|kbd)(?:\s[^<>]{0,200})?/?>", re.I)
_WORD = re.compile(r"[^\W_]+")


def passage_words(text: str | None) -> list[str]:
    """Words without case, punctuation, markup and line starts."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_INVISIBLE)
    return _WORD.findall(text.lower())


_INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_ODD = np.random.default_rng(77).integers(1, 2**63, max(map(len, MASKS)), dtype=np.uint64) | np.uint64(1)


def seeds(a: np.ndarray, mask: str) -> np.ndarray:
    """Hashes of the words under the mask, from each place on."""
    n = len(a) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    g = np.full(n, len(mask), np.uint64)
    for j, c in enumerate(mask):
        if c == "1":
            g += a[j : j + n] * _ODD[j]
    return mix(g)


def _reach(a: np.ndarray, b: np.ndarray) -> list[int]:
    """For 0..MOST_ERRORS errors: most words of a, from its start, that b follows; 'furthest reaching' edit paths."""
    n, m = len(a), len(b)

    def slide(i: int, d: int) -> int:
        while i < n and i + d < m and a[i] == b[i + d]:
            i += 1
        return i

    far = {0: slide(0, 0)}
    out = [far[0]]
    for _ in range(MOST_ERRORS):
        step: dict[int, int] = {}
        for d, i in far.items():
            for dd, ii in ((d, i + 1), (d - 1, i + 1), (d + 1, i)):  # changed, dropped, added
                if ii <= n and 0 <= ii + dd <= m and step.get(dd, -1) < ii:
                    step[dd] = ii
        far = {d: slide(i, d) for d, i in step.items()}
        out.append(max(far.values(), default=out[-1]))
    return out


def holds(a: np.ndarray, b: np.ndarray, hits: Iterable[tuple[int, int]]) -> bool:
    """Whether a holds LEAST consecutive words of b with at most one error in PER_ERROR, around hits (place in a, place in b)."""
    done: set[tuple[int, int]] = set()
    span = 3 * LEAST
    for p, q in hits:
        # The clean run around the seed's first word stands for all seeds in it.
        while p > 0 and q > 0 and a[p - 1] == b[q - 1]:
            p, q = p - 1, q - 1
        if (p, q) in done:
            continue
        done.add((p, q))
        right = _reach(b[q : q + span], a[p : p + span + MOST_ERRORS])
        left = _reach(b[max(0, q - span) : q][::-1], a[max(0, p - span - MOST_ERRORS) : p][::-1])
        if any(
            x + y >= max(LEAST, PER_ERROR * (i + j))
            for i, x in enumerate(right)
            for j, y in enumerate(left[: MOST_ERRORS + 1 - i])
        ):
            return True
    return False


def item_texts(items: DataFrame, item_id: str, fields: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(owners: text_id, item_id) and (texts: text_id, words binary) of the fields of at least LEAST words; equal texts are one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for b in batches:
            rows = []
            for i, text in zip(b["item"], b["text"]):
                words = passage_words(text)
                if len(words) >= LEAST:
                    rows.append((i, xxhash.xxh3_128_hexdigest("\0".join(words)), word_hashes(words).tobytes()))
            yield pd.DataFrame(rows, columns=["item", "digest", "words"])

    given = items.select(F.col(item_id).alias("item"), F.explode(F.array(*[F.col(f) for f in fields])).alias("text"))
    every = cut(given.filter("item is not null and text is not null").mapInPandas(run, "item bigint, digest string, words binary"))
    # Short numbers in place of digests: they go along with every hit. They are given once, before the cut.
    texts = cut(every.select("digest", "words").dropDuplicates(["digest"]).withColumn("text_id", F.monotonically_increasing_id()))
    return every.select("digest", "item").distinct().join(texts.select("digest", "text_id"), "digest").select("text_id", "item"), texts.select("text_id", "words")


def text_seeds(texts: DataFrame) -> DataFrame:
    """(seed, text_id, q, mask): the seeds of the test texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for t, raw in zip(b["text_id"], b["words"]):
                a = np.frombuffer(raw, np.uint64)
                for k, mask in enumerate(MASKS):
                    h = seeds(a, mask).view(np.int64)
                    yield pd.DataFrame({"seed": h, "text_id": t, "q": np.arange(len(h), dtype=np.int32), "mask": np.int32(k)})

    return texts.mapInPandas(run, "seed bigint, text_id bigint, q int, mask int")


#: A Bloom filter has 2**LEAST_BITS to 2**MOST_BITS bits (32 MB), 32 or more a seed as far as that allows; a fuller one only lets more seeds through.
LEAST_BITS, MOST_BITS, PROBES = 16, 28, 4
_CHUNK = 16  # bits of the number of a slot within one chunk of the filter


def _slots(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """The slots of a Bloom filter that a seed sets."""
    step = mix(h) | np.uint64(1)
    return [(h + np.uint64(k) * step) >> np.uint64(64 - bits) for k in range(PROBES)]


def bloom(known: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """(packed bits, their number as a power of two) of the ``n`` seeds; made in chunks, of which each task sends 8 KB."""
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, n) * 32))))

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                s = np.unique(np.concatenate(_slots(b["seed"].to_numpy().view(np.uint64), bits))).astype(np.int64)
                yield pd.DataFrame({"chunk": (s >> _CHUNK).astype(np.int32), "slot": (s & ((1 << _CHUNK) - 1)).astype(np.int32)})

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(1 << _CHUNK, bool)
        own[pdf["slot"]] = True
        return pd.DataFrame({"chunk": [pdf["chunk"].iat[0]], "bits": [np.packbits(own).tobytes()]})

    chunks = known.select("seed").mapInPandas(slots, "chunk int, slot int").distinct().groupBy("chunk").applyInPandas(pack, "chunk int, bits binary")
    out = np.zeros(1 << bits >> 3, np.uint8)
    size = 1 << _CHUNK >> 3
    for row in chunks.toLocalIterator():  # at most 2**(MOST_BITS - _CHUNK) rows
        out[row["chunk"] * size : (row["chunk"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return out, bits


def _passes(h: np.ndarray, filter_: np.ndarray, bits: int) -> np.ndarray:
    """Places of the seeds that the filter lets through."""
    at = np.arange(len(h))
    for k in range(PROBES):
        s = _slots(h[at], bits)[k]
        at = at[(filter_[(s >> np.uint64(3)).astype(np.int64)] >> (7 - (s & np.uint64(7))).astype(np.uint8)) & 1 == 1]
        if not len(at):
            break
    return at


def document_seeds(docs: DataFrame, doc_id: str, text: str, filter_: np.ndarray, bits: int) -> DataFrame:
    """(id, words binary, seeds array, places array, masks array) of the documents with seeds that the filter lets through."""
    shared = docs.sparkSession.sparkContext.broadcast(filter_)  # at most 32 MB

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gap = np.random.default_rng(5).integers(0, 2**63, max(map(len, MASKS)), dtype=np.uint64)
        for b in batches:
            arrays, starts, at = [], [], 0
            for t in b["_text"]:
                a = word_hashes(passage_words(t))
                arrays += [a, gap]
                starts.append(at)
                at += len(a) + len(gap)
            if not arrays:
                continue
            every, first = np.concatenate(arrays), np.array(starts)
            found = []
            for k, mask in enumerate(MASKS):
                h = seeds(every, mask)
                p = _passes(h, shared.value, bits)
                found.append((np.searchsorted(first, p, "right") - 1, h[p], p, np.full(len(p), k)))
            doc, h, p, k = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(doc, kind="stable")
            doc, h, p, k = doc[order], h[order].view(np.int64), p[order], k[order]
            rows = []
            ends = [*(np.flatnonzero(doc[1:] != doc[:-1]) + 1), len(doc)] if len(doc) else []
            lo = 0
            for hi in ends:
                d = int(doc[lo])
                rows.append((b["_id"].iat[d], arrays[2 * d].tobytes(), h[lo:hi], (p[lo:hi] - starts[d]).astype(np.int32), k[lo:hi].astype(np.int32)))
                lo = hi
            yield pd.DataFrame(rows, columns=["id", "words", "seeds", "places", "masks"])

    given = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).filter("_id is not null and _text is not null")
    return given.mapInPandas(run, "id bigint, words binary, seeds array<bigint>, places array<int>, masks array<int>")


def leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", fields: tuple[str, ...] = ("prompt", "answer")
) -> DataFrame:
    """(doc_id, item_id) of the documents that hold a passage of a test item; each pair once.

    Seeds of the test texts and of the documents meet in a shuffled join, in
    which frequent seeds are salted; only documents with seeds that a Bloom
    filter of the test seeds lets through take part. A passage has two seeds of
    the first mask at least (2 LEAST / PER_ERROR - 4 > 1), so pairs with fewer
    are no candidates; the others are verified on the words around their hits.

    The documents are read once, whatever the number of test items. Items of
    fewer than LEAST words in every field can't leak. Null ids, texts and fields
    hold nothing; rows given twice count once; empty tables give no rows. Texts
    are read whole. Other columns don't matter.
    """

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: tuple = ()
        doc = item = np.empty(0, np.uint64)
        hits: list[tuple[int, int]] = []
        for b in batches:
            rows = []
            for i, t, kind, words, p, q in zip(b["id"], b["text_id"], b["kind"], b["words"], b["p"], b["q"]):
                if (i, t) != key:
                    if hits and holds(doc, item, hits):
                        rows.append(key)
                    key, hits = (i, t), []
                if kind == 0:
                    doc = np.frombuffer(words, np.uint64)
                elif kind == 1:
                    item = np.frombuffer(words, np.uint64)
                else:
                    hits.append((p, q))
            yield pd.DataFrame(rows, columns=["id", "text_id"])
        if hits and holds(doc, item, hits):
            yield pd.DataFrame([key], columns=["id", "text_id"])

    owners, texts = item_texts(items, item_id, fields)
    known = cut(text_seeds(texts))
    n = known.count()
    out = f"`{doc_id}` bigint, `{item_id}` bigint"
    if not n:
        return docs.sparkSession.createDataFrame([], out)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = cut(document_seeds(docs, doc_id, text, *bloom(known, n)))
    each = marked.select("id", F.explode(F.arrays_zip("seeds", "places", "masks")).alias("s")).select("id", F.col("s.seeds").alias("seed"), F.col("s.places").alias("p"), F.col("s.masks").alias("mask"))
    hits = cut(salted_join(each, known.withColumnRenamed("mask", "m"), "seed", "id", "text_id", both=True).filter("mask = m").select("id", "text_id", "p", "q", "mask").distinct())
    pairs = cut(hits.groupBy("id", "text_id").agg(F.count_if(F.col("mask") == 0).alias("n")).filter("n > 1").select("id", "text_id"))
    heads = marked.select("id", "words").join(pairs.select("id").distinct(), "id", "left_semi").select("id", F.lit(-1).cast("bigint").alias("text_id"), F.lit(0).alias("kind"), "words", F.lit(0).alias("p"), F.lit(0).alias("q"))
    bodies = pairs.join(texts, "text_id").select("id", "text_id", F.lit(1).alias("kind"), "words", F.lit(0).alias("p"), F.lit(0).alias("q"))
    places = hits.join(pairs, ["id", "text_id"], "left_semi").select("id", "text_id", F.lit(2).alias("kind"), F.lit(b"").alias("words"), "p", "q")
    checked = (
        heads.union(bodies)
        .union(places.distinct())
        .repartition(parts, "id")
        .sortWithinPartitions("id", "text_id", "kind", F.col("q") - F.col("p"), "p")
        .mapInPandas(verify, "id bigint, text_id bigint")
    )
    return checked.join(owners, "text_id").select(F.col("id").alias(doc_id), F.col("item").alias(item_id)).distinct()


def leaked_items(pairs: DataFrame, item_id: str = "item_id") -> DataFrame:
    """Number of documents that each leaked item is in."""
    return pairs.groupBy(item_id).agg(F.count(F.lit(1)).alias("documents"))
