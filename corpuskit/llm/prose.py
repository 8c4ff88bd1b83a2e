"""Per-document text quality statistics, and natural prose told from lists, tables and junk."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.runtime import cut

#: Common words by language.
COMMON = {
    "en": frozenset(
        "the a an of and to in is it that was for on as with but not be by at from this these those which or had has have"
        " they we you our their its if when after so no one who are were would could should out only than more up what"
        " once there other each before cannot can may must most some any such still while because since about than then"
        " do does did will just very into over even also been being how why where your my me he she his her them us all"
        " both few many much own same too under until again here".split()
    ),
    "de": frozenset(
        "der die das und ist nicht ein eine einen einem einer den dem des zu zum zur mit auf von vom im in am wird werden"
        " sich er es sie wir haben hat einmal bleibt nur dass daß wer was sollte danach noch jeden jede jedes ob vor bei"
        " beim an für aus nach über unter wie als auch aber oder wenn weil so sind war waren kann können muss müssen"
        " alle alles diese dieser dieses diesen keinen kein keine sein seine seiner ihr ihre man mehr dann schon zwischen".split()
    ),
    "es": frozenset(
        "el la los las de del que y en un una es no se con por para al lo si este esta estos estas fue siempre mismo misma"
        " como más su sus vez cada antes entre pero sin sobre ya muy todo toda todos todas hay ser son era han ha he"
        " cuando donde porque hasta desde también otro otra tiene tienes volver le les nos mi tu yo queda quedan ni eso".split()
    ),
}
LANGUAGES = tuple(COMMON)
_LANGUAGE = {lang: k for k, lang in enumerate(LANGUAGES)}
STATS = (
    "mean_word_length",
    "symbol_ratio",
    "digit_ratio",
    "common_share",
    "punctuated_line_share",
    "list_share",
    "tabular_share",
    "repeated_line_share",
    "upper_share",
    "strange_share",
)
P = len(STATS)
#: Least standard deviation of each statistic in prose; keeps the covariance regular where prose never varies.
FLOOR = np.array([0.35, 0.02, 0.03, 0.07, 0.35, 0.08, 0.08, 0.08, 0.4, 0.01])
#: Squared distance beyond which a segment is no prose: the 0.9999 quantile of chi-squared with P degrees of freedom.
FAR = 35.56
#: Segments of fewer words don't take part in the fit; languages with fewer segments use the fit over all.
FIT_WORDS, FIT_SEGMENTS, STEPS = 8, 200, 4

_WORD = re.compile(r"[^\W\d_]+")
_LINES = re.compile(r"\r\n|[\n\r]")
_QUOTE = re.compile(r"^(?:\s*>)+ ?")
_HEADING = re.compile(r"^\s*(?:#{1,6} .*|={2,} .* ={2,}|[=~^-]{3,}|```\w*)\s*$")
_LIST = re.compile(r"^\s*(?:[-*+•‣◦▪–]|\d{1,3}[.)]|\(?[a-z]\)|\[[ xX]\])\s+\S")
_RULED = re.compile(r"\|.*\||^\s*\+[-=+]{3,}")
_CELLS = re.compile(r"\S\t+\S|\S {2,}\S+.* {2,}\S|^[^,\s]*(?: [^,\s]+)?(?:,[^,\s]*(?: [^,\s]+)?){2,}$|\.{4,} *\d+\s*$")
_PAIR = re.compile(r"^\s*[\w.\-]{2,}\s*(?:=\s*|:\s+)\S+(?: \S+){0,3}\s*$")
#: Classes of bytes: blank, digit, capital, symbol, continuation of a character, anything else.
_CLASS = np.full(256, 5, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[48:58] = 1
_CLASS[65:91] = 2
_CLASS[list(b"#$%&+/<=>@[\\]^{|}~")] = 3
_CLASS[128:192] = 4
#: Letters outside the three languages and stray signs of broken encodings.
_STRANGE = re.compile(r"[^\x00-\x7fäöüÄÖÜßáéíóúñÁÉÍÓÚÑ’“”‘–—…¿¡•»«\xa0]")
_ENDS = (".", "!", "?", ":", ";", ",", "…", '"', "'", "”", ")", "»")


_ANY_COMMON = frozenset().union(*COMMON.values())


def _form(line: str) -> str:
    """heading, list, table (with key-value lines) or plain; separators of cells may be mere spacing in running text."""
    bare = _QUOTE.sub("", line) if ">" in line else line
    if _HEADING.match(bare):
        return "heading"
    if _LIST.match(bare):
        return "list"
    if ("|" in bare or "+" in bare) and _RULED.search(bare):
        return "table"
    spaced = "\t" in bare or "  " in bare or "...." in bare or bare.count(",") > 1
    cells, pair = spaced and _CELLS.search(bare), _PAIR.match(bare)
    if cells or pair or bare is not line:
        words = _WORD.findall(bare.lower().replace("n/a", ""))
        common = sum(w in _ANY_COMMON for w in words)
        if (cells or pair) and common <= 0.15 * len(words):
            return "table"
        if bare != line and not common and len(words) <= 4:
            return "list"  # an item behind > rather than a quoted sentence
    return "plain"


def _segments(text: str) -> list[tuple[str, list[str]]]:
    """Runs of lines of one form in one paragraph; headings and fences stand alone."""
    out: list[tuple[str, list[str]]] = []
    last = None
    for line in _LINES.split(text):
        bare = _QUOTE.sub("", line) if ">" in line else line
        if not bare.strip():
            last = None
            continue
        form = _form(line)
        if form != last or form == "heading":
            out.append((form, []))
        out[-1][1].append(bare)
        last = form
    return out


#: Word to the languages it is common in, one bit each.
_BITS = {w: sum(1 << k for k, c in enumerate(COMMON.values()) if w in c) for w in _ANY_COMMON}


def _votes(words: list[str]) -> list[int]:
    """Common words by language."""
    bits = Counter(map(_BITS.get, words))
    del bits[None]
    return [sum(n for b, n in bits.items() if b >> k & 1) for k in range(len(LANGUAGES))]


def _counts(lines: list[str], form: str, seen: Counter) -> tuple[list[int], list[str]]:
    """Additive counts behind the statistics, and the words."""
    text = "\n".join(lines)
    words = _WORD.findall(text.lower())
    size = len(text) - len(lines) + 1
    blank, digits, capitals, symbols, more, _ = np.bincount(_CLASS[np.frombuffer(raw := text.encode(errors="replace"), np.uint8)], minlength=6).tolist()
    return [
        sum(map(len, words)),
        symbols,
        digits,
        sum(x.rstrip().endswith(_ENDS) for x in lines),
        size if form == "list" else 0,
        size if form == "table" else 0,
        sum(len(x) for x in lines if seen[x.strip()] > 3),
        capitals,
        0 if text.isascii() else len(_STRANGE.findall(text)),
        size,
        len(raw) - more - blank,
        len(lines),
        len(words),
    ], words


def _statistics(c: list[int], common: int) -> list[float]:
    letters, symbols, digits, ended, listed, tabular, repeated, upper, strange, size, solid, lines, words = c
    size, solid = max(1, size), max(1, solid)
    return [
        letters / max(1, words),
        symbols / solid,
        digits / solid,
        common / max(1, words),
        ended / max(1, lines),
        listed / size,
        tabular / size,
        repeated / size,
        upper / max(1, letters),
        strange / size,
    ]


_ROW = P + 3  # statistics, words, characters, language


def describe(text: str) -> tuple[list[float], np.ndarray]:
    """Statistics of the whole text, and one row per segment (statistics, words, characters, language)."""
    segments = _segments(text)
    seen = Counter(x.strip() for _, s in segments for x in s)
    counted = [_counts(lines, form, seen) for form, lines in segments]
    votes = [_votes(words) for _, words in counted]
    sums = [sum(v) for v in zip(*votes)] or [0]
    main = sums.index(max(sums))
    rows = []
    for (form, _), (c, _), v in zip(segments, counted, votes):
        if form != "heading":
            lang = v.index(max(v)) if c[-1] >= FIT_WORDS and any(v) else main
            rows.append([*_statistics(c, v[lang]), c[-1], c[9], lang])
    total = [sum(x) for x in zip(*(c for c, _ in counted))] or [0] * 13
    return [total[-1], *_statistics(total, sums[main])], np.array(rows, np.float32).reshape(-1, _ROW)


def described(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, whole array<double>, chars, segments binary) of each text that isn't null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [describe(t) for t in b["_text"]]
            yield pd.DataFrame(
                {
                    "id": b["_id"],
                    "whole": [w for w, _ in got],
                    "chars": [sum(len(x) for x in _LINES.split(t)) for t in b["_text"]],
                    "segments": [s.tobytes() for _, s in got],
                }
            )

    return (
        df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        .filter("_text is not null")
        .mapInPandas(run, "id bigint, whole array<double>, chars bigint, segments binary")
    )


class Model:
    """Centre and inverse covariance of prose, by language."""

    def __init__(self, centre: np.ndarray, spread: np.ndarray):
        self.centre, self.inverse = centre, np.linalg.inv(spread)

    def distances(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of segment rows, and each statistic's share in them."""
        lang = s[:, P + 2].astype(int)
        d = s[:, :P].astype(np.float64) - self.centre[lang]
        parts = d * np.einsum("nij,nj->ni", self.inverse[lang], d)
        return parts.sum(1), parts


def _totals(table: DataFrame, row) -> np.ndarray:
    """Sum over all documents of row(segments): one small vector per partition comes to the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            s = np.frombuffer(b"".join(b["segments"]), np.float32).reshape(-1, _ROW)
            s = s[s[:, P] >= FIT_WORDS]
            t = row(s)
            total = t if total is None else total + t
        if total is not None:
            yield pd.DataFrame({"k": np.arange(len(total)), "v": total})

    got = table.select("segments").mapInPandas(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    size = len(row(np.empty((0, _ROW), np.float32)))
    out = np.zeros(size)
    out[got["k"]] = got["v"]
    return out


def with_floor(cov: np.ndarray) -> np.ndarray:
    """The covariance with each variance raised to FLOOR squared where it is less; larger ones stay as they are."""
    return cov + np.diag(np.maximum(FLOOR**2 - np.diag(cov), 0.0))


_BINS = 400
_TOP = np.array([16.0, *[1.0] * (P - 1)])


def fit(table: DataFrame) -> Model:
    """Robust centre and covariance per language over all segments of all documents.

    Start: medians and median absolute deviations from histograms. Then
    concentration steps: the moments of the segments that lie within the 0.975
    quantile of the fit so far, with the consistency factor of that trimming.
    """
    n = len(LANGUAGES)

    def histogram(s: np.ndarray) -> np.ndarray:
        out = np.zeros((n, P, _BINS))
        bins = np.clip(s[:, :P] / _TOP * (_BINS - 1), 0, _BINS - 1).round().astype(int)
        for k in range(n):
            own = bins[s[:, P + 2] == k]
            for j in range(P):
                out[k, j] = np.bincount(own[:, j], minlength=_BINS)
        return out.ravel()

    h = _totals(table, histogram).reshape(n, P, _BINS)
    pooled = h.sum(0)
    values = np.arange(_BINS) / (_BINS - 1)

    def middle(counts: np.ndarray) -> float:
        c = np.cumsum(counts)
        return values[np.searchsorted(c, c[-1] / 2)] if c[-1] else 0.0

    enough = h[:, 0].sum(1) >= FIT_SEGMENTS
    centre, spread = np.zeros((n, P)), np.zeros((n, P, P))
    for k in range(n):
        for j in range(P):
            counts = h[k, j] if enough[k] else pooled[j]
            m = middle(counts)
            order = np.argsort(np.abs(values - m), kind="stable")
            c = np.cumsum(counts[order])
            mad = np.abs(values - m)[order][np.searchsorted(c, c[-1] / 2)] if c[-1] else 0.0
            centre[k, j] = m * _TOP[j]
            spread[k, j, j] = max(1.4826 * mad * _TOP[j], FLOOR[j]) ** 2
    near = 20.48  # 0.975 quantile of chi-squared with P degrees of freedom
    for _ in range(STEPS):
        model = Model(centre, spread)

        def moments(s: np.ndarray, model: Model = model) -> np.ndarray:
            out = np.zeros((n, 1 + P + P * P))
            d, _ = model.distances(s)
            s = s[d <= near]
            for k in range(n):
                x = s[s[:, P + 2] == k, :P].astype(np.float64)
                out[k] = np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
            return out.ravel()

        m = _totals(table, moments).reshape(n, -1)
        m[~enough] = m.sum(0)
        for k in range(n):
            c = m[k, 0]
            if c <= P:
                continue
            mean = m[k, 1 : 1 + P] / c
            cov = m[k, 1 + P :].reshape(P, P) / c - np.outer(mean, mean)
            centre[k], spread[k] = mean, with_floor(cov * 1.08)
    return Model(centre, spread)


def prose_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics, outlierness and verdict of each document.

    Columns: the id, word_count and the statistics over the whole text,
    distance (robust Mahalanobis, mean over segments weighted by characters),
    contributions (map: each statistic's share of it), outlying_chars, chars,
    is_prose: at most half of the characters lie in segments beyond FAR.

    Null texts have no row; empty texts have zero statistics and count as
    prose. Long texts are read whole. Repeated rows get the same result each.
    """
    table = cut(described(df, id_col, text_col))
    model = fit(table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for raw in b["segments"]:
                s = np.frombuffer(raw, np.float32).reshape(-1, _ROW)
                d, parts = model.distances(s)
                size = s[:, P + 1].astype(np.float64)
                total = max(1.0, size.sum())
                rows.append(
                    (
                        float(np.sqrt((d * size).sum() / total)),
                        {name: float(v) for name, v in zip(STATS, (parts * size[:, None]).sum(0) / total)},
                        int(size[d > FAR].sum()),
                    )
                )
            whole = np.array(b["whole"].tolist()).reshape(-1, P + 1)
            out = pd.DataFrame(whole, columns=["word_count", *STATS])
            out.insert(0, id_col, b["id"].to_numpy())
            out["word_count"] = out["word_count"].astype("int64")
            out["distance"] = [r[0] for r in rows]
            out["contributions"] = [r[1] for r in rows]
            out["outlying_chars"] = [r[2] for r in rows]
            out["chars"] = b["chars"].to_numpy()
            out["is_prose"] = 2 * out["outlying_chars"] <= out["chars"]
            yield out

    schema = (
        f"`{id_col}` bigint, word_count bigint, "
        + ", ".join(f"{s} double" for s in STATS)
        + ", distance double, contributions map<string,double>, outlying_chars bigint, chars bigint, is_prose boolean"
    )
    return table.mapInPandas(run, schema)
