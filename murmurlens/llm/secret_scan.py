"""Secret scans: fixed patterns, and strings that a character Markov model takes for random.

Two first-order Markov models over printable ASCII, one of random strings and
one of ordinary identifiers, give each long run of token characters a
log-likelihood ratio per character.  Of each run, the parts outside pattern
matches become spans of kind ``markov`` if they are above ``threshold``.  Both
models are counted from all documents: strings the patterns mark and seeded draws
from the usual secret alphabets are "random"; the other words are "ordinary", but
for long ones, which have no label.

Spans are code point ranges, end exclusive.  Null counts as the empty text and
has no spans.  Rows are independent: repeated rows and ids are scanned again, a
null id stays null.  Without documents the ordinary model knows no words and
falls back to its smoothing.  Other columns are not looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_texts, replaced_texts, ship_package, slices, texts_of

#: The patterns and the least lengths of what they mark.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "markov")
#: What an assignment starts with, lower case; a text without any of them has none.
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_ASSIGN = re.compile(ASSIGN, re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(ACCESS)
# a run of fewer characters holds no longer one, so the least length may stand in the pattern
_HEX = re.compile(HEX[:-1] + "{%d,}" % LEAST["hex"])
_WORD = re.compile(r"\S+")
_SYMBOLS = 96  # printable ASCII and the edge of a string
_SECRET_ALPHABETS = (
    "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-",
)


def pattern_spans(text: str) -> list[tuple[int, int, str]]:
    """Matches of the fixed patterns by start, then kind as listed."""
    spans = []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        spans += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        spans += [(*m.span(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    spans += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return sorted(spans, key=_order)


def _order(span: tuple[int, int, str]) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


def transitions(strings: list[str]) -> np.ndarray:
    """How often one character follows another in the strings, their edges included."""
    joined = np.frombuffer("\n".join(["", *strings, ""]).encode("ascii", "replace"), dtype=np.uint8).astype(np.int64) - 31
    joined[(joined < 0) | (joined >= _SYMBOLS)] = 0
    return np.bincount(joined[:-1] * _SYMBOLS + joined[1:], minlength=_SYMBOLS**2).reshape(_SYMBOLS, _SYMBOLS)


def random_strings(seed: int, each: int = 400) -> list[str]:
    rng = np.random.default_rng(seed)
    return ["".join(np.array(list(a))[rng.integers(0, len(a), rng.integers(20, 48))]) for a in _SECRET_ALPHABETS for _ in range(each)]


def gaps(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The parts of a text that no span of ``taken``, which is in order of start, covers."""
    parts, at = [], 0
    for s, e, _ in taken:
        if s > at:
            parts.append((at, s))
        at = max(at, e)
    return parts + [(at, len(text))] if at < len(text) else parts


def within(parts: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
    """What lies of ``parts``, disjoint and in order, in a range."""
    found = []
    k = max(bisect_right(parts, (start, end)) - 1, 0)
    while k < len(parts) and parts[k][0] < end:
        a, b = max(parts[k][0], start), min(parts[k][1], end)
        if a < b:
            found.append((a, b))
        k += 1
    return found


@dataclass(frozen=True)
class MarkovPair:
    """Log-likelihood ratio of each transition, and what makes a run a secret."""

    ratio: np.ndarray
    run: re.Pattern
    threshold: float

    @classmethod
    def fit(cls, random: np.ndarray, ordinary: np.ndarray, min_length: int, threshold: float) -> MarkovPair:
        def log_rates(counts: np.ndarray) -> np.ndarray:
            # smoothed towards the rate of the character itself
            single = (counts.sum(0) + 1) / (counts.sum() + _SYMBOLS)
            return np.log((counts + 20 * single) / (counts.sum(1, keepdims=True) + 20))

        return cls(log_rates(random) - log_rates(ordinary), re.compile(f"[A-Za-z0-9+/_=-]{{{min_length},}}"), threshold)

    def ratios(self, string: str) -> np.ndarray:
        """Log-likelihood ratios of the transitions inside a string of printable ASCII."""
        codes = np.frombuffer(string.encode("ascii"), dtype=np.uint8).astype(np.int64) - 31
        return self.ratio[codes[:-1], codes[1:]]

    def spans(self, text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """The parts of long runs outside ``taken`` (by start) whose mean ratio is above the threshold.

        A part's transitions are those inside it and to the characters of its run beside it.
        """
        found, free = [], gaps(text, taken)
        for m in self.run.finditer(text):
            start, end = m.span()
            ratios = self.ratios(m[0])
            for a, b in within(free, start, end):
                if ratios[max(a - start - 1, 0):b - start].mean() > self.threshold:
                    found.append((a, b, "markov"))
        return found


def fit_markov(docs: DataFrame, min_length: int = 20, threshold: float = 0.9, seed: int = 0, text: str = "text") -> MarkovPair:
    """Fits both models on all documents.

    The texts stay on the executors; what comes to the driver are two tables of
    96 x 96 counts.
    """
    ship_package(docs.sparkSession)
    texts = docs.select(F.col(text).alias("__text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, _SYMBOLS, _SYMBOLS), dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "__text"):
                random, ordinary = [], []
                for t in texts_of(part, "__text"):
                    spans = pattern_spans(t)
                    random += [t[s:e] for s, e, k in spans if k != "assign"]
                    # long words, their parts beside a span included, carry no label: they are what is to be judged
                    if spans:
                        free = gaps(t, spans)
                        ordinary += [t[a:b] for m in _WORD.finditer(t) if len(m[0]) < min_length for a, b in within(free, *m.span())]
                    else:
                        ordinary += [w for w in t.split() if len(w) < min_length]
                sums += [transitions(random), transitions(ordinary)]
        cells = np.argwhere(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cells[:, 0] * _SYMBOLS**2 + cells[:, 1] * _SYMBOLS + cells[:, 2]), pa.array(sums[tuple(cells.T)])], ["cell", "n"])

    sums = np.zeros(2 * _SYMBOLS**2)
    for cell, n in texts.mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n")).collect():
        sums[cell] = n
    random, ordinary = sums.reshape(2, _SYMBOLS, _SYMBOLS)
    return MarkovPair.fit(random + transitions(random_strings(seed)), ordinary, min_length, threshold)


def scan_secrets(docs: DataFrame, model: MarkovPair, text: str = "text") -> DataFrame:
    """doc_id and ``spans``, an array of (start, end, kind) by start, then kind as listed."""
    kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])

    def make():
        def compute(texts: list[str]) -> dict:
            out = []
            for t in texts:
                base = pattern_spans(t)
                out.append([dict(zip(("start", "end", "kind"), s)) for s in sorted(base + model.spans(t, base), key=_order)])
            return {"spans": pa.array(out, pa.list_(kind))}

        return compute

    return map_texts(docs, make, "spans array<struct<start:bigint,end:bigint,kind:string>>", text)


def mask_secrets(docs: DataFrame, model: MarkovPair, mask: str = "[SECRET]", text: str = "text") -> DataFrame:
    """``docs`` with each secret (touching and overlapping spans as one) replaced by ``mask``; a null text stays null."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        base = pattern_spans(t)
        out, at = [], 0
        for start, end, _ in sorted(base + model.spans(t, base), key=_order):
            if start > at or not out:
                out += [t[at:start], mask]
            at = max(at, end)
        return "".join(out) + t[at:]

    return replaced_texts(docs, lambda: lambda texts: pa.array(map(one, texts), pa.string()), text)
