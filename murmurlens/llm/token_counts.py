"""Token counts of every prefix of a text, by dynamic programming over its pieces.

Byte-level BPE encodes the pieces of a text (a word with its space, a number, a
run of signs or of white space) each on its own.  Inside a piece the encoding of
a prefix ends in exactly one token, and taking that token off leaves the
encoding of a shorter prefix.  So ``last[j]`` is the one vocabulary item that ends
at ``j`` and stays apart from ``last[j - len]`` when the two are encoded together,
and ``count[j] = count[j - len] + 1``.  One pass gives the exact count of every
prefix; truncation and budget questions are then look-ups, not encodings.

Null counts as the empty text: 0 bytes, 0 tokens.  Rows are independent, so
repeated rows and ids give repeated results; a null id stays null.  Other
columns are not looked at.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate
from pathlib import Path

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts

#: Pieces and pairs kept in a worker; when full the table starts anew, so memory is bounded.
KEPT = 800_000
#: Fixed value: the characters with the White_Space property.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NEVER = 1 << 60


def _class(*kinds: str) -> str:
    """The characters of general categories, as ranges for a pattern."""
    ranges, start = [], None
    for code in range(sys.maxunicode + 2):
        inside = code <= sys.maxunicode and unicodedata.category(chr(code)).startswith(kinds)
        if inside and start is None:
            start = code
        elif not inside and start is not None:
            ranges.append(f"\\U{start:08x}-\\U{code - 1:08x}")
            start = None
    return "".join(ranges)


class Pieces:
    """Cuts text into pieces as the vocabulary's authors do (fixed alternatives, in their order).

    The short classes of ``re`` differ from the Unicode properties in a few
    characters; a text with one of those takes the long classes.
    """

    def __init__(self):
        letter, number = _class("L"), _class("N")
        self._exact = re.compile(
            f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{WHITE}{letter}{number}]+"
            f"|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
        )
        self._short = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
        self._odd = re.compile(f"[\x1c-\x1f{_class('Nl', 'No')}]")

    def _of(self, text: str) -> re.Pattern:
        return self._exact if self._odd.search(text) else self._short

    def findall(self, text: str) -> list[str]:
        return self._of(text).findall(text)

    def finditer(self, text: str):
        return self._of(text).finditer(text)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable bytes for themselves, the rest from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class PrefixCounter(dict):
    """Piece to token count; also whole texts and all their prefixes."""

    def __init__(self, vocabulary: str):
        super().__init__()
        data = json.loads(Path(vocabulary).read_text(encoding="utf-8"))
        letters = _byte_letters()
        plain = ["".join(chr(letters[c]) for c in t) for t in data["model"]["vocab"] if all(c in letters for c in t)]
        as_bytes = {c: chr(b) for c, b in letters.items()}
        self._rank = {}
        for k, pair in enumerate(data["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self._rank["".join(map(as_bytes.get, a)), "".join(map(as_bytes.get, b))] = k
        self._words, parents = ahocorasick.Automaton(), {}
        for t in plain:
            parts, step = self._merged(t)
            if parts == [t]:
                self._words.add_word(t, t)
                parents[t] = step
        self._words.make_automaton()
        # the rightmost (leftmost) symbols a token is built from, each with the rank of the merge that takes it up
        self._right = {t: self._edge(t, parents, 1) for t in parents}
        self._left = {t: self._edge(t, parents, 0) for t in parents}
        self._apart: dict[tuple[str, str], bool] = {}
        self._pieces = Pieces()
        self._white = re.compile(f"[{WHITE}]+")
        self._specials = sorted((t["content"] for t in data["added_tokens"]), key=len, reverse=True)
        self._special = re.compile("|".join(map(re.escape, self._specials)))

    def _merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """What the merges make of a text, and the last of them."""
        parts, step = list(text), None
        while len(parts) > 1:
            rank, i = min((self._rank.get(p, NEVER), i) for i, p in enumerate(zip(parts, parts[1:])))
            if rank == NEVER:
                break
            step = parts[i], parts[i + 1]
            parts[i:i + 2] = [step[0] + step[1]]
        return parts, step

    def _edge(self, token: str, parents: dict, side: int) -> list[tuple[str, int]]:
        edge, until = [], NEVER
        while True:
            edge.append((token, until))
            if (pair := parents[token]) is None:
                return edge
            token, until = pair[side], self._rank[pair]

    def _stay_apart(self, left: str, right: str) -> bool:
        """Whether no merge joins two tokens: a merge across takes place if its rank comes before both symbols are taken up."""
        if len(self._apart) > KEPT:
            self._apart.clear()
        rank = self._rank
        known = self._apart[left, right] = not any(
            (r := rank.get((a, b), NEVER)) < a_until and r <= b_until and r < NEVER
            for a, a_until in self._right[left] for b, b_until in self._left[right]
        )
        return known

    def piece_counts(self, piece: str) -> list[int]:
        """Tokens of each byte prefix of a piece, the empty one first."""
        raw = piece.encode("utf-8", "surrogatepass").decode("latin-1")
        last, counts, done, apart = [""] * (len(raw) + 1), [0] * (len(raw) + 1), 0, self._apart
        for end, token in self._words.iter(raw):  # by end; at one end the longest first
            end += 1
            if end == done:
                continue
            before = last[end - len(token)]
            if before:
                free = apart.get((before, token))
                if not (self._stay_apart(before, token) if free is None else free):
                    continue
            last[end], counts[end], done = token, counts[end - len(token)] + 1, end
        return counts

    def __missing__(self, piece: str) -> int:
        if len(self) > KEPT:
            self.clear()
        count = self[piece] = self.piece_counts(piece)[-1]
        return count

    def _plain_count(self, text: str) -> int:
        return sum(map(self.__getitem__, self._pieces.findall(text)))

    def count(self, text: str) -> int:
        """Tokens of the whole text."""
        if not any(s in text for s in self._specials):
            return self._plain_count(text)
        return sum(map(self._plain_count, self._special.split(text))) + len(self._special.findall(text))

    def _tail_counts(self, piece: str) -> list[int]:
        """Tokens of each code point prefix of a piece as the end of a text."""
        if piece[0] == "'" and len(piece) > 1:  # a contraction that is cut falls apart
            return [self._plain_count(piece[:i]) for i in range(len(piece) + 1)]
        by_byte = self.piece_counts(piece)
        if len(by_byte) == len(piece) + 1:
            return by_byte
        return [by_byte[e] for e in np.cumsum([0, *(len(c.encode("utf-8", "surrogatepass")) for c in piece)])]

    def _plain_prefixes(self, text: str, upto: int | None = None) -> np.ndarray:
        """As ``prefix_counts``, special tokens taken as ordinary text."""
        out = np.zeros(len(text) + 1, dtype=np.int64)
        total, white = 0, 0  # up to ``white`` the counts are set
        for m in self._pieces.finditer(text):
            begin, end = m.span()
            if begin >= white and (run := self._white.match(text, begin)):
                # white space at the end of a text is one piece, however it is cut when a word follows
                white = run.end()
                out[begin + 1:white + 1] = np.array(self._tail_counts(run.group())[1:]) + total
            if end > white:
                first = max(begin, white) + 1
                out[first:end + 1] = np.array(self._tail_counts(m.group())[first - begin:]) + total
            total += self[m.group()]
            if upto is not None and total > upto:
                return out[:max(end, white) + 1]
        return out

    def prefix_counts(self, text: str, upto: int | None = None) -> np.ndarray:
        """``out[i]`` is the token count of ``text[:i]``; with ``upto`` the array ends behind the piece that goes beyond it."""
        found, total, at = [np.zeros(1, dtype=np.int64)], 0, 0
        for m in self._special.finditer(text) if any(s in text for s in self._specials) else ():
            # a special token that is cut is ordinary text
            found.append(self._plain_prefixes(text[at:m.end() - 1])[1:] + total)
            total, at = total + self._plain_count(text[at:m.start()]) + 1, m.end()
            found.append(np.array([total]))
            if upto is not None and total > upto:
                return np.concatenate(found)
        found.append(self._plain_prefixes(text[at:], None if upto is None else upto - total)[1:] + total)
        return np.concatenate(found)

    def longest_prefix(self, text: str, budget: int) -> int:
        """Code points of the longest prefix of at most ``budget`` tokens."""
        return self.count_and_fit(text, budget)[1]

    def count_and_fit(self, text: str, budget: int) -> tuple[int, int]:
        """Tokens of the whole text, and code points of its longest prefix of at most ``budget`` tokens."""
        if any(s in text for s in self._specials):
            total = self.count(text)
            return total, len(text) if total <= budget else int(np.flatnonzero(self.prefix_counts(text, budget) <= budget)[-1])
        pieces = self._pieces.findall(text)
        counts = list(map(self.__getitem__, pieces))
        total = sum(counts)
        if total <= budget:
            return total, len(text)
        # whole pieces as far as they fit, then prefixes of what follows; white space before it belongs to it
        sums = list(accumulate(counts[:budget + 1]))
        k = bisect_right(sums, budget)
        while k and pieces[k - 1].isspace():
            k -= 1
        before, at = sums[k - 1] if k else 0, sum(map(len, pieces[:k]))
        inside = self._plain_prefixes(text[at:], budget - before)
        return total, at + int(np.flatnonzero(inside <= budget - before)[-1])


@lru_cache(maxsize=2)
def prefix_counter(vocabulary: str) -> PrefixCounter:
    """One counter in each Python worker, kept from task to task."""
    return PrefixCounter(vocabulary)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, prefixes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fit_chars; with ``prefixes`` also the count at every prefix.

    ``vocabulary`` is a tokenizer file that every executor can open.
    ``fit_chars`` is the longest prefix, in code points, of at most ``limit``
    tokens.
    """

    def make():
        counter = prefix_counter(vocabulary)

        def compute(texts: list[str]) -> dict:
            found = [counter.count_and_fit(t, limit) for t in texts]
            counts = np.array([n for n, _ in found], dtype=np.int64)
            out = {
                "n_bytes": np.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], dtype=np.int64),
                "n_tokens": counts,
                "over_limit": counts > limit,
                "fit_chars": np.array([n for _, n in found], dtype=np.int64),
            }
            if prefixes:
                out["prefix_tokens"] = [counter.prefix_counts(t).tolist() for t in texts]
            return out

        return compute

    schema = "n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint"
    return map_texts(docs, make, schema + (", prefix_tokens array<int>" if prefixes else ""))
