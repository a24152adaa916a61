"""BPE encoding and decoding: words in a trie, each shared prefix encoded once.

Byte-level BPE encodes the pieces of a text (a word with its space, a number, a
run of signs or of white space) each on its own.  The distinct pieces of many
texts go into one trie of bytes.  A node stands for a prefix, and the encoding of
a prefix is known from the one token it ends in: taking that token off leaves the
encoding of the prefix above.  So a depth-first walk gives every node its last
token, from its ancestors' alone: of the vocabulary's tokens that end at the
node, it is the one that stays apart from the last token of the prefix before it
when both are encoded together.  Whatever words share is so encoded once, and a
word's ids are read off by going up from its node.

The walk also carries the longest end of the prefix that begins some token, so
that only few tokens come into question at a node.

Words are dealt with a slice of texts at a time; the trie stays in the Python
worker for later slices and starts anew beyond ``KEPT_NODES``.  A word longer than
``LONG`` bytes is walked on arrays of its own and not kept, so one endless word
costs a few bytes of memory for each of its bytes.

Null counts as the empty text: no tokens, decoded to the empty text.  Rows are
independent: repeated rows and ids give repeated results, a null id stays null.
Other columns are not looked at, whatever their names.  Special strings in a
text become their special tokens, as the library does by default.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from array import array
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_texts, ship_package
from .token_counts import Pieces

#: Nodes and words kept in a worker.
KEPT_NODES, KEPT_WORDS = 1_500_000, 400_000
#: And pairs of tokens.
KEPT_PAIRS = 1_000_000
#: Bytes of the longest word that is put into the trie.
LONG = 200
NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The byte behind each letter of the vocabulary file: printable bytes stand for themselves, the others for letters from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in printable)
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabulary:
    """Tokens as bytes, and which pairs of them stay apart."""

    def __init__(self, path: str):
        data = json.loads(Path(path).read_text(encoding="utf-8"))
        letters = byte_letters()

        def raw(token: str) -> bytes:
            return bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()

        ids = {raw(t): i for t, i in data["model"]["vocab"].items()}
        self.rank: dict[tuple[bytes, bytes], int] = {}
        for k, pair in enumerate(data["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[raw(a), raw(b)] = k
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes_of = {i: t for t, i in ids.items()} | {i: raw(t) for t, i in self.special.items()}
        # a token takes part if its own bytes are encoded as that token; how it is put together
        self.made_of: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.ids: dict[bytes, int] = {}
        for token, number in ids.items():
            left, step = self._merged(token)
            if left == [token]:
                self.made_of[token], self.ids[token] = step, number
        self.starts = {t[:n] for t in self.ids for n in range(1, len(t) + 1)}
        self._edges: tuple[dict[int, list[tuple[bytes, int]]], ...] = ({}, {})
        self.ends_of: dict[bytes, list[tuple[int, int]]] = {}
        self.apart_of: dict[int, bool] = {}

    def _merged(self, token: bytes) -> tuple[list[bytes], tuple[bytes, bytes] | None]:
        parts, step = [token[i:i + 1] for i in range(len(token))], None
        while len(parts) > 1:
            rank, at = min((self.rank.get(p, NEVER), i) for i, p in enumerate(zip(parts, parts[1:])))
            if rank == NEVER:
                break
            step = parts[at], parts[at + 1]
            parts[at:at + 2] = [step[0] + step[1]]
        return parts, step

    def _edge(self, number: int, side: int) -> list[tuple[bytes, int]]:
        """The symbols that stand at one side of a token as it is put together, each with the rank of the merge that ends it."""
        if (known := self._edges[side].get(number)) is None:
            known, part, until = [], self.bytes_of[number], NEVER
            while True:
                known.append((part, until))
                if (pair := self.made_of[part]) is None:
                    break
                part, until = pair[side], self.rank[pair]
            self._edges[side][number] = known
        return known

    def apart(self, left: int, right: int) -> bool:
        """Whether two tokens stay two when encoded together.

        Some symbol at the end of one and some at the start of the other merge
        if that merge comes before both are merged into their own tokens; among
        equal ranks the place further left goes first.
        """
        pair = left << 32 | right
        if (known := self.apart_of.get(pair)) is None:
            if len(self.apart_of) > KEPT_PAIRS:
                self.apart_of.clear()
            rank, firsts = self.rank.get, self._edge(right, 0)
            known = self.apart_of[pair] = not any(
                (r := rank((a, b), NEVER)) < a_until and r <= b_until and r != NEVER
                for a, a_until in self._edge(left, 1) for b, b_until in firsts)
        return known

    def ends(self, start: bytes) -> list[tuple[int, int]]:
        """(length, id) of the tokens that a start of some token ends in, the longest first."""
        if (known := self.ends_of.get(start)) is None:
            known = self.ends_of[start] = [(len(t), self.ids[t]) for n in range(len(start)) if (t := start[n:]) in self.ids]
        return known


class TrieEncoder:
    """Encodes and decodes texts, with a trie of the words met so far."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self._pieces = Pieces()
        self._special = re.compile("|".join(map(re.escape, sorted(self.vocabulary.special, key=len, reverse=True)))) if self.vocabulary.special else None
        self._clear()

    def _clear(self) -> None:
        #: word to its ids, as little-endian 32-bit integers
        self.known: dict[str, bytes] = {}
        self._child: dict[int, int] = {}
        # of nodes: last token (-1 at the root), its first node's parent, length of the longest end that begins a token
        self._last, self._before, self._reach = array("i", [-1]), array("i", [0]), array("i", [0])
        self._path = [0]  # nodes of the word walked last

    def _walk(self, word: bytes, shared: int) -> int:
        """The node of a word that has ``shared`` bytes in common with the word walked before; new nodes get their last token."""
        child, path = self._child, self._path
        del path[shared + 1:]
        node, size = path[shared], len(word)
        for end in range(shared, size):
            below = child.get(node << 8 | word[end])
            if below is None:
                break
            node = below
            path.append(node)
        else:
            return node
        last, before, reach, starts = self._last, self._before, self._reach, self.vocabulary.starts
        candidates, known, bytes_of = self.vocabulary.ends_of, self.vocabulary.apart_of, self.vocabulary.bytes_of
        longest = reach[node]
        for stop in range(end + 1, size + 1):
            begin = stop - longest - 1
            while word[begin:stop] not in starts:
                begin += 1
            longest = stop - begin
            start = word[begin:stop]
            for length, number in candidates.get(start) or self.vocabulary.ends(start):
                above = path[stop - length]
                if length == stop or (known.get(pair := last[above] << 32 | number) or pair not in known and self.vocabulary.apart(last[above], number)):
                    break
            else:
                raise AssertionError("each byte is a token")
            below = child[node << 8 | word[stop - 1]] = len(last)
            last.append(number)
            before.append(above)
            reach.append(longest)
            path.append(below)
            node = below
        return node

    def _long(self, word: bytes) -> list[int]:
        """The ids of a long word, from the end; the same walk without nodes that stay."""
        last, sizes, longest, vocabulary = array("i", [-1]), array("i", [0]), 0, self.vocabulary
        for stop in range(1, len(word) + 1):
            begin = stop - longest - 1
            while word[begin:stop] not in vocabulary.starts:
                begin += 1
            longest = stop - begin
            length, number = next(
                (n, i) for n, i in vocabulary.ends(word[begin:stop]) if n == stop or vocabulary.apart(last[stop - n], i))
            last.append(number)
            sizes.append(length)
        ids, end = [], len(word)
        while end:
            ids.append(last[end])
            end -= sizes[end]
        return ids

    def learn(self, words: set[str]) -> None:
        """Puts words into the trie, in order, which makes the walk a depth-first one."""
        new = words.difference(self.known)
        if len(self._last) > KEPT_NODES or len(self.known) + len(new) > KEPT_WORDS:
            self._clear()
            new = words
        last, before, walked = self._last, self._before, b""
        self._path = [0]
        for word in sorted(new):  # code points and their UTF-8 bytes have one order
            raw = word.encode("utf-8", "surrogatepass")
            if len(raw) > LONG:
                ids = self._long(raw)
            else:
                shared, most = 0, min(len(walked), len(raw))
                while shared < most and walked[shared] == raw[shared]:
                    shared += 1
                ids, node = [], self._walk(raw, shared)
                walked = raw
                while node:
                    ids.append(last[node])
                    node = before[node]
            ids.reverse()
            self.known[word] = struct.pack(f"<{len(ids)}I", *ids)

    def cut(self, text: str) -> list[str | int]:
        """The pieces of a text, special tokens as their ids."""
        special = self._special
        if special is None or not any(s in text for s in self.vocabulary.special):
            return self._pieces.findall(text)
        found, at = [], 0
        for m in special.finditer(text):
            found += self._pieces.findall(text[at:m.start()])
            found.append(self.vocabulary.special[m.group()])
            at = m.end()
        return found + self._pieces.findall(text[at:])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit integers."""
        pieces = [self.cut(t) for t in texts]
        words = set(chain.from_iterable(pieces))
        self.learn(words.difference(self.vocabulary.special.values()))
        known, out = self.known.__getitem__, []
        for own in pieces:
            try:
                out.append(b"".join(map(known, own)))
            except KeyError:  # a special token among the words
                out.append(b"".join(known(w) if type(w) is str else w.to_bytes(4, "little") for w in own))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters, ids outside the vocabulary nothing."""
        known = self.vocabulary.bytes_of
        return b"".join([known.get(i, b"") for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> TrieEncoder:
    """One encoder in each Python worker, kept from task to task."""
    return TrieEncoder(path)


def encoded(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """doc_id and ``ids``, the token ids of each text.

    ``vocabulary`` is a tokenizer file that every executor can open.
    """

    def make():
        def compute(texts: list[str]) -> dict:
            found = encoder(vocabulary).encode(texts)
            offsets = np.cumsum([0, *map(len, found)]) // 4
            flat = np.frombuffer(b"".join(found), dtype="<i4")
            return {"ids": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, pa.int32()))}

        return compute

    return map_texts(docs, make, "ids array<int>", text)


def decoded(rows: DataFrame, vocabulary: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """``rows`` with the text that each row's ids stand for; null ids give null."""
    ship_package(rows.sparkSession)

    @F.pandas_udf("string")
    def texts(column):
        return column.map(lambda i: None if i is None else encoder(vocabulary).decode(i))

    return rows.withColumn(out, texts(F.col(ids)))


def round_trip(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, lossless: each text encoded and its ids decoded again in one pass.

    The first digest is of the ids as little-endian 32-bit integers, the second
    of the decoded text in UTF-8; ``lossless`` says whether that is the text.
    """

    def make():
        def compute(texts: list[str]) -> dict:
            made = encoder(vocabulary)
            n, ids_hash, text_hash, same = [], [], [], []
            for t, ids in zip(texts, made.encode(texts)):
                back = made.decode(np.frombuffer(ids, dtype="<u4").tolist())
                n.append(len(ids) // 4)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                text_hash.append(hashlib.sha256(back.encode("utf-8")).hexdigest())
                same.append(back == t)
            return {"n_tokens": np.array(n, dtype=np.int64), "ids_sha256": ids_hash, "decoded_sha256": text_hash, "lossless": np.array(same, dtype=bool)}

        return compute

    return map_texts(docs, make, "n_tokens bigint, ids_sha256 string, decoded_sha256 string, lossless boolean", text)
