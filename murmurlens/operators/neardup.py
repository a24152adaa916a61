"""Near-duplicate removal: keep a row iff no *kept* earlier row is similar.

Two rows can match if they agree in the group columns and in their first two
tokens, their length buckets differ by at most one, and their token-set score
reaches the threshold.  The result equals a sequential pass in row order:

1. Rows with equal group, prefix, bucket and token set behave alike, so each
   such set is one node, its first row.  A flood of copies ends here, in a
   pre-aggregated ``min``.
2. Nodes of one block meet in rounds.  A round's *front* are the first of them by
   row order, ``frontier`` in the first round and four times as many in each
   later one, so the number of rounds is a logarithm of the largest block.  All
   before the front is settled, so :func:`_settle` finds what of it is kept, and the kept
   ones remove their near copies from the rest of the block.  A cluster of ``n`` near
   copies whose first is early costs a small multiple of ``n`` comparisons, not ``n²``.
3. Nodes of equal or adjacent buckets are compared in *cells*: runs of a block's
   buckets up to a bounded size and work, often the whole block.  A text is shipped once to its
   own cell, and once more if it stands at a border.  Only buckets that are beyond a *tile* by
   themselves are cut into tiles, dealt out to tasks in pairs (:func:`_pairs`); their
   texts are shipped once for each tile they meet.
4. In a bucket or tile, one node is compared with all others at once (:class:`Tile`):
   token sets, then bitmaps and counts of characters and of their pairs.  What these bounds leave open,
   of many nodes together, goes to common subsequences by arrays (:class:`_Batch`).  Only pairs of
   very long texts that pass the bounds are left to :func:`_edges`.
5. Cells, tiles and tasks are cut by the steps their pairs take, not only by their texts' size.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from functools import cached_property, reduce
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from murmurlens.functions.cleaning import comparison_form
from murmurlens.functions.common import computed_once
from murmurlens.functions.similarity import block_prefix, length_bucket, similar_pairs, subsequence_within, token_set
from murmurlens.operators.dedup import number_within
from murmurlens.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Nodes of a block that are settled in round one; a round takes four times those of the one before.
FRONTIER = 4096
_GROWTH, _ROUNDS = 4, 12
#: Nodes of a tile at most, and about how many characters they may have together.
_TILE, _TILE_CHARS = 4096, 4_000_000
#: About how many characters the nodes of a cell have together, that of its last bucket aside.
_CELL_CHARS = 2_000_000
#: About how many steps the pairs of a cell (that of its last bucket aside) or of two tiles take together, some seconds; tasks at most.
_CELL_WORK, _MOST_TASKS = 1e9, 10_000
#: Longest text whose common subsequences are found in the tile; of longer ones so many characters are compared as a bound.
_LONG = 2000
#: Pairs for each word of a text below which they go one by one.
_FEW = 8
#: Words of all pairs that are compared together, and characters after which those that cannot reach their need end.
_BATCH, _CHECK = 1 << 15, 32
#: Longs of the bitmaps.
_CHAR_LONGS, _WORD_LONGS = 4, 2
_BAG, _GRAMS = 128, 1024


def _group_text(group: Sequence[str]) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in group]


def profile(df: DataFrame, text_col: str = "text", order: str = "seq", group: Sequence[str] = ()) -> DataFrame:
    """``id, block, prefix, bucket, tokens`` of every row with comparable text."""
    named = [g.alias(f"g{i}") for i, g in enumerate(_group_text(group))]
    source = df.select(F.col(order).alias("id"), *named, F.col(text_col).alias("raw"))
    normal = computed_once(source, "normal", comparison_form(F.col("raw")))
    prefix = block_prefix(F.col("normal"))
    return normal.filter(F.col("normal") != "").select(
        "id",
        F.to_json(F.array(*[F.col(f"g{i}") for i in range(len(named))], prefix)).alias("block"),
        prefix.alias("prefix"),
        length_bucket(F.col("normal")).alias("bucket"),
        F.array_join(token_set(F.col("normal")), " ").alias("tokens"),
    )


def candidate_counts(df: DataFrame, text_col: str = "text", order: str = "seq", group: Sequence[str] = ()) -> DataFrame:
    """Pairs in reach per block, counted from bucket sizes without forming a pair."""
    rows = profile(df, text_col, order, group)
    sizes = rows.groupBy("block", "prefix", "bucket").agg(F.count(F.lit(1)).alias("n"))
    by_bucket = Window.partitionBy("block").orderBy("bucket").rangeBetween(-1, -1)
    below = F.coalesce(F.sum("n").over(by_bucket), F.lit(0))
    pairs = sizes.withColumn("pairs", (F.col("n") * (F.col("n") - 1) / 2).cast("bigint") + F.col("n") * below)
    return (
        pairs.groupBy("block", "prefix")
        .agg(F.sum("n").alias("n_rows"), F.sum("pairs").alias("n_pairs"))
        .filter(F.col("n_pairs") > 0)
    )


def _nodes(df: DataFrame, text_col: str, order: str, group: Sequence[str]) -> DataFrame:
    rows = profile(df, text_col, order, group)
    return rows.groupBy("block", "bucket", "tokens").agg(F.min("id").alias("id"))


def _bitmaps(text: str, codes: np.ndarray) -> list[int]:
    """Bits of characters, turned over by each, and bits of tokens, set by each.

    The second ``e`` of a text turns another bit than the first, so of two
    texts' bits no more differ than one has characters the other has not.
    """
    points = np.sort(np.frombuffer(text.replace(" ", "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)).astype(np.uint64)
    place = np.arange(len(points), dtype=np.uint64)
    first = np.r_[True, points[1:] != points[:-1]][: len(points)]
    place -= np.maximum.accumulate(np.where(first, place, 0))
    mixed = (points * np.uint64(0x9E3779B97F4A7C15) + place) * np.uint64(0xD6E8FEB86659FD93)
    chars = np.bincount((mixed >> np.uint64(32)).astype(np.int64) % (64 * _CHAR_LONGS), minlength=64 * _CHAR_LONGS) & 1
    words = np.bincount(codes % (64 * _WORD_LONGS), minlength=64 * _WORD_LONGS) > 0
    return [int(x) for bits in (chars, words) for x in np.packbits(bits.astype(np.uint8)).view("<i8")]


class Tile:
    """Texts of a tile (sorted distinct tokens, joined) as arrays, to compare one other text with all of them.

    Every token is followed by a space here, so lengths of joined tokens are sums less one.
    """

    def __init__(self, ids: np.ndarray, texts: list[str], threshold: float):
        self.ids, self.texts, self.threshold = ids, texts, threshold
        tokens = [t.split(" ") for t in texts]
        self.vocabulary: dict[str, int] = {}
        place = self.vocabulary
        self.token = np.array([place.setdefault(t, len(place)) for t in chain.from_iterable(tokens)], dtype=np.int64)
        self.n_tokens = np.array([len(t) for t in tokens], dtype=np.int64)
        self.first = np.r_[0, np.cumsum(self.n_tokens)[:-1]]
        self.width = np.array([len(t) + 1 for t in place], dtype=np.int64)[self.token]
        self.token_start = np.cumsum(self.width) - self.width
        self.points = _points(" ".join(texts) + " ")
        self.alphabet, codes = np.unique(self.points, return_inverse=True)
        self.codes = (codes + 1).astype(np.int32)
        self.size = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        self.start = np.r_[0, np.cumsum(self.size)[:-1]]
        self.bits = np.array([_bitmaps(t, self.token[f : f + n])[:_CHAR_LONGS] for t, f, n in zip(texts, self.first, self.n_tokens)], dtype=np.int64)
        char_owner = np.repeat(np.arange(len(texts)), self.size)
        bags = np.bincount(char_owner * _BAG + self.codes % _BAG, minlength=len(texts) * _BAG)
        self.bags = bags.reshape(-1, _BAG).astype(np.uint16 if self.size.max() < 1 << 16 else np.int32)

    def bounded(self, text: str, open_: np.ndarray) -> tuple[np.ndarray, "_Open"]:
        """Places among ``open_`` whose score with ``text`` surely reaches the threshold, and those that bounds do not decide."""
        mine = text.split(" ")
        in_mine = np.full(len(self.vocabulary), -1, dtype=np.int64)
        for at, t in enumerate(mine):
            known = self.vocabulary.get(t)
            if known is not None:
                in_mine[known] = at
        at = in_mine[self.token]
        shared = at >= 0
        both = np.add.reduceat(np.where(shared, self.width, 0), self.first)[open_]
        s = np.maximum(both - 1, 0)
        x = np.maximum(len(text) - both, 0)  # one space less than tokens
        y = np.maximum(self.size[open_] - 1 - both, 0)
        total = 2 * s + np.where(s > 0, 2, 0) + x + y
        part = np.minimum(x, y)
        lower = np.where(s > 0, 100 - 100 * (1 + part) / (2 * s + 1 + part), 0.0)
        sure = ((s > 0) & (part == 0)) | (lower >= self.threshold)
        need = (x + y - total * (100 - self.threshold) / 100) / 2 - 1e-6
        maybe = np.flatnonzero(~sure & (part > 0) & (part >= need))
        codes = self._codes(text + " ")
        if len(maybe):
            own = np.array(_bitmaps(text, np.zeros(1, dtype=np.int64))[:_CHAR_LONGS], dtype=np.int64)
            differing = np.bitwise_count((self.bits[open_[maybe]] ^ own).view(np.uint64)).sum(axis=1, dtype=np.int64)
            maybe = maybe[differing <= x[maybe] + y[maybe] - 2 * need[maybe] + 2]
        if len(maybe):
            bag = np.minimum(np.bincount(codes[codes > 0] % _BAG, minlength=_BAG), np.iinfo(self.bags.dtype).max).astype(self.bags.dtype)
            common = np.minimum(self.bags[open_[maybe]], bag).sum(axis=1, dtype=np.int64) - both[maybe] - 1
            maybe = maybe[common >= need[maybe]]
        # a character left out breaks two pairs of neighbours, one put in breaks one
        by_grams = maybe[3 * need[maybe] > x[maybe] + y[maybe] - 1]
        if len(by_grams):
            gram = np.bincount(_grams(_points(" " + text + " ")), minlength=_GRAMS)
            gram = np.minimum(gram, np.iinfo(self.grams.dtype).max).astype(self.grams.dtype)
            common = np.minimum(self.grams[open_[by_grams]], gram).sum(axis=1, dtype=np.int64) - both[by_grams]
            far = by_grams[common + x[by_grams] + y[by_grams] - 1 < 3 * need[by_grams]]
            maybe = np.setdiff1d(maybe, far, assume_unique=True)
        return open_[sure], _Open(text, mine, codes, at, shared, open_[maybe], x[maybe], y[maybe], total[maybe], need[maybe])

    @cached_property
    def grams(self) -> np.ndarray:
        """Counts of pairs of neighbouring characters, a space before and after each token."""
        points = np.r_[np.uint32(32), self.points]
        owner = np.repeat(np.arange(len(self.texts)), self.size)
        counts = np.bincount(owner * _GRAMS + _grams(points), minlength=len(self.texts) * _GRAMS)
        return counts.reshape(-1, _GRAMS).astype(np.uint16 if self.size.max() < 1 << 16 else np.int32)

    def similar_to(self, text: str, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places among ``open_`` whose score with ``text`` reaches the threshold, and those too long to tell here."""
        sure, rest = self.bounded(text, open_)
        queue = _Queue(self)
        queue.add(0, rest)
        parts = list(queue.run())
        found = [sure] + [place for _, place, known in parts if known]
        return np.concatenate(found), np.concatenate([np.empty(0, dtype=np.int64)] + [place for _, place, known in parts if not known])

    def _codes(self, text: str) -> np.ndarray:
        """Codes of characters as in the tile, 0 for those it has not."""
        points = _points(text)
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at + 1, 0)


class _Open(NamedTuple):
    """A text and the places of a tile whose score with it needs the common subsequence of what they do not share.

    ``x`` and ``y`` are the lengths of these parts, ``need`` what they must have in common.
    """

    text: str
    mine: list[str]
    codes: np.ndarray
    at: np.ndarray
    shared: np.ndarray
    places: np.ndarray
    x: np.ndarray
    y: np.ndarray
    total: np.ndarray
    need: np.ndarray

    def of(self, which: np.ndarray) -> "_Open":
        return self._replace(**{f: getattr(self, f)[which] for f in ("places", "x", "y", "total", "need")})


class _Queue:
    """Pairs of many texts with places of a tile, whose common subsequences are found together."""

    def __init__(self, tile: Tile):
        self.tile = tile
        self.short, self.long = _Batch(tile, sys.maxsize), _Batch(tile, _LONG)

    def add(self, query: int, rest: _Open) -> None:
        is_long = (len(rest.text) > _LONG) | (self.tile.size[rest.places] > _LONG)
        for batch, which in ((self.short, ~is_long), (self.long, is_long)):
            if which.any():
                batch.add(query, rest.of(which))

    def full(self) -> bool:
        return self.short.full() or self.long.full()

    def run(self, alive: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """Queries and places that reach the threshold (True), or are too long to tell but pass the bounds (False)."""
        for batch, known in ((self.short, True), (self.long, False)):
            for query, rest, length in batch.run(alive):
                score = 100 - 100 * (rest.x + rest.y - 2 * length) / rest.total
                hit = score >= self.tile.threshold if known else length >= rest.need
                if hit.any():
                    yield query[hit], rest.places[hit], known
            batch.clear()


class _Batch:
    """Common subsequences of pairs by bit rows of 63 characters a word, of at most ``stop`` characters of the places.

    Rows hold what a text does not share with its place.  A match far from the
    diagonal cannot be part of a subsequence that is long enough, so only words near it are
    counted, and a pair ends as soon as what is left cannot reach its need.
    """

    def __init__(self, tile: Tile, stop: int):
        self.tile, self.stop = tile, stop
        self.clear()

    def clear(self) -> None:
        self.open: list[tuple[int, _Open]] = []
        self.n = self.words = 0

    def add(self, query: int, rest: _Open) -> None:
        self.open.append((query, rest))
        self.n += len(rest.places)
        self.words = max(self.words, self._words(rest))

    def _words(self, rest: _Open) -> int:
        """Words that matches near the diagonal can lie in."""
        rows = min(self.stop, int(rest.y.max()))
        return min(len(rest.text), int(len(rest.text) - rest.need.min()) + rows) // 63 + 1

    def full(self) -> bool:
        return self.n * self.words >= _BATCH

    def run(self, alive: np.ndarray | None) -> Iterator[tuple[np.ndarray, _Open, np.ndarray]]:
        """Queries, pairs and what they have in common at most: exactly that, if it is enough and ``stop`` is not met."""
        if alive is not None:
            self.open = [(q, r.of(alive[r.places])) for q, r in self.open]
            self.open = [(q, r) for q, r in self.open if len(r.places)]
        if not self.open:
            return
        if sum(len(r.places) for _, r in self.open) < _FEW * self.words:
            for query, rest in self.open:
                length = np.array([self._one(rest, i) for i in range(len(rest.places))], dtype=np.int64)
                yield np.full(len(length), query), rest, length
            return
        most, part, n = max(1, 2 * _BATCH // self.words), [], 0
        for query, rest in self.open:
            for first in range(0, len(rest.places), most):
                some = rest.of(np.arange(first, min(first + most, len(rest.places))))
                if part and n + len(some.places) > most:
                    yield from self._together(part)
                    part, n = [], 0
                part.append((query, some))
                n += len(some.places)
        yield from self._together(part)

    def _one(self, rest: _Open, i: int) -> int:
        theirs = self.tile.texts[rest.places[i]].split(" ")
        here, there = set(rest.mine), set(theirs)
        return subsequence_within(" ".join(t for t in rest.mine if t not in there), " ".join(t for t in theirs if t not in here), float(rest.need[i]), self.stop)

    def _together(self, part: list[tuple[int, _Open]]) -> Iterator[tuple[np.ndarray, _Open, np.ndarray]]:
        tables, masks, rows, sizes = zip(*[self._prepared(rest) for _, rest in part])
        words, kinds = max(len(t) for t in tables), len(self.tile.alphabet) + 1
        table = np.zeros((words, len(part), kinds), dtype=np.uint64)
        for i, t in enumerate(tables):
            table[: len(t), i] = t
        counts = [len(rest.places) for _, rest in part]
        mask = np.zeros((words, sum(counts)), dtype=np.uint64)
        for end, m in zip(np.cumsum(counts), masks):
            mask[: len(m), end - m.shape[1] : end] = m
        of = np.repeat(np.arange(len(part)), counts)
        far = np.concatenate([len(rest.text) - rest.need for _, rest in part])
        y, need = (np.concatenate([getattr(rest, f) for _, rest in part]) for f in ("y", "need"))
        length = _in_band(table.reshape(words, -1), mask, of * kinds, np.concatenate(rows), np.concatenate(sizes), y, need, far)
        ends = np.cumsum(counts)
        for (query, rest), end in zip(part, ends):
            yield np.full(len(rest.places), query), rest, length[end - len(rest.places) : end]

    def _prepared(self, rest: _Open) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bits of each character of the text; bits of what it does not share with a place; characters of the places, and how many."""
        tile, n, words = self.tile, len(rest.places), self._words(rest)
        counts = tile.n_tokens[rest.places]
        token = _ranges(tile.first[rest.places], counts)
        owner = np.repeat(np.arange(n), counts)
        common = rest.shared[token]
        kept = np.ones((n, len(rest.mine) + 1), dtype=bool)
        kept[:, -1] = False
        kept[owner[common], rest.at[token[common]]] = False
        ends = np.cumsum([len(t) + 1 for t in rest.mine])
        place = np.arange(64 * words) // 64 * 63 + np.arange(64 * words) % 64
        slot = np.where((np.arange(64 * words) % 64 < 63) & (place < ends[-1]), np.searchsorted(ends, place, "right"), len(rest.mine))
        mask = np.packbits(np.ascontiguousarray(kept[:, slot]), axis=1, bitorder="little").view("<u8")
        last = ends[len(rest.mine) - 1 - np.argmax(kept[:, -2::-1], axis=1)] - 1  # the space after the last token that is left
        inside = np.flatnonzero(last < 63 * words)
        mask[inside, last[inside] // 63] ^= np.uint64(1) << (last[inside] % 63).astype(np.uint64)
        at = np.arange(min(ends[-1], 63 * words))
        table = np.zeros((words, len(tile.alphabet) + 1), dtype=np.uint64)
        np.add.at(table, (at // 63, rest.codes[at]), np.uint64(1) << (at % 63).astype(np.uint64))
        own, owner = token[~common], owner[~common]
        chars = tile.codes[_ranges(tile.token_start[own], tile.width[own])]
        whole = np.bincount(owner, tile.width[own], minlength=n).astype(np.int64)
        sizes = np.minimum(whole - 1, self.stop)
        return table, mask.T, chars[_ranges(np.cumsum(whole) - whole, sizes)], sizes


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``start, start + 1, ..`` of each, ``count`` of them."""
    return np.arange(count.sum()) + np.repeat(start - np.cumsum(count) + count, count)


def _in_band(table: np.ndarray, mask: np.ndarray, base: np.ndarray, chars: np.ndarray, sizes: np.ndarray,
             y: np.ndarray, need: np.ndarray, far: np.ndarray) -> np.ndarray:
    """What pairs have in common, or a bound of it that is below their need; ``y - sizes`` characters are taken as matched."""
    order = np.argsort(-sizes, kind="stable")
    chars = chars[_ranges((np.cumsum(sizes) - sizes)[order], sizes[order])]
    sizes, y, need, far, mask = sizes[order], y[order], need[order], far[order], np.ascontiguousarray(mask[:, order])
    rows = np.zeros((int(sizes[0]), len(order)), dtype=np.intp)
    rows[_ranges(np.zeros_like(sizes), sizes), np.repeat(np.arange(len(order)), sizes)] = chars + np.repeat(base[order], sizes)
    words, length = len(table), np.full(len(order), -1, dtype=np.int64)
    full, top = np.uint64((1 << 63) - 1), np.uint64(63)
    free = np.full(mask.shape, full)
    here, dropped, done = order, 0, 0
    while len(here):
        low, high, until = int(np.floor((need - y).min())), int(far.max()), min(done + _CHECK, int(sizes[0]))
        hits, moves, carries = (np.empty(len(here), dtype=np.uint64) for _ in range(3))
        for at in range(done, until):
            k = len(here) if sizes[-1] > at else int(np.searchsorted(-sizes, -at, "left"))
            row, hit, moved, carry = rows[at - dropped, :k], hits[:k], moves[:k], carries[:k]
            first = max(0, (low + at) // 63)
            for w in range(first, min(words, (high + at) // 63 + 1)):
                v = free[w, :k]
                table[w].take(row, out=hit, mode="clip")
                hit &= mask[w, :k]
                hit &= v
                np.add(v, hit, out=moved)
                if w > first:
                    moved += carry
                np.right_shift(moved, top, out=carry)
                moved &= full
                hit ^= v
                np.bitwise_or(moved, hit, out=v)
        done = until
        matched = words * 63 - np.bitwise_count(free).sum(axis=0, dtype=np.int64)
        over = sizes <= done
        length[here[over]] = (matched + y - sizes)[over]
        go = ~over & (matched + y - done >= need)
        if over.any() or go.sum() < 0.9 * len(go):
            rows, dropped = rows[done - dropped :, go], done
            free, mask, sizes, y, need, far, here = free[:, go], mask[:, go], sizes[go], y[go], need[go], far[go], here[go]
    return length


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _grams(points: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring characters."""
    return ((points[:-1] * np.uint32(0x9E3779B1) + points[1:] * np.uint32(0x85EBCA6B)) >> np.uint32(12)).astype(np.int64) % _GRAMS


class _Found:
    """Pairs ``a < b``, and whether their score is known to reach the threshold."""

    def __init__(self, ids: np.ndarray, texts: list[str], threshold: float, first_only: bool):
        self.ids, self.texts, self.threshold, self.first_only = ids, texts, threshold, first_only
        self.a, self.b, self.sure = ([np.empty(0, dtype=kind)] for kind in (np.int64, np.int64, bool))

    def meet(self, left: np.ndarray, right: np.ndarray) -> None:
        """Compare the rows of ``left`` with later ones of ``right``."""
        ids = self.ids
        if not len(left) or not len(right) or ids[left].min() >= ids[right].max():
            return
        right = right[np.argsort(ids[right], kind="stable")]
        tile = Tile(ids[right], [self.texts[i] for i in right], self.threshold)
        alive = np.ones(len(right), dtype=bool)
        queue = _Queue(tile)

        def note(query: np.ndarray, places: np.ndarray, known: bool) -> None:
            if self.first_only and known:
                alive[places] = False
            self.a.append(ids[query])
            self.b.append(tile.ids[places])
            self.sure.append(np.full(len(places), known))

        for i in left[np.argsort(ids[left], kind="stable")]:
            later = int(np.searchsorted(tile.ids, ids[i], "right"))
            open_ = later + np.flatnonzero(alive[later:])
            if not len(open_):
                continue
            found, rest = tile.bounded(self.texts[i], open_)
            note(np.full(len(found), i), found, True)
            queue.add(i, rest)
            if queue.full():
                for hits in queue.run(alive if self.first_only else None):
                    note(*hits)
        for hits in queue.run(alive if self.first_only else None):
            note(*hits)

    def table(self) -> pa.Table:
        return pa.table({"a": np.concatenate(self.a), "b": np.concatenate(self.b), "sure": np.concatenate(self.sure)})


def _compare(threshold: float, first_only: bool):
    """Function of the rows of a cell or a pair of tiles; rows may be of both sides."""

    def compare(table: pa.Table) -> pa.Table:
        on_left, on_right, bucket = (table.column(c).to_numpy(zero_copy_only=False) for c in ("left", "right", "bucket"))
        found = _Found(table.column("id").to_numpy(), table.column("tokens").to_pylist(), threshold, first_only)
        for at in np.unique(bucket[on_right]):
            found.meet(np.flatnonzero(on_left & (np.abs(bucket - at) <= 1)), np.flatnonzero(on_right & (bucket == at)))
        return found.table()

    return compare


def _steps(bucket: Column, threshold: float) -> Column:
    """About how many steps a pair of texts takes: words times characters near the diagonal, and what a pair takes besides."""
    chars = 20.0 * (bucket + 1)
    return 1000 + chars * chars / 63 * min(1.0, (100 - threshold) / 30) ** 2


def _by_cells(left: DataFrame, right: DataFrame, meetings: DataFrame) -> DataFrame:
    """Rows of nodes by the cells they meet in; the bucket of the right says which."""
    chars = 20 * (F.max("to") * (F.col("br") + 1) + F.sum(F.col("of") * (F.col("bl") + 1)))
    size = chars + F.sum(F.floor(F.col("work") * (_CELL_CHARS / _CELL_WORK)))
    before = Window.partitionBy("block").orderBy("br").rowsBetween(Window.unboundedPreceding, -1)
    cell = F.floor(F.coalesce(F.sum("size").over(before), F.lit(0)) / _CELL_CHARS)
    cells = meetings.groupBy("block", "br").agg(size.alias("size")).select("block", F.col("br").alias("bucket"), cell.alias("own"))
    visits = meetings.select("block", F.col("bl").alias("from"), F.col("br").alias("bucket")).join(cells, ["block", "bucket"])
    visits = visits.groupBy("block", F.col("from").alias("bucket")).agg(F.collect_set("own").alias("met"))
    none = F.array().cast("array<bigint>")
    places = visits.join(cells, ["block", "bucket"], "full").select("block", "bucket", F.coalesce("met", none).alias("met"), "own")
    places = materialise(places, "cells")

    def rows(df: DataFrame, on_left: bool, on_right: bool) -> DataFrame:
        own = F.when(F.col("own").isNotNull(), F.array("own")).otherwise(none)
        each = {(True, True): F.array_union("met", own), (True, False): F.col("met"), (False, True): own}[on_left, on_right]
        met = df.select("block", "bucket", "id", "tokens").join(places, ["block", "bucket"])
        met = met.select("block", "bucket", "id", "tokens", "met", "own", F.explode(each).alias("cell"))
        is_left = F.array_contains("met", F.col("cell")) if on_left else F.lit(False)
        is_right = F.coalesce(F.col("own") == F.col("cell"), F.lit(False)) if on_right else F.lit(False)
        return met.select("block", "cell", "bucket", is_left.alias("left"), is_right.alias("right"), "id", "tokens")

    return rows(left, True, True) if left is right else rows(left, True, False).unionByName(rows(right, False, True))


def _by_tiles(left: DataFrame, right: DataFrame, meetings: DataFrame) -> DataFrame:
    """Rows of nodes by the pairs of tiles (``bl, br, tl, tr``) they meet in."""

    def dealt_to(df: DataFrame, is_left: bool) -> DataFrame:
        own, n_own, n_other = ("bl", "nl", "nr") if is_left else ("br", "nr", "nl")
        mine = F.pmod(F.xxhash64("id"), F.col(n_own)).cast("bigint")
        each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n_other) - 1))
        met = df.select("block", F.col("bucket").alias(own), "id", "tokens").join(meetings, ["block", own])
        met = met.select("block", "bl", "br", mine.alias("mine"), each.alias("other"), F.col(own).alias("bucket"), F.lit(is_left).alias("left"), "id", "tokens")
        tl, tr = ("mine", "other") if is_left else ("other", "mine")
        return met.select("block", "bl", "br", F.col(tl).alias("tl"), F.col(tr).alias("tr"), "bucket", "left", (~F.col("left")).alias("right"), "id", "tokens")

    return dealt_to(left, True).unionByName(dealt_to(right, False))


def _pairs(left: DataFrame, right: DataFrame, threshold: float, first_only: bool) -> DataFrame:
    """``a, b, sure`` of nodes ``a`` of the left and later ``b`` of the right that are or can be similar.

    ``first_only`` names one ``a`` for a ``b`` of a bucket or tile, if that is sure.
    """
    tile = F.greatest(F.lit(8), F.least(
        F.lit(_TILE), F.floor(F.lit(_TILE_CHARS / 20) / (F.col("bucket") + 1)), F.floor(F.sqrt(_CELL_WORK / _steps(F.col("bucket"), threshold)))))
    sizes = lambda df: df.groupBy("block", "bucket").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / F.first(tile)).alias("tiles"))
    near = F.explode(F.array(*[F.col("bucket") + i for i in (-1, 0, 1)]))
    ours = sizes(left).select("block", F.col("bucket").alias("bl"), F.col("tiles").alias("nl"), F.col("n").alias("of"), near.alias("br"))
    theirs = sizes(right).select("block", F.col("bucket").alias("br"), F.col("tiles").alias("nr"), F.col("n").alias("to"))
    work = F.col("of") * F.col("to") * _steps(F.greatest("bl", "br"), threshold)
    meetings = ours.join(theirs, ["block", "br"]).withColumn("work", work)
    if left is right:
        meetings = meetings.filter((F.col("bl") != F.col("br")) | (F.col("of") > 1))
    meetings = materialise(meetings, "meetings")
    # a bucket of one tile meets others of one tile in cells, all else by tiles
    small = (F.col("nl") == 1) & (F.col("nr") == 1)
    load = meetings.agg(*[F.coalesce(F.sum(F.when(x, F.col("work"))), F.lit(0.0)).alias(n) for n, x in (("small", small), ("crowded", ~small))]).first()
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compared(rows: DataFrame, steps: float, *keys: str) -> DataFrame:
        # dealt out by work: few bytes may take long
        rows = rows.repartition(max(parts, min(int(4 * steps / _CELL_WORK), _MOST_TASKS)), *keys)
        return rows.groupBy(*keys).applyInArrow(_compare(threshold, first_only), "a bigint, b bigint, sure boolean")

    pairs = compared(_by_cells(left, right, meetings.filter(small)), load["small"], "block", "cell")
    if not load["crowded"]:
        return pairs
    tiles = _by_tiles(left, right, meetings.filter(~small))
    return pairs.unionByName(compared(tiles, load["crowded"], "block", "bl", "br", "tl", "tr"))


def _edges(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs that are similar; those not ``sure`` are scored."""
    pairs = materialise(pairs, "pairs")
    unsure = pairs.filter(~F.col("sure"))
    sure = pairs.filter("sure").select("a", "b")
    if unsure.isEmpty():
        return sure
    # few texts are asked for; the others stay where they are
    ends = materialise(unsure.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ends")
    texts = materialise(nodes.select("id", "tokens").join(ends, "id", "left_semi"), "texts")
    side = lambda n: texts.select(F.col("id").alias(n), F.split("tokens", " ").alias(f"tokens_{n}"))
    reach = unsure.join(side("a"), "a").join(side("b"), "b")
    return sure.unionByName(similar_pairs(reach, "tokens_a", "tokens_b", threshold).select("a", "b"))


def _settle(live: DataFrame) -> list[DataFrame]:
    """Drop what a kept node removes, until nothing changes: the dropped ids.

    A node that is never the later end of a live edge is kept; the later ends of
    its edges go, and with them all their edges.
    """
    gone: list[DataFrame] = []
    while not live.isEmpty():
        kept = live.select(F.col("a").alias("id")).distinct().join(
            live.select(F.col("b").alias("id")), "id", "left_anti"
        )
        dropped = materialise(
            live.join(kept.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct(),
            "dropped",
        )
        gone.append(dropped)
        live = materialise(_without(live, dropped, "a", "b"), "live-edges")
    return gone


def _without(df: DataFrame, ids: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.join(ids.select(F.col("id").alias(c)), c, "left_anti")
    return df


def _in_rounds(nodes: DataFrame, frontier: int) -> DataFrame:
    """Nodes with another one in reach of their block, and the round in which each is in the front."""
    nodes = nodes.filter(F.col("id").isNotNull())
    sizes = nodes.groupBy("block", "bucket").agg(F.count(F.lit(1)).alias("n"))
    around = Window.partitionBy("block").orderBy("bucket").rangeBetween(-1, 1)
    # stored, so that its size is known and the texts need no shuffle to meet a short table
    company = materialise(sizes.withColumn("near", F.sum("n").over(around)).filter("near > 1").drop("near"), "company")
    met = nodes.join(company.drop("n"), ["block", "bucket"])
    large = company.groupBy("block").agg(F.sum("n").alias("n")).filter(F.col("n") > frontier).select("block")
    if large.isEmpty():
        return met.withColumn("round", F.lit(0))
    ids = materialise(met.select("id", "block"), "met")
    # places 1 to f are round 0, the next 4f round 1, the next 16f round 2
    place = number_within(ids.join(large, "block"), ["block"], "id", "place")
    bounds = [frontier * (_GROWTH ** (r + 1) - 1) // (_GROWTH - 1) for r in range(_ROUNDS)]
    turn = reduce(lambda later, r: F.when(F.col("place") <= bounds[r], r).otherwise(later), reversed(range(_ROUNDS)), F.lit(_ROUNDS))
    later = place.select("id", turn.alias("round")).groupBy("id").agg(F.min("round").alias("round")).filter("round > 0")
    later = materialise(_without(later, ids.join(large, "block", "left_anti"), "id"), "later")
    return met.join(later, "id", "left").withColumn("round", F.coalesce("round", F.lit(0)))


def _dropped_nodes(nodes: DataFrame, threshold: float, frontier: int) -> DataFrame | None:
    alive = materialise(_in_rounds(nodes, frontier), "rounds")
    last = alive.agg(F.max("round").alias("r")).first()["r"]
    gone: list[DataFrame] = []
    for number in range(-1 if last is None else last + 1):
        front = alive.filter(F.col("round") == number)
        live = materialise(_edges(_pairs(front, front, threshold, False), nodes, threshold).distinct(), "edges")
        dropped = _settle(live)
        gone += dropped
        if number == last:
            break
        if dropped:
            front = materialise(_without(front, reduce(DataFrame.union, dropped), "id"), "kept")
        rest = alive.filter(F.col("round") > number)
        near = _edges(_pairs(front, rest, threshold, True), nodes, threshold).select(F.col("b").alias("id"))
        near = materialise(near.distinct(), "near")
        gone.append(near)
        alive = materialise(_without(rest, near, "id"), "rounds")
    return reduce(DataFrame.union, gone) if gone else None


def kept_ids(df: DataFrame, threshold: float = 95, group: Sequence[str] = (), text_col: str = "text",
             order: str = "seq", frontier: int = FRONTIER) -> DataFrame:
    """Order values of the rows that stay, as column ``id``."""
    threshold = max(1, min(int(threshold), 100))
    nodes = materialise(_nodes(df, text_col, order, group), "nodes")
    dropped = _dropped_nodes(nodes, threshold, frontier)
    ids = nodes.select("id")
    return ids if dropped is None else ids.join(dropped, "id", "left_anti")


def drop_near_duplicates(df: DataFrame, threshold: float = 95, group: Sequence[str] = (), text_col: str = "text",
                         order: str = "seq", frontier: int = FRONTIER) -> DataFrame:
    """Rows that stay; 0 switches the filter off, rows without words are dropped.

    ``order`` must be unique.  Absent group columns are ignored.
    """
    if threshold <= 0:
        return df
    group = [c for c in group if c in df.columns]
    kept = kept_ids(df, threshold, group, text_col, order, frontier)
    return df.join(kept, df[order] == kept["id"], "left_semi")
