"""Substring dedup by recompression: words in windows that stand earlier already are taken out.

Recompression shortens a word sequence in rounds.  A run of one word gets a name, then
in each round two neighbours get one name if the first falls into the left and the
second into the right half of the names, halves and names being hashes that all tasks
share.  So equal stretches get equal symbols wherever they stand, but for some at their
edges, and each symbol knows the words it hangs on: its own and those that kept it from
growing.  A window of ``window`` words that repeats holds, at each of its places, the same
symbols among those that hang on words of the window alone.

1. Every text is parsed, and each symbol counted over all texts; a count of one comes
   with its place.
2. A window that holds a symbol of count one stands nowhere else.  The rest are
   candidates, a small share of all windows.
3. Candidates are named by 96 bits of their words; the least place of each name is its
   first.  Candidates that are not their name's first stand earlier, and their words go.

A text that is a copy of another is its own top symbol: only the copy of least id is
parsed, and of the others every word goes if there are enough for a window.

Counts and least places are aggregates that combine before the shuffle, so a passage
that stands everywhere costs each task one row.  What comes together for one row is
the list of a single text.  Texts are shuffled once, by id; all three steps read that.

Null counts as the empty text: 0 words, none removed.  Words are what ASCII white space
separates, unchanged.  A null id comes after all others; the largest long stands for it.
Repeated rows are one place, so neither removes the other; of rows of one id with
different texts, any one counts as the first place of what they share.  Other columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from murmurlens.session import materialise

from .common import LAST_ID, ship_package, slices, texts_of

WINDOW = 20
ROUNDS = 4
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _named(kind: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of a run (kind 0: word and length) or of a pair."""
    return _mixed(_mixed(a + np.uint64(_ODD[kind])) * np.uint64(_ODD[2]) + b)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def parse(words: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the word sequences of consecutive documents: name, and the range [low, high) of words it hangs on.

    The range goes beyond the document where its border kept a symbol from growing.
    """
    n = len(words)
    if not n:
        return words, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    heads = np.flatnonzero(np.r_[True, (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])])
    length = np.diff(np.r_[heads, n])
    name, of = words[heads].copy(), doc[heads]
    runs = length > 1
    name[runs] = _named(0, name[runs], length[runs].astype(np.uint64))
    low, high = heads - 1, heads + length + 1
    for r in range(rounds):
        right = (_mixed(name + np.uint64(r + 1)) >> np.uint64(63)).astype(bool)
        together = of[1:] == of[:-1]
        merges = np.r_[~right[:-1] & right[1:] & together, False]
        merged = np.r_[False, merges[:-1]]
        alone = ~merges & ~merged
        # what kept a lone symbol from merging: the neighbour on its side, or the border
        before, after = np.r_[False, together], np.r_[together, False]
        from_left, from_right = np.flatnonzero(alone & right & before), np.flatnonzero(alone & ~right & after)
        new_low, new_high = low.copy(), high.copy()
        for at, side in ((from_left, -1), (from_right, 1)):
            new_low[at], new_high[at] = np.minimum(low[at], low[at + side]), np.maximum(high[at], high[at + side])
        first = np.flatnonzero(merges)
        new_low[first], new_high[first] = np.minimum(low[first], low[first + 1]), np.maximum(high[first], high[first + 1])
        name[first] = _named(1, name[first], name[first + 1])
        keep = ~merged
        name, of, low, high = name[keep], of[keep], new_low[keep], new_high[keep]
    return name, low, high


def usable_symbols(words: np.ndarray, doc: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols that some window of their document holds: name, first and last start of those windows (positions in ``words``).

    ``starts`` are the positions where documents start, and the end of the last.
    """
    name, low, high = parse(words, doc)
    # a range may go one word beyond its document; its middle does not
    of = doc[(low + high) // 2]
    first, last = np.maximum(high - window, starts[of]), np.minimum(low, starts[of + 1] - window)
    ok = (first <= last) & (low >= starts[of]) & (high <= starts[of + 1])
    return name[ok], first[ok], last[ok]


def candidate_windows(sizes: np.ndarray, spans: list[np.ndarray], window: int) -> np.ndarray:
    """Which positions start a window that no symbol of count one rules out; ``spans`` are packed ranges of starts per document."""
    starts = np.r_[0, np.cumsum(sizes)]
    cover = np.zeros(starts[-1] + 1, dtype=np.int32)
    first = np.concatenate([(x >> 8) + starts[i] for i, x in enumerate(spans)]) if spans else np.zeros(0, dtype=np.int64)
    last = first + (np.concatenate([x & 255 for x in spans]) if spans else first)
    np.add.at(cover, first, 1)
    np.add.at(cover, last + 1, -1)
    ends = np.repeat(starts[1:], sizes)
    return (np.cumsum(cover)[:-1] == 0) & (np.arange(starts[-1]) + window <= ends)


def window_names(words: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes that name the windows starting at the given positions."""
    a, b = np.zeros(len(at), dtype=np.uint64), np.full(len(at), 1, dtype=np.uint64)
    for i in range(window):
        w = words[at + i]
        a = (a ^ w) * np.uint64(_ODD[0])
        a ^= a >> np.uint64(32)
        b = (b + w) * np.uint64(_ODD[1])
        b ^= b >> np.uint64(29)
    return _mixed(a), _mixed(b)


def _word_slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]], np.ndarray]]:
    """Slices of a batch with the words of each text and their numbers."""
    for part in slices(batch, "__text"):
        words = [words_of(t) for t in texts_of(part, "__text")]
        yield part, words, np.fromiter(map(len, words), dtype=np.int64, count=len(words))


def _flat(words: list[list[bytes]]) -> np.ndarray:
    return word_hashes([w for ws in words for w in ws])


def _keys(part: pa.RecordBatch, of: np.ndarray) -> list[pa.Array]:
    """Id and variant of the texts with the given numbers."""
    key = part.column("__key")
    return [key.field(name).take(pa.array(of)) for name in ("id", "variant")]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _lists(part: pa.RecordBatch, column: str) -> list[np.ndarray]:
    """A column of lists of longs; null is empty."""
    return [np.zeros(0, dtype=np.int64) if x is None else np.asarray(x, dtype=np.int64) for x in (v.values if v.is_valid else None for v in part.column(column))]


def _key(id_: Column | str, variant: Column | str) -> Column:
    """Key of a document; never null in any part, so that all joins deal it out alike."""
    none = F.lit(0).cast("long")
    return F.struct(F.coalesce(id_, none).alias("id"), F.coalesce(variant, none).alias("variant")).alias("__key")


def keyed_texts(docs: DataFrame, text: str) -> DataFrame:
    """__key (id and variant), __text and __copy (whether an earlier row has the same text) of every row.

    The variant is 0 as long as no two texts share an id; else it is the text's
    hash, all 64 bits of it.  Texts are dealt out by key, once, and whatever is found
    out about a document comes to them by key.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    id_ = F.coalesce("doc_id", F.lit(LAST_ID)).cast("long")
    hashes = docs.select(id_.alias("id"), F.xxhash64(raw).alias("h1"), F.xxhash64(F.lit(1), raw).alias("h2")).distinct()
    hashes = materialise(hashes, "dedup-texts")
    shared = not hashes.groupBy("id").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").isEmpty()

    def key(id_: Column, h1: Column) -> Column:
        return _key(id_, h1 if shared else F.lit(0).cast("long"))

    least = hashes.groupBy("h1", "h2").agg(F.min("id").alias("least"))
    copies = hashes.join(least, ["h1", "h2"]).where("id > least").select(key(F.col("id"), F.col("h1")), F.lit(True).alias("__copy"))
    texts = docs.select(key(id_, F.xxhash64(raw)), raw.alias("__text"))
    return texts.join(copies.hint("shuffle_hash"), "__key", "left")


def remove_repeats(docs: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and ``kept``, the words that stay joined by one space, of every row."""
    if not 2 <= window <= 256:
        raise ValueError("a window has 2 to 256 words")
    ship_package(docs.sparkSession)
    texts = keyed_texts(docs, text)
    # the same columns and the same exchange of texts in all three steps
    parsed = texts.where(F.col("__copy").isNull())

    def symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words, sizes in _word_slices(batch):
                if not sizes.sum():
                    continue
                starts = np.r_[0, np.cumsum(sizes)]
                doc = np.repeat(np.arange(len(sizes)), sizes)
                name, first, last = usable_symbols(_flat(words), doc, starts, window)
                of = doc[first]
                span = ((first - starts[of]) << 8) | (last - first)
                yield pa.RecordBatch.from_arrays([_signed(name), *_keys(part, of), pa.array(span)], ["name", "id", "variant", "span"])

    found = parsed.mapInArrow(symbols, "name bigint, id bigint, variant bigint, span bigint")
    once = found.groupBy("name").agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in ("id", "variant", "span")]).where("n = 1")
    spans = once.select(_key("id", "variant"), "span").groupBy("__key").agg(F.collect_list("span").alias("__spans"))
    ruled = texts.join(spans.hint("shuffle_hash"), "__key", "left")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words, sizes in _word_slices(batch):
                at = np.flatnonzero(candidate_windows(sizes, _lists(part, "__spans"), window))
                if not len(at):
                    continue
                of = np.repeat(np.arange(len(sizes)), sizes)[at]
                a, b = window_names(_flat(words), at, window)
                yield pa.RecordBatch.from_arrays([_signed(a), pa.array(b.astype(np.uint32).view(np.int32)), *_keys(part, of)], ["a", "b", "id", "variant"])

    places = ruled.where(F.col("__copy").isNull()).mapInArrow(candidates, "a bigint, b int, id bigint, variant bigint")
    firsts = places.groupBy("a", "b").agg(F.min("id").alias("id"), F.min_by("variant", "id").alias("variant"))
    firsts = firsts.select(_key("id", "variant"), "a").groupBy("__key").agg(F.collect_list("a").alias("__firsts"))
    known = ruled.join(firsts.hint("shuffle_hash"), "__key", "left")

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words, sizes in _word_slices(batch):
                gone = _removed(words, sizes, part, window)
                starts = np.r_[0, np.cumsum(sizes)]
                kept, removed = [], []
                for i, ws in enumerate(words):
                    out = gone[starts[i]:starts[i + 1]]
                    removed.append(int(out.sum()))
                    kept.append(b" ".join(ws if not removed[-1] else [w for w, g in zip(ws, out.tolist()) if not g]).decode("utf-8", "replace"))
                ids = part.column("__key").field("id")
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept"])

    out = known.mapInArrow(rest, "id bigint, n_words bigint, n_removed bigint, kept string")
    return out.select(F.nullif("id", F.lit(LAST_ID)).alias("doc_id"), "n_words", "n_removed", "kept")


def _removed(words: list[list[bytes]], sizes: np.ndarray, part: pa.RecordBatch, window: int) -> np.ndarray:
    """Which words of the texts of a slice lie in a window that stands earlier."""
    starts, of = np.r_[0, np.cumsum(sizes)], np.repeat(np.arange(len(sizes)), sizes)
    copy = np.asarray(part.column("__copy").is_valid(), dtype=bool)
    cover = np.zeros(starts[-1] + 1, dtype=np.int32)
    # a copy has no symbols of its own: all its windows stand earlier
    gone = copy[of] & (sizes[of] >= window)
    mine = candidate_windows(sizes, _lists(part, "__spans"), window) & ~copy[of]
    at = np.flatnonzero(mine)
    if len(at):
        name, _ = window_names(_flat(words), at, window)
        firsts = _lists(part, "__firsts")
        later = np.ones(len(at), dtype=bool)
        bounds = np.searchsorted(at, starts)
        for i in np.flatnonzero(np.diff(bounds)).tolist():
            own = name[bounds[i]:bounds[i + 1]]
            _, head = np.unique(own, return_index=True)
            first = np.zeros(len(own), dtype=bool)
            first[head] = True  # the others stand earlier in the text itself
            later[bounds[i]:bounds[i + 1]] = ~(first & np.isin(own, firsts[i].view(np.uint64)))
        np.add.at(cover, at[later], 1)
        np.add.at(cover, at[later] + window, -1)
    return gone | (np.cumsum(cover)[:-1] > 0)
