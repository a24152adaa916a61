"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A text of any length is cut by its content (``content_digests``): at line ends and after
words whose hash meets a condition.  An edit so changes the paragraphs it touches and no
others.  The distinct hashes of the paragraphs are the digests.  A sketch is a table of cells in three parts.  A digest
goes into one cell of each part, a cell keeping the number of its digests and the
exclusive or of digests and of check hashes.  Sketches of two versions are subtracted
cell by cell: what both have cancels.  A cell left with one digest whose check fits gives
that digest away; taking it out of its other cells gives away more, until nothing is
left.  If something is, the attempt failed and is made again with more room: first the
sketch of one block that is the fingerprint itself, then as many blocks as the digests
might need, a failing block again with more cells, and if that is not enough twice as
many blocks each time, always with other hashes.  Digests that differ are so
recovered without either text, and the likeness of two texts is the Jaccard index of
their digests.

Texts are cut, hashed and brought together by DataFrame operations.  Sketches of many
documents are filled and peeled at once on arrays (``_Sketches``, in Arrow batches); the functions of
columns (``sketch``, ``subtract``, ``peel``, ``difference``) give the same of single values.

Null counts as the empty text; it has no digests and is like another empty text (1).
Equal texts have equal fingerprints.  For neighbours, documents are ordered by id, nulls
last, then by the text's hash; repeated rows are one document and get equal rows.  The
next of the last document is the first, also if there is only one.  Other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from murmurlens.functions.common import computed_once, let
from murmurlens.session import materialise

from .common import ship_package

#: One word in so many ends a paragraph.
WORDS = 4
#: In a word of more characters (text without spaces, say) one pair of characters in so many ends one, too.
LONG_WORD, PAIRS = 32, 16
#: Cells of each of the three parts of the fingerprint's sketch.
CELLS = 8
#: And of a block of a larger sketch; a block that fails is made again with the next number.
BLOCK_CELLS = (6, 12, 20)
#: Digests of both versions for each block, when a single block did not do.
BLOCK_LOAD = 5
#: Attempts with twice the blocks each; one of them has room to spare for any text.
ATTEMPTS = 16
#: Digests whose sketches are worked on at once.
SLICE = 200_000


def content_digests(text: Column) -> Column:
    """Distinct hashes of the paragraphs of a text, cut by content alone."""
    # the text's own marks are told apart, so that "\x01\x03" is a cut and nothing else
    kept = F.when(F.contains(text, F.lit("\x01")), F.replace(text, F.lit("\x01"), F.lit("\x01\x02"))).otherwise(text)

    def ended(part: Column, ends: Column) -> Column:
        return F.when(ends, F.concat(part, F.lit("\x01\x03"))).otherwise(part)

    def by_pairs(word: Column) -> Column:
        def one(chars: Column) -> Column:
            return F.transform(chars, lambda c, i: ended(c, F.pmod(F.xxhash64(F.get(chars, i - 1), c), F.lit(PAIRS)) == 0))

        return F.array_join(let(F.split(word, ""), one), "")

    def word(w: Column) -> Column:
        ends = (F.pmod(F.xxhash64(w), F.lit(WORDS)) == 0) | F.endswith(w, F.lit("\n"))
        return ended(F.when(F.length(w) > LONG_WORD, by_pairs(w)).otherwise(w), ends)

    # a word and what follows it up to the next; a line's leading marks are its own
    words = F.regexp_extract_all(kept, F.lit("[^\\s\\p{P}\\p{Z}]+[[\\s\\p{P}\\p{Z}]&&[^\\n]]*\\n*|[\\s\\p{P}\\p{Z}]+"), F.lit(0))
    cut = F.split(F.array_join(F.transform(words, word), ""), "\x01\x03")
    return F.array_distinct(F.transform(F.filter(cut, lambda p: p != ""), lambda p: F.xxhash64(p)))


def _bit(number: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), number)


def _entry(digest: Column, sign: Column, cells: int, salt: Column) -> Column:
    """A digest with its sign, the bits of its cells and its check hash."""
    h = F.xxhash64(digest, salt)
    bits = [_bit((F.pmod(F.shiftright(h, 20 * part), F.lit(cells)) + part * cells).cast("int")) for part in range(3)]
    return F.struct(digest.alias("d"), sign.alias("n"), bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).alias("bits"), F.xxhash64(digest, salt, F.lit(1)).alias("h"))


def _cell(n: Column, d: Column, h: Column) -> Column:
    return F.struct(n.alias("n"), d.alias("d"), h.alias("h"))


def _with_entries(cell: Column, number: Column, entries: Column, sign: int) -> Column:
    """A cell after entries were added (1) or taken out (-1)."""
    return F.aggregate(
        entries, cell,
        lambda c, e: F.when(
            F.getbit(e["bits"], number) == 1,
            _cell(c["n"] + sign * e["n"], c["d"].bitwiseXOR(e["d"]), c["h"].bitwiseXOR(e["h"]))).otherwise(c))


def _filled(entries: Column, cells: int) -> Column:
    zero = _cell(F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), F.lit(0).cast("bigint"))
    return let(entries, lambda e: F.transform(F.sequence(F.lit(0), F.lit(3 * cells - 1)), lambda c: _with_entries(zero, c, e, 1)))


def _signed(values: Column, sign: int, cells: int, salt: Column) -> Column:
    return F.transform(values, lambda d: _entry(d, F.lit(sign).cast("bigint"), cells, salt))


def sketch(values: Column, cells: int = CELLS, salt: Column | None = None) -> Column:
    """The cells of digests, three parts of ``cells`` each."""
    return _filled(_signed(values, 1, cells, F.lit(0) if salt is None else salt), cells)


def difference_sketch(left: Column, right: Column, cells: int, salt: Column) -> Column:
    """``subtract`` of two sketches, made in one go."""
    return _filled(F.concat(_signed(left, 1, cells, salt), _signed(right, -1, cells, salt)), cells)


def subtract(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: _cell(a["n"] - b["n"], a["d"].bitwiseXOR(b["d"]), a["h"].bitwiseXOR(b["h"])))


def peel(difference: Column, cells: int = CELLS, salt: Column | None = None) -> Column:
    """The digests of a difference, or null if some cells can't be resolved."""
    salt = F.lit(0) if salt is None else salt

    def single(c: Column) -> Column:
        return (F.abs(c["n"]) == 1) & (c["h"] == F.xxhash64(c["d"], salt, F.lit(1)))

    def round_(state: Column) -> Column:
        given = F.array_distinct(F.transform(F.filter(state["cells"], single), lambda c: _entry(c["d"], c["n"], cells, salt)))
        return let(given, lambda g: F.when(F.size(g) == 0, state).otherwise(F.struct(
            F.transform(state["cells"], lambda c, i: _with_entries(c, i, g, -1)).alias("cells"),
            F.concat(state["found"], F.transform(g, lambda e: e["d"])).alias("found"))))

    start = F.struct(difference.alias("cells"), F.array().cast("array<bigint>").alias("found"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(cells)), start, lambda s, _: round_(s))
    return let(end, lambda s: F.when(F.forall(s["cells"], lambda c: (c["n"] == 0) & (c["d"] == 0) & (c["h"] == 0)), s["found"]))


def _part_of(ordered: Column, blocks_of: Column, block: Column) -> Column:
    """The digests of a block; ``blocks_of`` are the blocks of ``ordered``, ascending."""
    first = F.array_position(blocks_of, block)
    behind = F.size(blocks_of) + 2 - F.array_position(F.reverse(blocks_of), block)
    return F.when(first == 0, F.array().cast("array<bigint>")).otherwise(F.slice(ordered, first.cast("int"), (behind - first).cast("int")))


def _by_blocks(left: Column, right: Column, attempt: Column) -> Column:
    """The differing digests found with sketches of many blocks, or null."""
    blocks = (F.ceil((F.size(left) + F.size(right)) / BLOCK_LOAD) * _bit(attempt)).cast("int")
    salt = attempt + 1

    def sides(n: Column) -> Column:
        # a block is a range of digests, so sorted digests stand block by block
        def block(d: Column) -> Column:
            return F.floor((F.shiftrightunsigned(d, 33)) * n.cast("bigint") / F.lit(1 << 31)).cast("int")

        def ordered(x: Column) -> Column:
            return F.array_sort(F.transform(x, lambda d: F.struct(F.shiftrightunsigned(d, 33).alias("k"), d.alias("d"))))

        pairs = F.array(*(let(ordered(x), lambda o: F.struct(F.transform(o, lambda e: e["d"]).alias("d"), F.transform(o, lambda e: block(e["d"])).alias("b"))) for x in (left, right)))
        def of_block(a: Column, b: Column) -> Column:
            tries = [peel(difference_sketch(a, b, cells, salt + ATTEMPTS * k), cells, salt + ATTEMPTS * k) for k, cells in enumerate(BLOCK_CELLS)]
            return F.coalesce(*tries)

        def parts(p: Column, g: Column) -> Column:
            return let(F.array(*(_part_of(p[k]["d"], p[k]["b"], g) for k in (0, 1))), lambda ab: of_block(ab[0], ab[1]))

        return let(pairs, lambda p: F.transform(F.sequence(F.lit(0), n - 1), lambda g: parts(p, g)))

    found = let(blocks, sides)
    return let(found, lambda f: F.when(F.forall(f, lambda x: x.isNotNull()), F.flatten(f)))


def difference(left: Column, right: Column, left_sketch: Column, right_sketch: Column) -> Column:
    """The digests that only one of two versions has, recovered from sketches; ``left`` and ``right`` serve larger sketches."""
    first = peel(subtract(left_sketch, right_sketch))
    later = F.aggregate(
        F.sequence(F.lit(0), F.lit(ATTEMPTS - 1)), F.lit(None).cast("array<bigint>"),
        lambda done, attempt: F.when(done.isNotNull(), done).otherwise(_by_blocks(left, right, attempt)))
    return F.coalesce(first, later)


def likeness(left: Column, right: Column, differing: Column) -> Column:
    """Jaccard index from the numbers of digests and of differing ones."""
    both = F.size(left) + F.size(right)
    # bound once: finding the differing digests is the costly part
    return F.when(both == 0, F.lit(1.0)).otherwise(let(F.size(differing), lambda d: (both - d) / (both + d)))


def spelt(cells: Column) -> Column:
    """A sketch as text: count, digests and checks of each cell in hexadecimal."""
    return F.lower(F.array_join(F.transform(cells, lambda c: F.concat_ws(".", F.hex(c["n"]), F.hex(c["d"]), F.hex(c["h"]))), ","))


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _P2
    x = (x ^ (x >> np.uint64(29))) * _P3
    return x ^ (x >> np.uint64(32))


def _hashed(digests: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """``xxhash64(digest, salt)``, signed, and ``xxhash64(digest, salt, 1)``."""
    with np.errstate(over="ignore"):
        def int_more(number: int, h: np.ndarray) -> np.ndarray:
            return _mixed(_turned((h + _P5 + np.uint64(4)) ^ (np.uint64(number) * _P1), 23) * _P2 + _P3)

        d = digests.view(np.uint64)
        first = _mixed(_turned((np.uint64(42) + _P5 + np.uint64(8)) ^ (_turned(d * _P2, 31) * _P1), 27) * _P1 + _P4)
        h = int_more(salt, first)
        return h.view(np.int64), int_more(1, h).view(np.int64)


class _Sketches:
    """Sketches of ``n`` sets of digests: counts, digests and checks of cells, ``3 * cells`` for each."""

    def __init__(self, n: int, cells: int, salt: int):
        self.n, self.cells, self.salt = n, cells, salt
        self.count, self.digest, self.check = (np.zeros(n * 3 * cells, dtype=np.int64) for _ in range(3))

    def add(self, of: np.ndarray, digests: np.ndarray, signs: np.ndarray) -> None:
        h, check = _hashed(digests, self.salt)
        for part in range(3):
            at = of * (3 * self.cells) + (h >> np.int64(20 * part)) % self.cells + part * self.cells
            np.add.at(self.count, at, signs)
            np.bitwise_xor.at(self.digest, at, digests)
            np.bitwise_xor.at(self.check, at, check)

    def less(self, other: _Sketches) -> _Sketches:
        out = _Sketches(self.n, self.cells, self.salt)
        out.count, out.digest, out.check = self.count - other.count, self.digest ^ other.digest, self.check ^ other.check
        return out

    def peel(self) -> np.ndarray:
        """How many digests each difference gives, -1 where some cells can't be resolved; the sketches are used up."""
        found = np.zeros(self.n, dtype=np.int64)
        for _ in range(self.cells):
            at = np.flatnonzero(np.abs(self.count) == 1)
            at = at[self.check[at] == _hashed(self.digest[at], self.salt)[1]]
            if not len(at):
                break
            # a digest may stand alone in several of its cells
            of, digests, signs = at // (3 * self.cells), self.digest[at], self.count[at]
            order = np.lexsort((signs, digests, of))
            of, digests, signs = of[order], digests[order], signs[order]
            new = np.r_[True, (of[1:] != of[:-1]) | (digests[1:] != digests[:-1]) | (signs[1:] != signs[:-1])]
            of, digests, signs = of[new], digests[new], signs[new]
            self.add(of, digests, -signs)
            found += np.bincount(of, minlength=self.n)
        left = ((self.count != 0) | (self.digest != 0) | (self.check != 0)).reshape(self.n, 3 * self.cells).any(axis=1)
        return np.where(left, -1, found)


class _Sets:
    """Digests of consecutive documents: flat, with the document of each."""

    def __init__(self, column: pa.ListArray):
        self.digests = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
        offsets = column.offsets.to_numpy()
        self.sizes = np.diff(offsets)
        self.of = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.sketches = _Sketches(len(self.sizes), CELLS, 0)
        self.sketches.add(self.of, self.digests, np.ones(len(self.digests), dtype=np.int64))

    def spelt(self) -> list[str]:
        cells = np.stack([x.view(np.uint64) for x in (self.sketches.count, self.sketches.digest, self.sketches.check)], axis=1)
        form = ",".join(["%x.%x.%x"] * (3 * CELLS))
        return [form % tuple(row) for row in cells.reshape(len(self.sizes), -1).tolist()]


def _differing(left: _Sets, right: _Sets) -> np.ndarray:
    """Numbers of digests that only one of two versions has, as ``difference`` recovers them; -1 if it can't."""
    found = left.sketches.less(right.sketches).peel()
    of = np.concatenate([left.of, right.of])
    digests = np.concatenate([left.digests, right.digests])
    signs = np.repeat([1, -1], [len(left.of), len(right.of)])
    for attempt in range(ATTEMPTS):
        pending = np.flatnonzero(found < 0)
        if not len(pending):
            break
        blocks = np.zeros(len(found), dtype=np.int64)
        blocks[pending] = -(-(left.sizes + right.sizes)[pending] // BLOCK_LOAD) << attempt
        first = np.cumsum(blocks) - blocks
        mine = found[of] < 0
        of, digests, signs = of[mine], digests[mine], signs[mine]
        key = (digests.view(np.uint64) >> np.uint64(33)).astype(np.int64)
        block = first[of] + np.floor((key * blocks[of]) / (1 << 31)).astype(np.int64)
        given = np.full(int(blocks.sum()), -1, dtype=np.int64)
        for k, cells in enumerate(BLOCK_CELLS):
            open_ = np.flatnonzero(given < 0)
            place = np.full(len(given), -1, dtype=np.int64)
            place[open_] = np.arange(len(open_))
            inside = place[block] >= 0
            sketches = _Sketches(len(open_), cells, attempt + 1 + ATTEMPTS * k)
            sketches.add(place[block[inside]], digests[inside], signs[inside])
            given[open_] = sketches.peel()
        failed = np.bincount(np.repeat(np.arange(len(found)), blocks), weights=given < 0, minlength=len(found)) > 0
        total = np.bincount(np.repeat(np.arange(len(found)), blocks), weights=given, minlength=len(found)).astype(np.int64)
        done = pending[~failed[pending]]
        found[done] = total[done]
    return found


def _likeness(left: _Sets, right: _Sets) -> pa.Array:
    both, differing = left.sizes + right.sizes, _differing(left, right)
    return pa.array(np.where(both == 0, 1.0, (both - differing) / np.maximum(both + differing, 1)), mask=(differing < 0) & (both > 0))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints and likenesses of rows with the digests ``own, edited, next``; ``copies`` stay."""
    for batch in batches:
        ends = sum(np.cumsum(np.diff(batch.column(n).offsets.to_numpy())) for n in ("own", "edited", "next"))
        cuts = np.flatnonzero(np.diff(ends // SLICE, prepend=0)) if len(ends) else []
        bounds = np.unique(np.r_[0, cuts, batch.num_rows]).tolist()
        for lo, hi in zip(bounds, bounds[1:]):
            part = batch.slice(lo, hi - lo)
            own, edited, following = (_Sets(part.column(n)) for n in ("own", "edited", "next"))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(n) for n in ("doc_id", "n_chars", "edited_sha256")), pa.array(own.spelt(), pa.string()),
                 pa.array(edited.spelt(), pa.string()), _likeness(own, edited), _likeness(own, following), part.column("copies")],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "copies"])


#: A document: whether it has no id, its id, its text's hash.
KEY = ("__none", "__id", "__hash")


def neighbours(rows: DataFrame) -> DataFrame:
    """Distinct documents (``KEY``) with ``__n`` characters and how often they come (``__copies``): each with its successor (``next__*``), the last with the first.

    Rows are ordered by ranges; within a range the successor is the next row, at
    its end the first row of the next range.  Only the ranges' first rows, as
    many as there are partitions, meet in one task.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.groupBy(*KEY).agg(F.min(F.length("__text")).alias("__n"), F.count(F.lit(1)).alias("__copies"))
    ranged = materialise(rows.repartitionByRange(parts, *KEY).withColumn("__part", F.spark_partition_id()), "fingerprint-order")
    # few rows, whose order decides where a range goes on
    heads = ranged.groupBy("__part").agg(F.min(F.struct(*KEY)).alias("head"))
    order = Window.orderBy("__part")
    heads = heads.select("__part", F.coalesce(F.lead("head").over(order), F.first("head").over(order)).alias("head"))
    inside = Window.partitionBy("__part").orderBy(*KEY)
    following = F.lead(F.struct(*KEY)).over(inside)
    with_next = ranged.select("*", following.alias("__following")).join(F.broadcast(heads), "__part")
    following = F.coalesce("__following", "head")
    return with_next.select(*KEY, "__n", "__copies", *(following[k].alias(f"next{k}") for k in KEY))


def fingerprints_of_versions(docs: DataFrame, text: str = "text", digests: Callable[[Column], Column] = content_digests) -> DataFrame:
    """Fingerprints of each document and of its edited text, and the likeness of the first to the second and to the next document.

    The edited text has the last quarter of the characters replaced by the first
    as many (or all) of the next document.  doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next.
    """
    id_type = docs.schema["doc_id"].dataType
    raw = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col("doc_id").isNull().alias("__none"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("__id"), F.xxhash64(raw).alias("__hash"), raw.alias("__text"))
    chain = materialise(neighbours(rows), "fingerprint-neighbours")
    # every text is shuffled once: all that follows is dealt out by the same key
    texts = rows.dropDuplicates(list(KEY))
    # what a document needs of the next one: the start of its text and its digests
    wanted = chain.select(*(F.col(f"next{k}").alias(k) for k in KEY), *(F.col(k).alias(f"to{k}") for k in KEY), "__n", "__copies")
    quarter = F.floor(F.col("__n") / 4).cast("int")
    sent = texts.join(wanted.hint("shuffle_hash"), list(KEY)).select(
        *(F.col(f"to{k}").alias(k) for k in KEY), "__copies", quarter.alias("__quarter"),
        F.substring("__text", F.lit(1), quarter).alias("__head"), digests(F.col("__text")).alias("__next"))
    both = texts.join(sent.hint("shuffle_hash"), list(KEY))
    n = F.length("__text")
    edited = F.concat(F.substring("__text", F.lit(1), n - F.col("__quarter")), F.col("__head"))
    both = computed_once(both.withColumn("__edited", edited), "__edited", edited)
    both = both.select(
        F.when(~F.col("__none"), F.col("__id")).cast(id_type).alias("doc_id"), n.cast("long").alias("n_chars"), F.sha2(F.col("__edited").cast("binary"), 256).alias("edited_sha256"),
        digests(F.col("__text")).alias("own"), digests(F.col("__edited")).alias("edited"), F.col("__next").alias("next"), F.col("__copies").alias("copies"))
    ship_package(docs.sparkSession)
    found = both.mapInArrow(
        _compared, f"doc_id {id_type.simpleString()}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, copies bigint")
    return found.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).drop("copies", "__copy")
