"""Merkle manifest of a dataset: a tree of hashes per group, and a witness for every row.

Rows of a group in order are leaves.  While several nodes remain, every ``FAN``
consecutive ones (the last run may be shorter, even one) become the hash of
their joined digests.  What remains is the group's root; the groups' roots, in
order of the group, form a tree of their own with the dataset's root on top.

Witnesses are kept as leaves come in.  An ``Appender`` holds the open runs of each
level; an appended leaf has an empty witness, and whenever a run completes, each
leaf below one of its nodes gets the run's other nodes.  A task appends the
leaves of one aligned block (``FAN ** LEVELS`` places), so its runs never reach
into another block.  A block's root is then appended to a stream of block roots
in the same way, block by block of those, until one root is left: what a block
learns there extends the witnesses of all its leaves.  The extension is kept
once per block and joined to the leaves at the end.  Leaves move in two
shuffles, as digests; texts don't move.

A witness is ``siblings`` (32 bytes each, level by level, left to right) and
``shape`` (for each level the node's place in its run and the run's size).

Fields are hashed as ``-`` if null, else UTF-8 byte count, colon and value.  A null
group comes first, null ids come first within their group, rows of equal id follow
a hash of the row, and repeated rows are leaves of their own.  A null text is no
empty text.  An empty table gives no rows.  Other columns are not looked at,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from murmurlens.operators.dedup import number_within
from murmurlens.session import materialise

from .common import ship_package

FAN = 8
#: Levels of a block: one task's stream has ``FAN ** LEVELS`` places at most.
LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_hash(fields: Sequence[Column]) -> Column:
    """Digest of a row's fields, each null or with its length, so that no two rows read the same."""
    def spelt(field: Column) -> Column:
        value = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(spelt, fields)), 256)


def joined_hash(digests: Sequence[bytes]) -> bytes:
    """Digest of digests, which go in as hexadecimal text."""
    return sha256(b"".join(digests).hex().encode()).digest()


class Appender:
    """A tree that grows leaf by leaf, with the witnesses of its leaves."""

    def __init__(self, fan: int = FAN):
        self.fan = fan
        self.shapes: list[bytearray] = []
        self.siblings: list[bytearray] = []
        # of each level, the run that is not complete: (digest, first leaf, end of leaves) of its nodes
        self._open: list[list[tuple[bytes, int, int]]] = [[]]

    def append(self, digest: bytes) -> None:
        at = len(self.shapes)
        self.shapes.append(bytearray())
        self.siblings.append(bytearray())
        self._push(0, (digest, at, at + 1))

    def _push(self, level: int, node: tuple[bytes, int, int]) -> None:
        if level == len(self._open):
            self._open.append([])
        self._open[level].append(node)
        if len(self._open[level]) == self.fan:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self._open[level] = self._open[level], []
        digests = [d for d, _, _ in run]
        for place, (_, first, end) in enumerate(run):
            shape, others = bytes((place, len(run))), b"".join(digests[:place] + digests[place + 1:])
            for leaf in range(first, end):
                self.shapes[leaf] += shape
                self.siblings[leaf] += others
        self._push(level + 1, (joined_hash(digests), run[0][1], run[-1][2]))

    def close(self, height: int = 0) -> bytes:
        """The root, at ``height`` or above; runs that are open are complete as they are."""
        level = 0
        while True:
            above = any(self._open[level + 1:])
            if len(self._open[level]) == 1 and not above and level >= height:
                return self._open[level][0][0]
            if self._open[level]:
                self._complete(level)
            level += 1


def folded(leaf: bytes, shape: bytes, siblings: bytes) -> bytes:
    """The root that a leaf and its witness lead to."""
    node, at = leaf, 0
    for place, size in zip(shape[::2], shape[1::2]):
        end = at + 32 * (size - 1)
        middle = at + 32 * place
        node = joined_hash((siblings[at:middle], node, siblings[middle:end]))
        at = end
    return node


def appended(nodes: DataFrame, fan: int, levels: int) -> DataFrame:
    """Appends nodes (group, place, digest and what else they carry) to their blocks.

    Adds ``block``, the place of a node's block among its group's, ``shape`` and
    ``siblings`` as far as the block goes, and ``top``: the block's root, in the row of
    its first place.
    """
    blocked = nodes.withColumn("block", F.expr(f"place div {fan ** levels}"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocked.schema.fields)

    def grow(block: pa.Table) -> pa.Table:
        block = block.sort_by("place")
        tree = Appender(fan)
        for digest in block.column("digest").to_pylist():
            tree.append(bytes.fromhex(digest))
        # the last block of several is raised to the others' level
        top = tree.close(levels if block.column("block")[0].as_py() else 0).hex()
        return (
            block.append_column("shape", pa.array(map(bytes, tree.shapes), pa.binary()))
            .append_column("siblings", pa.array(map(bytes, tree.siblings), pa.binary()))
            .append_column("top", pa.array([top, *[None] * (block.num_rows - 1)], pa.string())))

    return blocked.groupBy("group", "block").applyInArrow(grow, f"{schema}, shape binary, siblings binary, top string")


def _same_group(a: DataFrame, b: DataFrame) -> Column:
    return a["group"].eqNullSafe(b["group_above"])


def grown(leaves: DataFrame, fan: int, levels: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Trees of leaves (group, place, digest, ...): leaves with shape, siblings and their block, and per block of each
    group what extends them, (group, block, shape, siblings, root)."""
    tiers = [materialise(appended(leaves, fan, levels), name)]
    while True:
        tops = tiers[-1].where(F.col("top").isNotNull()).select("group", F.col("block").alias("place"), F.col("top").alias("digest"))
        if not (tiers[-1].agg(F.max("block")).first()[0] or 0):
            break
        tiers.append(materialise(appended(tops, fan, levels), f"{name}-{len(tiers)}"))
    nothing = F.lit(b"")
    extended = tops.select("group", F.col("place").alias("block"), nothing.alias("shape"), nothing.alias("siblings"), F.col("digest").alias("root"))
    for tier in reversed(tiers[1:]):
        above = extended.select(F.col("group").alias("group_above"), F.col("block").alias("block_above"), F.col("shape").alias("shape_above"), F.col("siblings").alias("siblings_above"), "root")
        joined = tier.join(above, _same_group(tier, above) & (tier["block"] == above["block_above"]))
        extended = joined.select(
            "group", F.col("place").alias("block"), F.concat("shape", "shape_above").alias("shape"), F.concat("siblings", "siblings_above").alias("siblings"), "root")
    return tiers[0], extended


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", order: str = "doc_id", altered: dict[str, Column] | None = None,
             fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """A row per row of ``docs``: ``order``, leaf, altered_leaf, subroot, root, shape, siblings.

    ``altered`` gives other values for some fields; the altered leaf is the digest
    with those, for a check of the witnesses.
    """
    ship_package(docs.sparkSession)
    altered = altered or {}
    own = leaf_hash([F.col(f) for f in fields])
    other = leaf_hash([altered.get(f, F.col(f)) for f in fields])
    digests = docs.select(F.col(group).alias("group"), F.col(order).alias("id"), own.alias("digest"), other.alias("altered"))
    # written, since texts would be read and hashed again to find the ranges of the order
    numbered = number_within(materialise(digests, "manifest-digests"), ["group"], "id", "number")
    leaves, extended = grown(numbered.select("group", (F.col("number") - 1).alias("place"), "id", "digest", "altered"), fan, levels, "manifest")
    extended = materialise(extended, "manifest-blocks")
    roots = extended.where(F.col("block") == 0).select(F.col("group").alias("of"), F.col("root").alias("digest"))
    roots = number_within(roots, [], "of", "number").select(F.lit(0).alias("group"), (F.col("number") - 1).alias("place"), "of", "digest")
    of_roots, last = grown(roots, fan, levels, "manifest-roots")
    last = last.select(F.col("group").alias("group_above"), F.col("block").alias("block_above"), F.col("shape").alias("shape_above"), F.col("siblings").alias("siblings_above"), F.col("root").alias("top_root"))
    to_root = of_roots.join(last, _same_group(of_roots, last) & (of_roots["block"] == last["block_above"])).select(
        F.col("of").alias("group_above"), F.concat("shape", "shape_above").alias("shape_above"), F.concat("siblings", "siblings_above").alias("siblings_above"), "top_root")
    extended = extended.join(to_root, _same_group(extended, to_root)).select(
        F.col("group").alias("group_above"), F.col("block").alias("block_above"), F.concat("shape", "shape_above").alias("shape_above"),
        F.concat("siblings", "siblings_above").alias("siblings_above"), "root", "top_root")
    found = leaves.join(extended, _same_group(leaves, extended) & (leaves["block"] == extended["block_above"]))
    return found.select(
        F.col("id").alias(order), F.col("digest").alias("leaf"), F.col("altered").alias("altered_leaf"), F.col("root").alias("subroot"), F.col("top_root").alias("root"),
        F.concat("shape", "shape_above").alias("shape"), F.concat("siblings", "siblings_above").alias("siblings"))


def verified(witnessed: DataFrame, leaf: str = "altered_leaf", root: str = "root") -> DataFrame:
    """``witnessed`` with proof_sha256, the digest of the siblings, folded_root, where ``leaf`` leads to, and verified,
    whether that is ``root``; shape and siblings are left out."""
    ship_package(witnessed.sparkSession)
    kept = [c for c in witnessed.columns if c not in ("shape", "siblings")]
    schema = ", ".join(f"`{c}` {witnessed.schema[c].dataType.simpleString()}" for c in kept)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {c: batch.column(batch.schema.get_field_index(c)) for c in (*kept, "shape", "siblings")}
            proofs, ends = [], []
            for digest, shape, siblings in zip(column[leaf].to_pylist(), column["shape"].to_pylist(), column["siblings"].to_pylist()):
                proofs.append(joined_hash((siblings,)).hex())
                ends.append(folded(bytes.fromhex(digest), shape, siblings).hex())
            fits = [a == b for a, b in zip(ends, column[root].to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*(column[c] for c in kept), pa.array(proofs, pa.string()), pa.array(ends, pa.string()), pa.array(fits, pa.bool_())],
                [*kept, "proof_sha256", "folded_root", "verified"])

    return witnessed.mapInArrow(check, f"{schema}, proof_sha256 string, folded_root string, verified boolean")
