"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits; bit ``b`` is 1 if it is set in over half of the hashes
of the text's shingles.  Fingerprints link at ``radius`` or fewer differing bits,
linked fingerprints form components, and a component is named after its
smallest doc_id.

Covering masks: each bit position gets a vector of ``radius + 1`` bits, and for every
non-zero vector ``v`` a mask keeps the positions whose vector has an odd number of
bits in common with ``v``.  At most ``radius`` differing positions span at most ``radius``
dimensions, so some ``v`` is orthogonal to all of them: its mask keeps none of the
differing bits, and the pair meets in that table for certain, not just likely.

Copies are one fingerprint before anything is linked.  In a bucket of at most
``SMALL`` fingerprints pairs are compared; a larger one links its members through
the points around them instead: each fingerprint names all points within
``radius / 2`` of itself (within the bits its mask does not keep), and two
fingerprints that name the same point are within ``radius``, while two within
``radius`` have such a point halfway.  A point joins its namers to the least of
them, a minimum that combines before the shuffle, so the work is linear in the
bucket and no group is ever listed.  Components then shrink by alternating steps of
large-star and small-star, each a written table.

Null counts as the empty text; texts without words have the fingerprint zero, which
links like any other.  Every row comes back, repeated rows and ids too; a null id
links others but never names a component unless all its ids are null.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import xor

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from murmurlens.session import materialise

from .common import map_texts

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Fingerprints of a bucket that are compared pair by pair; a cost parameter, results do not depend on it.
SMALL = 32


def fingerprints(texts: list[str]) -> np.ndarray:
    """The 64-bit fingerprint of each text."""
    out = np.zeros(len(texts), dtype=np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for i, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        if len(words) <= SHINGLE:
            hashes = [xxhash.xxh64_intdigest(joined, SEED)]
        else:
            ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
            starts = np.r_[0, ends[:-SHINGLE] + 1]
            digest = xxhash.xxh64_intdigest
            hashes = [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[SHINGLE - 1:].tolist())]
        ones = np.zeros(64, dtype=np.int64)
        for k in range(0, len(hashes), 1 << 15):
            part = np.array(hashes[k:k + (1 << 15)], dtype=np.uint64)
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[i] = weights[2 * ones > len(hashes)].sum()
    return out


def with_fingerprint(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` and ``fp``, the fingerprint as a signed long."""

    def make():
        return lambda texts: {"fp": pa.array(fingerprints(texts).view(np.int64))}

    return map_texts(docs, make, "fp bigint", text, carry)


def covering_masks(radius: int = RADIUS, seed: int = 1) -> list[int]:
    """One mask for each non-zero vector of ``radius + 1`` bits, as signed longs."""
    vectors = np.random.default_rng(seed).permutation(np.arange(64) % (2 ** (radius + 1) - 1) + 1)
    masks = []
    for v in range(1, 2 ** (radius + 1)):
        kept = [b for b in range(64) if bin(int(vectors[b]) & v).count("1") % 2]
        masks.append(_signed(sum(1 << b for b in kept)))
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _flips(spark: SparkSession, masks: list[int], radius: int) -> DataFrame:
    """(mask, flip): changes of at most half the radius in bits the mask does not keep; a few hundred per mask, whatever the data."""
    rows = []
    for k, mask in enumerate(masks):
        free = [_signed(1 << b) for b in range(64) if not mask >> b & 1]
        rows += [(k, reduce(xor, c, 0)) for n in range(radius // 2 + 1) for c in combinations(free, n)]
    return spark.createDataFrame(pa.table({"mask": pa.array([r[0] for r in rows], pa.int32()), "flip": pa.array([r[1] for r in rows], pa.int64())}))


def links(spark: SparkSession, distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) with a < b: links between the distinct fingerprints ``fp`` whose closure is that of all links.

    ``radius`` is even.
    """
    masks = covering_masks(radius)
    tables = F.array(*(F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(m).alias("kept")) for k, m in enumerate(masks)))
    keyed = distinct.select("fp", F.explode(tables).alias("t")).select("fp", "t.mask", "t.kept")
    crowds = keyed.groupBy("mask", "kept").agg(F.count("*").alias("n"), F.min("fp").alias("one"), F.max("fp").alias("other")).where("n > 1")
    crowds = materialise(crowds, "simhash-buckets")
    # the members of buckets that hold more than one fingerprint
    members = materialise(keyed.join(crowds.where("n > 2").select("mask", "kept", "n"), ["mask", "kept"]), "simhash-members")
    pairs = crowds.where("n = 2").select(F.col("one").alias("a"), F.col("other").alias("b"))
    small = members.where(F.col("n") <= SMALL).select("mask", "kept", "fp")
    right = small.select("mask", "kept", F.col("fp").alias("b"))
    pairs = pairs.unionByName(small.withColumnRenamed("fp", "a").join(right, ["mask", "kept"]).where("a < b").select("a", "b"))
    near = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    crowded = members.where(F.col("n") > SMALL)
    if crowded.isEmpty():
        return near.distinct()
    flips = F.broadcast(_flips(spark, masks, radius))
    named = crowded.join(flips, "mask").select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point")).distinct()
    return near.unionByName(_stars(named)).distinct()


def _stars(named: DataFrame) -> DataFrame:
    """Links from every namer of a point to the point's least namer."""
    least = named.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("point", "a")
    return named.join(least, "point").where("a < fp").select("a", F.col("fp").alias("b"))


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root): the least node reachable, for the nodes of the links (a, b)."""
    current = materialise(edges.select("a", "b").distinct(), "components")
    while True:
        # large star: larger neighbours go to the least neighbour (or the node itself)
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        # small star: a node and its smaller neighbours go to the least of them
        lowest = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(lowest, "b").select("a", "b", "m")
        following = small.select(F.col("m").alias("a"), "b").unionByName(small.select(F.col("m").alias("a"), F.col("a").alias("b"))).where("a < b").distinct()
        following = materialise(following, "components")
        changed = following.exceptAll(current).isEmpty() and current.exceptAll(following).isEmpty()
        current = following
        if changed:
            return current.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))


def _classed(docs: DataFrame, radius: int, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, __hash of the text, fp), and (fp, root, component_id) of the distinct fingerprints."""
    spark = docs.sparkSession
    hashed = docs.select("doc_id", F.col(text).alias("__raw"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__hash"))
    rows = materialise(with_fingerprint(hashed, "__raw", ("doc_id", "__hash")), "simhash")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(spark, links(spark, distinct.select("fp"), radius))
    classed = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = classed.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows, classed.join(named, "root").select("fp", "root", "component_id")


def near_duplicate_components(docs: DataFrame, radius: int = RADIUS, text: str = "text") -> DataFrame:
    """doc_id, fp and component_id of every row."""
    rows, classes = _classed(docs, radius, text)
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS, text: str = "text") -> DataFrame:
    """One document of each component, all columns as they were.

    It is the one of least id, nulls last, among equal ids the one of least text
    hash; of rows that repeat it the least by a hash of the row.
    """
    rows, classes = _classed(docs, radius, text)
    counted = rows.groupBy("fp", "doc_id", "__hash").agg(F.count(F.lit(1)).alias("n")).join(classes, "fp")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "__hash", "n")
    chosen = counted.groupBy("root").agg(F.min(place).alias("c"))
    chosen = materialise(chosen.select(F.col("c.doc_id").alias("__id"), F.col("c.__hash").alias("__of"), F.col("c.n").alias("__n")), "simhash-kept")
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == F.col("__of"))
    kept = docs.join(chosen, same, "left_semi")
    if chosen.where("__n > 1").isEmpty():
        return kept
    order = Window.partitionBy("doc_id", text).orderBy(F.xxhash64(*docs.columns))
    return kept.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank")
