"""Exact deduplication, caps, limits and numbering.

Every "first or last per key" here is ``row_number() <= k`` on a window.  Spark
turns that into a group limit *before* the shuffle as well as after it, so a
key that holds a third of all rows sends at most ``k`` rows per map task.  Numbering
goes by ranges instead, so that no window holds a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ByteType, DateType, IntegerType, LongType, ShortType, TimestampType

from murmurlens.functions.cleaning import strip
from murmurlens.operators.selection import smallest
from murmurlens.session import materialise

#: Largest ``k`` for which Spark plans the group limit
#: (``spark.sql.optimizer.windowGroupLimitThreshold``).
_GROUP_LIMIT = 1000
_RANK = "__rank"


def _ranked(df: DataFrame, keys: Sequence, order: Sequence[Column], k: int) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(_RANK, F.row_number().over(window)).filter(F.col(_RANK) <= k).drop(_RANK)


def keep_first(df: DataFrame, keys: Sequence, order: Sequence[str] = ("seq",)) -> DataFrame:
    return _ranked(df, keys, [F.col(c).asc() for c in order], 1)


def keep_last(df: DataFrame, keys: Sequence, order: Sequence[str] = ("seq",)) -> DataFrame:
    return _ranked(df, keys, [F.col(c).desc_nulls_last() for c in order], 1)


def drop_exact_duplicates(df: DataFrame, subset: Sequence[str] | None = None, text_col: str = "text",
                          order: Sequence[str] = ("seq",)) -> DataFrame:
    """Keep the first row per key; absent columns are ignored, default is the text."""
    keys = [c for c in (subset or [text_col]) if c in df.columns] or [text_col]
    return keep_first(df, keys, order)


def drop_platform_duplicates(df: DataFrame, fallback: Sequence[str], order: Sequence[str] = ("seq",)) -> DataFrame:
    """Keep the first row per comment id, or per ``fallback`` columns without one."""
    comment_id = strip(F.coalesce(F.col("comment_id"), F.lit("")))
    has_id = comment_id != ""
    keyed = df.withColumns({
        "__id": F.when(has_id, comment_id),
        **{f"__{c}": F.when(~has_id, F.col(c)) for c in fallback},
    })
    keys = ["__id", *[f"__{c}" for c in fallback]]
    return keep_first(keyed, keys, order).drop(*keys)


def _places(df: DataFrame, order: str) -> list[Column]:
    """Nulls first, then by value; equal values by a hash of the row."""
    return [F.col(order).asc_nulls_first(), F.xxhash64(*df.columns)]


def number_within(df: DataFrame, group: Sequence[str], order: str = "seq", column: str = "number") -> DataFrame:
    """Consecutive numbers from 1 per group, in ``order``: null first, ties by a hash of the row.

    The rows are dealt out by ranges of (group, order) and written once, each
    with its place in its range.  A group's numbers are these places, shifted by
    the group's counts in earlier ranges, of which there are as many as
    partitions, however many rows or values there are.
    ``group`` may be empty: that numbers the whole table.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.col(c).asc_nulls_first() for c in group], *_places(df, order)]
    placed = df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("__place", F.monotonically_increasing_id())
    placed = materialise(placed, "numbered").withColumn("__part", F.shiftrightunsigned("__place", 33))
    keys = [*group, "__part"]
    sizes = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min("__place").alias("__first"))
    ranges = sizes.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("__part", "__first", "__n"))).alias("__ranges"))
    before = F.aggregate(F.slice("__ranges", 1, F.col("__at")), F.lit(0).cast("bigint"), lambda total, r: total + r["__n"])
    named = [F.col(c).alias(f"__in_{c}") for c in group]
    opened = ranges.select(*named, "__ranges", F.posexplode("__ranges").alias("__at", "__r"))
    shifts = opened.select(
        *[f"__in_{c}" for c in group], F.col("__r.__part").alias("__of"), (before - F.col("__r.__first") + 1).alias("__shift"))
    match = F.col("__part") == F.col("__of")
    for c in group:
        match = match & F.col(c).eqNullSafe(F.col(f"__in_{c}"))
    return placed.join(shifts, match).select(*df.columns, (F.col("__place") + F.col("__shift")).alias(column))


def first_rows(df: DataFrame, n: int, order: str = "seq") -> DataFrame:
    """The first ``n`` rows in ``order``, null first, ties by a hash of the row; 0 means all.

    Integers, dates and times are found by counting (:func:`smallest`), whatever ``n``; other
    orders by number.
    """
    if n <= 0:
        return df
    kind = df.schema[order].dataType
    if isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        return smallest(df, n, [F.col(order).cast("bigint"), F.xxhash64(*df.columns)])
    if isinstance(kind, DateType):
        return smallest(df, n, [F.unix_date(order).cast("bigint"), F.xxhash64(*df.columns)])
    if isinstance(kind, TimestampType):
        return smallest(df, n, [F.unix_micros(order), F.xxhash64(*df.columns)])
    return number_within(df, [], order, "__number").filter(F.col("__number") <= n).drop("__number")


def cap_per_group(df: DataFrame, group: Sequence[str], n: int, order: Sequence[str] = ("seq",),
                  shards: int = 64) -> DataFrame:
    """At most ``n`` rows per group, the first in ``order``.

    Beyond Spark's own group limit, each group is first cut to ``n`` per hashed
    shard: a row among the first ``n`` of its group is so in its shard too.
    """
    asc = [F.col(c).asc() for c in order]
    if n > _GROUP_LIMIT:
        shard = F.pmod(F.xxhash64(*order), F.lit(shards))
        df = _ranked(df.withColumn("__shard", shard), [*group, "__shard"], asc, n).drop("__shard")
    return _ranked(df, group, asc, n)


def number_batches(df: DataFrame, size: int, group: Sequence[str] = (), order: str = "seq") -> DataFrame:
    """Consecutive batches of ``size`` rows: ``batch_id`` and ``pos``, both from 0."""
    numbered = number_within(df, group, order, "__number")
    return numbered.withColumns({
        "batch_id": F.expr(f"(__number - 1) div {size}"),
        "pos": F.expr(f"(__number - 1) % {size}").cast("int"),
    }).drop("__number")


def stable_sample(df: DataFrame, k: int, seed: int = 42, order: str = "seq") -> DataFrame:
    """``k`` rows picked by a hash of seed and row order: same rows on any layout and in any engine.

    The hash's least values win, found by counting its leading digits, so the
    rows picked stay where they are, however many.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(order).cast("string"), F.lit(""))))

    def digits(first: int, n: int) -> Column:
        return F.conv(F.substring(digest, first, n), 16, 10).cast("bigint")

    return smallest(df, k, [digits(1, 15), digits(16, 15), digits(31, 2), F.xxhash64(*df.columns)])


def synthetic_ids(df: DataFrame, group: Sequence[str] = ("facebook_group_id", "post_id"),
                  text_col: str = "text", order: str = "seq") -> DataFrame:
    """First row per text in a post, then ``facebook_<group>_<post>_<running number>``."""
    unique = keep_first(df, [*group, text_col], [order])
    numbered = number_within(unique, group, order, "__number")
    parts = [F.lit("facebook"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in group]]
    return numbered.withColumn(
        "comment_id", F.concat_ws("_", *parts, F.col("__number").cast("string"))
    ).drop("__number")


def append_latest(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("source", "post_id", "text"),
                  order: str = "seq") -> DataFrame:
    """Union of old and new rows, keeping the last per key; new beats old."""
    both = old.withColumn("__age", F.lit(0)).unionByName(
        new.withColumn("__age", F.lit(1)), allowMissingColumns=True
    )
    return keep_last(both, keys, ["__age", order]).drop("__age")


def anti_join_keys(df: DataFrame, done: DataFrame, keys: Sequence[str] = ("source", "record_key")) -> DataFrame:
    """Rows of ``df`` whose key is not among ``done``; null equals null."""
    right = done.select(*[F.col(c).alias(f"__done_{c}") for c in keys])
    match = F.lit(True)
    for c in keys:
        match = match & df[c].eqNullSafe(right[f"__done_{c}"])
    return df.join(right, match, "left_anti")
