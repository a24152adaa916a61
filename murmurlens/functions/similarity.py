"""Token-set similarity, 0 to 100.

For token sets A and B the score is the best of three insert/delete ratios:
shared part against A, shared part against B, and A against B with the shared
part written first.  Everything except one longest common subsequence is array
and length arithmetic, and most pairs are decided by bounds before that.
"""

from __future__ import annotations

import sys
from collections import Counter

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType

from murmurlens.functions.common import computed_once

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def token_set(normalised: Column) -> Column:
    """Sorted distinct tokens of a text in comparison form; ``array_sort`` would evaluate a lambda for each comparison."""
    return F.sort_array(F.array_distinct(F.filter(F.split(normalised, " "), lambda t: t != "")))


def block_prefix(normalised: Column) -> Column:
    """First two tokens, or the whole text if it has fewer."""
    return F.substring_index(normalised, " ", 2)


def length_bucket(normalised: Column) -> Column:
    return F.floor(F.char_length(normalised) / 20).cast("int")


#: Characters after which a comparison ends that cannot reach its need.
_CHECK = 64


def subsequence_within(a: str, b: str, need: float, stop: int = sys.maxsize) -> int:
    """Length of the longest common subsequence, one machine word per 64 characters.

    An upper bound of it, if that is below ``need`` or ``b`` goes on for more than ``stop`` characters.
    """
    start, stop_a, stop_b = 0, len(a), len(b)
    while start < min(stop_a, stop_b) and a[start] == b[start]:
        start += 1
    while min(stop_a, stop_b) > start and a[stop_a - 1] == b[stop_b - 1]:
        stop_a, stop_b = stop_a - 1, stop_b - 1
    trimmed = start + len(a) - stop_a
    a, b = a[start:stop_a], b[start:stop_b]
    if trimmed + min(len(a), len(b)) < need:
        return trimmed + min(len(a), len(b))
    positions: dict[str, int] = {}
    for i, ch in enumerate(a):
        positions[ch] = positions.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    free = full
    until = min(len(b), stop)
    for first in range(0, until, _CHECK):
        for ch in b[first : min(first + _CHECK, until)]:
            hit = free & positions.get(ch, 0)
            free = ((free + hit) | (free - hit)) & full
        most = trimmed + len(a) - free.bit_count() + len(b) - min(first + _CHECK, until)
        if most < need:
            return most
    return trimmed + len(a) - free.bit_count() + len(b) - until


def _common_subsequence(a: str, b: str) -> int:
    return subsequence_within(a, b, 0)


def _bounded_subsequence(a: str, b: str, need: float) -> int:
    """Same length, or an upper bound below ``need`` where that is cheaper to find.

    Characters the two texts share, whatever their order, bound it from above.
    """
    shared = (Counter(a) & Counter(b)).total()
    return shared if shared < need else subsequence_within(a, b, need)


def common_subsequence(left: Column, right: Column, need: Column) -> Column:
    """Arrow-batched kernel; null in, null out, so decided pairs cost nothing."""

    def kernel(a: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
        found = [None if x is None or y is None else _bounded_subsequence(x, y, m) for x, y, m in zip(a, b, n)]
        return pd.Series(found, dtype="Int32")

    return F.pandas_udf(kernel, IntegerType())(left, right, need)


def with_bounds(df: DataFrame, left: str, right: str) -> DataFrame:
    """Add ``lower`` and ``upper`` score bounds and the differing parts.

    ``left`` and ``right`` name token-set columns (sorted, distinct).  Set
    operations and lengths are computed once each; see :func:`computed_once`.
    """
    shared_length = F.char_length(F.array_join(F.array_intersect(left, right), " "))
    df = computed_once(df, "__parts", F.struct(
        shared_length.alias("s"),
        F.array_join(F.array_except(left, right), " ").alias("left"),
        F.array_join(F.array_except(right, left), " ").alias("right"),
        ((F.size(left) == 0) | (F.size(right) == 0)).alias("empty"),
    ))
    p = F.col("__parts")
    df = computed_once(df, "__n", F.struct(
        p["s"].alias("s"), F.char_length(p["left"]).alias("x"), F.char_length(p["right"]).alias("y"),
        p["empty"].alias("empty"),
    ))
    n = F.col("__n")
    s, x, y, empty = (n[c] for c in ("s", "x", "y", "empty"))
    total = 2 * s + F.when(s > 0, 2).otherwise(0) + x + y
    subset = (s > 0) & ((x == 0) | (y == 0))
    against = lambda part: 100 - 100 * (1 + part) / (2 * s + 1 + part)
    lower = F.when(empty, 0.0).when(subset, 100.0).when(s > 0, F.greatest(against(x), against(y))).otherwise(0.0)
    df = computed_once(df, "__bound", F.struct(lower.alias("lower"), total.alias("total")))
    low = F.col("__bound")["lower"]
    whole = 100 - F.try_divide(100 * F.abs(x - y), F.col("__bound")["total"])
    return df.withColumns({
        "lower": low, "upper": F.when(empty | subset, low).otherwise(F.greatest(low, whole)),
    })


def _resolved(df: DataFrame, undecided: Column, threshold: float) -> DataFrame:
    """Add ``score``: exact from ``threshold`` on, below it at least below it."""
    parts, n, total = F.col("__parts"), F.col("__n"), F.col("__bound")["total"]
    differing = n["x"] + n["y"]
    need = (differing - total * (100 - threshold) / 100) / 2 - 1e-6
    lcs = common_subsequence(
        F.when(undecided, parts["left"]), F.when(undecided, parts["right"]), F.coalesce(need, F.lit(0.0))
    )
    df = df.withColumn("__lcs", lcs)
    full = F.greatest("lower", 100 - 100 * (differing - 2 * F.col("__lcs")) / total)
    return df.withColumn("score", F.when(F.col("__lcs").isNotNull(), full).otherwise(F.col("lower")))


_SCRATCH = ("__parts", "__n", "__bound", "__lcs", "lower", "upper")


def score_pairs(df: DataFrame, left: str, right: str) -> DataFrame:
    """Add the exact ``score`` of two token-set columns."""
    bounded = with_bounds(df, left, right)
    return _resolved(bounded, F.col("upper") > F.col("lower"), 0).drop(*_SCRATCH)


def similar_pairs(df: DataFrame, left: str, right: str, threshold: float) -> DataFrame:
    """Keep the pairs with score ``>= threshold``; only undecided ones reach Python."""
    bounded = with_bounds(df, left, right).filter(F.col("upper") >= threshold)
    scored = _resolved(bounded, F.col("lower") < threshold, threshold)
    return scored.filter(F.col("score") >= threshold).drop(*_SCRATCH, "score")
