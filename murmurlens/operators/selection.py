"""The first ``k`` rows of an order, for any ``k``, without sorting or moving the table.

The place of the ``k``-th row is found by counting: a histogram over the leading bits
of the key tells in which stretch of keys it lies, one over the next bits where in
that stretch, until the stretch holds few rows or one key.  Rows below are then
a plain filter; only the rows of the last stretch are put in order.  Each histogram
has at most ``2 ** BITS`` counts and is an aggregate with map-side combine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Bits of the key that one histogram tells apart.
BITS = 14
#: Rows of a stretch that are put in order by one task.
FEW = 10_000
_KEY = "__key"


def smallest(df: DataFrame, k: int, keys: Sequence[Column]) -> DataFrame:
    """``k`` rows of least ``keys`` (64-bit integers, null first), as many as there are if fewer.

    Later keys decide between rows of equal earlier ones; which of rows with all
    keys equal are taken is open.  ``df`` is read a few times, the keys' columns only,
    so an expensive one is better written before.
    """
    if k <= 0:
        return df.limit(0)
    keyed = df.withColumn(_KEY, keys[0])
    n, nulls, low, high = keyed.agg(
        F.count(F.lit(1)), F.count_if(F.col(_KEY).isNull()), F.min(_KEY), F.max(_KEY)).first()
    if n <= k:
        return df
    if nulls >= k:
        return _ordered(keyed.where(F.col(_KEY).isNull()), nulls, k, keys)
    left, shift, stretch = k - nulls, (low ^ high).bit_length(), None
    # the whole range of keys differs in ``shift`` bits; ``stretch`` is what their leading bits are
    count = n - nulls
    inside = keyed.where(F.col(_KEY).isNotNull())
    if not shift:
        stretch, inside = low, inside
    while shift and (stretch is None or count > max(FEW, left)):
        narrower = max(shift - BITS, 0)
        part = F.shiftright(_KEY, narrower)
        counts = sorted(map(tuple, inside.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()))
        for stretch, count in counts:
            if count >= left:
                break
            left -= count
        shift, inside = narrower, inside.where(part == F.lit(stretch))
    leading = F.shiftright(_KEY, shift)
    below = keyed.where(F.col(_KEY).isNull() | (leading < F.lit(stretch)))
    last = keyed.where(leading == F.lit(stretch))
    if count == left:
        return below.unionByName(last).drop(_KEY)
    return below.drop(_KEY).unionByName(_ordered(last, count, left, keys, whole=shift > 0))


def _ordered(rows: DataFrame, count: int, k: int, keys: Sequence[Column], whole: bool = False) -> DataFrame:
    """The first ``k`` of ``count`` rows; ``whole`` if their first key differs still."""
    if count > FEW and not whole and len(keys) > 1:
        return smallest(rows.drop(_KEY), k, keys[1:])
    if count > FEW and not whole:
        return rows.limit(k).drop(_KEY)
    return rows.orderBy(*(x.asc_nulls_first() for x in keys)).limit(k).drop(_KEY)
