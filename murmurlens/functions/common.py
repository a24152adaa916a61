"""Ways to evaluate an expensive expression once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a lambda variable, so ``body`` may use it repeatedly.

    Without it every use repeats the whole expression tree.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later filters and projections read but do not repeat.

    Catalyst pushes a filter below a projection by copying the projected
    expression into it.  It does not push one below a generator.
    """
    keep = [c for c in df.columns if c != name]
    named = df.select(*keep, F.explode(F.array(value)).alias(name))
    return named.select(*df.columns) if name in df.columns else named


def dealt(df: DataFrame, partitions: int | None, by: str = "seq") -> DataFrame:
    """``df`` in that many partitions, by a hash of a column; None leaves it as it lies.

    A file of one row group is one task.  Who knows that the input is such and the
    work on a row dear, says so; nothing here decides it by size.
    """
    return df if partitions is None else df.repartition(partitions, by)
