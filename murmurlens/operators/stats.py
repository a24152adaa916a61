"""Label, source, time and length statistics.

Distributions over a fixed domain come from one global aggregate whose cells
are then unfolded into rows: a single pass, zeros kept, no join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from murmurlens.config import CORPUS_SOURCE, LABELS, LEVELS
from murmurlens.functions.keys import hour_of_day, normalize_label
from murmurlens.functions.predicates import is_toxic
from murmurlens.functions.scoring import correlation_band


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0)), digits)


def fixed_distribution(df: DataFrame, column: str, domain: Sequence[str]) -> DataFrame:
    """``value, count, pct`` per domain member, percentages of *all* rows."""
    cells = [F.count_if(F.col(column) == value).alias(f"n{i}") for i, value in enumerate(domain)]
    totals = df.agg(F.count(F.lit(1)).alias("total"), *cells)
    rows = F.array(*[
        F.struct(F.lit(v).alias(column), F.col(f"n{i}").alias("count"),
                 percent(F.col(f"n{i}"), F.col("total")).alias("pct"))
        for i, v in enumerate(domain)
    ])
    return totals.select(F.inline(rows))


def label_distribution(df: DataFrame) -> DataFrame:
    return fixed_distribution(df, "label", LABELS)


def corpus_label_shares(df: DataFrame) -> DataFrame:
    return label_distribution(df.filter(F.col("source") == CORPUS_SOURCE))


def level_distribution(scored: DataFrame) -> DataFrame:
    return fixed_distribution(scored, "toxic_level", LEVELS)


def outcome_summary(df: DataFrame) -> DataFrame:
    """Rows and share per label found, error label included."""
    counts = df.groupBy("label").agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count").alias("total"))
    return counts.select("label", "count", percent(F.col("count"), total.scalar()).alias("pct"))


def row_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def toxic_by_source(df: DataFrame) -> DataFrame:
    toxic = F.count_if(is_toxic(F.col("label")))
    total = F.count("source")
    return df.filter(F.col("source").isNotNull()).groupBy("source").agg(
        total.alias("total"), toxic.alias("toxic"), percent(toxic, total).alias("toxic_rate_pct")
    )


def toxic_totals(df: DataFrame) -> DataFrame:
    toxic = is_toxic(F.col("label"))
    return df.agg(F.count_if(toxic).alias("toxic"), F.count_if(F.col("label") == "CLEAN").alias("clean"))


def _label_cells(total: Column, digits: int) -> list[Column]:
    return [
        F.round(F.try_divide(F.count_if(F.col("label") == v), total) * F.lit(100.0), digits).alias(v)
        for v in LABELS
    ]


def source_label_crosstab(df: DataFrame) -> DataFrame:
    """Label shares per source with an ``All`` row, in percent with 2 decimals."""
    total = F.count(F.lit(1))
    rolled = df.filter(F.col("label").isNotNull() & F.col("source").isNotNull()).rollup("source")
    return rolled.agg(F.grouping("source").alias("is_all"), *_label_cells(total, 2)).select(
        F.when(F.col("is_all") == 1, "All").otherwise(F.col("source")).alias("source"), *LABELS
    )


def source_label_shares(df: DataFrame, min_sources: int = 2) -> DataFrame:
    """Same without the margin; empty when there are fewer sources than asked for.

    The gate reads the same small aggregate, not the input again.
    """
    total = F.count(F.lit(1))
    named = df.filter(F.col("source").isNotNull() & F.col("label").isNotNull())
    shares = named.groupBy("source").agg(*_label_cells(total, 6))
    sources = shares.agg(F.count("source").alias("n"))
    return shares.filter(sources.scalar() >= min_sources)


def label_level_crosstab(scored: DataFrame) -> DataFrame:
    total = F.count(F.lit(1))
    cells = [
        F.round(F.try_divide(F.count_if(F.col("toxic_level") == v), total) * 100.0, 6).alias(v) for v in LEVELS
    ]
    return scored.filter(F.col("label").isNotNull()).groupBy("label").agg(*cells)


def toxic_by_hour(df: DataFrame, hour: Column | None = None) -> DataFrame:
    """Comments, toxic comments and rate per hour; rows without a time are left out."""
    hour = hour_of_day(F.col("published_at")) if hour is None else hour
    toxic, total = F.sum(is_toxic(F.col("label")).cast("int")), F.count(F.lit(1))
    return (
        df.select("label", hour.alias("hour"))
        .filter(F.col("hour").isNotNull())
        .groupBy("hour")
        .agg(total.alias("total"), toxic.alias("toxic"), percent(toxic, total).alias("toxic_rate_pct"))
    )


def length_by_label(df: DataFrame, exact: bool = True) -> DataFrame:
    """Mean, median, min and max characters per label.

    The exact median keeps one counter per distinct length, which the longest
    text bounds; ``exact=False`` uses a sketch instead.
    """
    n = F.char_length("text")
    middle = F.median(n) if exact else F.percentile_approx(n, 0.5)
    return df.filter(F.col("label").isNotNull()).groupBy("label").agg(
        F.round(F.avg(n), 1).alias("mean"),
        F.round(middle.cast("double"), 1).alias("median"),
        F.min(n).alias("shortest"),
        F.max(n).alias("longest"),
    )


def score_by_label(scored: DataFrame) -> DataFrame:
    return scored.filter(F.col("label").isin(*LABELS)).groupBy("label").agg(
        F.round(F.avg("toxic_score"), 6).alias("mean_score")
    )


def metrics_by_label(scored: DataFrame) -> DataFrame:
    """Mean and median of length and words, mean and sum of toxic words."""
    r2 = lambda c: F.round(c, 2)
    return scored.filter(F.col("label").isNotNull()).groupBy("label").agg(
        r2(F.avg("n_chars")).alias("chars_mean"), r2(F.median("n_chars")).alias("chars_median"),
        r2(F.avg("n_words")).alias("words_mean"), r2(F.median("n_words")).alias("words_median"),
        r2(F.avg("n_toxic_words")).alias("toxic_words_mean"), F.sum("n_toxic_words").alias("toxic_words_sum"),
    )


def guarded_corr(x: str, y: str) -> Column:
    """Pearson correlation; null, not an error, when a side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def length_score_correlation(scored: DataFrame) -> DataFrame:
    return scored.agg(F.round(guarded_corr("n_chars", "toxic_score"), 6).alias("correlation")).withColumn(
        "strength", correlation_band(F.col("correlation"))
    )


def without_long_outliers(scored: DataFrame, quantile: float = 0.95) -> DataFrame:
    """Rows up to the exact length quantile, read as a scalar subquery."""
    bound = scored.agg(F.percentile("n_chars", quantile).alias("bound"))
    return scored.filter(F.col("n_chars") <= bound.scalar())


def length_score_trend(scored: DataFrame, quantile: float = 0.95) -> DataFrame:
    """Least-squares line of score over length and correlation, outliers removed."""
    x, y = "n_chars", "toxic_score"
    slope = F.try_divide(F.covar_pop(x, y), F.var_pop(x))
    return without_long_outliers(scored, quantile).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(slope, 6).alias("slope"),
        F.round(F.avg(y) - slope * F.avg(x), 6).alias("intercept"),
        F.round(guarded_corr(x, y), 6).alias("correlation"),
    )


def queue_status(pending: DataFrame, review: DataFrame, store: DataFrame) -> DataFrame:
    """Rows per queue, and per label in the review and store queues: one scan each."""
    total = pending.agg(F.count(F.lit(1)).alias("count")).select(
        F.lit("pending").alias("queue"), F.lit(None).cast("string").alias("label"), "count"
    )

    def by_label(df: DataFrame, queue: str) -> DataFrame:
        label = normalize_label(F.col("label"))
        shown = df.select(F.when(label == "", "<blank>").otherwise(label).alias("label"))
        # the margin of the rollup, where the label is null, is the queue total
        return shown.rollup("label").agg(F.count(F.lit(1)).alias("count")).select(
            F.lit(queue).alias("queue"), "label", "count"
        )

    return total.unionByName(by_label(review, "review")).unionByName(by_label(store, "store"))
