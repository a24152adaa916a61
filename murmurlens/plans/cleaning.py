"""The cleaning plan: text, length, exact and near duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from murmurlens.config import VIETNAMESE, TextConfig
from murmurlens.functions.cleaning import clean_text, nfc
from murmurlens.functions.common import computed_once, dealt
from murmurlens.operators.dedup import drop_exact_duplicates
from murmurlens.operators.neardup import drop_near_duplicates, kept_ids
from murmurlens.session import materialise

MIN_LENGTH = 5


def clean_comments(
    df: DataFrame,
    keep_emoji: bool = False,
    drop_duplicates: bool = True,
    min_length: int = MIN_LENGTH,
    duplicate_subset: Sequence[str] | None = ("text", "source"),
    similarity_threshold: float = 95,
    similarity_group: Sequence[str] = ("source",),
    config: TextConfig = VIETNAMESE,
    compose: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """Cleaned comments.  ``compose=True`` brings text to NFC first, ``partitions`` deals rows out first (:func:`dealt`)."""
    out = dealt(df.filter(F.col("text").isNotNull()), partitions)
    text = nfc(F.col("text")) if compose else F.col("text")
    out = computed_once(out, "text", clean_text(text, keep_emoji, config))
    out = out.filter(F.char_length("text") >= min_length)
    if drop_duplicates:
        out = drop_exact_duplicates(out, duplicate_subset)
    if similarity_threshold > 0:
        out = drop_near_duplicates(materialise(out, "cleaned"), similarity_threshold, similarity_group)
    return out


def cleaning_audit(df: DataFrame, similarity_threshold: float = 0, min_length: int = MIN_LENGTH,
                   duplicate_subset: Sequence[str] = ("text", "source"),
                   similarity_group: Sequence[str] = ("source",), config: TextConfig = VIETNAMESE) -> DataFrame:
    """Rows per reason of removal, ``kept`` included, in one aggregate.

    Duplicates are found by comparing each row to the first of its key, which
    is a pre-aggregated minimum, so that a flood of copies stays spread out.
    """
    keys = sorted({*duplicate_subset, *similarity_group} - {"text"})
    cleaned = computed_once(
        df.select("seq", *keys, "text", F.col("text").isNull().alias("missing")),
        "text", clean_text(F.col("text"), config=config),
    )
    short = F.char_length("text") < min_length
    first = F.when(F.col("missing"), "null_text").when(short, "too_short")
    staged = materialise(cleaned.withColumn("reason", first), "audit")
    long_enough = staged.filter(F.col("reason").isNull())
    unique = drop_exact_duplicates(long_enough, duplicate_subset)
    kept = unique.select("seq")
    if similarity_threshold > 0:
        unique = materialise(unique, "audit-unique")
        near = kept_ids(unique, similarity_threshold, similarity_group).withColumnRenamed("id", "seq")
        after = near.agg(F.count(F.lit(1)).alias("n_near"))
    else:
        after = kept.agg(F.count(F.lit(1)).alias("n_near"))
    n = F.count(F.lit(1))
    first_stage = staged.agg(
        n.alias("rows_in"),
        F.count_if(F.col("reason") == "null_text").alias("null_text"),
        F.count_if(F.col("reason") == "too_short").alias("too_short"),
    )
    exact = unique.agg(n.alias("n_exact"))
    counts = first_stage.select(
        "*", exact.scalar().alias("n_exact"), after.scalar().alias("n_near")
    )
    rows = F.array(*[
        F.struct(F.lit(name).alias("outcome"), value.alias("n"))
        for name, value in (
            ("null_text", F.col("null_text")),
            ("too_short", F.col("too_short")),
            ("exact_duplicate", F.col("rows_in") - F.col("null_text") - F.col("too_short") - F.col("n_exact")),
            ("near_duplicate", F.col("n_exact") - F.col("n_near")),
            ("kept", F.col("n_near")),
        )
    ])
    return counts.select(F.inline(rows))
