"""Manual review round trip."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from murmurlens.config import COLLECTED_SPLIT, LABELS, REVIEW_FRONT_COLUMNS
from murmurlens.functions.keys import normalize_label, with_record_key
from murmurlens.operators.dedup import anti_join_keys, first_rows, keep_last
from murmurlens.operators.labelling import validate_labels
from murmurlens.sources.comments import csv_options


class ReviewImport(NamedTuple):
    store: DataFrame
    pending: DataFrame
    review: DataFrame


def review_columns(df: DataFrame) -> DataFrame:
    """Columns a reviewer needs first, the rest behind."""
    front = [c for c in REVIEW_FRONT_COLUMNS if c in df.columns]
    return df.select(*front, *[c for c in df.columns if c not in front])


def export_review(pending: DataFrame, limit: int = 100, platform: str = "reddit", order: str = "seq") -> DataFrame:
    """First pending rows with a blank label; 0 exports all."""
    keyed = with_record_key(first_rows(pending, limit, order), platform)
    return review_columns(keyed.withColumn("label", F.lit("")))


def write_review(review: DataFrame, path: str, overwrite: bool = False) -> None:
    """CSV for a spreadsheet; an existing file is refused unless told otherwise."""
    mode = "overwrite" if overwrite else "errorifexists"
    csv_options(review.write.mode(mode)).csv(path)


def _ordered(df: DataFrame, order: str, age: int) -> DataFrame:
    """Row order as a number: a table from a spreadsheet has text or nothing there."""
    value = F.col(order).try_cast("bigint") if order in df.columns else F.lit(None).cast("bigint")
    return df.withColumns({order: value, "__age": F.lit(age)})


def upsert(store: DataFrame, fresh: DataFrame, order: str = "seq") -> DataFrame:
    """Union, last row per key, valid labels only; fresh rows beat stored ones."""
    both = _ordered(store, order, 0).unionByName(_ordered(fresh, order, 1), allowMissingColumns=True)
    valid = both.filter(F.col("label").isin(*LABELS))
    return keep_last(valid, ["record_key"], ["__age", order]).drop("__age")


def import_review(review: DataFrame, store: DataFrame, pending: DataFrame, labelled_by: str = "Manual",
                  platform: str = "reddit") -> ReviewImport:
    """Move filled labels into the store and out of the pending rows.

    Nothing happens if one filled label is outside the domain, or none is filled.
    """
    keyed = with_record_key(review, platform).withColumn("label", normalize_label(F.col("label")))
    validate_labels(keyed)
    filled = F.col("label").isin(*LABELS)
    if keyed.filter(filled).isEmpty():
        raise ValueError("no label is filled in")
    now = keyed.filter(filled).withColumn("labeled_by", F.lit(labelled_by))
    if "split" not in now.columns:
        now = now.withColumn("split", F.lit(COLLECTED_SPLIT))
    left = keyed.filter(~filled).withColumn("label", F.lit(""))
    merged = upsert(with_record_key(store, platform), now)
    rest = anti_join_keys(with_record_key(pending, platform), now, ["record_key"])
    return ReviewImport(merged, rest, left)
