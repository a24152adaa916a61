"""Platform ingest from end to end: what was collected becomes comments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from murmurlens.config import COLLECTED_SPLIT, VIETNAMESE, TextConfig
from murmurlens.functions.cleaning import strip
from murmurlens.functions.predicates import is_valid_comment, looks_vietnamese
from murmurlens.operators.dedup import append_latest, cap_per_group, drop_platform_duplicates, synthetic_ids
from murmurlens.plans.cleaning import MIN_LENGTH
from murmurlens.sources.threads import attach_titles, flatten_reply_trees


def ingest_threads(threads: DataFrame, posts: DataFrame, max_comments: int = 100,
                   accept: Callable[[Column], Column] | None = looks_vietnamese, min_length: int = MIN_LENGTH) -> DataFrame:
    """Comments of reply trees: live and accepted ones, the first ``max_comments`` of a post in reading order, one per id, with titles.

    Comments without an id are one per post and text.  ``posts`` has ``post_id``
    and ``post_title``.
    """
    found = cap_per_group(flatten_reply_trees(threads, accept=accept), ["post_id"], max_comments, ["path"])
    unique = drop_platform_duplicates(found, ["post_id", "text"], ["post_id", "path"])
    return attach_titles(unique.filter(F.char_length("text") >= min_length), posts)


def ingest_posts(comments: DataFrame, stored: DataFrame | None = None, max_comments: int = 100,
                 config: TextConfig = VIETNAMESE, order: str = "seq") -> DataFrame:
    """Comments below posts of groups: valid texts, the first of each text in a post, numbered ids, then appended to ``stored``.

    ``comments`` has ``facebook_group_id``, ``post_id``, ``text`` and ``order``; a
    post gives its first ``max_comments``.
    """
    stripped = comments.withColumn("text", strip(F.col("text")))
    numbered = synthetic_ids(stripped.filter(is_valid_comment(F.col("text"), config)), order=order)
    capped = cap_per_group(numbered, ["facebook_group_id", "post_id"], max_comments, [order])
    rows = capped.withColumns({"source": F.lit("facebook"), "split": F.lit(COLLECTED_SPLIT)})
    return append_latest(rows.limit(0) if stored is None else stored, rows, order=order)
