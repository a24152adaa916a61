"""Flatten semi-structured comment pages, post listings and reply trees."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, functions as F

from murmurlens.functions.common import computed_once
from murmurlens.functions.keys import epoch_to_iso
from murmurlens.functions.predicates import is_live_comment
from murmurlens.session import materialise

PAGE_SCHEMA = (
    "items array<struct<id:string, snippet:struct<topLevelComment:struct<id:string, "
    "snippet:struct<textDisplay:string, authorDisplayName:string, likeCount:bigint, "
    "publishedAt:string>>>>>, nextPageToken string"
)
LISTING_SCHEMA = (
    "data struct<children:array<struct<kind:string, data:struct<id:string, title:string, "
    "num_comments:bigint>>>>"
)
#: A node of a reply tree; what has another type is null, ``replies`` can be ``""``.
NODE_SCHEMA = (
    "struct<kind:string, data:struct<body:string, author:string, id:string, score:bigint, "
    "created_utc:double, replies:variant>>"
)


def flatten_comment_pages(pages: DataFrame, json_col: str = "json", video_col: str = "video_id") -> DataFrame:
    """One row per top-level comment of a page; the id falls back to the item id."""
    item = F.col("item")
    top = item["snippet"]["topLevelComment"]
    body = top["snippet"]
    return (
        pages.select(video_col, F.from_json(json_col, PAGE_SCHEMA).alias("page"))
        .select(video_col, F.posexplode("page.items").alias("pos", "item"))
        .select(
            F.coalesce(top["id"], item["id"], F.lit("")).alias("comment_id"),
            F.col(video_col).alias("video_id"),
            "pos",
            F.coalesce(body["textDisplay"], F.lit("")).alias("text"),
            F.coalesce(body["authorDisplayName"], F.lit("")).alias("author"),
            F.coalesce(body["likeCount"], F.lit(0)).alias("like_count"),
            F.coalesce(body["publishedAt"], F.lit("")).alias("published_at"),
            F.lit("youtube").alias("source"),
        )
    )


def flatten_post_listing(listings: DataFrame, json_col: str = "json") -> DataFrame:
    """Posts (kind ``t3``) that have comments, title cut to 80 characters."""
    keep = [c for c in listings.columns if c != json_col]
    return (
        listings.select(*keep, F.from_json(json_col, LISTING_SCHEMA).alias("listing"))
        .select(*keep, F.explode("listing.data.children").alias("post"))
        .filter((F.col("post.kind") == "t3") & (F.coalesce("post.data.num_comments", F.lit(0)) != 0))
        .select(
            *keep,
            F.coalesce("post.data.id", F.lit("")).alias("post_id"),
            F.left(F.coalesce("post.data.title", F.lit("")), F.lit(80)).alias("post_title"),
        )
    )


def attach_titles(comments: DataFrame, posts: DataFrame) -> DataFrame:
    """Put the title of its post onto each comment.

    A post that several listings show counts once.
    """
    titles = posts.groupBy("post_id").agg(F.min("post_title").alias("post_title"))
    return comments.join(titles, "post_id")


def _children(node: Column, path: str) -> Column:
    """Child array at ``path`` or null where replies are ``""`` or missing."""
    return F.try_variant_get(node, path, "array<variant>")


def unreadable_json(rows: DataFrame, json_col: str = "json") -> DataFrame:
    """Rows whose JSON cannot be read, nested beyond the parser included: the reject table of the readers here."""
    return rows.filter(F.col(json_col).isNotNull() & F.try_parse_json(json_col).isNull())


def flatten_reply_trees(
    threads: DataFrame,
    json_col: str = "json",
    post_col: str = "post_id",
    accept=None,
) -> DataFrame:
    """All live comments of nested reply trees, with their pre-order path.

    Works level by level over the whole table: each pass opens the replies of
    the comments accepted in the pass before, so a rejected comment takes its
    subtree with it; a comment's fields are taken out of it in one go.  Levels, with the replies still to open as variants, are
    written to the staging area: JSON is parsed once and the plan stays flat
    however deep the deepest tree is.  What cannot be read has no comments here
    and is in ``unreadable_json``.  ``accept(body)`` adds a
    text rule, such as the language test.
    """
    root = F.try_parse_json(json_col)
    # once: Spark tests an exploded array's size first, and would parse a second time for that
    level = computed_once(threads, "children", _children(root, "$[1].data.children")).select(
        post_col, F.lit("").alias("prefix"), "children")
    done = []
    for depth in count():
        data = F.col("node.data")
        body = data["body"]
        author = F.coalesce(data["author"], F.lit(""))
        live = is_live_comment(body, author)
        if accept is not None:
            live = live & accept(body)
        # A path segment is the position, preceded by its number of digits, so
        # that text order equals pre-order for any number of siblings.
        digits = F.col("pos").cast("string")
        segment = F.concat(F.chr(F.lit(96) + F.length(digits)), digits)
        opened = (
            computed_once(
                level.select(post_col, "prefix", F.posexplode("children").alias("pos", "node")),
                "node", F.try_variant_get("node", "$", NODE_SCHEMA))
            .filter((F.col("node.kind") == "t1") & live)
            .select(
                post_col,
                F.concat("prefix", segment).alias("path"),
                F.lit(depth).alias("depth"),
                F.coalesce(data["id"], F.lit("")).alias("comment_id"),
                body.alias("text"),
                author.alias("author"),
                F.coalesce(data["score"], F.lit(0)).alias("score"),
                epoch_to_iso(data["created_utc"]).alias("published_at"),
                _children(data["replies"], "$.data.children").alias("children"),
            )
        )
        opened = materialise(opened, f"replies-{depth}")
        if opened.isEmpty():
            break
        done.append(opened.drop("children"))
        level = opened.filter(F.size("children") > 0).select(post_col, F.col("path").alias("prefix"), "children")
    if not done:
        return opened.drop("children").withColumn("source", F.lit("reddit"))
    out = done[0]
    for df in done[1:]:
        out = out.union(df)
    return out.withColumn("source", F.lit("reddit"))
