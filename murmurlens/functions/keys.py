"""Record identity, label spelling, post ids and times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from murmurlens.config import CORPUS_LABEL_ALIASES
from murmurlens.functions.cleaning import strip
from murmurlens.functions.common import let


def _field(df: DataFrame, name: str, trim: bool = True) -> Column:
    if name not in df.columns:
        return F.lit("")
    value = F.coalesce(F.col(name).cast("string"), F.lit(""))
    return strip(value) if trim else value


def record_key(df: DataFrame, text_col: str = "text") -> Column:
    """``source|comment|id`` where there is an id, else source, parent and text.

    The parent is the video, or the post where the video is blank.
    """
    source = _field(df, "source", trim=False)
    comment_id = _field(df, "comment_id")
    video, post = _field(df, "video_id"), _field(df, "post_id")
    parent = F.when(video != "", video).otherwise(post)
    return F.when(
        comment_id != "", F.concat(source, F.lit("|comment|"), comment_id)
    ).otherwise(F.concat(source, F.lit("|text|"), parent, F.lit("|"), _field(df, text_col)))


def with_record_key(df: DataFrame, default_source: str | None = None, text_col: str = "text") -> DataFrame:
    """Add ``source`` and ``record_key`` where the columns are missing."""
    if "source" not in df.columns and default_source is not None:
        df = df.withColumn("source", F.lit(default_source))
    if "record_key" not in df.columns:
        df = df.withColumn("record_key", record_key(df, text_col))
    return df


def normalize_label(label: Column) -> Column:
    """Null to blank, trimmed, upper case."""
    return F.upper(strip(F.coalesce(label, F.lit(""))))


def corpus_label(label: Column) -> Column:
    """Map 0/1/2 and known aliases to label names, row by row."""
    text = F.upper(strip(label.cast("string")))
    number = text.try_cast("double")
    code = F.when(number == F.floor(number), number.try_cast("int").cast("string"))
    mapping = F.create_map(*[F.lit(v) for item in CORPUS_LABEL_ALIASES.items() for v in item])
    return F.coalesce(F.try_element_at(mapping, code), F.try_element_at(mapping, text), text)


def hour_of_day(value: Column) -> Column:
    """Hour as written, whatever the session or the written zone; unparsable gives null."""
    return F.hour(value.try_cast("timestamp_ntz"))


#: Seconds of the first and the last moment that a four-digit year can show.
_FIRST_SECOND, _LAST_SECOND = -62135596800, 253402300799


def epoch_to_iso(seconds: Column) -> Column:
    """UTC ISO text for epoch seconds; 0, null and what no four-digit year can show give null."""
    number = seconds.try_cast("double")
    shown = F.when(number.between(_FIRST_SECOND, _LAST_SECOND), number)
    whole = F.nullif(shown.try_cast("long"), F.lit(0).cast("long"))
    utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=whole)
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


# ---- fixed values: post id patterns ----------------------------------------
POST_QUERY_KEYS = ("multi_permalinks", "story_fbid", "fbid")
POST_PATHS = (r"/groups/[^/]+/(?:posts|permalink)/(\d+)", r"/posts/(\d+)")
# ---- end of fixed values ---------------------------------------------------


def _decoded(value: Column) -> Column:
    return let(value, lambda v: F.coalesce(F.try_url_decode(v), v))


def query_value(url: Column, key: str) -> Column:
    """First non-empty value of one query key, percent-decoded; ``''`` if absent."""
    return _decoded(F.regexp_extract(url, rf"^[^?#]*\?(?:[^#]*?&)?{key}=([^&#]+)", 1))


def _direct_id(url: Column, paths: tuple[str, ...], keys: tuple[str, ...]) -> Column:
    """Id in the query or the path of a decoded link, null if there is none."""
    candidates = [F.regexp_extract(query_value(url, k), r"^(\d+)$", 1) for k in keys]
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    candidates += [F.regexp_extract(path, p, 1) for p in paths]
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates])


def post_id_of_url(
    url: Column,
    paths: tuple[str, ...] = POST_PATHS,
    keys: tuple[str, ...] = POST_QUERY_KEYS,
) -> Column:
    """Post id in a link; a ``u=`` redirect target is looked at first.

    A link is followed as often as it may hold a target (``u=``, whatever the
    times the equals sign is encoded); the innermost id counts.
    """
    steps = F.sequence(F.lit(0), F.regexp_count(url, F.lit("u(?:=|%(?:25)*3[dD])")))

    def follow(state: Column, _: Column) -> Column:
        def here(decoded: Column) -> Column:
            own = _direct_id(decoded, paths, keys)
            return F.struct(query_value(decoded, "u").alias("link"), F.coalesce(own, state["id"]).alias("id"))

        return F.when(state["link"] == "", state).otherwise(let(_decoded(state["link"]), here))

    start = F.struct(url.alias("link"), F.lit(None).cast("string").alias("id"))
    return F.coalesce(F.aggregate(steps, start, follow, lambda state: state["id"]), F.lit(""))
