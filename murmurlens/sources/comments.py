"""The canonical comment table and the platform files it comes from."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from murmurlens.config import COLLECTED_SPLIT, LABELS, PLATFORMS
from murmurlens.functions.cleaning import strip
from murmurlens.functions.predicates import is_unlabelled

COMMENT_SCHEMA = StructType(
    [StructField("seq", LongType())]
    + [
        StructField(name, LongType() if name in ("like_count", "score") else StringType())
        for name in (
            "text", "label", "source", "split", "comment_id", "video_id", "post_id",
            "facebook_group_id", "subreddit", "post_title", "post_url", "author",
            "like_count", "score", "published_at", "labeled_by", "label_error", "record_key",
        )
    ]
)


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8", multiline: bool = True) -> DataFrame:
    """A CSV with header, every column a string.

    Comments hold newlines, and a multi-line CSV cannot be split: one file is
    one task.  Use it at the edge and keep Parquet inside.
    """
    return (
        spark.read.option("header", True)
        .option("multiLine", multiline)
        .option("escape", '"')
        .option("encoding", encoding)
        .csv(path)
    )


def normalise_platform(raw: DataFrame, platform: str) -> DataFrame:
    """Required text, default columns, blank source filled with the platform."""
    if "text" not in raw.columns:
        raise ValueError(f"{platform}: no text column, found {raw.columns}")
    df = raw.withColumn("text", strip(F.col("text"))).filter(F.char_length("text") > 0)
    source = F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit(platform)) if "source" in df.columns else F.lit(platform)
    df = df.withColumn("source", source)
    defaults = {"label": F.lit(None).cast("string"), "split": F.lit(COLLECTED_SPLIT),
                "published_at": F.lit(None).cast("string")}
    return df.withColumns({n: c for n, c in defaults.items() if n not in df.columns})


def with_row_order(df: DataFrame, column: str = "seq") -> DataFrame:
    """Number rows in file order (increasing, with gaps) where no order exists yet."""
    return df if column in df.columns else df.withColumn(column, F.monotonically_increasing_id())


def scan_platform(spark: SparkSession, path: str, platform: str, **options) -> DataFrame:
    """One platform file; :func:`gather` numbers the rows of all files together."""
    return normalise_platform(read_csv(spark, path, **options), platform)


def split_known(names: Iterable[str], known: Iterable[str] = PLATFORMS) -> tuple[list[str], list[str]]:
    """Requested sources that are known, and the rest for the caller to report."""
    known = list(known)
    names = list(names)
    return [n for n in names if n in known], sorted(set(names) - set(known))


def union_sources(frames: Iterable[DataFrame]) -> DataFrame:
    """Union by column name; a column missing on one side is null there."""
    out = None
    for df in frames:
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no input: give at least one source")
    return out


def gather(
    platforms: Mapping[str, DataFrame],
    sources: Iterable[str] | None = None,
    corpus: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """All comments with a unique ``seq``, and the unlabelled ones among them.

    Rows are numbered after the union, platforms in the order given and the
    corpus last, unless every input brings its own ``seq``, which then has to be
    unique over all of them.  The second frame is a filter, not a second read: a
    corpus holds labelled rows only.
    """
    wanted, unknown = split_known(sources or platforms, platforms)
    if unknown:
        raise ValueError(f"unknown sources: {', '.join(unknown)}")
    parts = [platforms[name] for name in wanted] + ([corpus] if corpus is not None else [])
    if not all("seq" in df.columns for df in parts):
        parts = [df.drop("seq") for df in parts]
    everything = with_row_order(union_sources(parts))
    return everything, everything.filter(is_unlabelled(F.col("label")))


def select_sources(df: DataFrame, sources: Iterable[str]) -> DataFrame:
    return df.filter(F.col("source").isin(*sources))


def exclude_source(df: DataFrame, source: str) -> DataFrame:
    """All rows but those of one source; rows without a source stay."""
    return df.filter(~F.col("source").eqNullSafe(F.lit(source)))


def labelled(df: DataFrame) -> DataFrame:
    return df.filter(F.col("label").isin(*LABELS))


def csv_options(writer):
    """Quote-doubling CSV with header that keeps leading and trailing blanks."""
    return (
        writer.option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )


def write_results(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Result sink: ``text, label, source``, those that exist."""
    writer = result_columns(df).write.mode(mode)
    if fmt == "csv":
        writer = csv_options(writer)
    writer.format(fmt).save(path)


def result_columns(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in ("text", "label", "source") if c in df.columns])
