"""A CSV with line breaks inside fields, read by many tasks.

A quoted field may hold line breaks, so a reader that starts in the middle of a
file cannot know whether it starts inside a field.  Counting tells: a line is inside a
field if an odd number of quotes stands before it (a doubled quote counts twice
and changes nothing).  Each range of the file counts its quotes, a running sum over
the ranges tells each whether it starts inside a field, and one over its lines where
records start.  Lines are then joined to records, those that reach over the end of
a range included, and each record is parsed by itself.

Fields that hold quotes, separators or line breaks are quoted, as CSV writers do; a
lone quote inside an unquoted field would be taken for the start of a field.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from murmurlens.session import materialise
from murmurlens.sources.comments import read_csv

_OPTIONS = {"escape": '"', "mode": "PERMISSIVE"}


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, range, at (order within the range), line and its number of quotes."""
    raw = spark.read.option("lineSep", "\n").text(path)
    line = F.regexp_replace("value", "\r$", "")
    lines = raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"),
        F.monotonically_increasing_id().alias("at"), line.alias("line"))
    return lines.withColumn("quotes", F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit(""))))


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, place (struct of range and at, ascending in a file) and text of each record, the header's included."""
    lines = materialise(_lines(spark, path), "csv-lines")
    # one row for each range of a file, as many as read tasks
    ranges = lines.groupBy("file", "range").agg(F.sum("quotes").alias("n"))
    earlier = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("file").alias("of_file"), F.col("range").alias("of_range"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    placed = lines.join(ranges, (F.col("file") == F.col("of_file")) & (F.col("range") == F.col("of_range")))
    inside = Window.partitionBy("file", "range").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    starts = (F.col("before") + F.coalesce(F.sum("quotes").over(inside), F.lit(0))) % 2 == 0
    started = placed.select("file", "range", "at", "line", starts.alias("starts"))
    through = Window.partitionBy("file", "range").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.max(F.when(F.col("starts"), F.struct("range", "at"))).over(through)
    started = materialise(started.select("file", "range", "at", "line", own.alias("record")), "csv-starts")
    # what stands before the first start of a range goes on from the last start before it
    last = started.groupBy("file", "range").agg(F.max("record").alias("last"))
    before = F.max("last").over(earlier)
    last = last.select(F.col("file").alias("of_file"), F.col("range").alias("of_range"), before.alias("open"))
    whole = started.join(last, (F.col("file") == F.col("of_file")) & (F.col("range") == F.col("of_range")))
    whole = whole.withColumn("place", F.coalesce("record", "open"))
    parts = F.array_sort(F.collect_list(F.struct("range", "at", "line")))
    return whole.groupBy("file", "place").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("text"))


def read_split_csv(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`read_csv` of UTF-8 files with one header, every column a string, read in ranges.

    Rows have no order of their own; ``csv_file`` and ``csv_place`` tell where a
    record starts.
    """
    names = read_csv(spark, path).columns  # reads the header
    found = records(spark, path)
    first = found.groupBy("file").agg(F.min("place").alias("header")).withColumnRenamed("file", "of_file")
    body = found.join(first, (F.col("file") == F.col("of_file")) & (F.col("place") > F.col("header"))).filter(F.col("text") != "")
    parsed = body.select("file", "place", F.from_csv("text", ", ".join(f"`{n}` STRING" for n in names), _OPTIONS).alias("row"))
    return parsed.select("row.*", F.col("file").alias("csv_file"), F.col("place").alias("csv_place"))

