"""Plan properties that matter at scale."""

from pyspark.sql import functions as F

from murmurlens.operators import dedup as D, neardup as ND, stats, terms
from murmurlens.sources import comments as C
from verification.registry import comments, table

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dedup_limits_each_key_before_the_shuffle(spark):
    df = table(spark, SF, "conversations").select(F.col("conv_id").alias("seq"), "text")
    for out in (D.keep_first(df, ["text"]), D.keep_last(df, ["text"]), D.cap_per_group(df, ["text"], 900)):
        p = physical(out)
        assert "WindowGroupLimit" in p and "Partial" in p


def test_aggregates_combine_before_the_shuffle(spark):
    p = physical(stats.toxic_by_source(comments(spark, SF).filter("label IS NOT NULL")))
    assert p.count("HashAggregate") >= 2 and "SortAggregate" not in p


def test_scan_reads_only_what_is_asked(spark):
    p = plan(stats.label_distribution(comments(spark, SF)))
    scans = [line for line in p.splitlines() if "ReadSchema" in line]
    assert scans and not any("text:string" in line for line in scans)


def test_source_filter_reaches_the_scan(spark):
    p = physical(C.select_sources(table(spark, SF, "events").withColumnRenamed("event_type", "source"), ["view", "click"]))
    assert "PushedFilters: [In(event_type" in p


def test_top_k_does_not_sort_everything(spark):
    counts = table(spark, SF, "events").select(F.col("event_type").alias("word"), F.col("event_id").alias("count"))
    assert "TakeOrderedAndProject" in physical(terms.top_k(counts, "word", 5))


def test_candidate_counts_form_no_pairs(spark):
    df = table(spark, SF, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("seq"), "text")
    assert "Join" not in physical(ND.candidate_counts(df))


def test_numbering_has_no_unpartitioned_row_number(spark):
    df = table(spark, SF, "events").select(F.col("event_id").alias("seq"))
    assert "Window" not in physical(D.number_within(df, []))
    assert "Window" not in physical(D.number_within(df.withColumn("g", F.col("seq") % 3), ["g"]))
