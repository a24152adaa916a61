"""Summary report as one row of JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from murmurlens.config import LABELS, TOXIC_LABELS
from murmurlens.operators.stats import percent


def summary_report(df: DataFrame) -> DataFrame:
    """Totals, label and source distribution, toxic share per source.

    One scan: rows are counted per source and label, and everything else is
    summed up from that small table.  The report lists every source, so it is
    as long as there are sources.
    """
    per_source = df.groupBy("source").agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("label") == v).alias(v) for v in LABELS])
    toxic = sum((F.col(v) for v in TOXIC_LABELS), F.lit(0)).alias("toxic")
    per_source = per_source.select("*", toxic).withColumn("toxic_rate_pct", percent(F.col("toxic"), F.col("total")))
    totals = per_source.agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total"),
        *[F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in LABELS],
        F.array_sort(F.collect_list(F.struct("source", "total", "toxic", "toxic_rate_pct"))).alias("rows"),
    )
    labels = F.create_map(*[
        part
        for v in LABELS
        for part in (F.lit(v), F.struct(F.col(v).alias("count"), percent(F.col(v), F.col("total")).alias("pct")))
    ])
    sources = F.map_from_entries(F.transform("rows", lambda r: F.struct(r["source"], r["total"])))
    return totals.select(
        F.to_json(F.struct(
            F.col("total").alias("total_rows"),
            labels.alias("label_distribution"),
            sources.alias("source_distribution"),
            F.col("rows").alias("toxic_by_source"),
        )).alias("report")
    )
