"""Keyed streaming state: repeats, restarts, other writers, and what a batch reads."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from murmurlens.sources.store import LabelStore
from murmurlens.streaming import keyed

SCHEMA = "seq long, comment_id string, text string, source string"


def step(df):
    return df.withColumns({"label": F.lit("CLEAN"), "label_error": F.lit(None).cast("string"), "labeled_by": F.lit("test")})


@pytest.fixture
def paths(tmp_path):
    return {n: str(tmp_path / n) for n in ("in", "store", "checkpoint")}


def arrive(spark, paths, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(paths["in"])


def run(spark, paths, store, **options):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(paths["in"])
    query = keyed.start_keyed_ingest(stream, store, paths["checkpoint"], step, **options)
    query.awaitTermination()


def stored(store):
    return sorted((r.record_key, r.text, r.writer) for r in store.log().collect())


def test_late_repeats_restarts_and_other_writers(spark, paths):
    store = LabelStore(spark, paths["store"])
    old = spark.createDataFrame([(9, "9", "an older text", "s", "HATE", "s|comment|9")], SCHEMA + ", label string, record_key string")
    store.append(old, 0, "review")
    provider = spark.conf.get(keyed._PROVIDER, None)
    arrive(spark, paths, [(1, "1", "first text", "s"), (2, "1", "second text", "s"), (3, "2", "abc", "s"), (4, "9", "known before", "s"), (5, "3", None, "s")])
    run(spark, paths, store)
    assert spark.conf.get(keyed._PROVIDER, None) == provider
    first = [("s|comment|1", "second text", "stream"), ("s|comment|9", "an older text", "review")]
    assert stored(store) == first
    # another writer labels key 4 meanwhile; keys 1 and 9 come again, key 2 is long enough now
    store.append(spark.createDataFrame([(8, "4", "by hand", "s", "HATE", "s|comment|4")], SCHEMA + ", label string, record_key string"), 1, "review")
    arrive(spark, paths, [(6, "1", "third text", "s"), (7, "4", "fourth text", "s"), (8, "2", "long enough", "s"), (9, "9", "once more", "s")])
    seen = []
    log = store._log
    store._log = lambda without=None, chosen=None: seen.append(chosen) or log(without, chosen)
    run(spark, paths, store)
    store._log = log
    assert stored(store) == sorted(first + [("s|comment|2", "long enough", "stream"), ("s|comment|4", "by hand", "review")])
    # the initial state names the versions up to its base; a batch reads newer ones of others only
    assert [[(v.writer, v.number) for v in chosen] for chosen in seen] == [[("review", 0)], [("review", 1)]]


def test_old_versions_may_go_once_they_are_state(spark, paths):
    store = LabelStore(spark, paths["store"])
    old = spark.createDataFrame([(9, "9", "an older text", "s", "HATE", "s|comment|9")], SCHEMA + ", label string, record_key string")
    store.append(old, 0, "review")
    arrive(spark, paths, [(1, "1", "first text", "s")])
    run(spark, paths, store)
    # the rows of the old version are not read any more: an empty folder does as well
    attempt = store.versions()[0].attempt
    for part in Path(paths["store"], "rows", f"attempt={attempt}").rglob("part-*"):
        part.write_bytes(b"")
    arrive(spark, paths, [(2, "9", "again and again", "s"), (3, "1", "again and again", "s"), (4, "5", "something new", "s")])
    run(spark, paths, store)
    newer = [v for v in store.versions() if v.writer == "stream"]
    assert sorted(r.record_key for r in store.log(chosen=newer).collect()) == ["s|comment|1", "s|comment|5"]


def test_nothing_arrives(spark, paths):
    store = LabelStore(spark, paths["store"])
    spark.createDataFrame([], SCHEMA).write.parquet(paths["in"])
    run(spark, paths, store)
    assert stored(store) == []


def test_version_written_without_adaptive_planning_has_one_file_for_each_folder(spark, paths):
    """As in a stream's batches, where the rebalance hint does nothing."""
    store = LabelStore(spark, paths["store"], buckets=4)
    session = spark.newSession()
    session.conf.set("spark.sql.adaptive.enabled", "false")
    rows = session.range(400).repartition(8).select(
        F.col("id").alias("seq"), F.lit("CLEAN").alias("label"), F.col("id").cast("string").alias("record_key"))
    store.append(rows, 0, "stream")
    assert len(list(Path(paths["store"]).rglob("*.parquet"))) == 4
    assert store.read().count() == 400
