"""Append-only label store.

A version belongs to a writer (a cycle, a stream, a review) and has a number.  Its
rows go into a folder of their own for each attempt; once they are written, an empty
file under ``_versions`` names the attempt, and with that rename the version is there.
So a crash leaves the version as it was before, and writing a version again replaces
that version only.  A reader keeps the last row per ``record_key``, versions in the order
of their first commit.  "Pending" is *ingested minus stored*: there is no second file
that could disagree.

Rows lie in folders by a hash of their key, so whoever asks for some keys reads the
folders of those keys only (:meth:`LabelStore.keys_of`); Spark prunes them while the query runs.
"""

from __future__ import annotations

import re
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from murmurlens.functions.keys import with_record_key
from murmurlens.operators.dedup import keep_last
from murmurlens.sources.comments import COMMENT_SCHEMA, labelled


_ATTEMPT, _BUCKET = "attempt", "key_bucket"


class Version(NamedTuple):
    """A committed version: place in the order, times committed, and where its rows are."""

    sequence: int
    generation: int
    writer: str
    number: int
    attempt: str

    @property
    def file_name(self) -> str:
        return f"{self.sequence:09d}~{self.generation:06d}~{self.writer}~{self.number}~{self.attempt}"


class LabelStore:
    """Labelled comments at ``path``, keyed by ``record_key``; ``buckets`` is fixed with the first version."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType = COMMENT_SCHEMA, buckets: int = 64):
        self.buckets = buckets
        self.spark = spark
        self.path = path.rstrip("/")
        self.schema = schema

    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop, hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[Version]:
        """Committed versions in order, one entry each; a folder listing, no rows are read."""
        folder, fs = self._fs(f"{self.path}/_versions")
        if not fs.exists(folder):
            return []
        found: dict[tuple[str, int], Version] = {}
        for name in sorted(status.getPath().getName() for status in fs.listStatus(folder)):
            if m := re.fullmatch(r"(\d+)~(\d+)~([^~]+)~(\d+)~([0-9a-f]+)", name):
                version = Version(int(m[1]), int(m[2]), m[3], int(m[4]), m[5])
                known = found.get((version.writer, version.number))
                if known is None or known.generation <= version.generation:
                    found[version.writer, version.number] = version
        return sorted(found.values())

    def exists(self) -> bool:
        return bool(self.versions())

    def append(self, rows: DataFrame, version: int, writer: str = "cycle") -> None:
        """Commit one version of a writer; the same version again replaces it."""
        if not re.fullmatch(r"[\w.:-]+", writer):
            raise ValueError("a writer's name has letters, digits and _ . : - only")
        known = [f for f in self.schema if f.name in rows.columns]
        projected = rows.select(
            *[F.col(f.name).cast(f.dataType) for f in known],
            *[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema if f.name not in rows.columns],
        )
        attempt = uuid.uuid4().hex
        # one file for each folder and task; a large folder is split, small ones share a task
        dealt = labelled(projected).withColumn(_BUCKET, self._bucket_of(F.col("record_key")))
        if rows.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true":
            dealt = dealt.hint("rebalance", _BUCKET)
        else:  # as in a stream's batches, where the hint does nothing and each task would write to each folder
            dealt = dealt.repartition(_BUCKET)
        dealt.write.partitionBy(_BUCKET).parquet(f"{self.path}/rows/{_ATTEMPT}={attempt}")
        before = self.versions()
        same = [v for v in before if (v.writer, v.number) == (writer, int(version))]
        if same:
            committed = same[0]._replace(generation=same[0].generation + 1, attempt=attempt)
        else:
            committed = Version(max((v.sequence for v in before), default=-1) + 1, 0, writer, int(version), attempt)
        draft, fs = self._fs(f"{self.path}/_drafts/{attempt}")
        target, _ = self._fs(f"{self.path}/_versions/{committed.file_name}")
        fs.mkdirs(target.getParent())
        fs.create(draft, True).close()
        if not fs.rename(draft, target):
            raise RuntimeError(f"version {version} of {writer} could not be committed")

    def last_sequence(self) -> int:
        """The place of the newest version, -1 without any."""
        return max((v.sequence for v in self.versions()), default=-1)

    def _bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def log(self, without: tuple[str, int] | None = None, chosen: list[Version] | None = None) -> DataFrame:
        """Every stored row with its version's place; ``without`` leaves one (writer, number) out, ``chosen`` reads those versions only."""
        return self._log(without, chosen).drop(_BUCKET)

    def _log(self, without: tuple[str, int] | None = None, chosen: list[Version] | None = None) -> DataFrame:
        added = [StructField("version", LongType()), StructField("writer", StringType()), StructField(_BUCKET, IntegerType())]
        schema = StructType([*self.schema, *added])
        out = self.spark.createDataFrame([], schema)
        chosen = [v for v in (self.versions() if chosen is None else chosen) if (v.writer, v.number) != without]
        if not chosen:
            return out
        # one scan of all folders; the few version entries join by folder name
        in_folders = StructType([*self.schema, StructField(_ATTEMPT, StringType()), StructField(_BUCKET, IntegerType())])
        folders = (f"{self.path}/rows/{_ATTEMPT}={v.attempt}" for v in chosen)
        rows = self.spark.read.option("basePath", f"{self.path}/rows").schema(in_folders).parquet(*folders)
        places = self.spark.createDataFrame([(v.attempt, v.sequence, v.writer) for v in chosen], f"{_ATTEMPT} string, version bigint, writer string")
        return rows.join(F.broadcast(places), _ATTEMPT).select(*[f.name for f in schema])

    def read(self) -> DataFrame:
        """Current labels: the last row per key."""
        return keep_last(self.log(), ["record_key"], ["version", "seq"]).drop("version", "writer")

    def keys(self, without: tuple[str, int] | None = None) -> DataFrame:
        """Source and key of every stored row: enough for an anti-join, no ranking."""
        return self.log(without).select("source", "record_key")

    def keys_of(self, rows: DataFrame, without: tuple[str, int] | None = None, chosen: list[Version] | None = None) -> DataFrame:
        """Source and key of the stored rows that can have a key of ``rows``: those in the same folders.

        The folders of ``rows`` are ``buckets`` numbers at most, whatever their count; Spark
        finds them first and prunes the scan by them.
        """
        # the comparison tells the planner that the numbers are a selection worth waiting for
        asked = rows.select(self._bucket_of(F.col("record_key")).alias("asked")).where("asked >= 0").distinct()
        log = self._log(without, chosen)
        return log.join(F.broadcast(asked), log[_BUCKET] == asked["asked"], "left_semi").select("source", "record_key")

    def newer_versions(self, sequence: int, writer: str) -> list[Version]:
        """Versions committed after a place by anybody but ``writer``; a folder listing."""
        return [v for v in self.versions() if v.sequence > sequence and v.writer != writer]

    def compact_to(self, path: str) -> LabelStore:
        """Write the current labels as one version elsewhere and return that store."""
        target = LabelStore(self.spark, path, self.schema)
        target.append(self.read(), version=0)
        return target


def backfill_store(df: DataFrame, default_source: str | None = None) -> DataFrame:
    """Rows of an older labelled file: valid labels, ``record_key`` added if absent."""
    return with_record_key(labelled(df), default_source)
