"""Streaming ingest with keyed state: each comment is labelled once, however late it comes again.

The keys that were labelled are state of the stream, one entry per ``record_key`` in
a RocksDB store that lies with the checkpoint and is dealt out by key, so a
micro-batch looks up its own keys instead of reading the label store.  What
the store held when the stream first started is the initial state.  Labels
that others commit later (a review, another stream) are newer than that, and
only those versions are read.

A batch that is replayed sees the state from before it, labels the same rows and
replaces its own version in the store; a restart goes on from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from murmurlens.config import VIETNAMESE, TextConfig
from murmurlens.functions.cleaning import clean_text
from murmurlens.functions.common import computed_once
from murmurlens.operators.dedup import anti_join_keys
from murmurlens.plans.labelling import LabelStep
from murmurlens.sources.store import LabelStore
from murmurlens.streaming.ingest import keyed_rows

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SEEN = StructType([StructField("seq", LongType())])


class FirstSeen(StatefulProcessor):
    """Passes on the last row of a key in the first batch that has the key, and nothing of it later."""

    def __init__(self, fields: list[str], order: str, keep_ms: int | None):
        self._fields, self._order, self._keep_ms = fields, order, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._seen = handle.getValueState("seen", _SEEN, self._keep_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802,N803  names of the interface
        place = self._fields.index(self._order)
        # of rows with one order value the greater by its other columns, so that the choice does not depend on arrival
        last = max(rows, key=lambda r: (r[place] is not None, r[place] or 0, tuple(str(x) for x in r)))
        if not self._seen.exists():
            self._seen.update((last[place],))
            yield last

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:  # noqa: N802,N803
        self._seen.update((None,))

    def close(self) -> None:
        pass


@contextmanager
def _state_store(spark: SparkSession):
    """Keyed state needs RocksDB; a query keeps the setting it started with, the session gets its own back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS_DB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def _base_sequence(spark: SparkSession, store: LabelStore, checkpoint: str) -> int:
    """The store's newest version when the stream of this checkpoint first started."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}-base")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        base = store.last_sequence()
        fs.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(folder, str(base + 1)))
    return int(fs.listStatus(folder)[0].getPath().getName()) - 1


def start_keyed_ingest(comments: DataFrame, store: LabelStore, checkpoint: str, label: LabelStep, config: TextConfig = VIETNAMESE,
                       min_length: int = 5, writer: str = "stream", order: str = "seq", keep_ms: int | None = None) -> StreamingQuery:
    """Process what has arrived and stop; each key is labelled in the first batch that has it long enough.

    ``comments`` has the column ``order``.  ``keep_ms`` lets state expire, for sources
    whose comments come again within a known time only.
    """
    spark = comments.sparkSession
    base = _base_sequence(spark, store, checkpoint)
    keyed = computed_once(keyed_rows(comments), "text", clean_text(F.col("text"), config=config))
    keyed = keyed.filter(F.char_length("text") >= min_length)
    known = store.log(chosen=[v for v in store.versions() if v.sequence <= base]).select("record_key").groupBy("record_key")
    with _state_store(spark):
        fresh = keyed.groupBy("record_key").transformWithState(
            FirstSeen(keyed.columns, order, keep_ms), keyed.schema, "Append", "None" if keep_ms is None else "ProcessingTime", known)

        def write(batch: DataFrame, batch_id: int) -> None:
            newer = store.newer_versions(base, writer)
            if newer:
                batch = anti_join_keys(batch, store.keys_of(batch, chosen=newer))
            store.append(label(batch), batch_id, writer)

        return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
