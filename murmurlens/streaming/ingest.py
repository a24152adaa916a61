"""Streaming ingest: clean, score, label and append as comments arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from murmurlens.config import VIETNAMESE, TextConfig
from murmurlens.functions.cleaning import clean_text
from murmurlens.functions.common import computed_once
from murmurlens.functions.keys import with_record_key
from murmurlens.operators.dedup import anti_join_keys, keep_last
from murmurlens.operators.labelling import lexicon_label, with_provenance
from murmurlens.plans.labelling import LabelStep
from murmurlens.sources.comments import with_row_order
from murmurlens.sources.store import LabelStore


def lexicon_step(labelled_by: str = "Lexicon", config: TextConfig = VIETNAMESE) -> LabelStep:
    """Label step that needs no service: the built-in lexicon labels."""

    def label(df: DataFrame) -> DataFrame:
        return with_provenance(computed_once(df, "label", lexicon_label(F.col("text"), config)), labelled_by)

    return label


def keyed_rows(comments: DataFrame) -> DataFrame:
    """Rows with text and their key, taken from the raw text."""
    return with_record_key(comments.filter(F.col("text").isNotNull()))


def prepare(batch: DataFrame, min_length: int = 5, config: TextConfig = VIETNAMESE) -> DataFrame:
    """Last row per key, cleaned, long enough.

    Deduplication goes first: its shuffle spreads the batch, however few files
    it came from, and the text work runs on the surviving rows only.
    """
    last = keep_last(with_row_order(batch), ["record_key"])
    cleaned = computed_once(last, "text", clean_text(F.col("text"), config=config))
    return cleaned.filter(F.char_length("text") >= min_length)


def start_ingest(comments: DataFrame, store: LabelStore, checkpoint: str, label: LabelStep,
                 config: TextConfig = VIETNAMESE, min_length: int = 5, writer: str = "stream") -> StreamingQuery:
    """Process what has arrived and stop.

    Each micro-batch becomes the version of its batch id for this ``writer`` (one
    name per stream), so a replayed batch replaces itself.  Comments that the
    store holds already, from a review or another stream, keep their labels.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        # only the store's folders that the batch's keys fall into are read
        prepared = prepare(batch, min_length, config)
        fresh = anti_join_keys(prepared, store.keys_of(prepared, without=(writer, batch_id)))
        store.append(label(fresh), batch_id, writer)

    return (
        keyed_rows(comments)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
