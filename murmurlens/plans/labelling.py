"""Incremental labelling cycle and the final labelled set."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from murmurlens.config import LABELS
from murmurlens.functions.keys import with_record_key
from murmurlens.operators.dedup import anti_join_keys, first_rows, keep_last
from murmurlens.operators.review import upsert
from murmurlens.session import materialise
from murmurlens.sources.comments import labelled
from murmurlens.sources.store import LabelStore

#: Turns pending rows into the same rows with ``label``, ``label_error`` and
#: ``labeled_by``; see :mod:`murmurlens.operators.labelling`.
LabelStep = Callable[[DataFrame], DataFrame]


class Cycle(NamedTuple):
    store: DataFrame
    pending: DataFrame
    fresh: DataFrame


def pending_batch(pending: DataFrame, max_rows: int = 0, order: str = "seq") -> DataFrame:
    """Keyed pending rows, last per key, cut to the cost cap."""
    unique = keep_last(with_record_key(pending), ["record_key"], [order])
    if max_rows <= 0:
        return unique
    return first_rows(materialise(unique, "pending"), max_rows, order)  # counted a few times


def label_cycle(pending: DataFrame, store: DataFrame, label: LabelStep, max_rows: int = 0) -> Cycle:
    """Label pending rows; what succeeds moves to the store, the rest stays.

    The fresh labels are written once, because both results read them and a
    labeller may be slow, costly or give another answer next time.
    """
    keyed = with_record_key(pending)
    fresh = materialise(labelled(label(pending_batch(keyed, max_rows))), "fresh")
    return Cycle(
        upsert(with_record_key(store), fresh),
        anti_join_keys(keyed, fresh, ["source", "record_key"]),
        fresh,
    )


def run_cycle(pending: DataFrame, store: LabelStore, label: LabelStep, version: int, max_rows: int = 0,
              writer: str = "cycle") -> DataFrame:
    """Same, committed: append one store version and return what is still pending.

    What the version itself holds from an earlier run does not count as done, so
    running a version again labels the same rows again and replaces them.
    """
    keyed = with_record_key(pending)
    open_rows = anti_join_keys(keyed, store.keys_of(keyed, without=(writer, version)))
    store.append(labelled(label(pending_batch(open_rows, max_rows))), version, writer)
    return anti_join_keys(keyed, store.keys_of(keyed))


def final_labels(corpus: DataFrame, store: DataFrame, order: str = "seq") -> DataFrame:
    """Corpus and stored labels, one row per text and source; the store wins."""
    both = corpus.withColumn("__age", F.lit(0)).unionByName(
        store.withColumn("__age", F.lit(1)), allowMissingColumns=True
    ).filter(F.col("label").isin(*LABELS))
    return keep_last(both, ["text", "source"], ["__age", order]).drop("__age")
