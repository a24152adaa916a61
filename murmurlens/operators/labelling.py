"""Batch labelling: requests, replies, provenance and the labeller hook."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from murmurlens.config import LABEL_ERROR, LABEL_INSTRUCTIONS, LABELS, QUOTA_MARKERS, VIETNAMESE, TextConfig
from murmurlens.functions.common import computed_once, let
from murmurlens.functions.predicates import is_quota_error
from murmurlens.functions.scoring import toxic_score
from murmurlens.functions.tokens import terms
from murmurlens.operators.dedup import number_batches
from murmurlens.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A labeller gets the texts of one batch and returns the reply text.
Labeller = Callable[[list[str]], str]

REPLY_TYPE = "array<struct<id:int, label:string>>"
PARSE_ERROR = "parse_error"
#: Error of batches that were not sent because the service has no quota left (fixed value).
NOT_CALLED = "quota_exhausted_not_called"


def label_requests(df: DataFrame, size: int = 25, text_col: str = "text", order: str = "seq") -> DataFrame:
    """One request per batch: instructions and the numbered comments.

    A batch holds ``size`` texts, so the collected group is bounded.
    """
    numbered = number_batches(df.select(order, text_col), size, (), order)
    lines = F.transform(
        F.array_sort(F.collect_list(F.struct("pos", F.col(text_col).alias("text")))),
        lambda r: F.concat(r["pos"].cast("string"), F.lit('. "'), r["text"], F.lit('"')),
    )
    return numbered.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("size"),
        F.concat(F.lit(LABEL_INSTRUCTIONS + "\n\n"), F.array_join(lines, "\n")).alias("request"),
    )


def reply_labels(reply: Column, size: Column) -> Column:
    """Labels of a batch in order, from free text that holds a JSON array.

    Code fences are ignored, the last entry per id wins, and whatever is
    missing, unknown or unreadable is an error label, never ``CLEAN``.
    """
    bare = F.regexp_replace(reply, "(?i)```(?:json)?", "")
    body = F.regexp_extract(bare, r"(?s)(\[.*\])", 1)

    def usable(items: Column) -> Column:
        whole = F.forall(items, lambda i: i.isNotNull() & i["id"].isNotNull() & i["label"].isNotNull())
        return F.when(whole, items)

    def labels(items: Column) -> Column:
        def at(pos: Column) -> Column:
            label = F.upper(F.try_element_at(F.filter(items, lambda i: i["id"] == pos), F.lit(-1))["label"])
            return F.when(label.isin(*LABELS), label).otherwise(F.lit(LABEL_ERROR))

        return F.transform(F.sequence(F.lit(0), size - 1), lambda p: at(p.cast("int")))

    items = let(F.from_json(body, REPLY_TYPE, {"mode": "PERMISSIVE"}), usable)
    return F.when(size > 0, let(items, labels)).otherwise(F.array().cast("array<string>"))


def parse_replies(replies: DataFrame, reply_col: str = "reply", size_col: str = "size") -> DataFrame:
    """One row per batch position: ``pos`` and ``label`` next to the other columns."""
    keep = [c for c in replies.columns if c not in (reply_col, size_col)]
    labels = reply_labels(F.col(reply_col), F.col(size_col))
    return replies.select(*keep, F.posexplode(labels).alias("pos", "label"))


def with_provenance(df: DataFrame, labelled_by: str, error: Column | None = None) -> DataFrame:
    """``label_error`` and ``labeled_by`` for freshly labelled rows."""
    ok = F.coalesce(F.col("label").isin(*LABELS), F.lit(False))
    message = F.lit(None).cast("string") if error is None else error
    return df.withColumns({
        "label_error": F.when(ok, "").otherwise(F.coalesce(message, F.lit(PARSE_ERROR))),
        "labeled_by": F.when(ok, labelled_by).otherwise(labelled_by + "_ERROR"),
    })


def lexicon_label(text: Column, config: TextConfig = VIETNAMESE) -> Column:
    """Built-in deterministic labels: no hit is clean, from 50 on it is hate."""
    return let(
        toxic_score(terms(text, config), config),
        lambda score: F.when(score == 0, LABELS[0]).when(score < 50, LABELS[1]).otherwise(LABELS[2]),
    )


def apply_labeller(df: DataFrame, labeller: Labeller, labelled_by: str, size: int = 25,
                   text_col: str = "text") -> DataFrame:
    """Send batches to ``labeller`` from the executors and parse what comes back.

    Batches form inside each Arrow batch, so nothing is shuffled.  A batch comes
    back as one row with its rows in an array, and its reply is parsed once.  An
    exception marks its own batch only, with the message in ``label_error``; after a
    quota error the task calls no more and marks the rest ``NOT_CALLED``.
    """
    rest = df.drop("label", "label_error", "labeled_by")
    rows_type = ArrayType(rest.schema, False)
    sent_type = StructType([StructField("__rows", rows_type), *StructType.fromDDL("__reply string, __error string, __size int").fields])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exhausted = False
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            replies, errors, starts = [], [], list(range(0, len(texts), size))
            for start in starts:
                reply, error = None, NOT_CALLED if exhausted else None
                if not exhausted:
                    try:
                        reply = labeller(texts[start : start + size])
                    except Exception as exc:  # noqa: BLE001 - any failure belongs to this batch
                        error = str(exc).replace("\n", " ")
                        exhausted = any(marker in error.lower() for marker in QUOTA_MARKERS)
                replies.append(reply)
                errors.append(error)
            bounds = pa.array([*starts, len(texts)], pa.int32())
            rows = pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays(batch.columns, fields=list(batch.schema)))
            sizes = [min(size, len(texts) - start) for start in starts]
            yield pa.RecordBatch.from_arrays(
                [rows, pa.array(replies, pa.string()), pa.array(errors, pa.string()), pa.array(sizes, pa.int32())], sent_type.names)

    sent = rest.mapInArrow(send, sent_type)
    labels = reply_labels(F.coalesce("__reply", F.lit("")), F.col("__size"))
    parsed = computed_once(sent.withColumn("__labels", labels), "__labels", labels)
    opened = parsed.select(F.posexplode("__rows").alias("__pos", "__row"), "__labels", "__error")
    labelled = opened.select("__row.*", "__error", F.get("__labels", F.col("__pos")).alias("label"))
    return with_provenance(labelled, labelled_by, F.col("__error")).drop("__error")


def apply_labeller_in_order(df: DataFrame, labeller: Labeller, labelled_by: str, size: int = 25, text_col: str = "text",
                            order: str = "seq", first: int = 40) -> DataFrame:
    """As :func:`apply_labeller`, for a service with one quota for the whole table.

    Batches of ``size`` rows go out in ``order``, in waves: ``first`` batches in one
    task, then twice as many in two tasks, and so on.  Once a wave meets the quota
    no later one is sent; its rows are marked ``NOT_CALLED``.
    """
    numbered = number_batches(df, size, (), order)
    last = numbered.agg(F.max("batch_id").alias("b")).first()["b"]
    waves, start, stop = [], 0, first
    while True:
        wave = numbered.filter((F.col("batch_id") >= start) & (F.col("batch_id") < stop))
        wave = wave.repartitionByRange((stop - start) // first, "batch_id").sortWithinPartitions("batch_id", "pos")
        waves.append(materialise(apply_labeller(wave.drop("batch_id", "pos"), labeller, labelled_by, size, text_col), "wave"))
        if last is None or stop > last or not waves[-1].filter(is_quota_error(F.col("label_error"))).isEmpty():
            break
        start, stop = stop, stop + 2 * (stop - start)
    unsent = numbered.filter(F.col("batch_id") >= stop).drop("batch_id", "pos", "label_error", "labeled_by")
    unsent = with_provenance(unsent.withColumn("label", F.lit(LABEL_ERROR)), labelled_by, F.lit(NOT_CALLED))
    out = waves[0]
    for rows in [*waves[1:], unsent]:
        out = out.unionByName(rows)
    return out


def validate_labels(df: DataFrame, show: int = 10) -> None:
    """Raise if a filled label is not in the domain; the first few are shown."""
    bad = df.filter((F.col("label") != "") & ~F.col("label").isin(*LABELS))
    rows = bad.select("record_key", "label", "text").limit(show).collect()
    if rows:
        listed = "; ".join(f"{r['record_key']}: {r['label']}" for r in rows)
        raise ValueError(f"labels must be one of {', '.join(LABELS)}: {listed}")
