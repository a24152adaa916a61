"""Helpers the operators share: slices of Arrow batches, bounded samples, row keys."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Text bytes a Python worker looks at together; bounds its memory, not its input.
SLICE_BYTES = 2_000_000
#: Rows without an id come after all others wherever order counts.
LAST_ID = (1 << 63) - 1

Texts = Callable[[list[str]], dict]


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that their Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix=f"{root.name}-code-")  # the driver's own, which hands the file out
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/{root.name}.zip", "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, str(source.relative_to(root.parent)))
    spark.sparkContext.addPyFile(f"{folder}/{root.name}.zip")
    _SHIPPED.add(app)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges of ``batch`` with about ``limit`` bytes of ``column`` each; a longer text is alone."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    start, total = 0, 0
    for row, size in enumerate(sizes):
        if row > start and total + size > limit:
            yield batch.slice(start, row - start)
            start, total = row, 0
        total += int(size)
    yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, the empty text for null."""
    return pc.fill_null(batch.column(column), "").to_pylist()


def map_texts(docs: DataFrame, make: Callable[[], Texts], schema: str, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns of each row and the columns that ``make()(texts)`` computes; ``make`` runs once in each task.

    ``schema`` names the computed columns in the order of the dictionary they
    come in.  Nothing is shuffled and rows keep their number.
    """
    ship_package(docs.sparkSession)
    kept = docs.select(*carry, F.col(text).alias("__text"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            for part in slices(batch, "__text"):
                found = compute(texts_of(part, "__text"))
                columns = [part.column(c) for c in carry] + [x if isinstance(x, pa.Array) else pa.array(x) for x in found.values()]
                yield pa.RecordBatch.from_arrays(columns, [*carry, *found])

    return kept.mapInArrow(run, f"{types}, {schema}" if types else schema)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether a row is kept from training: the crc32 of its id as text leaves ``fold`` when divided by ``folds``."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == fold, F.lit(False))


def learnable(labels: DataFrame, label: str, folds: int, fold: int) -> DataFrame:
    """(id, label) of the labels 0 and 1 that may be learnt from: those outside the held-out fold."""
    named = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("label"))
    return named.where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id"), folds, fold))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, folds: int, fold: int, text: str = "text") -> DataFrame:
    """``text`` and ``label`` of at most ``bound`` labelled documents outside the held-out fold, half of ``bound`` per class.

    The choice follows a hash of the id, so it depends on the rows alone.  The
    ids chosen are at most ``bound`` whatever the table holds, hence the
    broadcast.  Where an id has several labels the largest counts; where it has
    several texts, the one of least hash.
    """
    ship_package(docs.sparkSession)
    usable, chosen = learnable(labels, label, folds, fold), None
    for value in (0, 1):
        part = usable.where(F.col("label") == value).orderBy(F.xxhash64("id"), "id").limit(bound // 2)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = chosen.groupBy("id").agg(F.max("label").alias("label"))
    texts = docs.select(F.col("doc_id").alias("id"), F.col(text).alias("text"))
    found = texts.join(F.broadcast(chosen), "id")
    # one text for each id: what a task sends on is cut to one before the shuffle
    of_id = Window.partitionBy("id").orderBy(F.xxhash64("text"), "text")
    return found.withColumn("place", F.row_number().over(of_id)).where("place = 1").select("text", "label")


def kept_rows(docs: DataFrame, make: Callable[[], Callable[[list[str | None]], pa.Array]], text: str = "text") -> DataFrame:
    """The rows of ``docs`` for which ``make()(texts)`` is true, all columns as they were.

    Rows go through Arrow in slices, so a task holds no more texts in Python
    than one slice has.
    """
    return _through_slices(docs, make, text, lambda part, found: part.filter(found))


def replaced_texts(docs: DataFrame, make: Callable[[], Callable[[list[str | None]], pa.Array]], text: str = "text") -> DataFrame:
    """``docs`` with ``make()(texts)`` in place of its texts."""
    def put(part: pa.RecordBatch, found: pa.Array) -> pa.RecordBatch:
        at = part.schema.get_field_index(text)
        return pa.RecordBatch.from_arrays([found if k == at else part.column(k) for k in range(part.num_columns)], part.schema.names)

    return _through_slices(docs, make, text, put)


def _through_slices(docs: DataFrame, make: Callable, text: str, put: Callable) -> DataFrame:
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            for part in slices(batch, text):
                yield put(part, compute(part.column(part.schema.get_field_index(text)).to_pylist()))
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, docs.schema)
