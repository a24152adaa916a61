"""Vector code compression: eight codebooks of a few entries each, fitted by active-entry Lloyd rounds.

A vector's components become integers and its parts, one for each codebook, are
assigned to the nearest entry; then each entry becomes the floored mean of its
parts.  A row keeps, for each part, its entry and the exact distance to it.  In
the next round only entries that moved matter: if a part's own entry stayed
where it was, the stored distance still holds, all other unmoved entries lost
to it before and still do, and only the moved ones are compared.  A part whose
entry moved is compared with all.  Equal distances go to the lower index, so the
outcome is that of full rounds.

Each round reads the rows with what they keep and writes them with the new
state; a task adds one row with the sums of its parts, so no second pass is
needed.  Spark adds those up, and what comes to the driver is one number for each
component of a codebook entry, however many rows there are.  The table of the
round before is removed once the next is complete.

Rows whose vector is null or holds null or non-finite components are dropped.
The length that counts is that of the first vector, by id, of a positive multiple
of eight components; rows of another length stay, with null code and error, and
teach nothing.  With fewer rows than entries there are as many entries as rows; an
empty table gives no rows.  Null ids come last, rows of equal id are ordered by
their vectors; repeated rows count as often as they occur.  Components are exact up
to a magnitude of 2**62 (4096 times the value) and cut off there; an error beyond
a long is the largest long.  Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from murmurlens.session import staging_path

from .common import ship_package

PARTS = 8
SCALE = 4096
#: Rows compared together, which bounds a task's memory.
ROWS = 4096
#: Integers below this keep all sums of squares in 64 bits; beyond, Python's integers take over.
SMALL = 1 << 25
CUT, MOST = 1 << 62, (1 << 63) - 1


def quantised(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * value); 64-bit integers if all are small, else Python's."""
    scaled = np.floor(values.astype(np.float64) * SCALE)
    if not scaled.size or np.abs(scaled).max() < SMALL:
        return scaled.astype(np.int64)
    return np.array([int(min(max(v, -CUT), CUT)) for v in scaled.ravel()], dtype=object).reshape(scaled.shape)


@dataclass(frozen=True)
class Codebooks:
    """Entries by part, and which of them are not where they were a round before."""

    entries: list[list[tuple[int, ...]]]
    moved: np.ndarray

    @classmethod
    def start(cls, vectors: np.ndarray) -> Codebooks:
        cut = vectors.reshape(len(vectors), PARTS, -1)
        return cls([[tuple(map(int, e)) for e in cut[:, j]] for j in range(PARTS)], np.ones((PARTS, len(vectors)), dtype=bool))

    def means(self, sums: list[int]) -> Codebooks:
        """The next codebooks, from the sums and numbers of the parts of each entry."""
        size, entries = len(self.entries[0][0]), []
        step = iter(sums)
        for book in self.entries:
            entries.append([])
            for entry in book:
                *total, count = (next(step) for _ in range(size + 1))
                entries[-1].append(tuple(t // count for t in total) if count else entry)
        moved = [[a != b for a, b in zip(new, old)] for new, old in zip(entries, self.entries)]
        return Codebooks(entries, np.array(moved))

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for book in self.entries for entry in book for x in entry).encode()).hexdigest()

    def arrays(self, like: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors and entries, both as 64-bit integers if all are small."""
        small = like.dtype != object and all(abs(x) < SMALL for book in self.entries for entry in book for x in entry)
        kind = np.int64 if small else object
        return like.astype(kind).reshape(len(like), PARTS, -1), np.array(self.entries, dtype=kind)


def _distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    apart = x[:, None, :] - entries[None]
    return (apart * apart).sum(2)


def assign(vectors: np.ndarray, books: Codebooks, codes: np.ndarray | None = None, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Entry and distance of each part, and the number of distances that were computed.

    ``codes`` and ``known`` are those of the round before, a distance below 0 being
    one that was not kept.
    """
    x, entries = books.arrays(vectors)
    out, near, work = np.zeros((len(x), PARTS), dtype=np.uint8), np.zeros((len(x), PARTS), dtype=x.dtype), 0
    for j in range(PARTS):
        own, book, moved = x[:, j], entries[j], np.flatnonzero(books.moved[j])
        fixed = np.zeros(len(x), dtype=bool)
        if codes is not None:
            fixed = ~books.moved[j][codes[:, j]] & (known[:, j] >= 0)
            code, distance = codes[:, j].copy(), known[:, j].astype(x.dtype)
            at = np.flatnonzero(fixed)
            if len(moved) and len(at):
                found = _distances(own[at], book[moved])
                best = found.argmin(1)
                value, entry = found[np.arange(len(at)), best], moved[best]
                closer = (value < distance[at]) | ((value == distance[at]) & (entry < code[at]))
                code[at[closer]], distance[at[closer]] = entry[closer], value[closer]
                work += found.size
            out[:, j], near[:, j] = code, distance
        rest = np.flatnonzero(~fixed)
        if len(rest):
            found = _distances(own[rest], book)
            best = found.argmin(1)
            out[rest, j], near[rest, j] = best, found[np.arange(len(rest)), best]
            work += found.size
    return out, near, work


def part_sums(vectors: np.ndarray, codes: np.ndarray, n_entries: int) -> np.ndarray:
    """Componentwise sums of the parts of each entry and their number, flat by part and entry."""
    x, out = vectors.reshape(len(vectors), PARTS, -1), []
    for j in range(PARTS):
        for k in range(n_entries):
            mine = x[codes[:, j] == k, j]
            out.append(np.append(mine.sum(0) if len(mine) else np.zeros(x.shape[2], dtype=x.dtype), len(mine)))
    return np.concatenate(out).astype(object)


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("vector"))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _kept_state(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    def table(name: str, kind: type) -> np.ndarray:
        joined = b"".join(batch.column(batch.schema.get_field_index(name)).to_pylist())
        return np.frombuffer(joined, dtype=kind).reshape(batch.num_rows, PARTS)

    return table("codes", np.uint8), table("near", np.int64)


def _stored(near: np.ndarray) -> np.ndarray:
    """Distances as 64-bit integers, -1 for what does not fit."""
    return near if near.dtype != object else np.where(near <= MOST, near, -1).astype(np.int64)


def _parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def _round(rows: DataFrame, books: Codebooks, first: bool) -> DataFrame:
    """The rows with their new state, and a row of sums for each task."""
    names = ["id", "vector", "label"]
    types = [f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, work, fields = 0, 0, None
        for part in _parts_of(batches):
            vectors = quantised(_vectors(part))
            codes, near, done = assign(vectors, books, *(() if first else _kept_state(part)))
            sums, work = sums + part_sums(vectors, codes, len(books.entries[0])), work + done
            columns = [part.column(part.schema.get_field_index(n)) for n in names]
            fields = [c.type for c in columns]
            codes, near = np.ascontiguousarray(codes), np.ascontiguousarray(_stored(near))
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([d.tobytes() for d in near], pa.binary()),
                 pa.nulls(part.num_rows, pa.list_(pa.decimal128(38, 0))), pa.nulls(part.num_rows, pa.int64())],
                [*names, "codes", "near", "sums", "work"])
        if fields:
            yield pa.RecordBatch.from_arrays(
                [*(pa.nulls(1, f) for f in fields), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()),
                 pa.array([[int(s) for s in sums]], pa.list_(pa.decimal128(38, 0))), pa.array([work], pa.int64())],
                [*names, "codes", "near", "sums", "work"])

    return rows.mapInArrow(run, ", ".join([*types, "codes binary, near binary, sums array<decimal(38,0)>, work bigint"]))


def _removed(spark, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@dataclass(frozen=True)
class Compressed:
    """id, label, codes, error of each row; the codebooks; distances computed in each round."""

    rows: DataFrame
    codebooks: Codebooks | None
    work: list[int]


def compress(table: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", n_entries: int = 16, rounds: int = 6) -> Compressed:
    """Fits the codebooks on all rows and gives each row its codes.

    ``codes`` is a byte per part, ``error`` the sum of the parts' squared distances.
    """
    if not 1 <= n_entries <= 256:
        raise ValueError("an entry's index is one byte")
    spark = table.sparkSession
    ship_package(spark)
    named = table.select(F.col(id).alias("id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    kept = named.where(F.col("vector").isNotNull() & finite)
    order = [F.col("id").asc_nulls_last(), F.col("vector")]
    fit = (F.size("vector") > 0) & (F.size("vector") % PARTS == 0)
    heads = kept.where(fit).orderBy(*order).limit(1).collect()
    empty = kept.select("id", "label", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("bigint").alias("error"))
    if not heads:
        return Compressed(empty, None, [])
    length = len(heads[0]["vector"])
    usable = kept.where(F.size("vector") == length)
    books = Codebooks.start(quantised(np.array([r["vector"] for r in usable.orderBy(*order).limit(n_entries).collect()], dtype=np.float64)))
    rows, before, work = usable, None, []
    for number in range(rounds):
        path = staging_path(spark, f"codes-{number}")
        _round(rows, books, first=number == 0).write.parquet(path)
        written = spark.read.parquet(path)
        if before:
            _removed(spark, before)
        totals = written.where(F.col("sums").isNotNull()).select("work", F.posexplode("sums").alias("at", "s"))
        found = totals.groupBy("at").agg(F.sum("s").alias("s"), F.sum("work").alias("work")).orderBy("at").collect()
        work.append(found[0]["work"])
        books = books.means([int(r["s"]) for r in found])
        rows, before = written.where(F.col("sums").isNull()), path

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts_of(batches):
            codes, near, _ = assign(quantised(_vectors(part)), books, *_kept_state(part))
            errors = [min(int(e), MOST) for e in near.astype(object).sum(1)]
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.get_field_index("id")), part.column(part.schema.get_field_index("label")),
                 pa.array([c.tobytes() for c in np.ascontiguousarray(codes)], pa.binary()), pa.array(errors, pa.int64())],
                ["id", "label", "codes", "error"])

    types = ", ".join(f"`{n}` {usable.schema[n].dataType.simpleString()}" for n in ("id", "label"))
    path = staging_path(spark, "codes-last")
    rows.mapInArrow(last, f"{types}, codes binary, error bigint").write.parquet(path)
    _removed(spark, before)
    others = kept.where(F.size("vector") != length)
    others = others.select("id", "label", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("bigint").alias("error"))
    return Compressed(spark.read.parquet(path).unionByName(others), books, work)


def decompressed(codes: bytes, books: Codebooks) -> list[int]:
    """The integer vector that a row's codes stand for."""
    return [x for j, k in enumerate(codes) for x in books.entries[j][k]]


def label_errors(rows: DataFrame) -> DataFrame:
    """``rows`` with label_error, the error summed over rows of equal label, nulls together."""
    totals = rows.groupBy(F.col("label").alias("of")).agg(F.coalesce(F.try_sum("error"), F.lit(MOST)).alias("label_error"), F.count("error").alias("n"))
    joined = rows.join(totals, rows["label"].eqNullSafe(totals["of"]))
    return joined.select(*rows.columns, F.when(F.col("n") > 0, F.col("label_error")).alias("label_error"))
