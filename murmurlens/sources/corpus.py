"""Labelled corpus: three splits with varying column names and encodings."""

from __future__ import annotations

import posixpath
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from murmurlens.config import CORPUS_LABEL_COLUMNS, CORPUS_SOURCE, CORPUS_TEXT_COLUMNS
from murmurlens.functions.cleaning import strip
from murmurlens.functions.keys import corpus_label
from murmurlens.session import staging_path
from murmurlens.sources.comments import labelled, read_csv, union_sources


def detect_columns(columns: Iterable[str]) -> tuple[str, str]:
    """Text and label column by priority; only the header is looked at."""
    columns = list(columns)
    text = next((c for c in CORPUS_TEXT_COLUMNS if c in columns), None)
    label = next((c for c in CORPUS_LABEL_COLUMNS if c in columns), None)
    if text is None or label is None:
        raise ValueError(f"no text or label column among {columns}")
    return text, label


def tag_split(raw: DataFrame, split: str) -> DataFrame:
    text, label = detect_columns(raw.columns)
    return raw.select(
        strip(F.col(text).cast("string")).alias("text"),
        corpus_label(F.col(label)).alias("label"),
        F.lit(CORPUS_SOURCE).alias("source"),
        F.lit(split).alias("split"),
        *[c for c in ("seq",) if c in raw.columns],
    )


def load_corpus(splits: Mapping[str, DataFrame]) -> DataFrame:
    """Union of tagged splits without empty texts and unusable labels."""
    tagged = union_sources(tag_split(df, name) for name, df in splits.items())
    return labelled(tagged.filter(F.char_length("text") > 0))


def _file_system(spark: SparkSession, path: str):
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def find_split_file(spark: SparkSession, folder: str, name: str) -> str | None:
    """``train.csv`` if present, else ``._train.csv``; case does not matter."""
    fs, path = _file_system(spark, folder)
    names = [status.getPath().getName() for status in fs.listStatus(path)]
    plain = [n for n in names if n.lower() == name.lower()]
    dotted = [n for n in names if n.replace("._", "").lower() == name.lower()]
    found = (plain + dotted)[:1]
    return posixpath.join(folder, found[0]) if found else None


def visible_copy(spark: SparkSession, path: str) -> str:
    """Spark skips names that start with ``.`` or ``_``; copy those to a plain name."""
    name = posixpath.basename(path)
    if name[0] not in "._":
        return path
    fs, source = _file_system(spark, path)
    target = posixpath.join(staging_path(spark, "corpus"), name.lstrip("._"))
    target_fs, target_path = _file_system(spark, target)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(
        fs, source, target_fs, target_path, False, spark._jsc.hadoopConfiguration()
    )
    return target


def detect_encoding(spark: SparkSession, path: str) -> str:
    """UTF-16 by its byte order mark, UTF-8 if it decodes, else Latin-1.

    Every row of the file is checked, as a Spark job over the raw lines.
    """
    lines = spark.read.text(path)  # hands over the bytes of a line undecoded
    head = F.substring(F.col("value").cast("binary"), 1, 2)
    verdict = lines.agg(
        F.coalesce(F.bool_or(head.isin(bytearray(b"\xff\xfe"), bytearray(b"\xfe\xff"))), F.lit(False)).alias("wide"),
        F.coalesce(F.bool_and(F.is_valid_utf8("value")), F.lit(True)).alias("utf8"),
    ).first()
    return "UTF-16" if verdict["wide"] else "UTF-8" if verdict["utf8"] else "ISO-8859-1"


def read_corpus(spark: SparkSession, folder: str, encodings: Mapping[str, str] | None = None) -> DataFrame:
    """Read the splits found in ``folder``; a missing split is left out."""
    splits = {}
    for split in ("train", "dev", "test"):
        path = find_split_file(spark, folder, f"{split}.csv")
        if path is None:
            continue
        path = visible_copy(spark, path)
        encoding = (encodings or {}).get(split) or detect_encoding(spark, path)
        splits[split] = read_csv(spark, path, encoding)
    if not splits:
        raise FileNotFoundError(f"no train.csv, dev.csv or test.csv in {folder}")
    return load_corpus(splits)
