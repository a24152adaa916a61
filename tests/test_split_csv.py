"""A CSV read in ranges is the CSV read whole."""

import csv
import random

from murmurlens.sources.comments import read_csv
from murmurlens.sources.split_csv import read_split_csv


def written(path, rows, bom=False, end="\n"):
    with open(path, "w", encoding="utf-8-sig" if bom else "utf-8", newline="") as out:
        csv.writer(out, lineterminator=end).writerows([["seq", "text", "a b"], *rows])


def values(df):
    return sorted((tuple(r[c] for c in ("seq", "text", "a b")) for r in df.collect()), key=str)


def test_as_read_whole_with_small_ranges(spark, tmp_path):
    rng = random.Random(1)
    pieces = ["word", " ", "\n", "\n\n", '"', '""', ",", "é", '",\n"', "x" * 300, "end"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 40))).strip(), rng.choice(["", "plain", "two\nlines"])) for i in range(400)]
    (tmp_path / "in").mkdir()
    written(tmp_path / "in" / "one.csv", rows[:250], bom=True)
    written(tmp_path / "in" / "two.csv", rows[250:], end="\r\n")
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    want = values(read_csv(spark, str(tmp_path / "in")))
    for n in names:
        spark.conf.set(n, "2000")
    try:
        got = read_split_csv(spark, str(tmp_path / "in"))
        assert spark.read.text(str(tmp_path / "in")).rdd.getNumPartitions() > 20
        assert values(got) == want and len(want) == 400
        order = [r.seq for r in got.where("csv_file like '%one.csv'").orderBy("csv_place").collect()]
        assert order == [str(i) for i in range(250)]
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def test_header_only(spark, tmp_path):
    written(tmp_path / "none.csv", [])
    assert read_split_csv(spark, str(tmp_path / "none.csv")).count() == 0


def test_query_writes_by_as_many_tasks_as_read(spark, tmp_path, monkeypatch):
    from verification import source_queries

    written = str(tmp_path / "csv")
    monkeypatch.setattr(source_queries, "staging_path", lambda *_: written)
    docs = spark.range(0, 40, 1, 4).selectExpr("id AS doc_id", "concat('a, \"b\"\\n', id) AS text", "'src' AS source")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = source_queries.csv_read_in_ranges(spark, str(tmp_path)).collect()
    assert {r["comment_id"]: r["text"] for r in got} == {str(i): f'say "yes, a, "b"\n{i}' for i in range(40)} and len(got) == 40
    assert len(list((tmp_path / "csv").glob("*.csv"))) > 1
