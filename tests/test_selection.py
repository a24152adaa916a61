"""The first k rows by counting, against sorting in Python."""

import random

import pytest
from pyspark.sql import functions as F

from murmurlens.operators import selection as S
from murmurlens.operators.dedup import first_rows, stable_sample


def table(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v long").repartition(5)


@pytest.mark.parametrize("few", [1, 7, 10_000])
def test_as_sorting(spark, monkeypatch, few):
    monkeypatch.setattr(S, "FEW", few)
    monkeypatch.setattr(S, "BITS", 3)
    rng = random.Random(few)
    spread = [rng.choice([rng.randrange(-(1 << 63), 1 << 63), rng.randrange(20), None]) for _ in range(120)]
    equal = [5] * 40
    for values in (spread, equal, [None] * 9 + [3, 1, 2], [-(1 << 63), (1 << 63) - 1, 0, -1, 1] * 4):
        order = sorted(range(len(values)), key=lambda i: (values[i] is not None, values[i] or 0, i))
        for k in (0, 1, len(values) // 3, len(values) - 1, len(values), len(values) + 5):
            got = S.smallest(table(spark, values), k, [F.col("v"), F.col("i")])
            assert got.columns == ["i", "v"]
            assert sorted(r.i for r in got.collect()) == sorted(order[:k])


def test_rows_below_are_a_filter(spark):
    df = spark.range(200_000).selectExpr("id as seq", "id * 7919 % 200000 as v")
    got = first_rows(df, 60_000, "v")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and got.where("v >= 60000").isEmpty() and got.count() == 60_000


def test_sample_is_the_same_on_any_layout(spark):
    df = spark.range(30_000).selectExpr("id as seq", "cast(id as string) as text")
    picked = [sorted(r.seq for r in stable_sample(x, 12_345, 3).collect()) for x in (df, df.repartition(13).orderBy("text"))]
    assert picked[0] == picked[1] and len(picked[0]) == 12_345
    assert set(r.seq for r in stable_sample(df, 50, 3).collect()) < set(picked[0])
    assert stable_sample(df.limit(0), 5).count() == 0
