"""Samples as rows are the samples as lists, bytes of foreign characters and texts with few paths included."""

import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from murmurlens.llm import sampled_pieces as S  # noqa: E402

MODEL = P.path("piece_bpe_32k.model")


@pytest.mark.parametrize("k", [1, 2, 5])
def test_rows_are_the_lists_opened(spark, k):
    texts = ["the river runs", "a", "", None, "☃ and 😀 \x07", "z", "日本 word " * 50, "the river runs", "long text " * 100_000 if k == 2 else "q"]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, "no id here", 1, "y")], "doc_id long, text string, sample int, __text string").repartition(3)
    rows = S.sample_rows(docs, MODEL, k=k)
    lists = S.sampled_pieces(docs, MODEL, k=k).select("doc_id", F.posexplode("samples").alias("sample", "s")).select("doc_id", "sample", "s.pieces", "s.log_prob", "s.log_inclusion")
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.sample)
    assert rows.columns == lists.columns
    assert [tuple(r) for r in sorted(rows.collect(), key=key)] == [tuple(r) for r in sorted(lists.collect(), key=key)]
    back = S.decoded_texts(rows, MODEL, out="back").where("doc_id < 8").select("doc_id", "back").collect()
    assert all(r.back == (texts[r.doc_id] or "") for r in back)


def test_what_else_is_in_a_slice_changes_nothing():
    texts = ["the river runs over stones", "another day, another 12 words", "übermäßig"] * 30
    alone = [S.Sampler(MODEL, 0.5, 3, 1).sample([i], [t])[0] for i, t in enumerate(texts[:6])]
    together = S.Sampler(MODEL, 0.5, 3, 1).sample(list(range(len(texts))), texts)
    for a, b in zip(alone, together):
        assert [(p.tolist(), x, y) for p, x, y in a] == [(p.tolist(), x, y) for p, x, y in b]


def test_no_rows(spark):
    assert S.sample_rows(spark.createDataFrame([], "doc_id long, text string"), MODEL).collect() == []
