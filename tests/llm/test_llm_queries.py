"""The registered queries: SQL where there is some, native plans where asked for, and the pipeline's stages."""

import pytest

import corpus_pipeline
from murmurlens.llm.queries import ORACLES, QUERIES
from verification.compare import canonical, oracle_rows

SF = "/root/testdata/sf0.001"
NATIVE = ("op2_decontamination", "op4_fingerprints", "op7_chat_threads", "requoted_threads")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan
    if name in NATIVE:
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    rows = df.collect()
    assert rows
    if name in ORACLES:
        assert canonical(df.columns, rows) == oracle_rows(SF, ORACLES[name])


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, docs, SF)
        found.write.parquet(str(tmp_path / str(number)))
        after = spark.read.parquet(str(tmp_path / str(number)))
        if number < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns and after.schema == docs.schema
            assert 0 < after.count() <= before
            before = after.count()
        else:
            assert after.select("doc_id").distinct().count() == before and after.count() >= before
        docs = after
    assert before < 200
