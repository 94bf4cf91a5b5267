"""The registered queries against their SQL, and the pipeline's stages against their own operators' decisions."""

import pytest
from oracle import SF, check

import corpus_pipeline
from partsmith.llm import exact_dedup, simhash
from partsmith.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    check(spark, QUERIES[name], ORACLE_SQL[name])


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(corpus_pipeline.materialize(stage(spark, seen[-1], SF), "test"))
        assert seen[-1].columns == docs.columns, name
    start, clean, distinct, far, _ = seen
    assert 0.8 * start.count() < clean.count() <= start.count()
    texts = {r["text"] for r in clean.collect()}
    assert {r["text"] for r in distinct.collect()} == texts and distinct.count() == len(texts)
    assert set(exact_dedup.exact_dedup(clean).where("kept").select("doc_id").toPandas().doc_id) == set(distinct.toPandas().doc_id)
    assert far.count() <= distinct.count()
    last = corpus_pipeline.STAGES[-1][1](spark, seen[-1], SF)
    assert last.count() == seen[-1].count() and last.where("n_tokens is null").isEmpty()
