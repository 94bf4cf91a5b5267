"""The corpus gate on texts that are null, empty or begin like a PDF."""

import duckdb

from partsmith.plans.registry import ORACLE_SQL, QUERIES


def test_gate_of_odd_texts(spark, tmp_path):
    texts = [None, "", "%PDF-1.7", "%PDF-", " ", "plain"]
    rows = [(10 * i + k, t) for i, t in enumerate(texts) for k in range(10)] + [(-4, None), (-9, "%PDF-"), (None, "plain"), (None, None)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(path)
    got = QUERIES["corpus_gate"](spark, str(tmp_path)).collect()
    want = duckdb.sql(ORACLE_SQL["corpus_gate"].replace("FROM documents", f"FROM '{path}/*.parquet'")).fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
