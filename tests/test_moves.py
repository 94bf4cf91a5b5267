"""Moves where a path belongs to several documents: names of more than 10,000 documents of a folder repeat."""

import os

import duckdb
import pytest
from oracle import SF, check

from partsmith.plans.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", ["relocate_documents", "relocate_outcome", "relocate_scan_state"])
def test_moves_of_many_documents(spark, tmp_path, name):
    for f in os.listdir(SF):
        os.symlink(f"{SF}/{f}", tmp_path / f)
    os.remove(tmp_path / "supplier.parquet")
    duckdb.sql(f"copy (select s.* replace (cast(i as bigint) as s_suppkey) from range(41000) r(i), (select * from '{SF}/supplier.parquet' limit 1) s) to '{tmp_path}/supplier.parquet' (format parquet)")
    check(spark, QUERIES[name], ORACLE_SQL[name], str(tmp_path))
