"""Comparison of a query with its SQL in DuckDB."""

import collections

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(table, cols):
    return collections.Counter(repr([r[c] for c in cols]) for r in table.to_pylist())


def check(spark, query, sql, sf=SF):
    got = query(spark, sf).toArrow()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(sql).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    cols = sorted(got.column_names)
    a, b = rows_of(got, cols), rows_of(want, cols)
    assert a == b, (list((a - b))[:3], list((b - a))[:3])
