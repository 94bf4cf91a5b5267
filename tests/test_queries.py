import pytest
from oracle import SF, check

from partsmith.plans.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    check(spark, QUERIES[name], ORACLE_SQL[name])


def test_fuzzy_equals_difflib(spark):
    import difflib

    from partsmith.operators import extract

    page = [("123A4567-1",), ("123A4567-2",), ("99B1000",)]
    found = spark.createDataFrame([(1, 1, t) for (t,) in page], "doc_id int, page_num int, token string")
    raws = ["123A4567-1", "l23A4567-1", "123A4S67-1", "99B1O00", "ZZZ9", ""]
    cells = spark.createDataFrame([(1, 1, r) for r in raws], "doc_id int, page_num int, raw string")
    got = {r["raw"]: r for r in extract.canonicalize(cells, found).collect()}
    for raw in raws[1:3]:
        best = max(difflib.SequenceMatcher(None, t, raw.upper()).ratio() for (t,) in page)
        assert got[raw]["method"] == ("fuzzy" if best >= 0.92 else "fuzzy_low" if best >= 0.90 else "unverified")
    assert got["123A4567-1"]["method"] == "exact" and got["99B1O00"]["method"] == "loose"
    assert got["ZZZ9"]["method"] == "unverified" and got[""]["method"] == "empty"


def test_export_has_all_metrics(spark):
    row = QUERIES["metrics_export"](spark, SF).first()
    assert set(row["counters"]) == set(row["gauges"]) == set(row["histograms"]) and row["counters"]
