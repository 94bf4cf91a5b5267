"""A batch's rows are multiplied from arrays of bare numbers, without losing any."""

from collections import Counter

from partsmith.operators import search


def test_numbers_are_multiplied_bare(spark):
    ranked = spark.createDataFrame([("A", 1, 10), ("A", 2, 10), ("A", 20000, 0), ("A", None, 3), ("B", 1, 11), ("C", -7, 12)], "needle string, id bigint, rank int")
    asked = spark.createDataFrame([(1, "a"), (2, " A "), (2, "A"), (None, "b"), (9000, "c"), (3, "z")], "qid int, q string")
    out = search.all_by_query(ranked, asked)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan and "inline(" not in plan
    own = {"A": [(1, 10), (2, 10), (20000, 0), (None, 3)], "B": [(1, 11)], "C": [(-7, 12)]}
    want = Counter((q, *r) for q, n in [(1, "A"), (2, "A"), (2, "A"), (None, "B"), (9000, "C")] for r in own[n])
    assert Counter(map(tuple, out.collect())) == want
