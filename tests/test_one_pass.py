"""A page's steps run in one pass of the Python workers; their Arrow rules answer as the expressions do."""

import difflib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from partsmith.functions import text as T
from partsmith.operators import extract, hierarchy, reconcile
from partsmith.operators import layout as L
from partsmith.plans.registry import QUERIES
from partsmith.sources.fixtures import Catalogue

SF = "/root/testdata/sf0.001"


def passes(df):
    return df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")


@pytest.mark.parametrize("name", ["truth_rows", "pn_anchors", "row_segments", "raw_rows", "rows_near_anchor"])
def test_a_page_is_one_pass(spark, name):
    assert passes(QUERIES[name](spark, SF)) == 1


def test_truth_is_read_once(spark):
    c = Catalogue(spark, SF)
    rows = c.boxes.where("doc_id < 9")
    assert passes(reconcile.truth_parents(reconcile.truth_rows(rows), c.word_pages.withColumn("figure_code", F.lit("F")))) == 0  # the rows are a table


def texts(n, seed):
    r = random.Random(seed)
    own = ["", "0", "12", "123", "21-10-00-01", "21-10-00-02A", "a12", "A–7", "1O1", "OO1", "A0B", "A0B0C1", "1 2 3", "A\t1", "ß1", "é", "A.1/B", "-1", "A1\n"]
    return own + ["".join(r.choices("AB0O1 2-./–x", k=r.randrange(1, 9))) for _ in range(n)]


def test_rules_of_columns(spark):
    own = texts(2000, 3)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(own)], "i int, t string").select("i", T.is_part_number_cell("t").alias("a"), T.is_part_number_truth(F.regexp_replace("t", "\\s", "")).alias("b"), T.pn_loose_form("t").alias("c"), F.upper("t").alias("d")).orderBy("i").collect()
    column = pa.array(own, pa.string())
    assert [r["a"] for r in rows] == L.is_part_number_cell(column).tolist()
    assert [r["b"] for r in rows] == L.is_part_number_truth(pa.array(["".join(t.split()) for t in own])).tolist()
    assert [r["c"] for r in rows] == L.loose_form(column).to_pylist()
    assert [r["d"] for r in rows] == L.upper(column).to_pylist()


def test_repeats_are_of_the_last_that_stays():
    r = random.Random(1)
    rows = sorted((r.randrange(3), r.randrange(60) / 2) for _ in range(300))
    pn = [r.choice("AB") for _ in rows]
    want, last = [], None
    for (p, y), n in zip(rows, pn, strict=True):
        again = last is not None and last[0] == p and last[2] == n and abs(y - last[1]) <= 3
        want.append(again)
        last = last if again else (p, y, n)
    assert L.repeats(np.array([p for p, _ in rows]), np.array([y for _, y in rows]), pa.array(pn), 3.0).tolist() == want


def test_nearest_is_the_greatest_similarity():
    r = random.Random(5)
    word = lambda: "".join(r.choices("ABC-1é", k=r.randrange(6, 14)))
    forms = [[{"token": t, "form": None if r.random() < 0.7 else t[::-1]} for t in {word() for _ in range(8)}] if i % 9 else None for i in range(300)]
    near = lambda t: t[:3] + r.choice("ABC") + t[4:] if r.random() < 0.7 else t[1:] + t[:1]
    own = [near((f := r.choice(fs))["form"] or f["token"]) if fs else word() for fs in forms]
    want = []
    for x, fs in zip(own, forms, strict=True):
        best = min(((-difflib.SequenceMatcher(None, f["form"] or f["token"], x).ratio(), f["token"]) for f in fs or ()), default=(0, ""))
        want.append((best[1], -best[0]) if -best[0] >= 0.8 else None)
    assert L.nearest(pa.array(own), pa.array(forms, pa.list_(pa.struct([("token", pa.string()), ("form", pa.string())]))), 0.8) == want
    assert sum(w is not None for w in want) > 50


def test_numbers_of_a_page(spark):
    rows = [(1, ["A10", "a10", "AO1", "A1O1", "ZZ99999", "A1000001", ""], ["A10", "A0B1", "A1000002", "A101", "AOB1"]), (2, ["A10"], []), (3, [], ["A10"])]
    df = spark.createDataFrame(rows, "id int, raws array<string>, tokens array<string>").select("id", "raws", extract.loose_tokens(F.col("tokens")).alias("forms"))
    got = {r["id"]: [tuple(x) for x in r["read"]] for r in df.select("id", extract.numbers("raws", "forms").alias("read")).collect()}
    none = (None,) * 4
    assert got == {1: [("A10", "A10", None, None), ("A10", "A10", None, None), none, (None, "A101", None, None), none, none, none], 2: [none], 3: []}


def test_rows_are_numbered_in_reading_order(spark):
    c = Catalogue(spark, SF)
    rows = extract.opened(extract.page_records(c.boxes, c.word_pages)).select("doc_id", "page_num", "y", "pn", "nth").collect()
    assert len(rows) > 100
    by_doc = {}
    for r in sorted(rows):
        by_doc.setdefault(r["doc_id"], []).append(r["nth"])
    assert all(v == list(range(1, len(v) + 1)) for v in by_doc.values())


def test_parts_without_copies(spark):
    rows = [(1, 0), (2, 1), (3, 1), (4, 3)]
    df = spark.createDataFrame(rows, "id bigint, parent_part_id bigint")
    found = spark.createDataFrame([(3, 2)], "id bigint, survivor bigint")
    for n in (1, hierarchy.NARROW + 1):
        assert {tuple(r) for r in hierarchy.without(df, found, n).collect()} == {(1, 0), (2, 1), (4, 2)}
