"""Steps of a page: words as rows and as arrays of pages give the same, and a page's own steps shuffle nothing."""

import pytest

from partsmith.operators import extract, reconcile
from partsmith.plans.registry import QUERIES
from partsmith.sources.fixtures import Catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["column_text", "row_segments", "truth_rows", "rows_near_anchor", "pn_anchors", "line_bands"])
def test_steps_of_a_page_shuffle_nothing(spark, name):
    assert "Exchange" not in QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_rows_and_pages_of_words_agree(spark):
    c = Catalogue(spark, SF)
    words, boxes, pages = c.words.where("doc_id < 6"), c.boxes.where("doc_id < 6"), c.word_pages.where("doc_id < 6")
    assert sorted(words.collect()) == sorted(boxes.selectExpr("doc_id", "page_num", "inline(boxes)").select(*words.columns).collect())
    for step in (lambda w: extract.records(w, pages), reconcile.truth_rows, extract.cell_texts, extract.rows_near):
        assert sorted(step(words).collect()) == sorted(step(boxes).collect())
