"""The totals of a corpus: of all documents, and of the rows that the whole build keeps."""

from partsmith.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_totals_are_of_the_whole_build(spark):
    totals, rows = QUERIES["build_totals"](spark, SF).first().asDict(), QUERIES["raw_rows"](spark, SF)
    parts, documents = QUERIES["build_parts"](spark, SF), spark.read.parquet(f"{SF}/documents.parquet")
    assert totals["docs"] == documents.count() >= parts.select("document_id").distinct().count()
    assert totals["parts"] == parts.count() and totals["parts"] + totals["parts_dedup"] == rows.count() and totals["pn_corrected"] > 0
