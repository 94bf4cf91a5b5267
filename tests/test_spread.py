"""Keys that many rows share do not gather in one task."""

from pyspark.sql import functions as F

from partsmith.operators import reconcile


def largest_share(df):
    sizes = [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    return max(sizes) / sum(sizes)


def test_rows_without_parents_spread(spark):
    parts = spark.range(1, 401).select(
        "id", (F.col("id") % 40).alias("document_id"), F.lit(1).alias("page_num"), F.concat(F.lit("P"), "id").alias("part_number_cell"), F.lit("part").alias("row_kind"), F.lit("F").alias("figure_code"), F.lit(0).alias("nom_level"),
        F.when(F.col("id") % 10 == 1, F.col("id") - 1).when(F.col("id") % 2 == 0, 0).alias("parent_part_id"), *(F.lit(None).cast("string").alias(c) for c in ("part_number_canonical", "part_number_extracted", "fig_item_raw", "fig_item_no")), F.lit(0).alias("not_illustrated"),
    )
    docs = spark.range(40).select("id", F.concat("id", F.lit(".pdf")).alias("relative_path"), F.concat("id", F.lit(".pdf")).alias("pdf_name"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(kept, ("-1", "false"), strict=True):
            spark.conf.set(k, v)
        for side in (reconcile.own_side, reconcile.qa_side):
            rows = side(parts, docs)
            assert largest_share(rows) < 0.4
            got = {r["id"]: r["parent_pn"] for r in rows.collect()}
            assert got == {i: f"P{i - 1}" if i % 10 == 1 and i > 1 else "" for i in range(1, 401)}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_pages_of_records_travel_once(spark):
    from partsmith.operators import extract
    from partsmith.sources.fixtures import Catalogue

    c = Catalogue(spark, "/root/testdata/sf0.001")
    many = lambda df: df.repartition(3)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert exchanges(extract.records(many(c.boxes), many(c.word_pages))) == 1
        cells = many(spark.range(9).selectExpr("cast(id as int) doc_id", "cast(id % 3 as int) page_num", "'A1' raw"))
        found = many(spark.range(9).selectExpr("cast(id as int) doc_id", "cast(id % 3 as int) page_num", "'A10' token"))
        assert exchanges(extract.canonicalize(cells, found)) == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_only_rows_that_come_again_gather_chains(spark):
    from partsmith.operators import hierarchy

    rows = [(i, 1, 1, "F", f"P{i % 8}", 0, None) for i in range(1, 11)]
    df = spark.createDataFrame(rows, "id bigint, document_id bigint, page_num int, figure_code string, part_number_cell string, nom_level int, parent_part_id bigint")
    df = df.selectExpr("*", "0 as not_illustrated", *(f"cast(null as string) as {c}" for c in ("fig_item_raw", "fig_item_no", "nomenclature_clean", "effectivity", "units_per_assy")))
    assert {(r["id"], r["survivor"]) for r in hierarchy.copies(df, 2).collect()} == {(9, 1), (10, 2)}
    assert {r["id"] for r in hierarchy.first_ones(df, 2).collect()} == set(range(1, 9))


def test_pages_to_build_are_read_without_a_shuffle(spark):
    from partsmith.sources.fixtures import Catalogue, build_pages

    c = Catalogue(spark, "/root/testdata/sf0.001")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert exchanges(c.build_pages) == 0
        rows = lambda df: sorted(df.collect(), key=lambda r: (r["doc_id"], r["page_num"]))
        assert rows(c.build_pages) == rows(build_pages(c.boxes, c.word_pages).select(*c.build_pages.columns))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_asks_meet_the_truth_in_one_join(spark):
    rows = [(1, p, y, f"P{y % 3}", f"{y % 2}", f"up{y}", "top") for p in (1, 2) for y in range(6)]
    truth = spark.createDataFrame(rows, "doc_id int, page_num int, y int, pn string, fig_item string, parent string, root string").repartition(3)
    asks = spark.createDataFrame([(1, 1, "P1", "1"), (1, 1, "P1", "none"), (1, 2, "P2", "0"), (1, 2, "P9", "0"), (2, 1, "P1", "1")], "doc_id int, page_num int, pn string, fig_item string").repartition(3)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = reconcile.truth_of(asks, truth)
        assert exchanges(found) == 2
        got = {tuple(r[:4]): (r["parent"], r["root"]) for r in found.collect()}
        none = ("", "")
        assert got == {(1, 1, "P1", "1"): ("up1", "top"), (1, 1, "P1", "none"): ("up1", "top"), (1, 2, "P2", "0"): ("up2", "top"), (1, 2, "P9", "0"): none, (2, 1, "P1", "1"): none}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
