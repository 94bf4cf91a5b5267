"""The build, its inputs and its catalogue; the truth side of the checks."""

import random

from partsmith.functions import text as T
from partsmith.operators import build, extract, hierarchy, reconcile
from partsmith.sources import catalog as sources
from partsmith.sources.fixtures import Catalogue
from partsmith.sources.store import Store

SF = "/root/testdata/sf0.001"
WORDS = "doc_id int, page_num int, x0 double, y0 double, x1 double, y1 double, word string"
LEFT = {"fig_item": 70.0, "part_number": 120.0, "nomenclature": 240.0, "effect": 470.0, "units": 530.0}


def boxes(*rows, doc=1):
    return [(doc, p, LEFT[c], float(y), LEFT[c] + 10, y + 8.0, w) for p, c, y, w in rows]


def test_a_catalogue_is_built_and_merged(spark, tmp_path):
    c = Catalogue(spark, SF)
    words, pages = c.words.where("doc_id < 12"), c.build_pages.where("doc_id < 12")
    store = Store(spark, str(tmp_path / "db"), buckets=8)
    files = words.select("doc_id").distinct().selectExpr("doc_id", "concat('in/d', doc_id, '.pdf') as relative_path")
    first = build.ingest(store, words, pages, files, 0)
    assert first["ingested"] == files.count() and first["replaced"] == 0 and first["parts"] == store.read("parts").count() > 0 and first["pn_corrected"] > 0
    again = build.ingest(store, words.where("doc_id in (3, 5)"), pages.where("doc_id in (3, 5)"), files.where("doc_id in (3, 5)"), 1)
    assert (again["ingested"], again["replaced"], again["docs"]) == (2, 2, 2)
    parts, docs = store.read("parts"), store.read("documents")
    assert parts.count() == first["parts"] and docs.count() == first["ingested"] and docs.select("id").distinct().count() == docs.count()
    assert {tuple(r) for r in docs.select("pdf_name", "pdf_path").collect()} == {(f"d{r[0]}.pdf", f"in/d{r[0]}.pdf") for r in files.select("doc_id").collect()}
    assert parts.select("id").distinct().count() == parts.count()
    ids = parts.select("id")
    assert parts.where("parent_part_id is not null").join(ids.withColumnRenamed("id", "parent_part_id"), "parent_part_id", "left_anti").isEmpty()
    assert parts.join(docs.select("id"), parts.document_id == docs.id, "left_anti").isEmpty()
    assert store.read("xrefs").join(ids.withColumnRenamed("id", "part_id"), "part_id", "left_anti").isEmpty()
    assert not [c for c in sources.SCHEMAS["parts"].split(", ") if c.split()[0] not in parts.columns]


def test_details_join_without_a_shuffle_of_parts(spark):
    c = Catalogue(spark, SF)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sources.save_tables({"documents": c.f_documents, "pages": c.f_pages, "parts": hierarchy.assign_parents(c.f_parts)}, "t_bucketed", 4)
        t = sources.open_tables(spark, "t_bucketed")
        found = hierarchy.detail(t["parts"], t["documents"], t["pages"])
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == c.f_parts.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
        for n in ("documents", "pages", "parts"):
            spark.sql(f"DROP TABLE IF EXISTS t_bucketed_{n}")


def test_inputs_are_checked(spark):
    good, bad = sources.checked(spark.createDataFrame([(1, 1, "1.5", 2.0, 3.0, 4.0, "w", "more"), (1, 1, "x", 2.0, 3.0, 4.0, "w", ""), (1, 0, "1", 2.0, 3.0, 4.0, "w", ""), (1, 1, "5", 2.0, 3.0, 4.0, "w", ""), (None, 1, "1", 2.0, 3.0, 4.0, "w", "")], "doc_id long, page_num int, x0 string, y0 double, x1 double, y1 double, word string, extra string"), "words")
    assert good.collect() == [(1, 1, 1.5, 2.0, 3.0, 4.0, "w")] and good.columns == [c.split()[0] for c in sources.INPUTS["words"].split(", ")]
    assert sorted(r["reason"] for r in bad.collect()) == ["inverted", "null:doc_id", "page", "type:x0"] and "extra" in bad.columns
    good, bad = sources.checked(spark.createDataFrame([(1, 2)], "doc_id int, page_num int"), "words")
    assert good.count() == 0 and bad.first()["reason"] == "missing:x0"
    assert sources.checked(spark.createDataFrame([(1, 2)], "doc_id int, page_num int"), "word_pages")[0].collect() == [(1, 2, None, None)]


def test_truth_rows(spark):
    rows = boxes(
        (1, "part_number", 120, "A-12"), (1, "fig_item", 121, "4"), (1, "fig_item", 140, "5"), (1, "nomenclature", 122, "..BOLT,"), (1, "nomenclature", 136, "LONG"),
        (1, "part_number", 200, "21-10-00-01"), (1, "nomenclature", 190, "of the row above"), (1, "part_number", 230, "77"), (1, "part_number", 250, "777"),
        (2, "nomenclature", 130, "goes on"), (2, "part_number", 300, "B7"), (2, "part_number", 302.5, "B7"),
    )
    df = spark.createDataFrame(rows, WORDS)
    got = {(r["page_num"], r["y"]): (r["pn"], r["fig_item"], r["first_line"], r["level"]) for r in reconcile.truth_rows(df).collect()}
    assert got == {(1, 120.0): ("A-12", "4", "..BOLT,", 2), (1, 200.0): ("21-10-00-01", "", "", 0), (1, 250.0): ("777", "", "", 0), (2, 300.0): ("B7", "", "", 0)}
    pages = spark.createDataFrame([(1, 1, True), (1, 2, True)], "doc_id int, page_num int, is_table boolean")
    found = reconcile.truth_against_records(reconcile.truth_rows(df), extract.records(df, pages)).first()
    assert tuple(found) == (3, 1, 0, 0, 1)  # a figure code is a number to the truth alone; a line goes on over the page in the records alone


def test_truth_parents_of_any_depth(spark):
    r = random.Random(9)
    levels = [r.randrange(9) for _ in range(200)]
    rows = [(1, 1 + i // 20, float(i % 20), f"P{i}", str(i % 3), level) for i, level in enumerate(levels)]
    df = spark.createDataFrame(rows, "doc_id int, page_num int, y double, pn string, fig_item string, level int")
    figures = spark.createDataFrame([(1, p, "21-1") for p in range(1, 11)], "doc_id int, page_num int, figure_code string")
    stack, want = [], {}
    for i, level in enumerate(levels):
        parent = stack[level - 1] if level and len(stack) >= level else ""
        stack = [*(stack + [""] * level)[:level], f"P{i}"]
        want[f"P{i}"] = (parent, stack[0])
    assert {x["pn"]: (x["parent"], x["root"]) for x in reconcile.truth_parents(df, figures).collect()} == want
    truth = spark.createDataFrame([(1, 1, 1.0, "P", "1", "a", "r"), (1, 1, 2.0, "P", "2", "b", "r"), (1, 1, 3.0, "P", "1", "c", "r")], "doc_id int, page_num int, y double, pn string, fig_item string, parent string, root string")
    asks = spark.createDataFrame([(1, 1, "P", "1"), (1, 1, "P", "2"), (1, 1, "P", "9"), (1, 1, "P", ""), (1, 1, "Q", "1")], "doc_id int, page_num int, pn string, fig_item string")
    assert sorted((x["pn"], x["fig_item"], x["parent"]) for x in reconcile.truth_of(asks, truth).collect()) == [("P", "", "c"), ("P", "1", "c"), ("P", "2", "b"), ("P", "9", "c"), ("Q", "1", "")]


def test_query_segments(spark):
    rows = [("BOLT (M6) and nut", "bolt (m6)"), ("aXa", "x a"), ("", "q"), (None, "q"), ("abc", " a  b "), ("a.b.c", "b. a.b"), ("naïve É", "ÉÉ Ïve")]
    df = spark.createDataFrame(rows, "t string, q string").select(T.query_segments("t", "q").alias("s"))
    got = [[(x["text"], x["hit"]) for x in r["s"]] for r in df.collect()]
    assert got == [
        [("BOLT", True), (" ", False), ("(M6)", True), (" and nut", False)], [("aXa", False)], [("", False)], [("", False)], [("abc", False)],
        [("a.b", True), (".c", False)], [("na", False), ("ïve", True), (" É", False)],
    ]


def test_parents_of_rows_without_a_level(spark):
    rows = [(1, 0), (2, 1), (3, None), (4, 1), (5, 9)]
    df = spark.createDataFrame([(i, 1, 1, "f", n, 0) for i, n in rows], "id bigint, document_id bigint, page_num int, figure_code string, nom_level int, not_illustrated int")
    parents = hierarchy.assign_parents(df)
    assert {r["id"]: r["parent_part_id"] for r in parents.collect()} == {1: None, 2: 1, 3: None, 4: 3, 5: None}
    assert hierarchy.drop_duplicates(parents).count() == 5


def test_ancestors_of_cycles_and_long_chains(spark):
    up = {1: None, **{i: i - 1 for i in range(2, 21)}, 30: 31, 31: 32, 32: 30, 33: 30, 40: 99, 50: 50}
    df = spark.createDataFrame([(i, p) for i, p in up.items()], "id bigint, parent_part_id bigint")

    def by_hand(i):
        path, at = [], up[i]
        while at in up and at not in path and at != i and len(path) < 12:
            path.append(at)
            at = up[at]
        return path[::-1]

    assert {r["id"]: r["ancestors"] for r in hierarchy.ancestors(df).collect()} == {i: by_hand(i) for i in up}
