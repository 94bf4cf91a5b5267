"""Operators against short stateful versions on random input, and the streams against their batch results."""

import json
import random

from pyspark.sql import functions as F

from partsmith.functions import text as T
from partsmith.operators import catalog, extract, hierarchy, metrics, reconcile, search
from partsmith.sources import catalog as sources
from partsmith.sources.store import Store
from partsmith.streaming import incremental


def bands_by_hand(words, tol=2.0):
    groups = []
    for y, x, w in sorted(words):
        if not groups or abs(y - groups[-1][0]) > tol:
            groups.append((y, []))
        groups[-1][1].append((x, y, w))
    return [(y, " ".join(w for _, _, w in sorted(g))) for y, g in groups]


def test_line_bands(spark):
    r = random.Random(1)
    words = {p: [(round(r.uniform(0, 30), 1), round(r.uniform(0, 90), 1), f"w{i}") for i in range(r.randint(1, 25))] for p in range(30)}
    rows = [(1, p, x, x + 1, y, y + 1, w) for p, ws in words.items() for y, x, w in ws]
    df = spark.createDataFrame(rows, "doc_id int, page_num int, x0 double, x1 double, y0 double, y1 double, word string")
    got = {}
    for row in extract.line_bands(df).orderBy("page_num", "band").collect():
        got.setdefault(row["page_num"], []).append((row["y"], row["text"]))
    assert got == {p: bands_by_hand(ws) for p, ws in words.items()}


def parents_by_hand(levels):
    stack, out = [], []
    for i, level in enumerate(levels, 1):
        parent = stack[level - 1] if level > 0 and len(stack) >= level else None
        stack += [0] * (level - len(stack))
        stack = [*stack[:level], i]
        out.append(parent)
    return out


def test_parents(spark):
    r = random.Random(2)
    groups = {g: [r.choice([0, 0, 1, 1, 2, 3, 5]) for _ in range(r.randint(1, 30))] for g in range(40)}
    rows = [(1000 * g + i, g, 1, f"F{g}", level) for g, ls in groups.items() for i, level in enumerate(ls, 1)]
    df = spark.createDataFrame(rows, "id bigint, document_id bigint, page_num int, figure_code string, nom_level int")
    got = {x["id"]: x["parent_part_id"] for x in hierarchy.assign_parents(df).collect()}
    for g, levels in groups.items():
        want = [p if not p else 1000 * g + p for p in parents_by_hand(levels)]
        assert [got[1000 * g + i] for i in range(1, len(levels) + 1)] == want


def test_text_cases(spark):
    def one(c):
        return spark.range(1).select(c.alias("v")).first()["v"]

    lit = F.lit
    assert one(T.fig_item_display(lit("-"), lit("4"), lit(0))) == "- 4" and one(T.fig_item_display(lit(None).cast("string"), lit("4"), lit(1))) == "- 4"
    assert one(T.fig_item_display(lit("A"), lit("4"), lit(0))) == "A 4" and one(T.fig_item_display(lit(""), lit(""), lit(0))) == ""
    assert one(T.path_clean(lit("C:\\a\\b.pdf"))) == "b.pdf" and one(T.path_clean(lit("../a//b.pdf"))) == "a/b.pdf" and one(T.path_clean(lit(""))) == ""
    assert one(T.is_pn_query(lit("113a4200-1"))) and not one(T.is_pn_query(lit("bolt"))) and not one(T.is_pn_query(lit("a 1")))
    assert one(T.strip_watermark(lit("DATE\nOF\nBOLT"))) == "BOLT" and one(T.strip_watermark(lit("OUT"))) == "" and one(T.strip_watermark(lit(None).cast("string"))) == ""
    assert one(T.nomenclature_level(lit("..BOLT"))) == 2 and one(T.nomenclature_clean(lit("..BOLT\n.X"))) == "BOLT\n.X"


def test_history_stream_equals_batch(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, i, f"m{r.randint(0, 2)}", float(r.randint(0, 99)), 0, 0) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id bigint, ts bigint, metric string, value double, cache_hit int, user_id int")
    for k in range(3):
        df.where(f"event_id between {k * 100} and {k * 100 + 99}").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    log = incremental.new_files(spark, str(tmp_path / "in"), df.schema)
    q = incremental.history_stats(log, 50).writeStream.outputMode("update").format("memory").queryName("history").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {x["metric"]: x for x in spark.table("history").collect()}
    for x in metrics.histogram(df, 50).collect():
        assert (x["count"], x["sum"], x["min"], x["max"], x["p99"]) == tuple(got[x["metric"]][c] for c in ("count", "sum", "min", "max", "p99"))


def test_merge_stream_is_idempotent(spark, tmp_path):
    sink = incremental.merge_into(str(tmp_path / "out"))
    a = spark.createDataFrame([("a.pdf", 1, 1.0), ("b.pdf", 1, 1.0)], "relative_path string, size bigint, mtime double")
    b = spark.createDataFrame([("b.pdf", 2, 2.0), ("b.pdf", 3, 3.0), ("c.pdf", 1, 1.0)], a.schema)
    sink(a, 0)
    sink(b, 1)
    sink(b, 1)
    got = {x["relative_path"]: x["size"] for x in Store(spark, str(tmp_path / "out")).read("documents").collect()}
    assert got == {"a.pdf": 1, "b.pdf": 3, "c.pdf": 1}


def test_rolling_over_blocks(spark):
    r = random.Random(4)
    rows = [(i, f"2024-01-{1 + r.randrange(28):02d} 0{r.randrange(9)}:00:00", r.choice("aaab"), None if r.random() < 0.1 else float(r.randint(0, 99))) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id bigint, ts string, metric string, value double").withColumn("ts", F.to_timestamp("ts"))
    got = {x["event_id"]: (x["count"], x["sum"], x["min"], x["max"]) for x in metrics.rolling(df, 7).collect()}
    for m in "ab":
        own = [x for x in sorted(rows, key=lambda x: (x[1], x[0])) if x[2] == m]
        for k, x in enumerate(own):
            vs = [v for *_, v in own[max(0, k - 6) : k + 1] if v is not None]
            assert got[x[0]] == (len(vs), sum(vs) if vs else None, min(vs, default=None), max(vs, default=None))
    assert metrics.rolling(df.limit(0), 7).count() == 0


def test_duplicates_follow_their_parents(spark):
    r = random.Random(5)
    rows, level = [], {}
    for i in range(1, 301):
        up = r.choice([None, 0, *range(max(1, i - 12), i)])
        up = up if not up or level[up] < 4 else None
        level[i] = level[up] + 1 if up else 0
        rows.append((i, up, level[i], r.choice("xy")))
    df = spark.createDataFrame(rows, "id bigint, parent_part_id bigint, nom_level int, part_number_cell string").withColumn("document_id", F.lit(1)).withColumn("page_num", F.lit(1)).withColumn("not_illustrated", F.lit(0))
    want, first, of = {}, {}, {}
    for i, up, n, pn in sorted(rows, key=lambda x: (x[2], x[0])):
        parent = of.get(up, up) if up else up
        of[i] = first.setdefault((n, pn, parent or 0), i)
        want[i] = (of[i], parent)
    assert {x["id"]: (x["survivor"], x["parent"]) for x in hierarchy.drop_duplicates(df, 4).collect()} == want


def test_moves(spark):
    docs = spark.createDataFrame([(1, "a.pdf", "a.pdf"), (2, "b.pdf", "b.pdf"), (3, "c.pdf", "x/c.pdf"), (4, "d.pdf", "d.pdf")], "id bigint, pdf_name string, relative_path string")
    moves = spark.createDataFrame([("a.pdf", "x/n.pdf"), ("b.pdf", "x/n.pdf"), ("d.pdf", "x/c.pdf"), ("gone.pdf", "y.pdf"), ("x/c.pdf", "x/c.pdf")], "relative_path string, new_path string")
    assert {x["relative_path"]: x["outcome"] for x in catalog.move_outcome(docs, moves).collect()} == {"a.pdf": "moved", "b.pdf": "conflict", "d.pdf": "conflict", "gone.pdf": "missing", "x/c.pdf": "same"}
    assert sorted(x["relative_path"] for x in catalog.relocate(docs, moves).collect()) == ["b.pdf", "d.pdf", "x/c.pdf", "x/n.pdf"]
    state = spark.createDataFrame([("a.pdf", 1), ("x/n.pdf", 2), ("b.pdf", 3)], "relative_path string, size int")
    assert {tuple(x) for x in catalog.relocated_state(state, docs, moves).collect()} == {("x/n.pdf", 1), ("b.pdf", 3)}
    assert {x["relative_path"] for x in catalog.rename_folder(docs, "x", "y").collect()} == {"a.pdf", "b.pdf", "d.pdf", "y/c.pdf"}
    taken = docs.union(spark.createDataFrame([(5, "e.pdf", "y/e.pdf")], docs.schema))
    assert {x["relative_path"] for x in catalog.rename_folder(taken, "x", "y").collect()} == {"a.pdf", "b.pdf", "d.pdf", "x/c.pdf", "y/e.pdf"}


def test_files_of_a_nested_root(spark, tmp_path):
    for p in ("pdf/pdf/a.pdf", "pdf/b c.pdf", "pdf/c.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"%PDF-1")
    for root in (str(tmp_path / "pdf"), f"file://{tmp_path}/pdf/"):
        got = {x["relative_path"]: x["size"] for x in sources.files(spark, root).collect()}
        assert got == {"pdf/a.pdf": 6, "b c.pdf": 6}
    wanted = spark.createDataFrame([("b c.pdf", 0), ("z.pdf", 1)], "relative_path string, position int")
    listed = spark.createDataFrame([("b c.pdf",), ("q.pdf",)], "relative_path string")
    assert [x["relative_path"] for x in sources.not_found(wanted, listed).collect()] == ["z.pdf"]


def test_full_rebuild_round_trip(spark, tmp_path):
    tables = {}
    for name, schema in sources.SCHEMAS.items():
        df = spark.createDataFrame([], schema)
        row = [n + 1 if t in ("bigint", "int") else float(n) if t == "double" else f"{c}-{n}" if t == "string" else None for n, (c, t) in enumerate(df.dtypes)]
        tables[name] = spark.createDataFrame([row, [None] * len(row)], schema)
    sources.write(tables, str(tmp_path / "db"), buckets=3)
    for name, df in tables.items():
        assert sorted(map(str, sources.read(spark, str(tmp_path / "db"), name).collect())) == sorted(map(str, df.collect()))
    sources.write({"documents": tables["documents"].limit(0)}, str(tmp_path / "db"))
    assert sources.read(spark, str(tmp_path / "db"), "documents").count() == 0


def test_samples_from_json(spark, tmp_path):
    sample = lambda name, **more: {"name": name, "pdf_name": "a.pdf", "page_num": 3, "part_number": "p-1", **more}
    asked = [
        sample("good", fig_item="- 4", fig_item_set=["4", "- 5"], expected={"min_nom_level": 1, "figure_code": "21-1", "parent_part_number": "top", "count_at_least": 2}),
        sample("no item", fig_item="9", expected={"count_at_least": 99}), sample("other page", page_num=4), sample("first row", expected={"figure_code": "21-2", "parent_part_number": "x", "min_nom_level": 2, "count_at_least": 3}),
    ]
    (tmp_path / "qa.json").write_text(json.dumps(asked))
    parts = [(1, 1, 3, "21-1", "-", "4", 0, "P-1", "C-1", 1, 3), (2, 1, 3, "21-2", None, "5", 1, "P-1", "P-1", 1, None), (3, 1, 3, "21-1", None, "1", 0, "TOP", "OTHER", 0, None)]
    df = spark.createDataFrame(parts, "id bigint, document_id bigint, page_num int, figure_code string, fig_item_raw string, fig_item_no string, not_illustrated int, part_number_cell string, part_number_canonical string, nom_level int, parent_part_id bigint").withColumn("part_number_extracted", F.lit(None).cast("string"))
    docs = spark.createDataFrame([(1, "a.pdf", "x/a.pdf")], "id bigint, pdf_name string, relative_path string")
    found = reconcile.qa_check(reconcile.asks_of(sources.qa_samples(spark, str(tmp_path / "qa.json"))), reconcile.qa_side(df, docs))
    assert {x["name"]: x["failures"] for x in found.collect()} == {"good": "", "no item": "fig_item", "other page": "missing", "first row": "level,figure_code,parent,count"}
    sources.write_report(found, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 4


def test_wildcards_of_batch_queries(spark):
    import fnmatch

    values = ["A1B2", "A1-B2", "XA1", "\\A1", "ZZ", "A", "1A2B3C"]
    asked = ["A_B", "%%%", "A%2", "1_B", "\\A1", "A1_", "__2__3", "ZZZ%", "A1B2"]
    parts = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id bigint, part_number_canonical string").withColumn("part_number_extracted", F.lit(None).cast("string")).withColumn("part_number_cell", F.lit(None).cast("string"))
    none = spark.createDataFrame([], "part_id bigint, alias_value string")
    queries = spark.createDataFrame(list(enumerate([*asked, "A_B", " "])), "qid bigint, q string")
    got = {(x["qid"], x["id"]) for x in search.batch_search(parts, none, queries).collect()}
    like = lambda v, q: fnmatch.fnmatchcase(v, "*" + q.replace("%", "*").replace("_", "?") + "*")
    assert got == {(k, i) for k, q in enumerate([*asked, "A_B"]) for i, v in enumerate(values) if (like(v, q) if len(q) >= 3 else v == q)}


def test_a_document_goes_with_all_below_it(spark):
    docs = spark.createDataFrame([(1, "a.pdf"), (2, "b.pdf")], "id bigint, relative_path string")
    rows = lambda schema, *r: spark.createDataFrame(list(r), schema)
    old = {"documents": docs, "parts": rows("id bigint, document_id bigint", (10, 1), (20, 2)), "xrefs": rows("part_id bigint, target string", (10, "x"), (20, "y")), "pages": rows("document_id bigint, page_num int", (1, 1), (2, 1))}
    new = {"documents": rows("id bigint, relative_path string", (3, "a.pdf")), "parts": rows("id bigint, document_id bigint", (30, 3)), "xrefs": rows("part_id bigint, target string", (30, "z"))}
    got = {n: sorted(map(tuple, df.collect())) for n, df in catalog.replace_documents(old, new).items()}
    assert got == {"documents": [(2, "b.pdf"), (3, "a.pdf")], "parts": [(20, 2), (30, 3)], "xrefs": [(20, "y"), (30, "z")], "pages": [(2, 1)]}
