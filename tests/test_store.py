"""The bucketed store, the stored search index and the catalogue merge."""

import os

import pytest
from pyspark.sql import functions as F

from partsmith.operators import catalog, search, search_index
from partsmith.sources.store import Store

PARTS = "id bigint, document_id bigint, part_number_canonical string, part_number_extracted string, part_number_cell string"


def rows_of(store, table):
    return sorted(tuple(r) for r in store.read(table).drop("bucket").collect())


def test_commits_write_only_their_buckets(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=8)
    df = spark.range(100).withColumn("bucket", store.bucket("id"))
    assert store.commit({"t": (df, None)}, batch=0) == 1 and store.commit({"t": (df.limit(0), None)}, batch=0) == 1
    assert rows_of(store, "t") == [(i,) for i in range(100)]
    more = spark.range(100, 103).withColumn("bucket", store.bucket("id"))
    touched = store.touched(more)
    assert store.commit({"t": (store.read("t", touched).unionByName(more), touched)}, batch=1) == 2
    assert rows_of(store, "t") == [(i,) for i in range(103)]
    versions = store.manifest()["tables"]["t"]
    assert {int(b) for b, v in versions.items() if v == [2]} == set(touched) and len(touched) < 8
    assert not [p for p in store.read("t", touched[:1]).inputFiles() if f"bucket={touched[0]}/" not in p]
    gone = store.read("t", touched[:1]).limit(0)
    store.commit({"t": (gone, touched[:1])})  # a bucket that is left empty
    left = rows_of(store, "t")
    assert 0 < len(left) < 103 and str(touched[0]) not in store.manifest()["tables"]["t"]
    store.commit({"t": (more, [])}, append=("t",))
    assert len(rows_of(store, "t")) == len(left) + 3
    assert store.versions() == [3, 4] and not os.path.exists(tmp_path / "s/data/t/version=1" / f"bucket={touched[0]}")


def test_empty_tables(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.commit({"t": (spark.range(0).withColumn("bucket", store.bucket("id")), None)})
    assert rows_of(store, "t") == [] and store.read("t").columns == ["id", "bucket"]
    with pytest.raises(KeyError):
        store.read("other")


def test_stored_index_follows_merges(spark, tmp_path):
    part = lambda i, d, *v: (i, d, *v)
    parts = spark.createDataFrame([part(1, 1, "A1B2", "A1B2", "A1-B2"), part(2, 1, "XYZ9", None, "XYZ9"), part(3, 2, "A1B2", "A100", "ZZ%1"), part(4, 3, "a1b2", "", None)], PARTS)
    aliases = spark.createDataFrame([(2, "XYZ9-ALT"), (3, "A1B2")], "part_id bigint, alias_value string")
    queries = spark.createDataFrame(list(enumerate(["A1B2", "A1B", "A1", "1B2", "XYZ9", "%YZ", "____", "A_B2", "Z%1", "9-ALT", "NEW7", " ", "%%%"])), "qid int, q string")
    store = Store(spark, str(tmp_path / "index"), buckets=4)
    search_index.build(store, parts, aliases)

    def same(parts, aliases):
        for contains in (True, False):
            got = {tuple(r) for r in search_index.needle_hits(store, queries, contains).collect()}
            want = {tuple(r) for r in search.needle_hits(parts, aliases, queries, contains).collect()}
            assert got == want and want

    same(parts, aliases)
    gone, gone_aliases = parts.where("document_id = 1"), aliases.where("part_id = 2")
    new = spark.createDataFrame([part(11, 1, "NEW7", "A1B2", "NEW-7")], PARTS)
    none = aliases.limit(0)
    after = parts.where("document_id <> 1").unionByName(new)
    for _ in range(2):
        search_index.update(store, (gone, gone_aliases), (new, none), batch=1)
        same(after, aliases.where("part_id <> 2"))
    search_index.compact(store, versions=1)
    same(after, aliases.where("part_id <> 2"))
    assert store.read("postings").where("value = 'XYZ9-ALT'").isEmpty() or len(store.manifest()["tables"]["postings"]) > 0


def test_stored_search_reads_no_parts(spark, tmp_path):
    parts = spark.createDataFrame([(i, 1, f"P{i:04d}", None, None) for i in range(200)], PARTS)
    parts.write.parquet(str(tmp_path / "parts"))
    parts, none = spark.read.parquet(str(tmp_path / "parts")), spark.createDataFrame([], "part_id bigint, alias_value string")
    store = Store(spark, str(tmp_path / "index"), buckets=32)
    search_index.build(store, parts, none)
    found = search_index.needle_hits(store, spark.createDataFrame([(1, "P0012")], "qid int, q string"))
    assert found.count() == 1 and not [p for p in found.inputFiles() if "/parts/" in p]
    assert len({p.split("bucket=")[1].split("/")[0] for p in found.inputFiles() if "/identifiers/" in p}) == 1


def test_catalogue_merge(spark, tmp_path):
    rows = lambda schema, *r: spark.createDataFrame(list(r), schema)
    docs, parts, xrefs = "id bigint, relative_path string", "id bigint, document_id bigint", "part_id bigint, target string"
    store = Store(spark, str(tmp_path / "db"), buckets=16)
    first = {"documents": rows(docs, *((i, f"d{i}.pdf") for i in range(40))), "parts": rows(parts, *((100 + i, i) for i in range(40))), "xrefs": rows(xrefs, *((100 + i, f"x{i}") for i in range(40)))}
    catalog.merge_catalogue(store, first, 0)
    new = {"documents": rows(docs, (90, "d3.pdf"), (91, "new.pdf")), "parts": rows(parts, (900, 90), (901, 91)), "xrefs": rows(xrefs, (901, "y"))}
    for _ in range(2):
        catalog.merge_catalogue(store, new, 1)
        assert rows_of(store, "documents") == sorted([(i, f"d{i}.pdf") for i in range(40) if i != 3] + [(90, "d3.pdf"), (91, "new.pdf")])
        assert rows_of(store, "parts") == sorted([(100 + i, i) for i in range(40) if i != 3] + [(900, 90), (901, 91)])
        assert rows_of(store, "xrefs") == sorted([(100 + i, f"x{i}") for i in range(40) if i != 3] + [(901, "y")])
    touched = store.touched(new["documents"].select(store.bucket("relative_path").alias("bucket")))
    written = {int(b) for vs in store.manifest()["tables"].values() for b, v in vs.items() if v == [2]}
    assert written <= set(touched) and len(touched) <= 2
    assert store.read("parts").where(F.col("bucket").isNull()).isEmpty()
