"""A batch that returns all parts of every query: its rows, and the size of the files they make."""

import os
from collections import Counter

from pyspark.sql import functions as F

from partsmith.operators import search


def tables(spark, parts, queries):
    values = spark.range(parts).select((F.col("id") * 41 - 9000).alias("id"), F.concat(F.lit("N"), F.lpad((F.col("id") % 7).cast("string"), 3, "0"), F.lit("-"), "id").alias("part_number_canonical"), F.lit(None).cast("string").alias("part_number_extracted"), F.lit(None).cast("string").alias("part_number_cell"))
    asked = spark.range(queries).select((F.col("id") * 13).cast("int").alias("qid"), F.concat(F.lit("n"), F.lpad((F.col("id") % 9).cast("string"), 3, "0")).alias("q"))
    return values, spark.createDataFrame([(-9000, "N001")], "part_id bigint, alias_value string"), asked


def test_all_rows_of_a_batch(spark):
    parts, aliases, asked = tables(spark, 700, 1500)
    odd = spark.createDataFrame([(13, "N001"), (13, "N001"), (None, "N002"), (-5, "N003"), (7, " "), (8, None), (9, "N0"), (2147483647, "n000-0")], "qid int, q string")
    got = Counter(map(tuple, search.batch_search(parts, aliases, asked.union(odd), contains=False).collect()))
    want = Counter()
    for qid, q in [(k * 13, f"N{k % 9:03}") for k in range(1500)] + [(13, "N001"), (13, "N001"), (None, "N002"), (-5, "N003"), (2147483647, "N000-0")]:
        ranks = {i * 41 - 9000: 10 for i in range(700) if f"N{i % 7:03}-{i}".startswith(q)}
        if q == "N001":
            ranks[-9000] = 3
        if q == "N000-0":
            ranks[-9000] = 0
        want.update((qid, i, rank) for i, rank in ranks.items())
    assert got == want


def test_a_batch_makes_small_files(spark, tmp_path):
    search.batch_search(*tables(spark, 3500, 4500), contains=False).write.parquet(str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out")).count()
    size = sum(os.path.getsize(tmp_path / "out" / f) for f in os.listdir(tmp_path / "out") if f.endswith(".parquet"))
    assert rows >= 1750000 and size < 0.4 * rows  # 0.24 where each query's parts stand together, 0.62 where each part's queries do
