"""The pipeline's near-copy stage against all pairs of a small table."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from partsmith.llm import near_copies, simhash


def jaccard(a, b):
    x, y = (set(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 0


def test_near_copies(spark):
    r = random.Random(11)
    words = ["".join(r.choices("abcdefghij", k=r.randint(3, 8))) for _ in range(900)]
    texts = [" ".join(r.choices(words, k=r.randint(80, 300))) for _ in range(60)]
    near = []
    for i in range(12):  # one word changed in eighty or more: a similarity of 0.87 and more
        ws = texts[i].split(" ")
        ws[len(ws) // 3] = "changed"
        near.append(" ".join(ws))
    far = []
    for i in range(12, 20):  # every seventh word changed
        far.append(" ".join("other" if k % 7 == 0 else w for k, w in enumerate(texts[i].split(" "))))
    rows = list(enumerate([*texts, *near, *far, texts[0].upper(), "", None, "two words", "two words", "z" * 100_000]))
    df = spark.createDataFrame([*rows, (None, texts[0])], "doc_id bigint, text string").withColumn("_gone", F.lit(1))
    got = {x["id"]: x["component_id"] for x in near_copies.near_copies(df).collect()}
    for a, s in rows:
        for b, t in rows[:a]:
            linked = got.get(a, a) == got.get(b, b)
            assert linked == (jaccard(s, t) >= 0.8) or (a in got and b in got), (a, b)
    assert {got[60 + i] for i in range(12)} == set(range(12)) and got[len(texts) + 20] == 0
    kept = near_copies.survivors(df)
    assert kept.columns == df.columns and kept.count() == df.count() - sum(k != v for k, v in got.items())
    assert near_copies.near_copies(df.limit(0)).count() == 0


def test_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "CHUNK", 8)
    monkeypatch.setattr(near_copies, "EVERY", 1)
    r = random.Random(12)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(60):
        ws = list(base)
        ws[r.randrange(200)] = "x"
        texts.append(" ".join(ws))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert near_copies.survivors(df).count() == 1


def components(rows):
    """{id: smallest id reachable} over all pairs of a small table."""
    sets = {i: set(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for i, t in rows}
    at, met = {i: i for i in sets}, set()
    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and x & y and len(x & y) >= 0.8 * len(x | y):
                low, high = sorted((at[a], at[b]))
                at = {k: low if v == high else v for k, v in at.items()}
                met |= {a, b}
    return {i: at[i] for i in met}


def found(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return {x["id"]: x["component_id"] for x in near_copies.near_copies(df).collect()}


def variants(seed, n, size, changes):
    """Texts with a few words of one template replaced."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        ws = [f"w{k}" for k in range(size)]
        for k in r.sample(range(size), changes):
            ws[k] = f"x{i}-{k}"
        out.append(" ".join(ws))
    return out


def test_a_partner_other_than_the_nearest(spark):
    rows = list(enumerate(variants(31, 60, 240, 3)))  # some pairs above 0.8, most below
    want = components(rows)
    assert 20 < len(want) and found(spark, rows) == want


def test_a_large_group_of_far_variants(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "CHUNK", 8)
    monkeypatch.setattr(near_copies, "EVERY", 1)
    rows = list(enumerate(variants(32, 60, 240, 3)))
    want = components(rows)
    assert 20 < len(want) and found(spark, rows) == want


def test_chunks_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "EVERY", 1)
    rows = list(enumerate(variants(33, 40, 240, 2)))
    texts = spark.createDataFrame(rows, "id bigint, t string").selectExpr("id", "cast(t as binary) as t")
    got = []
    for chunk, few in ((1000, 64), (1000, 1), (3, 64)):
        monkeypatch.setattr(near_copies, "CHUNK", chunk)
        monkeypatch.setattr(near_copies, "FEW", few)
        hot = near_copies.hot_shingles(texts, 5)
        met = near_copies.meetings(near_copies.sketches(texts, hot, 5, 0.8).withColumn("comp", F.col("id")), hot, near_copies.ALL)
        got.append({tuple(x) for x in near_copies.pairs_of(met, hot, 0.8, 0).collect()})
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for _, t in rows]
    true = {(a, b) for b in range(40) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert got[0] == got[1] == got[2] >= true and len(true) > 100


def test_pairs_at_the_threshold_of_any_bits(spark):
    r, rows = random.Random(34), []
    for i in range(150):  # a similarity of 0.83, many bits apart in some pairs
        ws = [f"v{i}-{k}" for k in range(88)]
        other = list(ws)
        for k in (r.randrange(10, 40), 87, 0, 1):
            other[k] = f"y{i}-{k}"
        rows += [(2 * i, " ".join(ws)), (2 * i + 1, " ".join(other))]
    want = components(rows)
    bits = [simhash.majority(near_copies.shingle_set(t.encode(), 5).view(np.uint64)) for _, t in rows]
    assert len(want) == 300 and max((a ^ b).bit_count() for a, b in zip(bits[::2], bits[1::2])) > 12
    assert found(spark, rows) == want


def test_repeated_lines_do_not_count(spark):
    line = "this very line stands in the footer of each page "
    body = [" ".join(f"b{k}-{i}" for i in range(120)) for k in range(2)]
    twin = body[1].replace("b1-60 ", "changed ")
    rows = [(i, t + " " + line * n) for i, (t, n) in enumerate([(body[0], 300), (body[1], 300), (twin, 300), (body[0], 3)])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "text")
    pairs = []
    real = near_copies.similar
    near_copies.similar = lambda p, *a: pairs.append({tuple(sorted(x)) for x in p.select("a", "b").collect()}) or real(p, *a)
    try:
        got = {x["id"]: x["component_id"] for x in near_copies.near_copies(df).collect()}
    finally:
        near_copies.similar = real
    assert got == components(rows) == {0: 0, 3: 0, 1: 1, 2: 1}
    assert (0, 3) in pairs[0]  # equal sets have equal fingerprints: met in the first pass


def test_groups_are_never_cut(monkeypatch):
    monkeypatch.setattr(near_copies, "TOGETHER", 20)
    r = random.Random(35)
    keys = sorted((r.randrange(12), r.randrange(2)) for _ in range(300))
    h, part = (np.array(x, np.int64) for x in zip(*keys))
    batches = [pa.RecordBatch.from_arrays([pa.array(h[i : i + 7]), pa.array(part[i : i + 7]), pa.array(np.arange(i, min(i + 7, 300)))], ["h", "part", "at"]) for i in range(0, 300, 7)]
    wholes = list(near_copies.whole_groups(iter(batches)))
    assert np.concatenate([w[2] for w in wholes]).tolist() == list(range(300)) and len(wholes) > 3
    assert all((a[0][-1], a[1][-1]) != (b[0][0], b[1][0]) for a, b in zip(wholes, wholes[1:]))
