"""SimHash near-duplicates linked through pivot distance tables.

A text's fingerprint is the bitwise majority of its word shingles' XXH64 hashes. Fingerprints
within ``RADIUS`` bits are linked. Each fingerprint has a row of the pivot table: its Hamming
distances to ``PIVOTS`` reference fingerprints. By the triangle inequality two fingerprints whose
rows differ by more than the radius in any coordinate are too far apart; the others are verified.

To meet without all pairs, fingerprints are first dealt into blocks that agree on some of
``radius + 2`` bands of bits (two of them, whichever they are: of radius + 2 bands at least two hold no
differing bit). A block of more than ``BLOCK`` fingerprints is dealt again by the same rule on its
free bits, until at most 8 free bits, thus 256 fingerprints, are left: nothing is capped, and no
block outgrows a task. A block yields the edges of a spanning forest, never all its pairs. Equal
fingerprints are one node, so copies cost nothing here.

Defined cases: null and empty texts have fingerprint zero, which links like any other; fewer words
than a shingle: the whole sequence is the shingle; shingles count as often as they occur; repeated
rows come out once each; a null key is never a component's name unless all its keys are null.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, materialize
from .graph import connected_components

SEED, WORDS, RADIUS, PIVOTS, BLOCK = 42, 3, 2, 16, 1024


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


REFERENCES = [_signed(random.Random(7).getrandbits(64) ^ i * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for i in range(1, PIVOTS + 1)]


def shingle_hashes(text: bytes, n: int = WORDS) -> np.ndarray:
    """XXH64 of every n-word shingle, in order; A-Z lower-cased, words joined by one space."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False)) if len(words) >= n else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in joined), np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes, as a signed 64-bit integer; zero without hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[i : i + (1 << 16)])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: bytes, n: int = WORDS) -> int:
    """The majority fingerprint of a text's shingles, repeats included."""
    return majority(shingle_hashes(text, n))


def fingerprints(docs: DataFrame, n: int = WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp) of each row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, n) for t in _texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], [key, "fp"])

    return docs.select(key, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t")).mapInArrow(run, f"`{key}` {kind}, fp bigint")


def _texts(column: pa.Array) -> Iterator[bytes]:
    return (x.as_py() for x in column)


def _bands(bits: list[int], radius: int) -> list[int]:
    """Masks that each cover two of radius + 2 nearly equal bands of the given bits."""
    n = radius + 2
    cuts = [bits[i * len(bits) // n : (i + 1) * len(bits) // n] for i in range(n)]
    return [sum(1 << b for part in pair for b in part) for pair in combinations(cuts, 2)]


def _masks(radius: int) -> list[dict[int, list[int]]]:
    """Per level: from a block's mask (signed) to the masks that it is dealt by next."""
    levels, now = [], [0]
    while True:
        free = [b for b in range(64) if not now[0] >> b & 1]
        if now[0] and len(free) <= 8:
            return levels
        step = {m: [m | x for x in _bands([b for b in range(64) if not m >> b & 1], radius)] for m in now}
        levels.append({_signed(m): [_signed(x) for x in xs] for m, xs in step.items()})
        now = sorted({x for xs in step.values() for x in xs}, key=lambda m: m.bit_count())


def pivot_table(fps: DataFrame) -> DataFrame:
    """(fp, d): d holds the Hamming distances to the reference fingerprints."""
    return fps.select("fp", F.array(*(F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("tinyint") for p in REFERENCES)).alias("d"))


def block_links(fps: np.ndarray, d: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of one block: (fingerprint, smallest fingerprint of its tree)."""
    order = np.argsort(d[:, 0], kind="stable")
    fps, d = fps[order], d[order].astype(np.int16)
    last = np.searchsorted(d[:, 0], d[:, 0] + radius, "right")
    parent = list(range(len(fps)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i in range(len(fps) - 1):
        near = np.arange(i + 1, last[i])
        near = near[(np.abs(d[near] - d[i]) <= radius).all(1)]
        near = near[np.bitwise_count((fps[near] ^ fps[i]).view(np.uint64)) <= radius]  # of a negative number it would count the absolute value's bits
        for j in near:
            x, y = find(i), find(int(j))
            if x != y:
                x, y = (x, y) if fps[x] < fps[y] else (y, x)
                parent[y] = x
    return [(int(fps[i]), int(fps[find(i)])) for i in range(len(fps)) if find(i) != i]


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints of column fp that span all links within the radius."""
    spark = fps.sparkSession
    levels = _masks(radius)
    rows = pivot_table(fps).select("fp", "d", F.explode(F.array(*map(F.lit, levels[0][0]))).alias("mask"))
    ready = []
    for i, _ in enumerate(levels):
        keyed = rows.withColumn("part", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = keyed.groupBy("mask", "part").agg(F.count("*").alias("n")).where("n > 1")
        met = materialize(keyed.join(sizes, ["mask", "part"]), "simhash-blocks")
        if i == len(levels) - 1:
            ready.append(met)
            break
        ready.append(met.where(F.col("n") <= block))
        large = met.where(F.col("n") > block)
        if large.isEmpty():
            break
        finer = spark.createDataFrame([(m, x) for m, xs in levels[i + 1].items() for x in xs], "mask bigint, finer bigint")
        rows = large.join(F.broadcast(finer), "mask").select("fp", "d", F.col("finer").alias("mask"))  # a fixed table of at most some thousand masks
    out = None
    for part in ready:
        out = part if out is None else out.unionByName(part)
    blocks = out.groupBy("mask", "part").agg(F.collect_list("fp").alias("fps"), F.flatten(F.collect_list("d")).alias("d"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, d in zip(batch.column(0), batch.column(1), strict=True):
                found += block_links(np.asarray(x.values), np.asarray(d.values).reshape(-1, PIVOTS), radius)
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return blocks.select("fps", "d").mapInArrow(run, "a bigint, b bigint")


def simhash_components(docs: DataFrame, n: int = WORDS, radius: int = RADIUS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, fp, component_id (the smallest key of the fingerprints that its own reaches)."""
    rows = materialize(fingerprints(docs, n, key, text), "simhash-fingerprints")
    nodes = rows.groupBy("fp").agg(F.min(key).alias("first"))
    linked = materialize(connected_components(links(nodes.select("fp"), radius)), "simhash-components").withColumnRenamed("node", "fp")
    groups = nodes.join(linked, "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    names = groups.where("component is not null").groupBy("component").agg(F.min("first").alias("name"))
    named = groups.join(names, "component", "left").select("fp", F.coalesce("name", "first").alias("component_id"))
    return rows.join(named.hint("merge"), "fp").select(key, "fp", "component_id")


def survivors(docs: DataFrame, n: int = WORDS, radius: int = RADIUS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The input's rows with one document of each component, that of its name; all columns as they came."""
    name = free(docs, "_name")
    names = simhash_components(docs, n, radius, key, text).select(F.col("component_id").alias(name)).distinct()
    return docs.join(names, F.col(key).eqNullSafe(F.col(name)), "left_semi")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
