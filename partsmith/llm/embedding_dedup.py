"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosines, components.

Equal vectors are merged first and count as often as they occur. In each of ``tables`` tables a
vector's bucket is the signs of its products with ``bits`` seeded hyperplanes; all pairs of a bucket
are compared exactly, in double precision. Bits follow the number of vectors, tables then follow
from the recall asked for at the threshold: a pair at cosine c shares a bucket of b bits with
probability (1 - arccos(c) / pi) ** b. A pair that meets in several tables counts in the first only.

A bucket of more than ``CHUNK`` vectors is cut into chunks, and each pair of chunks is a group of its
own, so that no group outgrows a task and no pair is lost. A group yields a number of links per
vector and the edges of a spanning forest, never its pairs.

Defined cases: vectors that are null, zero, or hold null or non-finite components link with nothing,
nor do vectors without an id; keys are whole numbers, others raise; vectors of different lengths are never compared; rows of one id are one
vector's (their links add up); other columns of the input, whatever their names, are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, integer_key, materialize
from .graph import connected_components

THRESHOLD, RECALL, CHUNK, SEED, MAX_BITS = 0.95, 0.9995, 1024, 11, 40


def plan(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables) for n vectors: buckets of about eight unrelated vectors, tables for the recall."""
    bits = min(MAX_BITS, max(8, round(math.log2(max(n, 1))) - 3))
    meets = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meets))


@lru_cache(8)
def hyperplanes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim, bits]).standard_normal((dim, bits * tables))


def signatures(vectors: DataFrame, bits: int, tables: int) -> DataFrame:
    """(node, m, v) with v array<float or double>: adds s, the bucket in each table."""
    kind = vectors.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(2)
            sizes = np.diff(v.offsets.to_numpy())
            out = np.zeros((len(v), tables), np.int64)
            flat, start = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate([[0], np.cumsum(sizes)])
            for dim in np.unique(sizes):
                at = np.nonzero(sizes == dim)[0]
                x = flat[(start[at][:, None] + np.arange(dim)).ravel()].reshape(len(at), dim)
                out[at] = buckets(x, bits, tables)
            s = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, tables), pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), v, s], ["node", "m", "v", "s"])

    return vectors.select("node", "m", "v").mapInArrow(run, f"node bigint, m bigint, v {kind}, s array<bigint>")


def buckets(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The bucket of each vector in each table."""
    return ((x @ hyperplanes(x.shape[1], bits, tables)).reshape(-1, tables, bits) >= 0) @ (1 << np.arange(bits, dtype=np.int64))


def group_links(nodes, m, x, chunk, t: int, i: int, j: int, threshold: float, bits: int, tables: int) -> list[tuple[int, int, int]]:
    """(node, links that this group adds, smallest node of its tree) for the linked vectors of one group."""
    norm = np.sqrt((x * x).sum(1))
    near = (x @ x.T) / np.outer(norm, norm) >= threshold
    a, b = np.nonzero(np.triu(near, 1))
    if i != j:
        cross = chunk[a] != chunk[b]
        a, b = a[cross], b[cross]
    if len(a):  # a pair that meets in several tables counts in the first only
        linked = np.unique([a, b])
        s = buckets(x[linked], bits, tables)
        first = ~(s[np.searchsorted(linked, a), :t] == s[np.searchsorted(linked, b), :t]).any(1)
        a, b = a[first], b[first]
    parent: dict[int, int] = {}

    def find(k: int) -> int:
        while parent.setdefault(k, k) != k:
            parent[k] = k = parent[parent[k]]
        return k

    links = np.zeros(len(nodes), np.int64)
    np.add.at(links, a, m[b])
    np.add.at(links, b, m[a])
    for p, q in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(p), find(q)
        if p != q:
            p, q = (p, q) if nodes[p] < nodes[q] else (q, p)
            parent[q] = p
    return [(int(nodes[k]), int(links[k]), int(nodes[find(k)])) for k in parent]


def compare(members: DataFrame, threshold: float, bits: int, tables: int) -> DataFrame:
    """(node, links, root) from rows (t, bucket, dim, i, j, chunk, node, m, v) sorted by group in each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held).combine_chunks()
            keys = np.stack([table.column(k).to_numpy() for k in range(5)], 1)
            if len(keys) and (keys[-1] != keys[0]).any():
                cut = int(np.nonzero((keys != keys[-1]).any(1))[0][-1]) + 1
                yield found(table.slice(0, cut).combine_chunks(), keys[:cut])
                held = table.slice(cut).combine_chunks().to_batches()
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield found(table, np.stack([table.column(k).to_numpy() for k in range(5)], 1))

    def found(table: pa.Table, keys: np.ndarray) -> pa.RecordBatch:
        out: list[tuple[int, int, int]] = []
        if len(keys):
            chunk, nodes, m = (table.column(k).to_numpy() for k in (5, 6, 7))
            v = table.column(8).combine_chunks()
            v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
            ends = np.concatenate([[0], np.nonzero((keys[1:] != keys[:-1]).any(1))[0] + 1, [len(keys)]])
            flat, at = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate([[0], np.cumsum(np.diff(v.offsets.to_numpy()))])
            for lo, hi in zip(ends[:-1], ends[1:], strict=True):
                if hi - lo > 1:
                    x = flat[at[lo] : at[hi]].reshape(hi - lo, -1)
                    t, i, j = int(keys[lo, 0]), keys[lo, 3], keys[lo, 4]
                    out += group_links(nodes[lo:hi], m[lo:hi], x, chunk[lo:hi], t, i, j, threshold, bits, tables)
        a, b, c = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()) for k in (a, b, c)], ["node", "links", "root"])

    return members.mapInArrow(run, "node bigint, links bigint, root bigint")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Per row: key, n_links (other vectors linked directly), component_id (smallest key reachable), kept."""
    v = column(vector)
    good = v.isNotNull() & column(key).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(integer_key(vectors, key).alias("id"), F.when(good, v).alias("v"))
    valid = rows.where("v is not null")
    groups = valid.groupBy("v").agg(F.min("id").alias("node"), F.count("*").alias("m"))
    groups = materialize(groups, "embedding-groups")
    bits, tables = plan(groups.count(), threshold, recall)
    signed = signatures(groups, bits, tables)
    dealt = materialize(signed.select("node", F.size("v").cast("bigint").alias("dim"), F.posexplode("s").alias("t", "bucket")), "embedding-signatures")
    sizes = dealt.groupBy("t", "bucket", "dim").agg(F.count("*").alias("n")).where("n > 1")
    met = dealt.join(materialize(sizes, "embedding-buckets"), ["t", "bucket", "dim"])
    met = met.withColumn("g", F.ceil(F.col("n") / CHUNK)).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("g")))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("g") - 1))
    met = met.withColumn("other", other).select(
        F.col("t").cast("bigint").alias("t"), "bucket", "dim", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "node",
    )
    met = met.join(groups, "node").select("t", "bucket", "dim", "i", "j", "chunk", "node", "m", "v")  # only vectors that share a bucket travel
    group = ["t", "bucket", "dim", "i", "j"]
    found = materialize(compare(met.repartition(*group).sortWithinPartitions(*group), threshold, bits, tables), "embedding-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = materialize(
        groups.where("m > 1").select("node", "m").join(links, "node", "full").join(parts, "node", "full").select(
            "node", F.coalesce("m", F.lit(1)).alias("m"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component")
        ),
        "embedding-components",
    )
    copied = materialize(groups.where("m > 1").select("v", F.col("node").alias("of")), "embedding-copies")
    named = rows.join(copied, "v", "left").select("id", F.when(F.col("v").isNotNull(), F.coalesce("of", "id")).alias("node"))
    out = named.join(known, "node", "left").select(
        F.col("id").alias(key),
        (F.coalesce("links", F.lit(0)) + F.coalesce("m", F.lit(1)) - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
    )
    return out.withColumn("kept", column(key).eqNullSafe(F.col("component_id")))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
