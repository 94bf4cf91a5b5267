"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

Each piece of text that the split pattern finds is encoded by itself. The tree's leaves are the
piece's bytes; leaf i holds the rank of merging the token that starts at byte i with the next one,
and every node the leftmost smallest of its ``FAN`` children. A merge reads the root, drops the leaf
of the token that goes, updates the two leaves whose neighbours changed, and then their ancestors,
in logarithmic time; so a piece of n bytes takes O(n log n) however long it is.

The vocabulary is a file of base64 tokens with their ranks, named by a parameter and read on each
worker. The ids of short pieces are kept in a cache of the worker, bounded in number and size (``CACHE``
entries of ``LONGEST`` characters at most, in two generations); long ones are encoded each time.

Defined cases: null and empty texts have no ids and decode to no bytes; ids out of the vocabulary
raise; rows are neither merged nor reordered; other columns of the input are not looked at.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CACHE, LONGEST, ROWS, FAN = 150_000, 64, 512, 16
NONE, AFTER, BEFORE = 1 << 62, list(range(1, FAN + 2)), list(range(-1, FAN))
SPACES, CUTS = re.compile(r"\s\s").search, re.compile(r"(?<=\S)(?= \S)").split


@lru_cache(1)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(1)
def load_tokens(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in load_ranks(path).items()}


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece; of equal ranks the leftmost pair merges first."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n, get = len(piece), ranks.get
    if n <= FAN:
        return _one_node(piece, n, ranks)
    shift, none = n.bit_length(), NONE
    mask = (1 << shift) - 1
    after, before = list(range(1, n + 2)), list(range(-1, n))
    leaves = [none if (rank := get(piece[i : i + 2])) is None else rank << shift | i for i in range(n - 1)]
    leaves.append(none)
    tree = [leaves]
    while len(tree) == 1 or len(tree[-1]) > 1:
        below = tree[-1]
        tree.append([min(below[k : k + FAN]) for k in range(0, len(below), FAN)])
    root = tree[-1]
    while (best := root[0]) < none:
        i = best & mask
        gone = after[i]
        end = after[i] = after[gone]
        leaves[gone] = leaves[i] = none
        if end < n:
            before[end] = i
            if (rank := get(piece[i : after[end]])) is not None:
                leaves[i] = rank << shift | i
        if (start := before[i]) >= 0:
            leaves[start] = none if (rank := get(piece[start:end])) is None else rank << shift | start
        changed = {max(start, 0) // FAN, i // FAN, gone // FAN}
        for below, above in zip(tree, tree[1:], strict=False):
            up = set()
            for k in changed:
                least = min(below[k * FAN : k * FAN + FAN])
                if least != above[k]:
                    above[k] = least
                    up.add(k // FAN)
            changed = up
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


def _one_node(piece: bytes, n: int, ranks: dict[bytes, int]) -> list[int]:
    """The same for a piece whose tree is one node over its bytes."""
    get, after, before = ranks.get, AFTER[: n + 1], BEFORE[: n + 1]
    leaves = [get(piece[i : i + 2], NONE) for i in range(n - 1)]
    leaves.append(NONE)
    while (best := min(leaves)) < NONE:
        i = leaves.index(best)
        gone = after[i]
        end = after[i] = after[gone]
        leaves[gone] = NONE
        if end < n:
            before[end] = i
            leaves[i] = get(piece[i : after[end]], NONE)
        else:
            leaves[i] = NONE
        if i:
            start = before[i]
            leaves[start] = get(piece[start:end], NONE)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Kept:
    """A bounded cache of two generations: when the young one is full it becomes the old one. Keys longer than ``LONGEST`` are not kept."""

    def __init__(self, make, room: int):
        self.make, self.room, self.young, self.old = make, room, {}, {}

    def __call__(self, key: str) -> bytes:
        found = self.old.get(key) or self.make(key)
        if len(key) > LONGEST:
            return found
        if len(self.young) >= self.room:
            self.old, self.young = self.young, {}
        self.young[key] = found
        return found


class Coder:
    """A worker's encoder and decoder for one vocabulary and pattern.

    Pieces never reach over the place before a space that stands alone between two words, so a text
    is cut there first, and what follows such a space is looked up as a whole.
    """

    def __init__(self, path: str, pattern: str):
        self.ranks, self.tokens, self.split = load_ranks(path), load_tokens(path), regex.compile(pattern).findall
        self.pieces, self.spaced = Kept(self._piece, CACHE // 2), Kept(lambda part: self._pieces(" " + part), CACHE)

    def _piece(self, piece: str) -> bytes:
        """Ids as 32-bit integers."""
        return array("i", encode_piece(piece.encode(), self.ranks)).tobytes()

    def _pieces(self, text: str) -> bytes:
        found = self.split(text)
        if len(found) == 1:
            return self._piece(text)
        young, make = self.pieces.young.get, self.pieces
        return b"".join([young(p) or make(p) for p in found])

    def text(self, text: str) -> tuple[bytes, bytes]:
        """The text's ids as 32-bit integers, and the bytes that these ids decode to."""
        if SPACES(text):
            first, *rest = CUTS(text)
            rest = [part[1:] for part in rest]
        else:
            first, *rest = text.split(" ")
        young, make = self.spaced.young.get, self.spaced
        ids = b"".join([self._pieces(first), *[young(part) or make(part) for part in rest]])
        return ids, b"".join(map(self.tokens.__getitem__, array("i", ids)))


@lru_cache(1)
def coder(path: str, pattern: str) -> Coder:
    return Coder(path, pattern)


def _lists(parts: list[bytes], item: int, values) -> tuple[pa.Buffer, object]:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) // item for p in parts], out=offsets[1:])
    return pa.py_buffer(offsets), values(pa.py_buffer(b"".join(parts)))


def encode_decode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, ids (array<int>), decoded (the bytes that the ids stand for)."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids, back = zip(*(own.text(t.as_py()) for t in part.column(1)), strict=True)
                offsets, values = _lists(ids, 4, lambda b: pa.Array.from_buffers(pa.int32(), len(b) // 4, [None, b]))
                lists = pa.ListArray.from_buffers(pa.list_(pa.int32()), len(ids), [None, offsets], children=[values])
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(back, pa.binary())], [key, "ids", "decoded"])

    return docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(run, f"`{key}` {kind}, ids array<int>, decoded binary")


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes that an array of ids stands for (null ids: none)."""

    @F.pandas_udf("binary")
    def run(column):
        tokens = load_tokens(path)
        return column.map(lambda x: b"" if x is None else b"".join(map(tokens.__getitem__, x)))

    return rows.withColumn(out, run(F.col(ids)))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def digests(docs: DataFrame) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of each document under the multilingual vocabulary."""
    import public_tokenizers

    coded = encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
