"""Periodic runs of words, found in a grammar of the text.

A run is a stretch of at least ``LEAST`` words and of at least two periods, period its smallest, that
neither neighbour extends. Documents are taken in batches of about ``BATCH`` words, and numpy works on
all of a batch at once:

1. Every word of a run lies in six consecutive words (half of ``LEAST``) that come again in the document,
   one period on or back. Other words can't take part in runs; they, and the documents' ends, become
   separators that equal nothing.
2. Re-Pair in rounds: pairs of neighbouring symbols that occur twice or more in a document become
   nonterminals, the more frequent pair first where pairs overlap, until no pair comes again.
   What is left of each stretch is paired up to one root, so that every stretch is a balanced tree.
3. For each nonterminal, once: the runs inside it that cross its boundary. Periods are those by which a word
   beside the boundary comes again; how far they carry is read off a table of names of all stretches of
   1, 2, 4, ... words (names are exact: no hash decides).
4. The runs go to all places where the nonterminal is derived. A run of the text lies inside the lowest
   nonterminal that holds it and crosses its boundary, so it is found there as a whole; parts of it that
   smaller nonterminals report lie inside it, and maximal intervals of each period remain.

Defined cases: null and empty texts have no words; repeated rows are rows; a null key is the text ``null``
where its digits count; texts of any length are one batch's work at most by themselves; an empty table
gives no row; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column

LEAST, BATCH, ROOM = 12, 400_000, 1 << 21


def _again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A dense number of each key, in order of the keys, and how often that key occurs."""
    order = np.argsort(keys, kind="stable")
    new = np.diff(keys[order], prepend=keys[order[:1]] - 1) != 0
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, np.bincount(number)[number] if len(keys) else number


def recurring(words: np.ndarray, doc: np.ndarray, half: int = LEAST // 2) -> np.ndarray:
    """True for words in a stretch of ``half`` words that comes again in the same document.

    Stretches are compared by a 64-bit hash here: a clash would only keep a word too many.
    """
    n = len(words) - half + 1
    if n <= 0:
        return np.zeros(len(words), bool)
    mixed = words.astype(np.uint64)
    key = doc[:n].astype(np.uint64) + np.uint64(1)
    for i in range(half):
        key = (key ^ mixed[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    inside = np.flatnonzero(doc[:n] == doc[half - 1 :])
    ordered = np.sort(key[inside])
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(words), bool)
    at = np.minimum(np.searchsorted(twice, key[inside]), len(twice) - 1)
    start = inside[twice[at] == key[inside]]
    depth = np.zeros(len(words) + 1, np.int32)
    np.add.at(depth, start, 1)
    np.add.at(depth, start + half, -1)
    return np.cumsum(depth[:-1]) > 0


def grammar(ids: np.ndarray, part: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Re-Pair of all parts at once: per round the rules (left, right, a place of their text), and the roots with their places.

    Symbols below len(ids) stand for single words (equal words of a document share one), others for
    nonterminals: symbol len(ids) + i is rule i, counted over all rounds. Children are of earlier rounds.
    Among equally frequent pairs a mixed number decides, so that a round takes a fixed share of them whatever their order.
    """
    symbols, at, rules, count = ids.copy(), np.arange(len(ids)), [], len(ids)

    def put(where: np.ndarray, which: np.ndarray) -> None:
        """The pairs that begin at those places become nonterminals; which: a dense number of each pair."""
        nonlocal symbols, at, part, count
        _, one = np.unique(which, return_index=True)
        rules.append(np.stack([symbols[where[one]], symbols[where[one] + 1], at[where[one]]], 1))
        symbols[where] = count + which
        count += len(one)
        stay = np.ones(len(symbols), bool)
        stay[where + 1] = False
        symbols, at, part = symbols[stay], at[stay], part[stay]

    while len(symbols) > 1:
        pairs = np.flatnonzero(part[:-1] == part[1:])
        if not len(pairs):
            break
        number, often = _again(symbols[pairs] * np.int64(count) + symbols[pairs + 1])
        repeated = np.flatnonzero(often > 1)
        rank = np.zeros(len(symbols) + 1, np.int64)  # of the pair that begins here; equal pairs in a row: every second one counts
        rank[pairs[repeated]] = often[repeated] << 32 | number[repeated] * 0x9E3779B1 & 0xFFFFFFFF
        same = (rank[1:] == rank[:-1]) & (rank[1:] > 0)
        begin = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(rank)), 0))
        odd = (np.arange(len(rank)) - begin) % 2 == 1
        own = np.where(odd, 0, rank)
        before, after = np.concatenate([[0], own[:-1]]), np.concatenate([own[1:], [0]])
        taken = np.flatnonzero((own > 0) & (own > before) & (own > after))
        if not len(taken):
            break
        which, chosen = _again(rank[taken])
        where = taken[chosen > 1]
        if not len(where):  # what recurs is taken once at most: those pairs' other places went to more frequent ones
            where = taken
        put(where, _again(rank[where])[0])
    while len(pairs := np.flatnonzero(part[:-1] == part[1:])):
        first = np.searchsorted(part, part[pairs])
        where = pairs[(pairs - first) % 2 == 0]
        put(where, np.arange(len(where)))
    return rules, symbols, at


class Names:
    """Exact names of all stretches of 2^k words; how far two places agree."""

    def __init__(self, ids: np.ndarray, longest: int) -> None:
        self.levels = [ids.astype(np.int32)]
        while (step := 1 << len(self.levels) - 1) * 2 <= longest:
            low = self.levels[-1].astype(np.int64)
            self.levels.append(_again(low[:-step] * (low.max() + 1) + low[step:])[0].astype(np.int32))

    def forward(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Number of equal words from i and from j on, ``most`` at most."""
        n = np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.levels))):
            go = np.flatnonzero(n + (1 << k) <= most)
            go = go[self.levels[k][i[go] + n[go]] == self.levels[k][j[go] + n[go]]]
            n[go] += 1 << k
        return n

    def backward(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Number of equal words that end just before i and before j, ``most`` at most."""
        n = np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.levels))):
            go = np.flatnonzero(n + (1 << k) <= most)
            go = go[self.levels[k][i[go] - n[go] - (1 << k)] == self.levels[k][j[go] - n[go] - (1 << k)]]
            n[go] += 1 << k
        return n


def crossing(ids: np.ndarray, names: Names, begin: np.ndarray, middle: np.ndarray, end: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (rule, start, end, period) of the runs in [begin, end) that cross the middle, for all rules given.

    With period q and matched stretch [start, end - q): it holds the word before the middle if the run
    goes a period beyond the middle, else the two words that begin a period and one word before the middle.
    """
    found = [np.empty((0, 4), np.int64)]
    size = end - begin
    total = np.cumsum(size)
    i = 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + ROOM, "right")))
        for n, ahead in ((end[i:j] - middle[i:j], True), (middle[i:j] - begin[i:j] - 1, False)):
            n = np.maximum(n, 0)
            rule = np.repeat(np.arange(i, j), n)
            q = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1
            a = middle[rule] - 1 if ahead else middle[rule] - q
            hit = ids[a] == ids[a + q]
            if not ahead:
                hit &= ids[a - 1] == ids[a - 1 + q]
            rule, q, a = rule[hit], q[hit], a[hit]
            stop = a + names.forward(a, a + q, end[rule] - a - q) + q
            start = a - names.backward(a, a + q, a - begin[rule])
            good = (stop - start >= np.maximum(least, 2 * q)) & (start < middle[rule]) & (stop > middle[rule])
            found.append(np.stack([rule[good], start[good], stop[good], q[good]], 1))
        i = j
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    smallest = np.ones(len(rows), bool)
    smallest[1:] = (rows[1:, :3] != rows[:-1, :3]).any(1)
    return rows[smallest]


def runs(ids: np.ndarray, part: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and period. part: number of the stretch of each word, ascending; ids: equal for equal words of a document."""
    if not len(ids):
        return np.empty((0, 3), np.int64)
    rounds, roots, places = grammar(ids, part)
    left, right, first = np.concatenate([*rounds, np.empty((0, 3), np.int64)]).T
    n, ends = len(ids), np.cumsum([0, *map(len, rounds)])
    layers = [slice(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    size = np.ones(n + len(left), np.int64)
    for x in layers:
        size[n:][x] = size[left[x]] + size[right[x]]
    wide = np.flatnonzero(size[n:] >= least)
    begin, middle = first[wide], first[wide] + size[left[wide]]
    rows = crossing(ids, Names(ids, int(size.max())), begin, middle, begin + size[n + wide], least)
    holds = np.zeros(len(size), bool)
    holds[n + wide[rows[:, 0]]] = True
    for x in layers:
        holds[n:][x] |= holds[left[x]] | holds[right[x]]
    order = wide[rows[:, 0]] + n  # ascending: crossing() sorts by rule
    symbols, at, out = roots, places, [np.empty((0, 3), np.int64)]
    while len(symbols):
        go = holds[symbols]
        symbols, at = symbols[go], at[go]
        lo, hi = np.searchsorted(order, symbols, "left"), np.searchsorted(order, symbols, "right")
        k = np.repeat(np.arange(len(symbols)), hi - lo)
        row = rows[np.repeat(lo, hi - lo) + np.arange(len(k)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)]
        out.append(np.stack([row[:, 1] + at[k] - first[symbols[k] - n], row[:, 2] - row[:, 1], row[:, 3]], 1))
        deeper = symbols[symbols >= n] - n
        at = np.concatenate([at, at + size[left[deeper]]])
        symbols = np.concatenate([left[deeper], right[deeper]])
    return maximal(np.concatenate(out))


def maximal(rows: np.ndarray) -> np.ndarray:
    """Of (start, length, period), those in no longer one of the same period, each once."""
    stop = rows[:, 0] + rows[:, 1]
    order = np.lexsort((-stop, rows[:, 0], rows[:, 2]))
    rows, stop = rows[order], stop[order]
    if not len(rows):
        return rows
    group = np.cumsum(np.diff(rows[:, 2], prepend=rows[0, 2]) != 0) * (int(stop.max()) + 1)
    reach = np.maximum.accumulate(stop + group)
    keep = np.ones(len(rows), bool)
    keep[1:] = (stop + group)[1:] > reach[:-1]
    rows = rows[keep]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def runs_of(texts: list[list[bytes]], least: int = LEAST) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each list of words: its runs (start, length, period), and which words stay when each run keeps its first period only."""
    sizes = np.array([len(t) for t in texts], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    doc = np.repeat(np.arange(len(texts)), sizes)
    hashes = np.fromiter((hash(w) for t in texts for w in t), np.int64, len(doc))
    live = np.flatnonzero(recurring(hashes, doc, least // 2))
    ids, cuts = np.empty(len(live), np.int64), np.searchsorted(live, bounds)
    for d in np.unique(doc[live]):
        own, words, number = live[cuts[d] : cuts[d + 1]] - bounds[d], texts[d], {}
        ids[cuts[d] : cuts[d + 1]] = [number.setdefault(words[i], cuts[d] + len(number)) for i in own.tolist()]
    part = np.cumsum((np.diff(live, prepend=-2) > 1) | (np.diff(doc[live], prepend=-1) != 0))
    found = runs(ids, part, least)
    found[:, 0] = live[found[:, 0]]
    depth = np.zeros(len(doc) + 1, np.int32)
    np.add.at(depth, found[:, 0] + found[:, 2], 1)
    np.add.at(depth, found[:, 0] + found[:, 1], -1)
    stay = np.cumsum(depth[:-1]) == 0
    at = np.searchsorted(found[:, 0], bounds)
    return [found[at[i] : at[i + 1]] - [bounds[i], 0, 0] for i in range(len(texts))], [stay[bounds[i] : bounds[i + 1]] for i in range(len(texts))]


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", words=None, least: int = LEAST) -> DataFrame:
    """Per row: key, runs (array of start, length, period by start and period), collapsed (the text's words with each run cut to its first period).

    words: a function of the key and the list of a row's words (bytes) that gives the words to look at; the words themselves by default.
    """
    kind = docs.schema[key].dataType.simpleString()
    span = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def rows(keys: list, texts: list[list[bytes]], schema: pa.Schema) -> pa.RecordBatch:
        found, stay = runs_of(texts, least)
        flat = np.concatenate([*found, np.empty((0, 3), np.int64)])
        spans = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in flat.T.copy()], fields=list(span)))
        left = pa.array([b" ".join(t if s.all() else compress(t, s.tolist())) for t, s in zip(texts, stay, strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(keys, schema[0].type), spans, left.cast(pa.string())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([pa.field(key, batch.schema[0].type), ("runs", pa.list_(span)), ("collapsed", pa.string())])
            keys, texts, size = [], [], 0
            for k, t in zip(batch.column(0), batch.column(1), strict=True):
                k, found = k.as_py(), t.as_py().split()
                found = words(k, found) if words else found
                keys.append(k)
                texts.append(found)
                size += len(found)
                if size >= BATCH:
                    yield rows(keys, texts, schema)
                    keys, texts, size = [], [], 0
            yield rows(keys, texts, schema)

    rest = docs.select(column(key).alias(key), F.coalesce(column(text), F.lit("")).cast("binary").alias("_text"))
    return rest.mapInArrow(run, f"`{key.replace('`', '``')}` {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def repeated_tail(key: int | None, words: list[bytes]) -> list[bytes]:
    """For a tenth of the keys, the words from one place on become repetitions of the first of them."""
    h, n = zlib.crc32(str(key if key is not None else "null").encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=repeated_tail)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.shorter")).alias("length"), F.col("best.period").alias("period"),
        F.expr("-1000 * best.shorter div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
