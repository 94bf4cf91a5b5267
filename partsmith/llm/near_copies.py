"""Near copies: SimHash fingerprints and exact prefixes find pairs, pivot distances discard, true similarities decide.

A text's set of word shingles gives a 64-bit fingerprint and a prefix. Shingles have one order over the corpus,
the hot ones last; two sets of a similarity of ``SIMILARITY`` share one of the first size - least * size + 1
shingles of each, and from the first one they share, enough are left in both. So texts that meet in a shingle
of both prefixes are all pairs there can be.

Most of every large group is linked first without listing its pairs: texts meet by the ``FIRST`` shingles of their
prefixes, then by the last ones, and each takes the one of nearest fingerprint before it, and in a group of more than
``FEW`` the one nearest to the group's middle; in such groups each text takes the ``MANY`` nearest then, if it is not linked to them. The last pass takes all
shingles of the prefixes and every pair of texts that are not linked yet; it misses none. The texts of a shingle
that more than ``CHUNK`` hold are dealt, first to chunks in ``DEALS`` different ways, in the last pass as pairs of chunks, so that
no group outgrows a task.

All pairs pass the pivot distance table: fingerprints that differ by more than ``FAR`` in the
distance to any reference, or in bits, are discarded. At a similarity of 0.8 they differ in ten of 64 bits;
more than ``FAR`` are met once in a million such pairs. Sets of fewer than ``SMALL`` shingles, whose majorities
are coarse, are not discarded. What is left is verified: the Jaccard similarity of the sets must reach ``SIMILARITY``.

Defined cases: null and empty texts have no shingles and are near nothing; texts of fewer words than a
shingle are one shingle; rows without a key are near nothing; rows of one key are one document,
linked where any of their texts is; keys are whole numbers, others raise; of equally near fingerprints the
smallest id is taken; very long texts are sets of their own in one row; an empty table gives an empty
result; other columns of the input, whatever their names, are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, discard, free, integer_key, materialize
from .graph import connected_components
from .simhash import REFERENCES, majority, shingle_hashes

WORDS, SIMILARITY, FAR, SMALL, FIRST, DEALS, MANY = 5, 0.8, 24, 64, 8, 3, 16
HOT, EVERY, CHUNK = 100_000, 16, 4096  # shingles that come last in the order of prefixes, found in every sixteenth text; texts of one that meet at once
FEW, TOGETHER, BUCKET, NARROW = 64, 65_536, 4096, 300_000  # groups of up to so many texts are paired together, from about so many rows at once; texts of a bucket in verification; rows of a table that is broadcast

ALL = slice(None)
Hot = tuple[np.ndarray, np.ndarray, np.ndarray]


def shingle_set(text: bytes, n: int) -> np.ndarray:
    """The distinct shingles' hashes, ascending as signed integers."""
    return np.unique(shingle_hashes(text, n).view(np.int64))


def hot_shingles(texts: DataFrame, n: int) -> Hot:
    """Shingles that many texts hold, ascending, their ranks from rare to common, and the chunks that their texts
    are cut into. They only set the order and spread of the work: whatever they are, no pair is missed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py(), n))], ["h"])

    some = texts.where(F.pmod(F.xxhash64("id"), F.lit(EVERY)) == 0).select("t").mapInArrow(run, "h bigint")
    top = some.groupBy("h").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.col("n").desc(), "h").limit(HOT).collect()
    h = np.array([x["h"] for x in reversed(top)], np.int64)
    chunks = np.array([-(-x["n"] * EVERY // CHUNK) for x in reversed(top)], np.int64)
    order = np.argsort(h)
    return h[order], order, chunks[order]


def at_hot(hot: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the shingles stand among the hot ones, and whether they do."""
    if not len(hot):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
    return at, hot[at] == h


def sketches(texts: DataFrame, hot: Hot, n: int, least: float) -> DataFrame:
    """(id, fp, size, prefix) of rows (id, t) that have shingles."""
    known, rank, _ = hot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, fps, sizes, prefixes = [], [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                u = shingle_set(t.as_py(), n)
                if not len(u):
                    continue
                at, is_hot = at_hot(known, u)
                ordered = np.concatenate([u[~is_hot], u[is_hot][np.argsort(rank[at[is_hot]])]]) if is_hot.any() else u
                ids.append(i)
                fps.append(majority(u.view(np.uint64)))
                sizes.append(len(u))
                prefixes.append(ordered[: len(u) - math.ceil(least * len(u) - 1e-6) + 1])
            ends = np.cumsum([0, *map(len, prefixes)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prefixes) if prefixes else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()), lists], ["id", "fp", "size", "prefix"])

    return texts.select("id", "t").mapInArrow(run, "id bigint, fp bigint, size int, prefix array<bigint>")


def dealt(ids: np.ndarray, g: int, deal: int = 0) -> np.ndarray:
    """The chunk of g that each id belongs to; every deal is another way."""
    x = ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(deal * 0x632BE59BD9B4E019 & (1 << 64) - 1)
    return (((x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)).astype(np.int64) % g


MET = "h bigint, part bigint, id bigint, comp bigint, fp bigint, size int, left int"


def meetings(rows: DataFrame, hot: Hot, some: slice) -> DataFrame:
    """Rows (id, comp, fp, size, prefix) once per shingle of the prefix, or of some of it; ``part`` tells the groups of a hot shingle apart."""
    known, _, chunks = hot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, comps, fps, sizes = (batch.column(k).to_numpy() for k in range(4))
            prefix = batch.column(4)
            n = np.diff(prefix.offsets.to_numpy())
            h, of = prefix.flatten().to_numpy(), np.repeat(np.arange(len(n)), n)
            at = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            if some != ALL:
                size = np.repeat(n, n)
                taken = (at < some.stop) if some.stop else (at >= size + some.start)
                h, of, at = h[taken], of[taken], at[taken]
            where, is_hot = at_hot(known, h)
            g = np.where(is_hot, chunks[where] if len(known) else 1, 1)
            many = np.nonzero(g > 1)[0]
            take, part = [np.nonzero(g <= 1)[0]], [np.zeros(len(h) - len(many), np.int64)]
            for k in many:
                one = ids[of[k] : of[k] + 1]
                if some != ALL:  # the chunk of each deal
                    p = np.array([1 + d * g[k] + dealt(one, int(g[k]), d)[0] for d in range(DEALS)])
                else:  # every pair of chunks that holds the own one
                    own, other = dealt(one, int(g[k])), np.arange(g[k])
                    p = 1 + np.minimum(own, other) * g[k] + np.maximum(own, other)
                take.append(np.full(len(p), k))
                part.append(p)
            take, part = np.concatenate(take), np.concatenate(part)
            o = of[take]
            cols = [h[take], part, ids[o], comps[o], fps[o], sizes[o], (sizes[o] - at[take]).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], [x.split()[0] for x in MET.split(", ")])

    return rows.select("id", "comp", "fp", "size", "prefix").mapInArrow(run, MET)


def far_apart(x: np.ndarray, y: np.ndarray, small: np.ndarray) -> np.ndarray:
    """Which pairs of fingerprints the pivot distances or their own distance discard; small sets never."""
    bits = lambda v: np.bitwise_count(v.view(np.uint64)).astype(np.int16)  # noqa: E731  of a negative number it would count the absolute value's bits
    out = bits(x ^ y) > FAR
    for p in REFERENCES:
        out |= np.abs(bits(x ^ np.int64(p)) - bits(y ^ np.int64(p))) > FAR
    return out & ~small


def nearest_pairs(group: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text of a group (columns of MET) with the k of other components and nearest fingerprints before it (of all, if it
    is not linked yet), and with the one nearest to the group's middle, if they are not too far."""
    _, _, ids, comps, fps, sizes, _ = group
    order = np.argsort(ids, kind="stable")
    ids, comps, fps, sizes = ids[order], comps[order], fps[order], sizes[order]
    a, b = [], []
    for lo in range(0, len(ids), CHUNK):  # a group is a chunk of a hot shingle's texts; should it be larger, its own chunks
        part = slice(lo, lo + CHUNK)
        i, c, f, s = ids[part], comps[part], fps[part], sizes[part]
        for at in range(0, len(i), 256):
            upto = min(at + 256, len(i))
            apart = np.bitwise_count((f[at:upto, None] ^ f[None, :]).view(np.uint64))
            open_ = (c[at:upto, None] != c[None, :]) & ((np.arange(len(i))[None, :] < np.arange(at, upto)[:, None]) | (c[at:upto] == i[at:upto])[:, None])
            apart[~open_] = 255
            best = np.argsort(apart, 1, kind="stable")[:, :k] if k > 1 else apart.argmin(1)[:, None]
            x, nth = np.nonzero(np.take_along_axis(apart, best, 1) < 255)
            x, y = x + at, best[x, nth]
            keep = ~far_apart(f[x], f[y], np.minimum(s[x], s[y]) < SMALL)
            a.append(i[x[keep]])
            b.append(i[y[keep]])
        if len(i) > FEW:  # copies edited each in another way are nearest to what they were made from
            middle = np.int64(majority(f.view(np.uint64)))
            m = int(np.bitwise_count((f ^ middle).view(np.uint64)).argmin())
            x = np.nonzero(c != c[m])[0]
            keep = x[~far_apart(f[x], f[m : m + 1], np.minimum(s[x], s[m]) < SMALL)]
            a.append(i[keep])
            b.append(np.full(len(keep), i[m]))
    return np.concatenate(a), np.concatenate(b)


def unlinked_pairs(group: list[np.ndarray], hot: Hot, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of a group (columns of MET) of two components that its sizes and fingerprints allow."""
    known, _, chunks = hot
    order = np.argsort(group[3], kind="stable")
    h, part, i, c, fps, size, left = (x[order] for x in group)
    own = None
    if part[0]:
        g = int(chunks[at_hot(known, h[:1])[0][0]])
        if (part[0] - 1) // g != (part[0] - 1) % g:
            own = dealt(i, g)
    end = np.searchsorted(c, c, "right")  # of the own component
    for at in range(0, len(i), 512):
        x, y = slice(at, min(at + 512, len(i))), slice(int(end[at]), len(i))
        if y.start >= y.stop:
            break
        both = size[x, None].astype(np.int64) + size[None, y]
        ok = (c[x, None] < c[None, y]) & (np.minimum(left[x, None], left[None, y]) * (1 + least) >= least * both - 1e-6)
        if own is not None:
            ok &= own[x, None] != own[None, y]
        a, b = np.nonzero(ok)
        a, b = a + at, b + y.start
        keep = ~far_apart(fps[a], fps[b], np.minimum(size[a], size[b]) < SMALL)
        yield i[a[keep]], i[b[keep]]


def small_groups(cols: list[np.ndarray], starts: np.ndarray, ends: np.ndarray, least: float, nearest: bool) -> tuple[np.ndarray, np.ndarray]:
    """What the two functions above find, for whole (not dealt) groups of a few rows each, all groups at once."""
    _, _, ids, c, fps, size, left = cols
    n = ends - starts
    rows = np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum())
    last = np.repeat(ends, n)
    a_found, b_found = [], []
    best, to = (np.full(len(ids), 255, np.uint8), np.zeros(len(ids), np.int64)) if nearest else (None, None)
    for k in range(1, int(n.max(initial=1))):
        rows, last = rows[rows + k < last], last[rows + k < last]
        a = rows[c[rows] != c[rows + k]]
        b = a + k
        if nearest:
            apart = np.bitwise_count((fps[a] ^ fps[b]).view(np.uint64))
            for x, y, mine in ((a, b, ids[a] > ids[b]), (b, a, ids[b] > ids[a])):
                nearer = mine & ((apart < best[x]) | ((apart == best[x]) & (ids[y] < ids[to[x]])))
                best[x[nearer]], to[x[nearer]] = apart[nearer], y[nearer]
        else:
            ok = np.minimum(left[a], left[b]) * (1 + least) >= least * (size[a].astype(np.int64) + size[b]) - 1e-6
            a_found.append(a[ok])
            b_found.append(b[ok])
    if nearest:
        a_found.append(np.nonzero(best < 255)[0])
        b_found.append(to[a_found[0]])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a_found, b_found))
    keep = ~far_apart(fps[a], fps[b], np.minimum(size[a], size[b]) < SMALL)
    return ids[a[keep]], ids[b[keep]]


def pairs_of(met: DataFrame, hot: Hot, least: float, nearest: int) -> DataFrame:
    """Distinct candidate pairs (a, b), a < b, from rows of MET: of so many nearest texts (more than one in groups of more
    than ``FEW`` only), or for 0 of all unlinked ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in whole_groups(batches):
            h, part, comp = cols[0], cols[1], cols[3]
            ends = np.concatenate([np.nonzero((h[1:] != h[:-1]) | (part[1:] != part[:-1]))[0] + 1, [len(h)]])
            starts = np.concatenate([[0], ends[:-1]])
            many = np.minimum.reduceat(comp, starts) < np.maximum.reduceat(comp, starts)  # of two components at least
            starts, ends = starts[many], ends[many]
            few = (ends - starts <= FEW) & (part[starts] == 0)
            if nearest < 2:
                yield columns([small_groups(cols, starts[few], ends[few], least, nearest == 1)])
            for lo, hi in zip(starts[~few].tolist(), ends[~few].tolist(), strict=True):
                group = [x[lo:hi] for x in cols]
                for found in [nearest_pairs(group, nearest)] if nearest else unlinked_pairs(group, hot, least):
                    yield columns([found])

    def columns(out: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = (np.concatenate(x) for x in zip(*out, strict=True))
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    rows = met.repartition("h", "part").sortWithinPartitions("h", "part")
    return rows.mapInArrow(run, "a bigint, b bigint").where("a < b").distinct()


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of the batches, cut where one of the first two changes."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        now = [x.to_numpy() for x in batch.columns]
        if not len(now[0]):
            continue
        changes = np.nonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))[0]
        cut = int(changes[-1]) + 1 if len(changes) else 0
        if sum(len(x[0]) for x in held) + cut < TOGETHER:  # a few batches at once
            held.append(now)
            continue
        if cut or (held and (held[-1][0][-1], held[-1][1][-1]) != (now[0][0], now[1][0])):
            yield [np.concatenate(x) for x in zip(*held, [x[:cut] for x in now], strict=True)]
            held = []
        held.append([x[cut:] for x in now])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def alike(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether two ascending sets reach the similarity."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return both > 0 and both >= least * (len(x) + len(y) - both)


def similar(pairs: DataFrame, texts: DataFrame, n: int, least: float) -> DataFrame:
    """The pairs (a, b) whose texts (id, t) reach the similarity, as a table.

    Texts are dealt to buckets by the smallest partner they have, so that those of one cluster are together, and large
    buckets are cut into parts of about ``BUCKET``. The pairs between two buckets are a group, and the sets of their texts
    travel there once each, however many pairs a text is in. Which texts go where is broadcast if it is ``NARROW`` rows
    at most, so that only sets that are needed are shuffled; beyond that it is joined.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = pa.array([shingle_set(t.as_py(), n).tobytes() for t in part.column(2)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), made], ["keys", "id", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, {}
        for batch in batches:
            key, (kind, a, b) = batch.column(0), (batch.column(k).to_numpy() for k in range(1, 4))
            s, keep = batch.column(4), []
            for k, of in enumerate(key.to_pylist()):
                if of != group:
                    group, held = of, {}
                if kind[k] == 0:
                    held.setdefault(a[k], []).append(np.frombuffer(s[k].as_py(), np.int64))
                elif any(alike(x, y, least) for x in held.get(a[k], ()) for y in held.get(b[k], ())):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    lead = pairs.select(F.col("a").alias("id"), F.col("b").alias("with")).union(pairs.select("b", "a")).groupBy("id").agg(F.least("id", F.min("with")).alias("lead"))
    parts = lead.groupBy("lead").agg(F.ceil(F.count("*") / BUCKET).alias("n"))
    buckets = lead.join(parts, "lead").select("id", F.struct("lead", F.pmod(F.xxhash64("id"), F.col("n")).alias("part")).alias("bucket"))
    buckets = materialize(buckets, "near-buckets")
    at = lambda end: buckets.select(F.col("id").alias(end), F.col("bucket").alias(f"of_{end}"))
    asked = pairs.join(at("a"), "a").join(at("b"), "b").select(F.struct(F.least("of_a", "of_b").alias("i"), F.greatest("of_a", "of_b").alias("j")).alias("key"), "a", "b")
    asked = materialize(asked, "near-asked")
    places = materialize(asked.select("key", F.col("a").alias("id")).union(asked.select("key", "b")).distinct(), "near-places")
    goes = places.groupBy("id").agg(F.collect_list("key").alias("keys"))  # no more than a text has partners
    side = F.broadcast(goes) if places.count() <= NARROW else goes
    kind = dict(asked.dtypes)["key"]
    own = texts.join(side, "id").select("keys", "id", "t").mapInArrow(sets, f"keys array<{kind}>, id bigint, s binary")
    rows = own.select(F.explode("keys").alias("key"), "id", "s").select("key", F.lit(0).alias("kind"), F.col("id").alias("a"), F.lit(0).cast("bigint").alias("b"), "s")
    rows = rows.unionByName(asked.select("key", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("binary").alias("s")))
    rows = rows.repartition("key").sortWithinPartitions("key", "kind")
    out = materialize(rows.select("key", "kind", "a", "b", "s").mapInArrow(run, "a bigint, b bigint").distinct(), "near-links")
    discard(buckets, asked, places)
    return out


def near_copies(docs: DataFrame, n: int = WORDS, least: float = SIMILARITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, component_id) of every document that has a near copy; component_id is the smallest id reachable."""
    texts = docs.select(integer_key(docs, key).alias("id"), F.coalesce(column(text), F.lit("")).cast("binary").alias("t")).where("id is not null")
    hot = hot_shingles(texts, n)
    found = materialize(sketches(texts, hot, n, least), "near-sketches")
    named, links, tested = found.withColumn("comp", F.col("id")), None, []
    for some, nearest in ((slice(0, FIRST), 1), (slice(-FIRST, None), 1), (slice(-FIRST, None), MANY), (ALL, 0)):
        pairs = pairs_of(meetings(named, hot, some), hot, least, nearest)
        for before in tested:  # no pair is verified twice
            pairs = pairs.join(before, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "near-pairs")
        tested.append(pairs)
        more = similar(pairs, texts, n, least)
        links = more if links is None else links.unionByName(more)
        parts = materialize(connected_components(links), "near-parts")
        named = found.join(parts.select(F.col("node").alias("id"), F.col("component").alias("comp")), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    discard(found, links, *tested)
    return parts.select(F.col("node").alias("id"), F.col("component").alias("component_id"))


def survivors(docs: DataFrame, n: int = WORDS, least: float = SIMILARITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The input's rows with one document of each component, the one of the smallest key; all columns as they came."""
    gone = free(docs, "_gone")
    out = materialize(near_copies(docs, n, least, key, text).where("id <> component_id").select(F.col("id").alias(gone)), "near-copies")
    return docs.join(out, integer_key(docs, key) == F.col(gone), "left_anti")
