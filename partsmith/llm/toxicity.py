"""Toxicity by compression distance under zstandard dictionaries of toxic and of ordinary text.

A text is cut into windows of ``WINDOW`` words. A window's distance is how many bytes longer it gets
under the ordinary dictionary than under the toxic one. A document's distances are summed up in a few
numbers (how many windows pass each threshold, the largest ones, the mean), and a logistic curve,
fitted on labelled documents that the dictionaries have not seen, calibrates these to a probability.

Toxic documents are ordinary prose but for a few places, so the dictionaries are trained in steps, by
compressed lengths alone: (1) a base is trained on ordinary windows; of the toxic windows those stay
that cost most under it; (2) a toxic and an ordinary tail are trained on the windows that stay, each half of
the documents is measured under the tails of the other half, so that no window is measured under itself, and those of the largest
distances stay; (3) each of these is narrowed to the word without which its distance shrinks most, new tails are
trained on the narrowed windows of both kinds, and all windows are measured under these, ``ROUNDS`` times; the last tails are trained
on those of both halves. A tail's size follows what it is trained on (a ``SHARE``-th of it, ``LEAST_TAIL`` at least). Windows that stand in
several documents are left out, so that copies add nothing. Every part of both dictionaries is trained by zstandard, in the same way for both;
both hold the same base, nearest to the text, and tails of equal length before it: they differ in nothing but what the
tails match. They are matched as raw content: with the entropy tables of training, lengths follow the letters of a
window more than its matches, and little is told apart.

The model is fitted on a sample of about ``SAMPLE`` labelled training rows: four fifths give at most about
``WINDOWS`` windows of each kind (of ``LONGEST`` bytes at most) for the dictionaries, one fifth calibrates the
curve. Labels are looked at in training only; language, source and id never. Whole texts are scored.

Defined cases: null and empty texts, and texts of punctuation alone, are scored by the curve like texts
whose windows have no distance; rows without a label, or with a null one, are scored but not learned from; without any toxic or any
ordinary training row every score is the share of toxic ones (0 without rows); rows repeated come
out repeated, and a repeated label row counts as often as it occurs; of windows of equal distance the smaller
text comes first; a very long text is scored window by window in memory that its words take, and a very long
word is one window's word like any other; other columns of the input, whatever their names, come through untouched.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import zip_longest

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket, materialize

WINDOW, LEVEL, BASE, TAIL, ROUNDS, LONGEST = 8, 6, 65_536, 16_384, 4, 1024
SEGMENT, PART = 12, 6  # bytes of the pieces that training chooses among, and of their parts that it counts
NARROW, NARROW_PART, SHARE, LEAST_TAIL = 24, 8, 16, 1024  # the same for tails of narrowed windows, and their size
SAMPLE, WINDOWS, REJECT = 40_000, 60_000, 0.3
# Punctuation that is taken out of words.
PUNCTUATION = b".,!?;:|*%&$#\"()[]{}"
THRESHOLDS = (1, 2, 3, 4, 6)


def windows(text: str, n: int = WINDOW) -> list[bytes]:
    """The text's lower-case words without punctuation, n at a time; the last window may be shorter."""
    words = text.lower().encode().translate(None, PUNCTUATION).split()
    return [b" " + b" ".join(w for w in ws if w is not None) + b" " for ws in zip_longest(*[iter(words)] * n)]


def compressor(dictionary: bytes, level: int = LEVEL) -> zstandard.ZstdCompressor:
    own = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    own.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=own, write_content_size=False, write_checksum=False)


def lengths(dictionary: bytes, texts: list[bytes]) -> np.ndarray:
    compress = compressor(dictionary).compress
    return np.fromiter((len(compress(t)) for t in texts), np.int64, len(texts))


def trained(texts: list[bytes], size: int, segment: int = SEGMENT, part: int = PART) -> bytes:
    """A dictionary that zstandard trains on the texts; the texts themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, texts, level=LEVEL, k=segment, d=part).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-size:]


def pair(base: bytes, toxic: bytes, ordinary: bytes) -> tuple[bytes, bytes]:
    """(ordinary, toxic) dictionaries: a tail and the base. The shorter tail is filled up from the base's least useful part."""
    n = max(len(toxic), len(ordinary))
    fill = lambda tail: (base[:n] + b" " * n)[: n - len(tail)] + tail
    return fill(ordinary) + base, fill(toxic) + base


def most(values: np.ndarray, share: float, texts: list[bytes]) -> np.ndarray:
    """Marks the share of texts with the largest positive values."""
    order = sorted(range(len(texts)), key=lambda i: (-values[i], texts[i]))[: int(len(texts) * share)]
    out = np.zeros(len(texts), bool)
    out[[i for i in order if values[i] > 0]] = True
    return out


def core(window: bytes, far, near) -> bytes | None:
    """The word that carries most of the window's distance between two compressors; None if no word does."""
    distance = lambda w: len(far(w)) - len(near(w))
    words, whole = window.split(), distance(window)
    gains = [whole - distance(b" " + b" ".join(words[:i] + words[i + 1 :]) + b" ") for i in range(len(words))]
    at = int(np.argmax(gains)) if gains else 0
    return b" " + words[at] + b" " if gains and gains[at] > 0 else None


def narrowed(cores: list[bytes]) -> bytes:
    """A tail trained on windows that were narrowed to their cores.

    Training counts parts of ``NARROW_PART`` bytes, so a core in which no more than one fits is written again. Cores that come
    once are left out where others come again. The others are laid in rounds, each holding a core once, so that
    what training takes beside a core that recurs recurs too.
    """
    seen, nth = Counter(), []
    for c in cores:
        c = b" " + c[1:] * -(-NARROW_PART // (len(c) - 1))
        seen[c] += 1
        nth.append((seen[c], c))
    cores = [c for _, c in sorted([x for x in nth if seen[x[1]] > 1] or nth)]
    return trained(cores, max(LEAST_TAIL, sum(map(len, cores)) // SHARE), NARROW, NARROW_PART) if cores else b""


def fit(toxic: list[tuple[bytes, bool]], ordinary: list[tuple[bytes, bool]]) -> tuple[bytes, bytes]:
    """(ordinary, toxic) dictionaries from windows and the half that their document belongs to."""
    t, o = ([w for w, _ in x] for x in (toxic, ordinary))
    t_half, o_half = (np.array([h for _, h in x], bool) for x in (toxic, ordinary))
    base = trained(o, BASE)
    cost = lambda ws: lengths(base, ws) / np.array([len(w) for w in ws])
    keep_t, keep_o = most(cost(t), 0.3, t), most(cost(o), 0.05, o)
    chosen = lambda ws, *marks: [w for w, k in zip(ws, np.logical_and.reduce(marks), strict=True) if k]

    def measured(tails) -> tuple[np.ndarray, np.ndarray, list]:
        """Distances of both kinds, each half under the tails of the other half, and the pairs of dictionaries by half."""
        d_t, d_o, pairs = np.zeros(len(t), np.int64), np.zeros(len(o), np.int64), []
        for h in (False, True):
            pairs.append(pair(base, *tails(not h)))
            far, near = pairs[-1]
            for d, ws, half in ((d_t, t, t_half), (d_o, o, o_half)):
                own = chosen(ws, half == h)
                d[half == h] = lengths(far, own) - lengths(near, own)
        return d_t, d_o, pairs

    for _ in range(2):
        d_t, d_o, pairs = measured(lambda h: (trained(chosen(t, keep_t, t_half == h), TAIL), trained(chosen(o, keep_o, o_half == h), TAIL)))
        keep_t, keep_o = most(d_t, 0.3, t), most(d_o, 0.03, o)
    for last in (*[False] * ROUNDS, True):
        cores = {}
        for h, (far, near) in enumerate(pairs):
            far, near = compressor(far).compress, compressor(near).compress
            for kind, ws, keep, half in (("t", t, keep_t, t_half), ("o", o, keep_o, o_half)):
                cores[kind, bool(h)] = [c for w in chosen(ws, keep, half == bool(h)) if (c := core(w, far, near))]

        def tails(*halves: bool) -> tuple[bytes, bytes]:
            return tuple(narrowed([c for h in halves for c in cores[kind, h]]) for kind in "to")  # noqa: B023

        if last:
            return pair(base, *tails(False, True))
        d_t, d_o, pairs = measured(tails)
        keep_t, keep_o = d_t > 0, d_o > 0
    raise AssertionError


N_FEATURES = len(THRESHOLDS) + 8


@lru_cache(1)
def _compressors(ordinary: bytes, toxic: bytes):
    return compressor(ordinary).compress, compressor(toxic).compress


def numbers(text: str, ordinary: bytes, toxic: bytes) -> list[float]:
    """A document's numbers, from the distances of all its windows."""
    far, near = _compressors(ordinary, toxic)
    d = np.array([len(far(w)) - len(near(w)) for w in windows(text)] or [0])
    top = np.sort(d)[-3:]
    over = [int((d >= t).sum()) for t in THRESHOLDS]
    up = np.maximum(d, 0)
    return list(np.log1p(np.maximum(0, [d.max(), top.mean(), d.mean(), *over, *(n / len(d) for n in over[1:4]), up.sum(), (np.maximum(up - 1, 0) ** 2).sum()])))


def features(spark: SparkSession, text: F.Column, dictionaries: tuple[bytes, bytes]) -> F.Column:
    """The numbers of a text as an array of doubles."""
    shared = spark.sparkContext.broadcast(dictionaries)  # at most twice BASE + TAIL bytes

    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        found = np.array([numbers(t.as_py(), *shared.value) for t in texts]).reshape(-1, N_FEATURES)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, N_FEATURES), pa.int32()), pa.array(found.ravel()))

    return run(F.coalesce(text, F.lit("")))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and offset of a ridge logistic curve, by Newton steps."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z, w = np.c_[(x - mean) / spread, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.eye(len(w)), z.T @ (p - y) + w)
    return w[:-1] / spread, float(w[-1] - (w[:-1] * mean / spread).sum())


def sampled_windows(rows: DataFrame) -> dict[int, list[tuple[bytes, bool]]]:
    """By label, about ``WINDOWS`` windows of rows (text, toxic, h) that stand in one document only, with its half.

    Windows are drawn by their own hash, so that all copies of one are drawn or none.
    """
    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.sum(F.length("text")).alias("n")).collect()}
    rate = {y: WINDOWS * 6.5 * WINDOW / max(n, 1) * (1 << 32) for y, n in size.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, toxic, h in zip(*(batch.column(k) for k in range(3)), strict=True):
                least = rate[toxic.as_py()]
                found += [(toxic.as_py(), w, bool(h.as_py() & 32)) for w in set(windows(text.as_py())) if len(w) <= LONGEST and zlib.crc32(w) < least]
            cols = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.binary(), pa.bool_()), strict=True)], ["toxic", "w", "half"])

    drawn = rows.select("text", "toxic", "h").mapInArrow(run, "toxic int, w binary, half boolean")
    found = drawn.groupBy("toxic", "w").agg(F.count("*").alias("n"), F.first("half").alias("half")).where("n = 1").select("toxic", "w", "half").toArrow()
    out: dict[int, list[tuple[bytes, bool]]] = {0: [], 1: []}
    for toxic, w, half in zip(*(found.column(k).to_pylist() for k in range(3)), strict=True):
        out[toxic].append((w, half))
    return {y: sorted(x) for y, x in out.items()}


Model = tuple[tuple[bytes, bytes], np.ndarray, float]


def train(rows: DataFrame) -> Model:
    """Dictionaries and curve from rows (text, toxic)."""
    rows = rows.where("toxic is not null").select(F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic"))
    rows = materialize(rows.withColumn("h", F.xxhash64("text")), "toxicity-training")
    fold = F.pmod(F.col("h"), F.lit(5))
    found = sampled_windows(rows.where(fold != 0))
    dictionaries = fit(found[1], found[0]) if found[0] and found[1] else (b"", b"")
    held = rows.where(fold == 0).select("toxic", features(rows.sparkSession, F.col("text"), dictionaries).alias("f")).collect()  # a fifth of SAMPLE
    x, y = np.array([r["f"] for r in held]).reshape(-1, N_FEATURES), np.array([r["toxic"] for r in held], float)
    if not all(dictionaries) or not len(y) or y.min() == y.max():
        share = rows.agg(F.avg("toxic")).first()[0] or 0.0
        return dictionaries, np.zeros(N_FEATURES), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    return dictionaries, *logistic(x, y)


def score(docs: DataFrame, model: Model, text: str = "text") -> F.Column:
    """The probability of toxicity of the table's column ``text``, as a column."""
    dictionaries, weights, offset = model
    found = features(docs.sparkSession, docs[f"`{text}`"], dictionaries)
    z = F.aggregate(F.zip_with(found, F.array(*(F.lit(float(w)) for w in weights)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) + offset
    return 1 / (1 + F.exp(-z))


def labelled(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """Training rows (text, toxic): about ``most`` labelled documents outside the held-out fourth, all of them if there are fewer.

    The sample is drawn from the labels by a hash, so that what meets the texts is small enough to be
    broadcast and no text is shuffled.
    """
    marks = labels.where("toxic is not null").where(bucket("doc_id", 4) != 2).select("doc_id", "toxic")
    n = marks.count()
    if n > most:
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < 1_000_000 * most // n)
    marks = materialize(marks, "toxicity-labels")
    side = F.broadcast(marks) if marks.count() <= 2 * most else marks
    return docs.select("doc_id", "text").join(side, "doc_id").select("text", "toxic")


def survivors(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows, all columns as they came, that the model trained on the labelled ones among them does not reject."""
    return docs.where(score(docs, train(labelled(docs, labels))) < REJECT)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return docs.select("doc_id", (bucket("doc_id", 4) == 2).alias("held_out"), score(docs, model).alias("score")).withColumn("predicted", (F.col("score") >= REJECT).cast("int"))
