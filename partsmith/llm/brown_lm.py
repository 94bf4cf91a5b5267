"""Language-model scoring with a class-based bigram model (Brown classes by exchange clustering).

P(text) is the product over its words, then an end, of P(class | class before) P(type | class)
P(word | type). The ``TYPES`` most frequent training words are types of their own; all other words,
unknown ones too, share ``SLOTS`` types by hash. So what clustering works on is of bounded size
while every word of the corpus has a type, a class and a probability above zero.

Counts come from all training rows: word counts by a shuffle; in each sweep, for every type the
classes before and after it, summed by tasks over their rows and then by type. Exchange then moves
each type in turn to the class under which its neighbours and itself are likeliest. A word's count is
looked up in a broadcast table of at most ``HEAD`` frequent words, and in a join for all others.

Defined cases: null and empty texts are an end alone; a null key is a training or held-out row by the
text ``null``; repeated rows count and come out as often as they occur; an empty training set makes
every word unknown; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket, materialize

TYPES, SLOTS, CLASSES, HEAD, SWEEPS, ALPHA, BETA, FLUSH = 8192, 4096, 64, 262_144, 3, 0.5, 0.1, 500_000
END = TYPES + SLOTS  # the end's type; it has the last class for itself
ALL = END + 1


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for t in batch.column(0):
                seen.update(t.as_py().lower().split())
                if len(seen) >= FLUSH:
                    yield rows(seen)
                    seen.clear()
        yield rows(seen)

    def rows(seen: Counter[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])

    parts = docs.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t")).mapInArrow(run, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


class Lexicon:
    """Counts of the frequent words and of the slots, shared with the workers."""

    def __init__(self, words: list[bytes], n: np.ndarray, slot_n: np.ndarray, slot_v: np.ndarray, docs: int):
        order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
        self.name = uuid.uuid4().hex
        self.words, self.n, self.docs = [words[i] for i in order], n[order].astype(np.float64), docs
        slots = np.array([zlib.crc32(w) % SLOTS for w in self.words], np.int64)
        self.slot_n, self.slot_v = slot_n.astype(np.float64), slot_v.astype(np.float64)
        np.subtract.at(self.slot_n, slots[:TYPES], self.n[:TYPES])
        np.subtract.at(self.slot_v, slots[:TYPES], 1)
        own = np.arange(len(self.words)) < TYPES
        self.type = np.where(own, np.arange(len(self.words)), TYPES + slots)
        self.below = np.log10(self.slot_n + ALPHA * (self.slot_v + 1))
        self.emit = np.where(own, 0.0, np.log10(self.n + ALPHA) - self.below[slots])
        self.log_n1 = np.log10(self.n + 1)

    def sizes(self) -> np.ndarray:
        """How often each type occurs."""
        own = np.zeros(TYPES)
        own[: min(TYPES, len(self.n))] = self.n[:TYPES]
        return np.concatenate([own, self.slot_n, [self.docs]])


_INDEX: dict[str, dict[bytes, int]] = {}


def index_of(lexicon: Lexicon) -> dict[bytes, int]:
    """The worker's word index of a lexicon; a worker keeps one at a time."""
    if lexicon.name not in _INDEX:
        _INDEX.clear()
        _INDEX[lexicon.name] = {w: i for i, w in enumerate(lexicon.words)}
    return _INDEX[lexicon.name]


def lexicon_of(vocabulary: DataFrame, docs: int) -> Lexicon:
    """The words above the count that leaves at most ``HEAD``, and sums by slot."""
    step = F.floor(F.log2("n") * 32)
    above = sorted(((r["s"], r["k"]) for r in vocabulary.groupBy(step.alias("s")).agg(F.count("*").alias("k")).collect()), reverse=True)
    total, least = 0, None
    for s, k in above:
        if total + k > HEAD:
            break
        total, least = total + k, s
    head = vocabulary.where(step >= least if least is not None else F.lit(False)).toArrow()
    slot = (F.crc32("word") % SLOTS).alias("slot")
    slots = vocabulary.groupBy(slot).agg(F.sum("n").alias("n"), F.count("*").alias("v")).toArrow()
    n, v = np.zeros(SLOTS), np.zeros(SLOTS)
    at = slots.column("slot").to_numpy()
    n[at], v[at] = slots.column("n").to_numpy(), slots.column("v").to_numpy()
    return Lexicon([w.encode() for w in head.column("word").to_pylist()], head.column("n").to_numpy().astype(np.int64), n, v, docs)


TYPED = "row_id bigint, held_out boolean, n_tokens bigint, known bigint, base double, emit double, seq binary, tail array<struct<word:string,m:bigint>>"


def typed_texts(docs: DataFrame, lexicon, keep: str, held_out: F.Column, text: str = "text") -> DataFrame:
    """Each row's types (16 bits each, end last), sums over its frequent words, and its other words with counts."""
    kind = docs.schema[keep].dataType.simpleString()
    item = pa.struct([("word", pa.string()), ("m", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon.value
        get, at = index_of(lex).get, TaskContext.get().partitionId() << 40
        for batch in batches:
            out = [one(t.as_py(), lex, get) for t in batch.column(2)]
            ids, at = pa.array(range(at, at + len(out)), pa.int64()), at + len(out)
            cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 6, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(item)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, batch.column(1), *cols], [keep, "row_id", "held_out", "n_tokens", "known", "base", "emit", "seq", "tail"])

    def one(text: bytes, lex: Lexicon, get) -> tuple:
        words = text.lower().split()
        at = np.array([get(w, -1) for w in words], np.int64)
        seq = np.full(len(words) + 1, END, np.uint16)
        rare = np.nonzero(at < 0)[0]
        frequent = at[at >= 0] if len(rare) else at
        types = lex.type[at] if len(lex.type) else at  # for rare words any value; set below
        emit, tail = float(lex.emit[frequent].sum()), []
        if len(rare):
            seen = Counter(words[i] for i in rare)
            slots = {w: zlib.crc32(w) % SLOTS for w in seen}
            types[rare] = [TYPES + slots[words[i]] for i in rare]
            emit -= sum(m * lex.below[slots[w]] for w, m in seen.items())
            tail = [{"word": w.decode(), "m": m} for w, m in seen.items()]
        seq[:-1] = types
        base = float(lex.log_n1[frequent].sum()) + float(np.log10(lex.docs + 1))
        return len(words) + 1, len(frequent) + (lex.docs > 0), base, emit, seq.tobytes(), tail

    rows = docs.select(keep, held_out.alias("held_out"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    return rows.mapInArrow(run, f"`{keep}` {kind}, {TYPED}")


def contexts(typed: DataFrame, classes) -> np.ndarray:
    """[type, 0 or 1, class]: how often each class follows (0) or comes before (1) a type, over all training rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, total = classes.value, np.zeros((2, ALL * CLASSES), np.int64)
        for batch in batches:
            seq = np.frombuffer(b"".join([np.uint16(END).tobytes(), *(x.as_py() for x in batch.column(0))]), np.uint16).astype(np.int64)
            c = cls[seq]
            total[0] += np.bincount(seq[:-1] * CLASSES + c[1:], minlength=ALL * CLASSES)
            total[1] += np.bincount(seq[1:] * CLASSES + c[:-1], minlength=ALL * CLASSES)
        total = np.ascontiguousarray(total.reshape(2, ALL, CLASSES).transpose(1, 0, 2))
        yield rows({int(t): total[t] for t in np.nonzero(total.any((1, 2)))[0]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for t, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(x.as_py(), np.int64)
                total[t] = total[t] + x if t in total else x
        yield rows(total)

    def rows(total: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["type", "x"])

    form = "type bigint, x binary"
    found = typed.where("not held_out").select("seq").mapInArrow(count, form).repartition("type").mapInArrow(add, form).toArrow()
    out = np.zeros((ALL, 2, CLASSES))
    for t, x in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True):
        out[t] = np.frombuffer(x, np.int64).reshape(2, CLASSES)
    return out


def exchange(around: np.ndarray, classes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One sweep in order of frequency: each type goes to the class of the greatest likelihood, given its contexts."""
    classes = classes.copy()
    last = CLASSES - 1
    pairs, total = np.full((CLASSES, CLASSES), BETA), np.full(CLASSES, 1.0)
    np.add.at(pairs, classes, around[:, 0])
    np.add.at(total, classes, sizes)
    for t in np.argsort(-sizes, kind="stable"):
        if t == END or sizes[t] == 0:
            continue
        after, before, n, old = around[t, 0], around[t, 1], sizes[t], classes[t]
        pairs[old] -= after
        pairs[:, old] -= before
        np.maximum(pairs, BETA, out=pairs)
        total[old] = max(1.0, total[old] - n)
        logs = np.log(pairs)
        gain = logs @ after + before @ logs - 2 * n * np.log(total)
        gain[last] = -np.inf
        new = int(gain.argmax())
        pairs[new] += after
        pairs[:, new] += before
        total[new] += n
        classes[t] = new
    return classes


def model_of(around: np.ndarray, classes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 P(class | class before) and log10 P(type | its class)."""
    pairs = np.zeros((CLASSES, CLASSES))
    np.add.at(pairs, classes, around[:, 0])
    moves = (pairs + BETA) / (pairs.sum(1, keepdims=True) + BETA * CLASSES)
    total, kinds = np.bincount(classes, sizes, CLASSES), np.bincount(classes, minlength=CLASSES)
    return np.log10(moves), np.log10((sizes + ALPHA) / (total + ALPHA * kinds)[classes])


def lm_scores(docs: DataFrame, held_out: F.Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, held_out, n_tokens, n_known, train_tokens, base_score, score. Rows that are not held out train."""
    sc = docs.sparkSession.sparkContext
    training = docs.where(~held_out)
    vocabulary = materialize(word_counts(training, text), "lm-vocabulary")
    sums = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_docs = training.count()
    n, v = sums["n"] + n_docs, sums["v"] + (n_docs > 0)
    lexicon = lexicon_of(vocabulary, n_docs)
    typed = materialize(typed_texts(docs, sc.broadcast(lexicon), key, held_out, text), "lm-typed")  # at most HEAD words
    sizes = lexicon.sizes()
    classes = np.full(ALL, CLASSES - 2)
    classes[: CLASSES - 2] = np.arange(CLASSES - 2)
    classes[END] = CLASSES - 1
    for _ in range(SWEEPS):
        classes = exchange(contexts(typed, sc.broadcast(classes)), classes, sizes)
    moves, emits = model_of(contexts(typed, sc.broadcast(classes)), classes, sizes)
    shared = sc.broadcast((classes, moves, emits))
    kind = typed.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, move, emit = shared.value
        for batch in batches:
            found = []
            for x in batch.column(2):
                seq = np.frombuffer(x.as_py(), np.uint16)
                c = cls[seq]
                found.append(float(move[np.concatenate([cls[END:], c[:-1]]), c].sum() + emit[seq].sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], [key, "row_id", "lp"])

    paths = typed.select(key, "row_id", "seq").mapInArrow(run, f"`{key}` {kind}, row_id bigint, lp double").select("row_id", "lp")
    rare = typed.select("row_id", F.explode("tail").alias("w")).select("row_id", "w.word", "w.m")
    counted = rare.join(vocabulary, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    tails = counted.groupBy("row_id").agg(
        F.sum(F.col("m") * F.log10(F.col("n") + ALPHA)).alias("t_emit"), F.sum(F.col("m") * F.log10(F.col("n") + 1)).alias("t_base"), F.sum(F.when(F.col("n") > 0, F.col("m")).otherwise(0)).alias("t_known")
    )
    out = typed.drop("seq", "tail").join(paths, "row_id").join(tails, "row_id", "left")
    more = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        key, "held_out", "n_tokens", (F.col("known") + more("t_known")).alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base") + more("t_base") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"),
        (F.col("lp") + F.col("emit") + more("t_emit")).alias("score"),
    )


def op3_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return lm_scores(docs, bucket("doc_id", 7) == 2)
