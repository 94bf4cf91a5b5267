"""Phrase collocations, counted exactly in counting quotient filters.

1. Texts become blocks of word numbers. A block has a dictionary of its own, so texts are read once and never
   shuffled; the dictionaries alone meet in an aggregate, which gives each language's frequent words their ids.
2. A phrase of n words is the pair of the ids of its first and its last n - 1 words, packed into one key: it can
   only be frequent if both are. Each block counts its keys in a counting quotient filter: the key is permuted
   invertibly, its upper bits (quotient) name a slot and its lower bits (remainder) are stored in full, so the
   key can be told from its place and nothing is lost; counters take a byte and grow where they must.
3. Filters are sorted, and cut into ranges of quotients. The filters of a range are merged across blocks, and
   what is frequent gets an id. Each block hears which of its own keys are, and goes on with those to n + 1.

A block's filters, a range's filters and a block's answers are bounded by ``BLOCK`` and ``RANGE``, whatever
the corpus: a very common phrase is one entry in each block. Frequent words and phrases are never sent to
all tasks unless Spark finds their table small. Counts are exact and every text counts in full.

Defined cases: null and empty texts hold no words; a null language is ``und``; repeated rows count each
time; ties are broken as ``collocations`` says; texts of any length go into blocks whole; an empty table
gives no row; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, materialize

LEAST, LONGEST, TOP, BLOCK, RANGE, ENTRIES = 100, 5, 2000, 1_000_000, 1 << 20, 16_384  # ENTRIES: of a dictionary in one row
ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
STOP = b"\xff"  # no byte of UTF-8: stands for a mark that ends a piece
PIECES = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", STOP * 10)


# -- counting quotient filters


def permute(keys: np.ndarray, width: int) -> np.ndarray:
    """A one-to-one mix of the keys of ``width`` bits."""
    keys = keys.copy()
    mask, half = np.uint64((1 << width) - 1), np.uint64((width + 1) // 2)
    for odd in ODD:
        keys ^= keys >> half
        keys *= np.uint64(odd)
        keys &= mask
    keys ^= keys >> half
    return keys


def unpermute(keys: np.ndarray, width: int) -> np.ndarray:
    mask, half = np.uint64((1 << width) - 1), np.uint64((width + 1) // 2)
    for odd in reversed(ODD):
        keys = (keys ^ (keys >> half)) * np.uint64(pow(odd, -1, 1 << width)) & mask
    return keys ^ (keys >> half)


def _counters(values: np.ndarray) -> bytes:
    """A byte for each value; those of 255 and more follow in full."""
    large = values[values >= 255].astype("<i8")
    return np.int64(len(large)).tobytes() + np.minimum(values, 255).astype(np.uint8).tobytes() + large.tobytes()


def _read_counters(data: memoryview, n: int) -> tuple[np.ndarray, memoryview]:
    large = int(np.frombuffer(data, "<i8", 1)[0])
    values = np.frombuffer(data, np.uint8, n, 8).astype(np.int64)
    values[values == 255] = np.frombuffer(data[8 + n :], "<i8", large)
    return values, data[8 + n + 8 * large :]


def filter_of(keys: np.ndarray, counts: np.ndarray, width: int) -> bytes:
    """The filter of ascending permuted keys of ``width`` bits: entries of each slot, remainders, counters."""
    n = len(keys)
    quotient = min(width, n.bit_length())
    rest = width - quotient
    slots = np.bincount((keys >> np.uint64(rest)).astype(np.int64), minlength=1 << quotient)
    remainders = (keys & np.uint64((1 << rest) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : (rest + 7) // 8]
    return np.array([n, width, quotient], "<i8").tobytes() + _counters(slots) + remainders.tobytes() + _counters(counts)


def read_filter(data: memoryview) -> tuple[np.ndarray, np.ndarray]:
    """The keys, ascending, and their counts."""
    n, width, quotient = map(int, np.frombuffer(data, "<i8", 3))
    rest = width - quotient
    slots, data = _read_counters(data[24:], 1 << quotient)
    size = (rest + 7) // 8
    remainders = np.zeros((n, 8), np.uint8)
    remainders[:, :size] = np.frombuffer(data, np.uint8, n * size).reshape(n, size)
    keys = np.repeat(np.arange(1 << quotient, dtype=np.uint64), slots) << np.uint64(rest) | remainders.view("<u8").ravel()
    return keys, _read_counters(data[n * size :], n)[0]


def merge(filters: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of all filters together."""
    keys, counts = (np.concatenate(x) for x in zip(*filters, strict=True))
    order = np.argsort(keys, kind="stable")  # runs that are sorted already merge fast
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


# -- blocks of words


class _Numbers(dict):
    """Numbers words in order of their first coming, all languages' together."""

    def __init__(self, words: list) -> None:
        self.words = words

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        return n


def blocks(docs: DataFrame, text: str, lang: str, size: int = BLOCK) -> DataFrame:
    """(block, at, words, sizes, codes): codes number the words (0 ends a piece), sizes hold each language's words.

    A block's dictionary comes in rows of ``ENTRIES`` words from place ``at`` on; sizes and codes stand in the first of them.
    """
    entry = pa.struct([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
    total = pa.struct([("lang", pa.string()), ("n", pa.int64())])
    schema = pa.schema([("block", pa.int64()), ("at", pa.int32()), ("words", pa.list_(entry)), ("sizes", pa.list_(total)), ("codes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 24
        words, langs, tables, codes, held = [STOP], [None], {}, [], 0

        def block() -> Iterator[pa.RecordBatch]:
            flat = np.concatenate(codes)
            n = pa.array(np.bincount(flat, minlength=len(words))[1:])
            names = pa.array(langs[1:], pa.string())
            entries = pa.StructArray.from_arrays([names, pa.array(words[1:], pa.binary()).cast(pa.string()), n], fields=list(entry))
            sums = pa.table({"lang": names, "n": n}).group_by("lang").aggregate([("n", "sum")]).combine_chunks()
            totals = pa.StructArray.from_arrays([sums.column(i).combine_chunks() for i in range(2)], fields=list(total))
            for at in range(0, len(entries), ENTRIES):
                lists = (pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (entries.slice(at, ENTRIES), totals[: 0 if at else None]))
                yield pa.RecordBatch.from_arrays([pa.array([made]), pa.array([at], pa.int32()), *lists, pa.array([None if at else flat.tobytes()], pa.binary())], schema=schema)

        for batch in batches:
            for language, t in zip(*batch.columns, strict=True):
                language = language.as_py()
                if language not in tables:
                    tables[language] = _Numbers(words)
                    tables[language][STOP] = 0
                found = t.as_py().lower().translate(PIECES).replace(STOP, b" \xff ").split()
                codes.append(np.fromiter(map(tables[language].__getitem__, found), np.int32, len(found)))
                codes.append(np.zeros(1, np.int32))
                langs += [language] * (len(words) - len(langs))
                held += len(found)
                if held >= size:
                    yield from block()
                    made += 1
                    words, langs, tables, codes, held = [STOP], [None], {}, [], 0
        if held:
            yield from block()

    rows = docs.select(F.coalesce(column(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(column(text), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "block bigint, at int, words array<struct<lang: string, word: string, n: bigint>>, sizes array<struct<lang: string, n: bigint>>, codes binary")


def frequent_words(pieces: DataFrame, least: int) -> DataFrame:
    """(id, lang, phrase, a) of the words that a language holds ``least`` times. Ids are dealt by 64 groups of words, so no task numbers all of them."""
    found = pieces.select(F.inline("words")).groupBy("lang", "word").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    group = F.crc32(F.concat_ws(" ", "lang", "word")) % 64
    place = F.row_number().over(Window.partitionBy("group").orderBy("lang", "word")).cast("bigint")
    return found.withColumn("group", group).select(((place - 1) * 64 + F.col("group") + 1).alias("id"), "lang", F.col("word").alias("phrase"), "a")


def numbered(pieces: DataFrame, words: DataFrame) -> DataFrame:
    """(block, ids, pairs): the ids of the block's words, 0 for others and for ends of pieces, and how many neighbours both have one."""
    own = pieces.select("block", "at", F.posexplode("words").alias("nth", "w")).select("block", (F.col("at") + F.col("nth")).alias("at"), "w.lang", F.col("w.word").alias("phrase"))
    found = own.join(words.select("id", "lang", "phrase"), ["lang", "phrase"], "left")  # a row for each entry, whatever share of them is frequent
    known = found.groupBy("block").agg(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("at", "id"))).alias("known"))
    rows = pieces.where("codes is not null").join(known, "block").select("block", "codes", F.col("known.at").alias("at"), F.col("known.id").alias("id"))

    def ids_of(codes: memoryview, at: np.ndarray, ids: np.ndarray) -> np.ndarray:
        codes = np.frombuffer(codes, np.int32)
        table = np.zeros(int(codes.max()) + 1, np.int64)
        table[at + 1] = ids
        return table[codes]

    return _sequences(rows, ids_of)


def _sequences(rows: DataFrame, ids_of) -> DataFrame:
    """(block, ids, pairs) from rows of a block, a binary and two arrays; what no pair holds is left out."""
    schema = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("pairs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data, a, b in zip(*batch.columns, strict=True):
                ids = np.concatenate([[0], ids_of(data.as_buffer(), a.values.to_numpy(), b.values.to_numpy()), [0]])
                both = (ids[1:] > 0) & (ids[:-1] > 0)
                keep = np.concatenate([[False], both]) | np.concatenate([both, [False]])
                keep[1:] |= keep[:-1]  # and the 0 after it
                if both.any():
                    yield pa.RecordBatch.from_arrays([pa.array([block.as_py()]), pa.array([ids[keep].astype("<u4").tobytes()]), pa.array([int(both.sum())])], schema=schema)

    return rows.mapInArrow(run, "block bigint, ids binary, pairs bigint")


# -- phrases


def counted(blocks_of_ids: DataFrame, bits: int, ranges: int, least: int, answers: bool) -> DataFrame:
    """The frequent pairs of neighbours: rows (block, left, right, id, a) of arrays.

    Those without a block hold each range's pairs with their counts; those with one hold, if ``answers``
    is set, what of its own pairs is frequent (a is empty there). ranges: a power of two.
    """
    width, part = 2 * bits, ranges.bit_length() - 1
    inner = width - part

    def filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(*batch.columns, strict=True):
                ids = np.frombuffer(data.as_buffer(), "<u4")
                both = (ids[1:] > 0) & (ids[:-1] > 0)
                keys = ids[:-1][both].astype(np.uint64)
                keys <<= np.uint64(bits)
                keys |= ids[1:][both]
                keys = permute(keys, width)
                keys.sort()
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                counts = np.diff(first, append=len(keys))
                keys = keys[first]
                cut = np.searchsorted(keys, np.arange(ranges + 1, dtype=np.uint64) << np.uint64(inner)) if part else np.array([0, len(keys)])
                cut[-1] = len(keys)
                full = np.flatnonzero(np.diff(cut))
                made = [filter_of(keys[cut[r] : cut[r + 1]] & np.uint64((1 << inner) - 1), counts[cut[r] : cut[r + 1]], inner) for r in full]
                yield pa.RecordBatch.from_arrays([pa.array(full), pa.array([block.as_py()] * len(full), pa.int64()), pa.array(made, pa.binary())], ["range", "block", "filter"])

    longs = pa.list_(pa.int64())
    schema = pa.schema([("block", pa.int64()), ("left", longs), ("right", longs), ("id", longs), ("a", longs)])

    def met(table: pa.Table) -> pa.Table:
        own = table.column("range")[0].as_py()
        each = [read_filter(x.as_buffer()) for x in table.column("filter")]
        keys, counts = merge(each)
        often = counts >= least
        keys, counts = keys[often], counts[often]
        number = np.arange(len(keys), dtype=np.int64) * ranges + own + 1
        if len(keys) and number[-1] >= 1 << 32:
            raise ValueError("more than 2^32 phrases of one length are frequent")

        def ends(keys: np.ndarray) -> list[np.ndarray]:
            keys = unpermute(keys | np.uint64(own << inner) if part else keys, width)
            return [(keys >> np.uint64(bits)).astype(np.int64), (keys & np.uint64((1 << bits) - 1)).astype(np.int64)]

        out = [[None, *ends(keys), number, counts]] if len(keys) else []
        for block, (mine, _) in zip(table.column("block"), each, strict=True) if answers and len(keys) else ():
            at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
            hit = keys[at] == mine
            if hit.any():
                out.append([block.as_py(), *ends(mine[hit]), number[at[hit]], counts[:0]])
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 5, schema, strict=True)], schema=schema)

    made = blocks_of_ids.select("block", "ids").mapInArrow(filters, "range bigint, block bigint, filter binary")
    return made.groupBy("range").applyInArrow(met, "block bigint, left array<bigint>, right array<bigint>, id array<bigint>, a array<bigint>")


def longer(blocks_of_ids: DataFrame, answers: DataFrame, bits: int) -> DataFrame:
    """(block, ids, pairs) with the ids of pairs in place of those of their left parts."""
    packed = F.transform(F.arrays_zip("left", "right"), lambda p: F.shiftleft(p["left"], bits).bitwiseOR(p["right"]))
    known = answers.where("block is not null").groupBy("block").agg(F.flatten(F.collect_list(packed)).alias("pair"), F.flatten(F.collect_list("id")).alias("id"))

    def ids_of(data: memoryview, pairs: np.ndarray, ids: np.ndarray) -> np.ndarray:
        given, pairs = np.frombuffer(data, "<u4").astype(np.uint64), pairs.view(np.uint64)
        order = np.argsort(pairs)
        pairs, ids = pairs[order], ids[order]
        mine = given[:-1] << np.uint64(bits) | given[1:]
        at = np.minimum(np.searchsorted(pairs, mine), len(pairs) - 1)
        return np.where((pairs[at] == mine) & (given[:-1] > 0) & (given[1:] > 0), ids[at], 0)

    return _sequences(blocks_of_ids.join(known, "block").select("block", "ids", "pair", "id"), ids_of)


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, block: int = BLOCK, size: int = RANGE) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) of all words, and for each length from 1 on a table of its frequent phrases.

    A phrase has id, lang, phrase, a (its count), left and right (ids of its first and its last words but one),
    heads and tails (counts of its first and of its last 1, 2, ... words).
    """
    pieces = materialize(blocks(docs, text, lang, block), "collocation-blocks")
    totals = pieces.select(F.inline("sizes")).groupBy("lang").agg(F.sum("n").alias("n"))
    words = materialize(frequent_words(pieces, least), "collocation-words")
    ids = materialize(numbered(pieces, words), "collocation-ids")
    found = [words.select("*", F.array("a").alias("heads"), F.array("a").alias("tails"), F.col("phrase").alias("last"))]
    for n in range(2, longest + 1):
        most = found[-1].agg(F.max("id")).first()[0] or 1
        pairs = ids.agg(F.sum("pairs")).first()[0] or 0
        bits = int(most).bit_length()
        ranges = 1 << min(2 * bits, (pairs // size).bit_length())
        met = materialize(counted(ids, bits, ranges, least, n < longest), "collocation-pairs")
        rows = met.where("block is null").select(F.inline(F.arrays_zip("left", "right", "id", "a")))
        before = found[-1]
        head = before.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("begin"), "heads")
        tail = before.select(F.col("id").alias("right"), "tails", "last")
        found.append(
            materialize(
                rows.join(head, "left").join(tail, "right").select(
                    "id", "lang", F.concat_ws(" ", "begin", "last").alias("phrase"), "a", "left", "right",
                    F.concat("heads", F.array("a")).alias("heads"), F.concat("tails", F.array("a")).alias("tails"), "last",
                ),
                "collocation-phrases",
            )
        )
        if n < longest:
            ids = materialize(longer(ids, met, bits), "collocation-ids")
    return totals, found


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int | None = TOP, **sizes) -> DataFrame:
    """Each language's first ``top`` phrases (None: all): lang, rank, phrase, a, l, r, n, score.

    A phrase of count a that is cut into parts of counts l and r scores floor(1000 * a * n / (l * r)), n being the
    language's words; its lowest cut counts, of equal ones the first. A phrase inside a longer one that occurs as
    often is left out. Order: score and a descending, then phrase.
    """
    totals, found = phrase_counts(docs, text, lang, least, longest, **sizes)
    wide, out = (lambda c: c.cast("decimal(19,0)")), None
    for n, rows in enumerate(found[1:], 2):
        if n < longest:
            over = found[n].select(F.explode(F.array("left", "right")).alias("id"), "a")
            rows = rows.join(over, ["id", "a"], "left_anti")
        rows = rows.join(totals, "lang").withColumn("thousands", wide(F.col("a") * 1000) * wide(F.col("n")))
        cuts = [F.struct(F.call_function("div", F.col("thousands"), wide(F.col("heads")[k - 1]) * wide(F.col("tails")[n - k - 1])).alias("score"), F.lit(k).alias("k"), F.col("heads")[k - 1].alias("l"), F.col("tails")[n - k - 1].alias("r")) for k in range(1, n)]
        rows = rows.select("lang", "phrase", "a", "n", F.array_min(F.array(*cuts)).alias("cut"))
        out = rows if out is None else out.unionByName(rows)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    ranked = out.withColumn("rank", place)
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece
  FROM documents
), lists AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS ws FROM pieces),
totals AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM lists GROUP BY lang),
grams AS (
  SELECT lang, list_slice(ws, i, i + size - 1) AS g, CAST(count(*) AS BIGINT) AS a
  FROM (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM lists, (SELECT unnest([1, 2, 3, 4, 5]) AS size))
  GROUP BY 1, 2 HAVING count(*) >= 100
), cut AS (
  SELECT x.lang, x.g, x.a, k, l.a AS l, r.a AS r, t.n, CAST(CAST(1000 AS HUGEINT) * x.a * t.n // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, len(g))) AS k FROM grams WHERE len(g) > 1) x JOIN totals t ON t.lang = x.lang
  JOIN grams l ON l.lang = x.lang AND l.g = x.g[:k] JOIN grams r ON r.lang = x.lang AND r.g = x.g[k + 1:]
), best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inside AS (
  SELECT DISTINCT lang, list_slice(g, i, j) AS g, a FROM (SELECT lang, g, a, i, unnest(range(i + 1, len(g) + 1)) AS j FROM (SELECT lang, g, a, unnest(range(1, len(g))) AS i FROM grams WHERE len(g) > 2))
  WHERE j - i + 1 < len(g)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase, a, l, r, n, score
FROM best b WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = b.lang AND i.g = b.g AND 100 * i.a >= 100 * b.a)
QUALIFY rank <= 2000
"""
