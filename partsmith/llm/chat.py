r"""Chat formatting by columnar byte assembly.

Turns become one formatted string per conversation. A batch of turns is assembled at once: numpy
computes the length of every segment (opening, role, text, closing), their cumulative offsets and
the scatter indices, and copies the bytes of all of them into one preallocated Arrow buffer, which is
the data of the result's string column. No turn is handled by itself.

The template opens and closes each turn with control strings (``MARKS``). A control string inside a
text gets one backslash after its first sign, one that has backslashes there gets one more; so no
text holds a control string, nothing is lost, and ``unescape`` gives the text back. Every control
string starts with a sign that it holds only once, so none can arise where a text meets a mark.

``format_chat`` shuffles turns once, by conversation, and streams through them in order of turn (then
role, then text). Its rows: key, piece, formatted, loss (spans of the assistants' texts in code points,
end exclusive). A conversation is one row, ``piece`` 0; only one of over ``PIECE`` bytes comes as numbered
rows of whole turns, so a conversation of any length fits in a task's memory.

Defined cases: null texts and roles are empty; null turns come first; rows with a null key are one
conversation; repeated turns are turns; roles other than system, user and assistant are written out;
a long text is copied in slices; an empty table gives no row; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column

#: Opening, end of the role's name, closing of each kind of turn; the last is for all other roles.
MARKS = {
    "system": (b"[SYS] ", b"", b" [/SYS]\n"),
    "user": (b"[INST] ", b"", b" [/INST]\n"),
    "assistant": (b"<s>", b"", b"</s>\n"),
    "": (b"[ROLE]", b"[/ROLE]", b"[END]\n"),
}
OTHER, ASSISTANT = len(MARKS) - 1, list(MARKS).index("assistant")
CONTROL = r"/?INST\]|/?SYS\]|/?ROLE\]|END\]|/?s>"
RAW = re.compile(rf"[\[<]\\*(?:{CONTROL})".encode())
QUOTED = re.compile(rf"([\[<])\\(\\*(?:{CONTROL}))")
PIECE, SLICE = 32 << 20, 1 << 20


def unescape(text: str) -> str:
    return QUOTED.sub(r"\1\2", text)


def _bytes_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data and offsets of a binary column, without a copy."""
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int32, len(values) + 1, values.offset * 4).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def escaped(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data and offsets of the column with a backslash in each control string."""
    data, at = _bytes_of(values)
    found = np.array([m.span() for m in RAW.finditer(memoryview(data))], np.int64).reshape(-1, 2)
    row_end = at[np.searchsorted(at, found[:, 0], "right")]
    into = found[found[:, 1] <= row_end, 0] + 1  # what spans two texts is none
    return np.insert(data, into, ord("\\")), at + np.searchsorted(into, at, "left")


def _copy(to: np.ndarray, at: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
    """Segment i of data, from start[i] and of size[i], goes to at[i]; indices of ``SLICE`` bytes at a time."""
    total = np.cumsum(size)
    i = 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + SLICE, "right")))
        if j == i + 1:
            to[at[i] : at[i] + size[i]] = data[start[i] : start[i] + size[i]]
        else:
            n = size[i:j]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            to[np.repeat(at[i:j], n) + inside] = data[np.repeat(start[i:j], n) + inside]
        i = j


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Buffer, np.ndarray, np.ndarray, np.ndarray]:
    """All turns in one buffer; each turn's first byte (and the last one's end), kind of role, and characters of its five segments."""
    names, texts = escaped(roles), escaped(texts)
    kind = pc.index_in(roles, pa.array([r.encode() for r in MARKS][:OTHER], pa.binary())).fill_null(OTHER).to_numpy(zero_copy_only=False)
    marks = [b"".join(part) for part in zip(*MARKS.values(), strict=True)]
    sizes = np.array([[len(x) for x in part] for part in MARKS.values()])[kind]
    starts = (np.cumsum([[len(x) for x in part] for part in MARKS.values()], 0) - np.array([[len(x) for x in part] for part in MARKS.values()]))[kind]
    named = np.where(kind == OTHER, np.diff(names[1]), 0)
    size = np.stack([sizes[:, 0], named, sizes[:, 1], np.diff(texts[1]), sizes[:, 2]], 1)
    at = (np.cumsum(size) - size.ravel()).reshape(size.shape)
    buffer = pa.allocate_buffer(int(size.sum()))
    to = np.frombuffer(buffer, np.uint8)
    for k, (data, start) in enumerate(((marks[0], starts[:, 0]), (names[0], names[1][:-1]), (marks[1], starts[:, 1]), (texts[0], texts[1][:-1]), (marks[2], starts[:, 2]))):
        _copy(to, at[:, k], np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data, start, size[:, k])
    first = np.append((to & 0xC0) != 0x80, False).view(np.uint8)  # of each character; one more for segments that start at the end
    chars = np.where(size.ravel(), np.add.reduceat(first, at.ravel(), dtype=np.int64), 0).reshape(size.shape)
    return buffer, np.append(at[:, 0], len(to)), kind, chars


def _rows(turns: pa.Table, ends: np.ndarray, first_piece: int, schema: pa.Schema) -> pa.RecordBatch:
    """One row per conversation; ends: after its last turn. first_piece is the first one's number."""
    key, roles, texts = (turns.column(c).combine_chunks() for c in range(3))
    buffer, at, kind, chars = assemble(roles, texts)
    bounds = np.concatenate([[0], ends])
    formatted = pa.StringArray.from_buffers(len(ends), pa.py_buffer(at[bounds].astype(np.int32)), buffer)
    per_turn = chars.sum(1)
    own = np.repeat(np.cumsum(per_turn)[bounds[1:] - 1] - np.add.reduceat(per_turn, bounds[:-1]), np.diff(bounds))  # characters before the turn's conversation
    begin = np.cumsum(per_turn) - per_turn - own + chars[:, :3].sum(1)
    learn = np.flatnonzero(kind == ASSISTANT)
    spans = pa.StructArray.from_arrays([pa.array(begin[learn]), pa.array((begin + chars[:, 3])[learn])], ["start", "end"])
    loss = pa.ListArray.from_arrays(pa.array(np.searchsorted(learn, bounds), pa.int32()), spans)
    piece = np.zeros(len(ends), np.int32)
    piece[:1] = first_piece
    return pa.RecordBatch.from_arrays([key.take(pa.array(bounds[:-1])), pa.array(piece), formatted, loss], schema=schema)


def format_chat(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", piece_bytes: int = PIECE) -> DataFrame:
    """(key, piece, formatted, loss) of each conversation."""
    kind = turns.schema[key].dataType.simpleString()
    rows = turns.select(column(key).alias("k"), column(turn).alias("t"), *(F.coalesce(column(c), F.lit("")).cast("binary").alias(n) for c, n in ((role, "r"), (text, "x"))))
    rows = rows.repartition("k").sortWithinPartitions("k", "t", "r", "x").select("k", "r", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, written = None, None  # turns of a conversation that may go on; its key and pieces that went out before

        def out(table: pa.Table, ends: np.ndarray) -> pa.RecordBatch:
            return _rows(table, ends, written[1] if written and written[0] == table.column(0)[0].as_py() else 0, schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            schema = pa.schema([pa.field(key, batch.schema[0].type), ("piece", pa.int32()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held else table
            ends = pc.run_end_encode(table.column(0).combine_chunks()).run_ends.to_numpy()
            last = int(ends[-2]) if len(ends) > 1 else 0
            if last:
                yield out(table.slice(0, last), ends[:-1])
            held = table.slice(last)
            if held.nbytes > piece_bytes:
                mine = held.column(0)[0].as_py()
                yield out(held, np.array([len(held)]))
                written = (mine, written[1] + 1 if written and written[0] == mine else 1)
                held = None
        if held:
            yield out(held, np.array([len(held)]))

    return rows.mapInArrow(run, f"`{key.replace('`', '``')}` {kind}, piece int, formatted string, loss array<struct<start: bigint, end: bigint>>")


def turns_of(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted string, unescaped."""
    marks = [(role, *(m.decode() for m in part)) for role, part in MARKS.items()]
    at = 0
    while at < len(formatted):
        role, begin, named, close = next(m for m in marks if formatted.startswith(m[1], at))
        at += len(begin)
        if named:
            end = formatted.index(named, at)
            role, at = unescape(formatted[at:end]), end + len(named)
        end = formatted.index(close, at)
        yield role, unescape(formatted[at:end])
        at = end + len(close)


def digests(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """Number and digest of the turns, and of what is learned, read back from the formatted strings alone; one row per conversation.

    Pieces of one conversation are read in order, one at a time, where ``format_chat`` has left them: no shuffle.
    """
    kind = formatted.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now, schema = [], None, None

        def close() -> None:
            k, n, turns, size, learned, total = now
            done.append((k, n, turns.hexdigest(), size, learned.hexdigest(), total))

        def batch_of() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True)) if done else [[]] * len(schema)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        for batch in batches:
            schema = pa.schema([pa.field(key, batch.schema[0].type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
            for k, piece, text, loss in zip(*batch.columns, strict=True):
                text = text.as_py()
                if piece.as_py() == 0:
                    if now:
                        close()
                    now = [k.as_py(), 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in turns_of(text):
                    now[1] += 1
                    now[2].update(f"{role}\n{said}\n".encode())
                for span in loss.as_py():
                    said = unescape(text[span["start"] : span["end"]])
                    now[3] += len(said)
                    now[4].update(said.encode())
                now[5] += len(text)
            yield batch_of()
        if now:
            close()
            yield batch_of()

    return formatted.select(key, "piece", "formatted", "loss").mapInArrow(run, f"`{key.replace('`', '``')}` {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    added = spark.sql("SELECT bigint(-7) AS conv_id, bigint(turn) AS turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)")
    return digests(format_chat(given.unionByName(added)))
