"""Chat formatting against a plain reading of the turns."""

import hashlib
import random

from pyspark.sql import functions as F

from partsmith.llm import chat

TURNS = "conv_id bigint, turn bigint, role string, text string, piece int, formatted string, k string, loss int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 5, "x", "y", 1) for r in rows], TURNS)  # columns whose names the operator uses inside


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows):
    out = {}
    for c, t, r, x in sorted(rows, key=lambda q: (q[0] is not None, q[0] or 0, q[1] is not None, q[1] or 0, q[2] or "", q[3] or "")):
        out.setdefault(c, []).append((r or "", x or ""))
    return {c: (len(q), sha("".join(f"{r}\n{x}\n" for r, x in q)), len(y := "".join(x for r, x in q if r == "assistant")), sha(y)) for c, q in out.items()}


def sample(n=60):
    r = random.Random(3)
    parts = ["a", "Ünï 字😀", "</s>", "<s>", "[INST] ", " [/INST]", "[\\/INST]", "<\\\\/s>", "[ROLE]", "[/ROLE]", "[END]", "<", "[", "\\", "/s>", "END]", "\n", " ", "[SYS] x [/SYS]"]
    rows = []
    for c in range(n):
        for t in range(r.randint(1, 9)):
            rows.append((c, t, r.choice(["user", "assistant", "system", "tool", "a[/ROLE]b", "", None]), r.choice([None, "", *["".join(r.choices(parts, k=r.randint(1, 12)))] * 5])))
    rows += [(None, 1, "user", "<"), (None, None, "assistant", "/s>"), (None, 1, "user", "<"), (7, 1, "assistant", "tie"), (7, 1, "assistant", "tie"), (n, 0, "assistant", "long </s> " * 300_000)]
    rows += [(n + 1, t, "assistant" if t % 2 else "user", f"turn {t} [INST]") for t in range(25_000)]  # a conversation of many batches
    return rows


def test_turns_come_back(spark):
    rows = sample()
    want = plain(rows)
    for piece in (chat.PIECE, 2_000):
        done = chat.format_chat(frame(spark, rows), piece_bytes=piece)
        found = chat.digests(done).collect()
        assert {r["conv_id"]: tuple(r)[1:5] for r in found} == want and len(found) == len(want)
        assert sum(r["formatted_chars"] for r in found) == done.agg(F.sum(F.length("formatted"))).first()[0]
        numbers = {}
        for r in done.select("conv_id", "piece").collect():
            numbers.setdefault(r["conv_id"], []).append(r["piece"])
        assert all(sorted(p) == list(range(len(p))) for p in numbers.values())
        assert all(len(p) == 1 for p in numbers.values()) if piece == chat.PIECE else len(numbers[61]) > 1


def test_formatted_text(spark):
    rows = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (-7, 2, "tool", "é")]
    r = chat.format_chat(frame(spark, rows)).first()
    assert r["formatted"] == "[INST] <\\/s>[\\INST] ok [\\/INST] [/INST]\n<s><\\/s>[\\INST] ok [\\/INST]</s>\n[ROLE]tool[/ROLE]é[END]\n"
    (span,) = r["loss"]
    assert chat.unescape(r["formatted"][span["start"] : span["end"]]) == "</s>[INST] ok [/INST]"


def test_empty_table(spark):
    assert chat.digests(chat.format_chat(frame(spark, []))).count() == 0


def test_query_has_the_added_conversation(spark):
    from oracle import SF

    found = {r["conv_id"]: r for r in chat.op11_chat(spark, SF).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    want = plain([*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)])
    assert {c: tuple(r)[1:5] for c, r in found.items()} == want
