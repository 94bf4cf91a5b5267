"""Collocations against plain counting, and the filters against the keys that went in."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from partsmith.llm import collocations as C

DOC = "doc_id bigint, text string, lang string, block int, ids string, a int, left string, word string"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def plain(rows, least, longest=5, top=None):
    f, n = Counter(), Counter()
    for t, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(t or "")):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(ws)
            f.update((lang or "und", tuple(ws[i : i + k])) for k in range(1, longest + 1) for i in range(len(ws) - k + 1))
    found = {g: a for g, a in f.items() if a >= least and len(g[1]) > 1}
    inside = Counter()
    for (lang, g), a in found.items():
        for i in range(len(g)):
            for j in range(i + 1, len(g) + 1):
                if j - i < len(g):
                    inside[lang, g[i:j]] = max(inside[lang, g[i:j]], a)
    out = {}
    for (lang, g), a in found.items():
        if 100 * inside[lang, g] < 100 * a:
            score, k = min((1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g)))
            out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    return {(lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)}


def sample():
    r = random.Random(4)
    words = [*"abcdefg", "Ünï", "字", "A", "x\x00y", " ", "-"]
    rows = []
    for _ in range(150):
        ws = r.choices(words, weights=range(len(words), 0, -1), k=r.randint(0, 60))
        rows.append(("".join(w + r.choice([" ", " ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "!?"]) for w in ws), r.choice(["en", "en", "en", "de", "und", None])))
    rows += [("a a a a a a a a", "en"), ("long phrase " * 4000, "de"), (None, "fr"), ("", None), ("B C. " * 300, "fr"), rows[0], rows[0]]
    return rows


@pytest.mark.parametrize("least, block, size", [(5, C.BLOCK, C.RANGE), (5, 200, 64), (40, 1000, 1 << 20)])
def test_collocations(spark, least, block, size):
    rows = sample()
    df = spark.createDataFrame([(i, t, lang, 1, "x", 2, "y", "z") for i, (t, lang) in enumerate(rows)], DOC)
    for top in (None, 7):
        got = C.collocations(df, least=least, top=top, block=block, size=size).collect()
        want = plain(rows, least, top=top)
        assert len(got) == len(want) and {tuple(g) for g in got} == want and want


def test_nothing_to_count(spark):
    df = spark.createDataFrame([], DOC)
    assert C.collocations(df).count() == 0
    assert C.collocations(spark.createDataFrame([(1, None, None, 1, "", 1, "", ""), (2, "a b c", "en", 1, "", 1, "", "")], DOC)).count() == 0


def test_filters_lose_nothing():
    r = np.random.default_rng(1)
    for width in (1, 2, 7, 34, 63, 64):
        for n in (1, 5, 3000):
            keys = np.unique(r.integers(0, 1 << width, n, np.uint64, False) if width < 64 else r.integers(0, 1 << 64, n, np.uint64))
            mixed = C.permute(keys, width)
            assert len(np.unique(mixed)) == len(keys) and (mixed >> np.uint64(width - 1) <= 1).all()
            assert (C.unpermute(mixed, width) == keys).all()
            counts = np.where(r.random(len(keys)) < 0.1, r.integers(250, 1 << 40, len(keys)), 3)
            back = C.read_filter(memoryview(C.filter_of(keys, counts, width)))
            assert (back[0] == keys).all() and (back[1] == counts).all()


def test_merged_filters():
    r = np.random.default_rng(3)
    parts = [np.unique(r.integers(0, 500, 300, np.uint64), return_counts=True) for _ in range(9)]
    want = Counter()
    for keys, counts in parts:
        want.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
    keys, counts = C.merge(parts)
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == want and sorted(want) == keys.tolist()


def test_dictionaries_come_in_small_rows(spark, monkeypatch):
    monkeypatch.setattr(C, "ENTRIES", 7)
    texts = [(" ".join(f"w{(i * k) % 50}" for k in range(1, 60)), "en" if i % 2 else None) for i in range(40)]
    df = spark.createDataFrame(texts, "text string, lang string").coalesce(2)
    rows = C.blocks(df, "text", "lang", 500).collect()
    assert max(len(x["words"]) for x in rows) == 7 and all((x["codes"] is None) == (x["at"] > 0) == (not x["sizes"]) for x in rows)
    assert len({(x["block"], x["at"]) for x in rows}) == len(rows) > len({x["block"] for x in rows}) > 2
    got = C.collocations(df, least=5, block=500, size=64).collect()
    assert {tuple(x[k] for k in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for x in got} == plain(texts, 5, top=2000)
