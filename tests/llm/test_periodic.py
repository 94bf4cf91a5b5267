"""Periodic runs against all periods of all places."""

import hashlib
import random
import re
import zlib

import numpy as np

from partsmith.llm import periodic

DOC = "doc_id bigint, text string, runs int, collapsed string, _text string"


def plain(words, least=12):
    """For each period, the maximal stretches; of equal ones the smallest period."""
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, n, q) for (s, n), q in out.items())


def planted(i, words):
    h, n = zlib.crc32(str(i).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    return words


def expected(i, text):
    words = planted(i, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    runs = plain(words)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    head = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (i, len(runs), *head, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def samples():
    r = random.Random(11)
    out = []
    for size, letters in [(n, a) for n in (0, 1, 11, 12, 13, 40, 200, 700) for a in (1, 2, 3, 8, 300)]:
        out.append([str(r.randrange(letters)) for _ in range(size)])
    for _ in range(120):  # repetitions, nested ones, and ends that differ
        words = [str(r.randrange(50)) for _ in range(r.randint(0, 30))]
        for _ in range(r.randint(1, 4)):
            unit = [str(r.randrange(r.choice([2, 5, 500]))) for _ in range(r.randint(1, 25))]
            if r.random() < 0.3:
                unit = unit * 3 + unit[: r.randint(0, len(unit))]
            words += unit * r.randint(1, 6) + unit[: r.randint(0, len(unit))] + [str(r.randrange(50)) for _ in range(r.randint(0, 9))]
        out.append(words)
    a, b = ["a"], ["a", "b"]
    for _ in range(12):
        a, b = b, b + a
    return [*out, b, ["x"] * 500, ["x", "y"] * 300]


def test_runs_of_words():
    texts = samples()
    for batch in (texts, *([t] for t in texts)):
        found, stay = periodic.runs_of([[w.encode() for w in t] for t in batch])
        for t, rows, s in zip(batch, found, stay, strict=True):
            want = plain(t)
            assert [tuple(map(int, x)) for x in rows] == want, t
            assert [k for k in range(len(t)) if not s[k]] == sorted({k for a, n, q in want for k in range(a + q, a + n)})


def test_grammar_derives_the_words():
    r = np.random.default_rng(2)
    for letters in (1, 2, 7, 400):
        ids = np.sort(r.integers(0, letters, 3))[r.integers(0, 3, 900)] if letters < 3 else r.integers(0, letters, 900)
        part = np.sort(r.integers(0, 5, 900))
        rounds, roots, _ = periodic.grammar(ids, part)
        rules = np.concatenate(rounds)
        text = lambda s, rules=rules: [s] if s < 900 else [x for c in rules[s - 900][:2] for x in text(int(c))]  # noqa: B023, E731
        assert len(roots) == len(set(part.tolist())) and [x for s in roots for x in text(int(s))] == ids.tolist()
        assert len(rounds) < 60


def test_query(spark, tmp_path):
    texts = [" ".join(t) for t in samples()] + [None, "", " \n\t ", "Ünï 字 " * 40, "w " * 50_000, "a\x0bb\x0cc " * 9, "tie " * 12 + "x " + "tie " * 12]
    rows = [(i, t, 1, "x", "y") for i, t in enumerate(texts)] + [(3, texts[40], 1, "x", "y"), (3, texts[40], 1, "x", "y")]
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, periodic.op13_periodic(spark, str(tmp_path)).collect()), key=repr)
    short = [(i, t) for i, t, *_ in rows if t is None or len(t) < 90_000]
    assert [g for g in got if g[0] != texts.index("w " * 50_000)] == sorted((expected(i, t) for i, t in short), key=repr)
    assert periodic.periodic_runs(spark.createDataFrame([], DOC)).count() == 0
