"""The training-data operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import base64
import hashlib
import io
import random
import re
import zipfile
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from partsmith.llm import bpe, brown_lm, common, embedding_dedup, exact_dedup, graph, mixing, secrets, simhash, toxicity, url_filter, warc

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows):
    """Documents with columns whose names operators use inside."""
    rows = [(i, t, "en", s, 0) for i, t, s in rows]
    return spark.createDataFrame(rows, DOC).withColumn("recipe", F.lit("x")).withColumn("fp", F.lit(1)).withColumn("_key", F.lit(2)).withColumn("size", F.lit(3))


@pytest.fixture(scope="module")
def mixed_texts():
    r = random.Random(5)
    words = ["".join(r.choices("abcdefg", k=r.randint(2, 7))) for _ in range(200)]
    texts = [" ".join(r.choices(words, k=r.randint(1, 120))) for _ in range(60)]
    texts += [texts[0], texts[0], texts[1], "", None, " \n\t ", "x", "long " * 30_000, "y" * 200_000, "Ünïcode 字 ñ. Ok! \n" * 50]
    for t in texts[2:12]:
        ws = t.split(" ")
        ws[len(ws) // 2] = "changed"
        texts.append(" ".join(ws))
    return [(i, t, r.choice(["a", "a", "a", "b", "c", None])) for i, t in enumerate(texts)] + [(3, texts[3], "a")]


def test_exact_dedup(spark, mixed_texts):
    got = Counter(tuple(r) for r in exact_dedup.exact_dedup(docs(spark, mixed_texts)).collect())
    groups = {}
    for i, t, _ in mixed_texts:
        groups.setdefault(t or "", []).append(i)
    want = Counter((i, max(g := groups[t or ""]), len(g), i == max(g), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in mixed_texts)
    assert got == want
    kept = exact_dedup.survivors(docs(spark, mixed_texts))
    assert sorted((r["text"] or "") for r in kept.collect()) == sorted(groups)
    assert exact_dedup.exact_dedup(docs(spark, mixed_texts).limit(0)).count() == 0


def test_exact_dedup_takes_wider_identifiers(spark, mixed_texts):
    short = (("length", lambda c: F.length(c)), *exact_dedup.IDENTIFIERS)
    df = docs(spark, mixed_texts)
    assert Counter(map(tuple, exact_dedup.exact_dedup(df, identifiers=short).collect())) == Counter(map(tuple, exact_dedup.exact_dedup(df).collect()))


def test_chunks_join_to_the_text(spark, mixed_texts):
    df = docs(spark, mixed_texts).where("text is not null")
    assert df.where(F.array_join(exact_dedup.chunks(F.col("text")), "") != F.col("text")).count() == 0


def test_mixing(spark, mixed_texts):
    df = docs(spark, mixed_texts)
    rows = mixing.mix(df).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, mixing.mix(df.repartition(7)).collect()))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((i, size(t)) for i, t, _ in mixed_texts)
    total = sum(r["size"] for r in rows)
    per = {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        per.setdefault(r["source"], [r["target"], r["source_size"], 0])[2] += r["taken"]
    assert abs(sum(t for t, _, _ in per.values()) - total) < 1e-6 * total
    for target, own, taken in per.values():
        assert target <= 3 * own and abs(taken - target) <= mixing.BLOCK * 2
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mixed(df).columns == df.columns


def fingerprint(t, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    s = [" ".join(w[j : j + n]) for j in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components(n, linked):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return [find(i) for i in range(n)]


def test_simhash(spark, mixed_texts):
    rows = mixed_texts[:-1]  # ids are unique here
    got = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in simhash.simhash_components(docs(spark, rows)).collect()}
    fps = [fingerprint(t) for _, t, _ in rows]
    comp = components(len(rows), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert got == {i: (fps[i], comp[i]) for i, _, _ in rows}
    assert simhash.simhash_components(docs(spark, rows).limit(0)).count() == 0


def test_simhash_links_of_dense_blocks(spark):
    r = random.Random(8)
    centre = r.getrandbits(64)
    fps = {centre} | {centre ^ sum(1 << b for b in r.sample(range(64), k)) for k in (1, 2, 3, 4, 5) for _ in range(60)} | {r.getrandbits(64) for _ in range(200)}
    fps = sorted(simhash._signed(x) for x in fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp bigint")
    for block in (1024, 8):  # with the small one, blocks are dealt again
        comp = {r["node"]: r["component"] for r in graph.connected_components(simhash.links(df, 2, block)).collect()}
        want = components(len(fps), lambda a, b: ((fps[a] ^ fps[b]) % 2**64).bit_count() <= 2)
        assert [comp.get(x, x) for x in fps] == [fps[c] for c in want]


def test_embeddings(spark):
    r = np.random.default_rng(4)
    base = r.standard_normal((40, 16))
    x = [*base, *(base[:10] + 0.05 * r.standard_normal((10, 16))), *(base[:3] * 2), base[5], base[5]]
    bad = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf"), *[1.0] * 15], [None, *[1.0] * 15], [1.0] * 5]
    rows = [(i, v if v is None or isinstance(v, list) else [float(c) for c in v], 1) for i, v in enumerate([*x, *bad])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("m", F.lit(9)).withColumn("node", F.lit(1))
    good = np.array(x)
    norm = np.sqrt((good * good).sum(1))
    near = (good @ good.T) / np.outer(norm, norm) >= 0.95
    comp = components(len(x), lambda a, b: near[a, b])
    want = {(i, int(near[i].sum()) - 1, comp[i], comp[i] == i) for i in range(len(x))} | {(i, 0, i, True) for i in range(len(x), len(rows))}
    assert {tuple(q) for q in embedding_dedup.near_duplicates(df).collect()} == want
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_recall_at_the_threshold(spark):
    r = np.random.default_rng(12)
    n = 3000
    base = r.standard_normal((n, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = r.standard_normal((n, 64))
    side -= (side * base).sum(1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cos = r.uniform(0.9501, 0.97, n)
    twin = cos[:, None] * base + np.sqrt(1 - cos**2)[:, None] * side
    rows = [(i, [float(c) for c in v]) for i, v in enumerate([*base, *twin])]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).where(f"vec_id >= {n} and component_id = vec_id - {n} and n_links = 1").count()
    assert got >= 0.995 * n


def test_embedding_chunks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CHUNK", 4)
    r = np.random.default_rng(6)
    x = np.ones((30, 8)) + 0.02 * r.standard_normal((30, 8))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    assert {(q["n_links"], q["component_id"]) for q in embedding_dedup.near_duplicates(df).collect()} == {(29, 0)}


def test_warc(spark, tmp_path):
    rows = [(i, f"http://a/{i}\r\nx", t) for i, t in enumerate(["<p>a</p>", "<p>b</p>", "<p>a</p>", "", None, "z" * 300_000, "\r\n\r\n", "<p>a</p>"])] + [(7, None, "<p>a</p>"), (None, "u", "only")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("same", F.lit(0)).withColumn("keep", F.lit(0))
    manifest = warc.write_archives(warc.roles(df).repartition(2), f"file://{tmp_path}/w", per_archive=3)
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_archives(manifest).collect())
    last = {}
    for i, _, t in rows:
        last[t or ""] = max(-1 if i is None else i, last.get(t or "", -1))
    sha = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    revisit = lambda i, t: i is not None and i != last[t]
    assert got == Counter((i, len(t.encode()), sha(t), "revisit" if revisit(i, t) else "response", last[t] if revisit(i, t) else None) for i, _, t in ((i, u, t or "") for i, u, t in rows))
    assert warc.read_archives(warc.write_archives(warc.roles(df.limit(0)), f"file://{tmp_path}/e")).count() == 0


def test_zip_directories(monkeypatch):
    data = io.BytesIO()
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)  # everything takes the wide fields
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    with zipfile.ZipFile(data, "w", zipfile.ZIP_STORED) as z:
        z.writestr("a", b"x" * 1000)
        z.writestr("b/c", b"hello")
        z.comment = b"a comment PK\5\6 with a signature"
    found = warc.members(data, len(data.getvalue()))
    assert {n: data.getvalue()[a : a + k] for n, (a, k) in found.items()} == {"a": b"x" * 1000, "b/c": b"hello"}
    with pytest.raises(ValueError):
        warc.members(io.BytesIO(b"no zip"), 6)


def test_bpe_equals_tiktoken(spark, mixed_texts):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    r = random.Random(9)
    rows = [(i, "".join(r.choices("ab d\n\t\x0b\x1c\x85\u3000é字'sS1٣😀.,<|>", k=r.randint(0, 25))), "a") for i in range(300)] + [(1000 + i, t, s) for i, t, s in mixed_texts]
    got = bpe.decode(bpe.encode_decode(docs(spark, rows), path, P.PATTERN), path, out="again").collect()
    texts = {i: t or "" for i, t, _ in rows}
    for x in got:
        assert x["ids"] == enc.encode_ordinary(texts[x["doc_id"]]) and bytes(x["decoded"]) == texts[x["doc_id"]].encode() == bytes(x["again"])
    assert len(got) == len(rows)


def test_brown_lm(spark, mixed_texts):
    got = brown_lm.lm_scores(docs(spark, mixed_texts), common.bucket("doc_id", 7) == 2).collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    c = Counter(w for i, t, _ in mixed_texts if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t, _ in mixed_texts:
        ws = tokens(t)
        want[(i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws), 4))] += 1
    assert Counter((*(x[k] for k in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")), round(x["base_score"], 4)) for x in got) == want
    assert all(x["score"] < 0 for x in got)
    assert brown_lm.lm_scores(docs(spark, mixed_texts).limit(0), common.bucket("doc_id", 7) == 2).count() == 0


def test_brown_score_by_brute_force(spark, mixed_texts, monkeypatch):
    for name, value in (("TYPES", 40), ("SLOTS", 16), ("END", 56), ("ALL", 57), ("CLASSES", 6)):
        monkeypatch.setattr(brown_lm, name, value)
    seen = []
    real = brown_lm.model_of
    monkeypatch.setattr(brown_lm, "model_of", lambda around, classes, sizes: seen.append(classes) or real(around, classes, sizes))
    got = brown_lm.lm_scores(docs(spark, mixed_texts), common.bucket("doc_id", 7) == 2).collect()
    classes = seen[-1]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    words = lambda t: (t or "").encode().lower().split()
    training = [words(t) for i, t, _ in mixed_texts if not held(i)]
    n = Counter(w for ws in training for w in ws)
    own = {w: k for k, w in enumerate(sorted(n, key=lambda w: (-n[w], w))[:40])}
    type_of = lambda w: own.get(w, 40 + zlib.crc32(w) % 16)
    size, moves, slot_n, slot_v = Counter(), Counter(), Counter(), Counter()
    for ws in training:
        path = [56, *map(type_of, ws), 56]
        size.update(path[1:])
        moves.update(zip(classes[path[:-1]].tolist(), classes[path[1:]].tolist()))
    for w in n:
        if w not in own:
            slot_n[type_of(w)] += n[w]
            slot_v[type_of(w)] += 1
    a, b = brown_lm.ALPHA, brown_lm.BETA

    def score(ws):
        out, before = 0.0, classes[56]
        for w in [*ws, None]:
            t = 56 if w is None else type_of(w)
            c = classes[t]
            out += np.log10((moves[before, c] + b) / (sum(moves[before, k] for k in range(6)) + b * 6))
            out += np.log10((size[t] + a) / (sum(size[k] for k in range(57) if classes[k] == c) + a * sum(classes == c)))
            out += 0 if w is None or w in own else np.log10((n[w] + a) / (slot_n[t] + a * (slot_v[t] + 1)))
            before = c
        return out

    want = Counter((i, round(score(words(t)), 6)) for i, t, _ in mixed_texts if len(t or "") < 50_000)
    assert Counter((x["doc_id"], round(x["score"], 6)) for x in got if len(dict((i, t or "") for i, t, _ in mixed_texts)[x["doc_id"]]) < 50_000) == want


def test_exchange_finds_the_classes(monkeypatch):
    for name, value in (("TYPES", 30), ("SLOTS", 0), ("END", 30), ("ALL", 31), ("CLASSES", 4)):
        monkeypatch.setattr(brown_lm, name, value)
    r = random.Random(3)
    seq = [30]
    for _ in range(4000):  # words 0 to 9, then 10 to 19, then 20 to 29, then an end
        seq += [r.randrange(10), 10 + r.randrange(10), 20 + r.randrange(10), 30]
    sizes = np.bincount(seq[1:], minlength=31).astype(float)
    classes = np.array([r.randrange(3) for _ in range(30)] + [3])

    def around(classes):
        out = np.zeros((31, 2, 4))
        for x, y in zip(seq, seq[1:]):
            out[x, 0, classes[y]] += 1
            out[y, 1, classes[x]] += 1
        return out

    def likelihood(classes):
        moves, emits = brown_lm.model_of(around(classes), classes, sizes)
        return sum(moves[classes[x], classes[y]] + emits[y] for x, y in zip(seq, seq[1:]))

    before = likelihood(classes)
    for _ in range(6):
        now = brown_lm.exchange(around(classes), classes, sizes)
        assert likelihood(now) >= likelihood(classes) - 1e-6
        classes = now
    assert likelihood(classes) > before and [len(set(classes[k : k + 10])) for k in (0, 10, 20)] == [1, 1, 1] and len(set(classes)) == 4


def test_class_model_is_a_distribution():
    r = np.random.default_rng(1)
    classes = r.integers(0, brown_lm.CLASSES, brown_lm.ALL)
    around, sizes = r.integers(0, 3, (brown_lm.ALL, 2, brown_lm.CLASSES)).astype(float), r.integers(0, 50, brown_lm.ALL).astype(float)
    moves, emits = brown_lm.model_of(around, classes, sizes)
    assert np.allclose((10**moves).sum(1), 1) and np.allclose(np.bincount(classes, 10**emits, brown_lm.CLASSES), 1)


def test_secrets(spark):
    key = "q7RkZ2mX9vB4nL8sT1wY6cJ3hF5dG0pA"
    texts = [f'token = "{key}"', "AKIA" + "A1" * 8, "ab" * 12, f"private client: {key}", "private my_service_name_1_configuration_environment", None, "", "PassWord:=x password: abc", "password: hunter2 字 secret=abcdef", "token" * 5000]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secrets.secret_spans(docs(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()}
    assert got[0] == [("assign", 0, 9 + len(key))] and got[1] == [("access", 0, 20)] and got[2] == [("hex", 0, 24)]
    assert got[3] == [("novel", 16, 16 + len(key))] and got[4] == got[5] == got[6] == got[7] == got[9] == []
    assert got[8] == [("assign", 0, 17), ("assign", 20, 33)]


def test_secrets_by_brute_force(spark):
    r = random.Random(21)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    words = "invoice shipment garden weather bicycle journal tractor pebble harbor lantern mosaic orchard".split()
    prose = "the connection is opened by the client and the value is read from the configuration before the request is sent "
    rows, planted = [], {}
    for i in range(240):
        key = "".join(r.choices(letters, k=r.randint(20, 40))) if i % 2 else "_".join(r.sample(words, 4)) + str(r.randint(1, 9))
        text = prose[r.randrange(40) :] + r.choice(["private key id ", "字 credential for it = ", "bearer ", "passphrase, session "]) + key + ", " + prose
        rows.append((i, text, "a"))
        planted[i] = (text.index(key), text.index(key) + len(key))
    rows += [(900, "token " * 3 + "q7RkZ2mX9vB4nL8sT1wY6cJ3hF5dG0pA" * 400, "a"), (901, "", "a"), (902, None, "a"), (0, rows[0][1], "a"), (903, "secret " + "A" * 300_000, "a")]

    def brute(text):
        """Every run near every sensitive word, straight from the definition."""
        text, found = text or "", set()
        base = secrets.patterns(text)
        for m in re.finditer(r"[A-Za-z0-9+/_.=-]+", text):
            a, b = m.span()
            near = any(max(0, a - 100) + w.end() >= a - secrets.REACH for w in secrets.NEAR.finditer(text[max(0, a - 100) : a]))
            if near and b - a >= secrets.LEAST and re.search("[A-Za-z]", m[0]) and re.search("[0-9]", m[0]) and not any(x < b and a < y for _, x, y in base) and secrets.novelty(text, a, b) >= secrets.NOVELTY:
                found.add((a, b))
        return found

    got = secrets.secret_spans(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    spans = {x["doc_id"]: {(q["start"], q["end"]) for q in x["spans"] if q["kind"] == "novel"} for x in got}
    assert spans == {i: brute(t) for i, t, _ in rows}
    caught = sum(planted[i] in spans[i] for i in range(1, 240, 2))
    false = sum(bool(spans[i]) for i in range(0, 240, 2))
    assert caught >= 114 and false <= 6, (caught, false)
    assert secrets.secret_spans(docs(spark, rows).limit(0)).count() == 0


def test_many_url_rules(spark):
    rules = [("block" if i % 3 else "allow", f"h{i}.com", "/" if i % 2 else "/ab/") for i in range(300_000)]
    rows = [(i, f"http://x.h{i * 7 % 400_000}.com/{'ab/' if i % 5 else ''}") for i in range(3000)]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.url_verdicts(spark.createDataFrame(rows, "page_id bigint, url string"), rules).collect()}
    for i, _ in rows:
        n = i * 7 % 400_000
        fits = n < 300_000 and (n % 2 or i % 5)
        assert got[i] == ((f"h{n}.com" + ("/" if n % 2 else "/ab/"), "block" if n % 3 else "allow") if fits else (None, "allow"))


def test_urls(spark):
    urls = ["http://a.net/x", "https://Example.NET/en/1?x", "https://b.example.net/en/", "http://example.com/de/", "http://xexample.com/de/", "http://m.example.com/fr/", "http://x.org/fr/#", "http://x.org?/fr/", None, "", "nothing", "http://net", "http://net/", "x://a..net/\n?", "http://.net/"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(0, urls[0])]
    df = spark.createDataFrame(rows, "page_id bigint, url string").withColumn("key", F.lit("k")).withColumn("rule", F.lit("r"))

    def judge(u):
        host, path = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u).groups() if u and "://" in u else ("", "")
        host = host.lower()
        fits = [(len(h + p), h + p, a) for a, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits) if fits else (0, None, "allow")
        return host, path, best[1], best[2]

    want = Counter((i, *judge(u)) for i, u in rows)
    assert Counter(tuple(r) for r in url_filter.url_verdicts(df, url_filter.RULES).collect()) == want
    assert url_filter.url_verdicts(df.limit(0), url_filter.RULES).count() == 0


def test_cascade_is_exact(spark):
    listed = spark.range(0, 3000, 3).select(F.col("id").cast("string").alias("key"))
    universe = spark.range(3000).select(F.col("id").cast("string").alias("key"))
    levels = url_filter.cascade("t", listed, listed.count(), universe, 3000)
    beside = universe
    for f in levels:
        beside = beside.crossJoin(f.row)
    assert {r["key"] for r in beside.where(url_filter.member(levels, F.col("key"))).collect()} == {str(i) for i in range(0, 3000, 3)}


def test_toxicity(spark):
    r = random.Random(7)
    words = ["".join(r.choices("bcdfgaeiou", k=r.randint(3, 8))) for _ in range(400)]
    rows, marks = [], []
    for i in range(1200):
        ws, bad = r.choices(words, k=40), i % 3 == 0
        if bad:
            for _ in range(3):
                ws[r.randrange(40)] = r.choice(["slimeball", "nitwitted"])
        rows.append((i, " ".join(ws), "a"))
        marks.append((i, 1 if bad else 0))
    rows += [(1500, None, "a"), (1501, "", None), (1502, "w" * 300_000, "a"), (1503, "long " * 50_000, "a"), (1504, " .,! ", "b"), (3, rows[3][1], "a")]
    labels = spark.createDataFrame([*marks, (5000, None), (7, 0)], "doc_id bigint, toxic int")
    df = docs(spark, rows).withColumn("f", F.lit(1)).withColumn("score", F.lit("s")).withColumn("a.b", F.lit(2))
    model = toxicity.train(toxicity.labelled(df, labels))
    got = df.select("doc_id", "text", toxicity.score(df, model).alias("p")).collect()
    scores = {x["doc_id"]: x["p"] for x in got}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in scores.values())
    held = [(i, bad) for i, bad in marks if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((scores[i] >= toxicity.REJECT) != bool(bad) for i, bad in held) <= len(held) // 20
    (far, near), weights, offset = model  # the score by brute force: every window's lengths under both dictionaries
    for i, t, _ in rows[:20] + rows[-6:]:
        ws = (t or "").lower().encode().translate(None, toxicity.PUNCTUATION).split()
        cut = [b" " + b" ".join(ws[k : k + toxicity.WINDOW]) + b" " for k in range(0, len(ws), toxicity.WINDOW)]
        size = lambda d, w: len(toxicity.compressor(d).compress(w))
        d = np.array([size(far, w) - size(near, w) for w in cut[:400]] or [0])
        assert cut == toxicity.windows(t or "")
        if len(cut) <= 400:
            over = [(d >= k).sum() for k in toxicity.THRESHOLDS]
            x = np.log1p(np.maximum(0, [d.max(), np.sort(d)[-3:].mean(), d.mean(), *over, *(n / len(d) for n in over[1:4]), d.clip(0).sum(), ((d - 1).clip(0) ** 2).sum()]))
            assert abs(scores[i] - 1 / (1 + np.exp(-(x @ weights + offset)))) < 1e-9
    kept = toxicity.survivors(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(x["p"] < toxicity.REJECT for x in got)
    none = toxicity.train(toxicity.labelled(df, labels.limit(0)))
    assert df.select(toxicity.score(df, none).alias("p")).where("p > 0.01").count() == 0
    assert toxicity.survivors(df.limit(0), labels).count() == 0


def test_toxic_dictionaries_hold_what_recurs():
    r = random.Random(9)
    words = ["".join(r.choices("bcdfgaeiou", k=r.randint(3, 8))) for _ in range(400)]
    window = lambda bad: (" " + " ".join(r.choices(words, k=3) + ([bad] if bad else []) + r.choices(words, k=4)) + " ").encode()
    toxic = [(window(r.choice(["slimeball", "nitwitted", None])), bool(r.getrandbits(1))) for _ in range(1500)]
    ordinary = [(window(None), bool(r.getrandbits(1))) for _ in range(3000)]
    far, near = toxicity.fit(toxic, ordinary)
    assert len(far) == len(near) and b" slimeball " in near and b" nitwitted " in near and b"slimeball" not in far
    gain = lambda w: len(toxicity.compressor(far).compress(w)) - len(toxicity.compressor(near).compress(w))
    fresh = [window("slimeball") for _ in range(100)]
    assert np.mean([gain(w) for w in fresh]) > 2 and abs(np.mean([gain(window(None)) for _ in range(100)])) < 0.5


def test_narrowed_tails_keep_short_words():
    r = random.Random(10)
    noise = [("".join(r.choices("bcdfgaeiou", k=r.randint(5, 12)))).encode() for _ in range(3000)]
    short, often = [b"scum", b"moron", b"zq"], noise[:40]
    cores = [b" " + w + b" " for w in noise + 15 * often + 60 * short]
    r.shuffle(cores)
    tail = toxicity.narrowed(cores)
    assert all(b" " + w + b" " in tail for w in short) and sum(b" " + w + b" " in tail for w in noise[40:]) < 5  # what comes once is left out


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(60)] + [(500, 500)]
    got = {x["node"]: x["component"] for x in graph.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    linked = {frozenset(e) for e in edges}
    comp = components(502, lambda a, b: frozenset((a, b)) in linked)
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: comp[n] for n in nodes}
