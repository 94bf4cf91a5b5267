"""The pipeline's near-duplicate stage against all pairs of fingerprints."""

import random

import corpus_pipeline
from partsmith.llm import simhash


def test_fingerprints_decide_near_copies(spark):
    r = random.Random(41)
    words = ["".join(r.choices("abcdefghij", k=r.randint(3, 8))) for _ in range(2000)]
    texts = []
    for i in range(40):
        ws = r.choices(words, k=600)
        texts.append(" ".join(ws))
        if i % 2:  # scattered or repeated words changed: linked by bits or not, whatever the sets of shingles share
            for k in range(0, 600, 25 if i % 4 == 1 else 300):
                ws[k] = f"x{k}"
            texts.append(" ".join(ws))
    line = "one line that stands again and again in pages "
    texts += [line * 200 + texts[0][:200], line * 200 + texts[2][:200], "", None]  # far apart as sets, one fingerprint
    fps = [simhash.fingerprint((t or "").encode()) for t in texts]
    near = [[(a ^ b).bit_count() <= 2 for b in fps] for a in fps]
    name = list(range(len(fps)))
    for a in range(len(fps)):
        for b in range(a):
            if near[a][b] and name[a] != name[b]:
                low, high = sorted((name[a], name[b]))
                name = [low if x == high else x for x in name]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("doc_id", "text", "1 as f")
    kept = corpus_pipeline.near_copies_out(spark, df, "")
    assert kept.columns == df.columns and {x["doc_id"] for x in kept.collect()} == set(name)
    assert name[-3] == name[-4] and len(set(name)) < len(name) - 2
