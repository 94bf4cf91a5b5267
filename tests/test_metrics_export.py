"""The nested metrics record, value by value, and p99 of a sliding window."""

import random

from pyspark.sql import functions as F

from partsmith.operators import metrics

LOG = "event_id bigint, ts bigint, metric string, value double, cache_hit int, user_id int"


def test_export_holds_the_numbers(spark):
    r = random.Random(6)
    rows = [(i, r.randrange(50), r.choice("ab"), float(r.randint(0, 99)), r.randint(0, 1), 0) for i in range(500)]
    got = metrics.export(spark.createDataFrame(rows, LOG)).first()
    for m in "ab":
        own = sorted((x for x in rows if x[2] == m), key=lambda x: (x[1], x[0]))
        values = sorted(x[3] for x in own)
        assert got["counters"][m] == len(own) and got["gauges"][m] == own[-1][3]
        h = got["histograms"][m]
        assert (h["count"], h["sum"], h["min"], h["max"]) == (len(own), sum(values), values[0], values[-1])
        assert h["p99"] == values[min(int(0.99 * len(values)), len(values) - 1)] and abs(h["avg"] - sum(values) / len(values)) < 1e-5


def test_sliding_p99(spark):
    r = random.Random(7)
    rows = [(i, r.randrange(400), r.choice("aab"), None if r.random() < 0.1 else float(r.randint(0, 30)), 0, 0) for i in range(900)]
    df = spark.createDataFrame(rows, LOG).withColumn("ts", F.timestamp_seconds("ts"))
    for n in (1, 7, 150):
        got = {x["event_id"]: x["p99"] for x in metrics.rolling(df, n).collect()}
        for m in "ab":
            own = sorted((x for x in rows if x[2] == m), key=lambda x: (x[1], x[0]))
            for k, x in enumerate(own):
                vs = sorted(v[3] for v in own[max(0, k - n + 1) : k + 1] if v[3] is not None)
                assert got[x[0]] == (vs[min(int(0.99 * len(vs)), len(vs) - 1)] if vs else None)
