"""Service metrics over a request log (event_id, ts, metric, value, cache_hit, user_id)."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HISTORY = 5000


def counters(log: DataFrame) -> DataFrame:
    return log.groupBy("metric").agg(F.count("*").alias("requests"), F.sum("cache_hit").alias("hits"), F.sum(1 - F.col("cache_hit")).alias("misses"))


def latest(log: DataFrame, n: int = HISTORY, salts: int = 32) -> DataFrame:
    """The last n observations of each metric; cut by salted parts first, so that a hot metric is not one task's."""
    last = lambda *by: Window.partitionBy("metric", *by).orderBy(F.col("ts").desc(), F.col("event_id").desc())
    rows = log.withColumn("_salt", F.pmod(F.xxhash64("event_id"), F.lit(salts))).withColumn("_r", F.row_number().over(last("_salt"))).where(F.col("_r") <= n)
    return rows.withColumn("_r", F.row_number().over(last())).where(F.col("_r") <= n).drop("_r", "_salt")


def histogram(log: DataFrame, n: int = HISTORY) -> DataFrame:
    """count, sum, avg, min, max and p99 (nearest rank) of the last n observations."""
    values = F.array_sort(F.collect_list("value"))  # at most n
    at = F.least(F.floor(F.lit(0.99) * F.count("value")), F.count("value") - 1).cast("int") + 1
    return latest(log, n).groupBy("metric").agg(
        F.count("value").alias("count"), F.round(F.sum("value"), 6).alias("sum"), F.round(F.avg("value"), 6).alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"), F.element_at(values, at).alias("p99")
    )


def numbered(log: DataFrame, slices: int = 256) -> DataFrame:
    """Adds rn, the observation's place in its metric from 0: places in a slice of time, after the counts of the slices before."""
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    a, z = log.agg(F.min(ts), F.max(ts)).first()
    at = F.lit(0) if a == z else F.floor((ts - a) / ((z - a) / slices)).cast("int")
    rows = log.withColumn("_slice", F.coalesce(at, F.lit(-1)))
    counts = rows.groupBy("metric", "_slice").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("metric").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("metric", "_slice", F.coalesce(before, F.lit(0)).alias("_before"))  # at most slices + 1 rows a metric
    nth = F.row_number().over(Window.partitionBy("metric", "_slice").orderBy("ts", "event_id"))
    return rows.withColumn("_nth", nth).join(counts, ["metric", "_slice"]).withColumn("rn", F.col("_before") + F.col("_nth") - 1).drop("_slice", "_nth", "_before")


def rolling(log: DataFrame, n: int = HISTORY) -> DataFrame:
    """The same numbers after every observation.

    Observations are cut into blocks of n. The last n of one are the end of the block before, from the
    place after its own, and the beginning of its own block, so each row needs one running value
    from either side, and no task holds more than a slice of time or two blocks. Sums are exact to nine
    decimals, whatever the order of addition. p99 is the order statistic of a sorted window that slides
    through a block after the end of the one before.
    """
    rows = numbered(log.select("event_id", "ts", "metric", "value")).withColumn("_block", F.expr(f"rn div {n}"))
    part = Window.partitionBy("metric", "_block")
    upto, since = part.orderBy("rn").rowsBetween(Window.unboundedPreceding, 0), part.orderBy(F.col("rn").desc()).rowsBetween(Window.unboundedPreceding, 0)
    kinds = {"count": F.count, "sum": lambda c: F.sum(F.col(c).cast("decimal(28,9)")), "min": F.min, "max": F.max}
    both = rows.select("event_id", "metric", "rn", *(f("value").over(upto).alias(f"a_{k}") for k, f in kinds.items()), *(f("value").over(since).alias(f"z_{k}") for k, f in kinds.items()))
    tails = both.select("metric", (F.col("rn") + n - 1).alias("rn"), *(f"z_{k}" for k in kinds)).where(F.expr(f"rn % {n} <> {n - 1}"))  # else its own block is all
    out = both.drop(*(f"z_{k}" for k in kinds)).join(tails, ["metric", "rn"], "left").join(sliding_p99(rows, n), ["metric", "rn"])
    count, total = F.col("a_count") + F.coalesce("z_count", F.lit(0)), F.when(F.coalesce("a_sum", "z_sum").isNotNull(), (F.coalesce("a_sum", F.lit(0)) + F.coalesce("z_sum", F.lit(0))).cast("double"))
    return out.select("event_id", "metric", count.alias("count"), F.round(total, 4).alias("sum"), F.round(total / count, 9).alias("avg"), F.least("a_min", "z_min").alias("min"), F.greatest("a_max", "z_max").alias("max"), "p99")


def sliding_p99(rows: DataFrame, n: int = HISTORY) -> DataFrame:
    """(metric, rn, p99) of the last n observations up to each. rows: metric, rn, _block (rn div n) and value; a group holds two blocks at most."""
    both = rows.select("metric", "rn", "value", "_block", F.lit(True).alias("own")).unionByName(rows.select("metric", "rn", "value", (F.col("_block") + 1).alias("_block"), F.lit(False).alias("own")))

    def slide(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("rn")
        own, values = block["own"].to_numpy(), block["value"].to_numpy(dtype=float)
        first = int((~own).sum())
        out, window = [], []
        for i in range(len(block)):
            if values[i] == values[i]:
                insort(window, values[i])
            if i >= n:  # places are consecutive, so the window begins n rows back
                if values[i - n] == values[i - n]:
                    del window[bisect_left(window, values[i - n])]
            if i >= first:
                out.append(window[min(int(0.99 * len(window)), len(window) - 1)] if window else None)
        rows = block.iloc[first:]
        return pd.DataFrame({"metric": rows["metric"], "rn": rows["rn"], "p99": pd.array(out, "Float64")})

    return both.groupBy("metric", "_block").applyInPandas(slide, "metric string, rn bigint, p99 double")


def gauges(log: DataFrame) -> DataFrame:
    return log.groupBy("metric").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


def hit_rate(log: DataFrame) -> DataFrame:
    """Hits over requests of each metric, and of all ('all')."""
    rows = log.rollup("metric").agg(F.sum("cache_hit").alias("hits"), F.count("*").alias("n"))
    return rows.select(F.coalesce("metric", F.lit("all")).alias("metric"), F.when(F.col("n") > 0, F.col("hits") / F.col("n")).otherwise(0.0).alias("hit_rate"))


def export(log: DataFrame) -> DataFrame:
    """Everything in one nested record."""
    pairs = lambda df, c, name: df.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", c)))).alias(name))  # noqa: E731  one entry per metric
    c, g, h = counters(log), gauges(log), histogram(log)
    return pairs(c, "requests", "counters").join(pairs(g, "value", "gauges")).join(pairs(h, F.struct("count", "sum", "avg", "min", "max", "p99"), "histograms"))
