"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

Every source has a target of words: its weight's share of the whole corpus, at most ``MOST_REPEATS``
times its own size, what is above being shared again by weight. Targets are met in blocks of
``BLOCK`` words. Blocks go to sources by highest quotients target / (2 k - 1), then each source's
blocks to its shards (seeded parts of about ``SHARD_WORDS`` words) by highest quotients words /
(2 k - 1), which gives integer quotas. In a shard the documents stand in seeded order, end to end,
as a ring of words; its quota of blocks is laid on that ring one after the other from the start of
the order. So documents are taken whole, as often as every other document of the shard or once
less, but for the one where the last block ends.

Only rows of a shard are sorted together; sources and shards are aggregates. A hot source has as
many shards as its size asks for. Quotas depend on sizes and seeds only, so reruns agree.

Defined cases: a null text has no words and is taken 0 times; null sources are a source of their
own, last in order; a source without words has target 0; repeated rows each count; an empty table
gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, as_string, free, materialize

WEIGHTS, MOST_REPEATS, BLOCK, SHARD_WORDS, MAX_SHARDS, SEED = (5, 2, 1), 3, 8, 131_072, 4096, "mix-1"


def word_count(text: str) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """From (source, source_size): adds weight and target. One row per source, so a few windows over all.

    Water filling: in order of cap / weight, the first sources are those that stop at their cap; the
    rest share what is left by weight. A source is capped if its cap is below its share of what the
    sources before it leave.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    n = (F.row_number().over(in_order) - 1) % len(weights)
    rows = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (n + 1).cast("int")).cast("long"))
    rows = rows.withColumn("cap", F.col("source_size") * most)
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    heavy = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    rows = rows.withColumn("left", left).withColumn("heavy", heavy)
    rows = rows.withColumn("capped", F.col("cap") * F.col("heavy") < F.col("left") * F.col("weight"))
    first_free = F.min(F.when(~F.col("capped"), F.struct((F.col("cap") / F.col("weight")).alias("r"), (F.col("source").isNull()).alias("z"), F.col("source"), F.col("left"), F.col("heavy")))).over(everything)
    rows = rows.withColumn("free", first_free)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("free.left") * F.col("weight") / F.col("free.heavy"))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def sainte_lague(rows: DataFrame, group: list[str], name: list[str], claim: str, cap: str, seats) -> DataFrame:
    """Adds ``quota``: of each group's ``seats``, as many as go to the row by highest quotients claim / (2 k - 1).

    ``name`` breaks ties; no row gets more than ``cap``. Two divisors bound every row's seats from
    below and above so tightly that a group of n rows has at most 2 n + 2 quotients left to rank.
    """
    w = Window.partitionBy(*group)
    n, total = F.count("*").over(w), F.sum(claim).over(w)
    rows = rows.withColumn("_seats", seats).withColumn("_n", n).withColumn("_total", total)
    at = lambda m: F.when((F.col("_total") > 0) & (m > 0), F.floor(F.col(claim) * m / F.col("_total") + 0.5)).otherwise(0).cast("long")
    rows = rows.withColumn("_low", F.least(F.col(cap), at(F.col("_seats") - F.col("_n") / 2 - 1)))
    rows = rows.withColumn("_high", F.least(F.col(cap), at(F.col("_seats") + F.col("_n") / 2 + 1)))
    rest = F.col("_seats") - F.sum("_low").over(w)
    open_ = rows.withColumn("_rest", rest).where("_high > _low").withColumn("_k", F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))))
    ranked = open_.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy((F.col(claim) / (2 * F.col("_k") - 1)).desc(), *(F.col(c).asc_nulls_last() for c in name))))
    won = ranked.where("_rank <= _rest").groupBy(*group, *name).agg(F.count("*").alias("_won"))
    won = won.select(*(F.col(c).alias(f"_won_{c}") for c in [*group, *name]), "_won")
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_won_{c}")) for c in [*group, *name]))
    keep = [c for c in rows.columns if not c.startswith("_")]
    return rows.join(won, same, "left").select(*keep, (F.col("_low") + F.coalesce("_won", F.lit(0))).alias("quota"))


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: str = SEED, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per row: key, size, source, source_size, target, taken (words that the mix takes, repeats counted)."""
    rows = materialize(docs.select(F.col(key).alias(key), F.col(source).alias("source"), word_count(text).alias("size")), "mix-sizes")
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    everything = Window.partitionBy()
    targets = sainte_lague(
        targets.withColumn("most_blocks", F.ceil(F.col("source_size") * most / block)).withColumn("all_words", F.sum("source_size").over(everything)),
        [], ["source"], "target", "most_blocks", F.round(F.col("all_words") / block).cast("long"),
    ).withColumnRenamed("quota", "source_quota")
    n_shards = F.greatest(F.lit(1), F.least(F.lit(MAX_SHARDS), F.ceil(F.col("source_size") / shard_words)))
    targets = materialize(targets.select("source", "source_size", "target", "source_quota", n_shards.alias("shards")), "mix-targets")
    draw = F.md5(F.concat(F.lit(seed + ":"), as_string(key)))
    targets = targets.withColumnRenamed("source", "_source")
    dealt = rows.withColumn("draw", draw).join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    dealt = dealt.withColumn("shard", F.conv(F.substring("draw", 25, 8), 16, 10).cast("long") % F.col("shards"))
    per_shard = dealt.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.first("source_quota").alias("source_quota"))
    quotas = sainte_lague(
        per_shard.withColumn("most_blocks", F.ceil(F.col("words") * most / block)), ["source"], ["shard"], "words", "most_blocks", F.col("source_quota")
    ).select(F.col("source").alias("_s"), F.col("shard").alias("_h"), "words", "quota")
    placed = dealt.join(quotas, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_h")))
    seeded = Window.partitionBy("source", "shard").orderBy("draw", key, "size").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("size").over(seeded)
    laid = F.least(F.col("quota") * block, F.col("words") * most)
    turns = F.when(F.col("words") > 0, F.expr("laid div words")).otherwise(0)
    placed = placed.withColumn("end", end).withColumn("laid", laid).withColumn("turns", turns)
    over = F.least(F.col("size"), F.greatest(F.lit(0), F.col("laid") - F.col("turns") * F.col("words") - (F.col("end") - F.col("size"))))
    return placed.select(key, "size", "source", "source_size", "target", (F.col("size") * F.col("turns") + over).alias("taken"))


def mixed(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The documents that the mix takes, each as often as it takes it whole or in part, other columns as they came.

    A document is repeated ceil(taken / size) times; one that the mix doesn't take is left out, but
    for documents without words, which take no room and stay. Rows that share a key
    are taken as often as the most taken of them.
    """
    sizes = mix(docs, key=key, **options)
    own, often, copy = (free(docs, n) for n in ("_key", "_times", "_copy"))
    times = F.max(F.when(F.col("size") == 0, 1).otherwise(F.ceil(F.col("taken") / F.col("size")))).cast("int")
    taken = sizes.groupBy(F.col(key).alias(own)).agg(times.alias(often)).where(F.col(often) > 0)
    rows = docs.join(taken, F.col(key).eqNullSafe(F.col(own))).drop(own)
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(often)))).drop(often, copy)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")




#: The same mix by brute force: every quotient of every source and shard is ranked. ``docs`` names the table.
def mixing_ctes(docs: str = "documents") -> str:
    return f"""
mx_rows AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS draw FROM {docs}),
mx_s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM mx_rows GROUP BY source),
mx_s1 AS (SELECT *, {MOST_REPEATS} * source_size AS cap, [{', '.join(map(str, WEIGHTS))}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS weight FROM mx_s0),
mx_s2 AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0))::BIGINT AS rest, (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::BIGINT AS heavy
  FROM mx_s1 WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
mx_free AS (SELECT rest AS f_rest, heavy AS f_heavy FROM mx_s2 WHERE NOT cap * heavy < rest * weight ORDER BY cap / weight, source NULLS LAST LIMIT 1),
mx_s3 AS (SELECT source, source_size, CASE WHEN cap * heavy < rest * weight THEN cap::DOUBLE ELSE (f_rest * weight)::DOUBLE / f_heavy END AS target,
  greatest(1, least({MAX_SHARDS}, ceil(source_size / {SHARD_WORDS})))::BIGINT AS shards FROM mx_s2 LEFT JOIN mx_free ON true),
mx_q AS (SELECT source, target, unnest(range(1, ceil({MOST_REPEATS} * source_size / {BLOCK})::BIGINT + 1)) AS k FROM mx_s3),
mx_won AS (SELECT source, count(*) AS source_quota FROM (SELECT source, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, source NULLS LAST) AS r FROM mx_q)
  WHERE r <= (SELECT round(sum(source_size) / {BLOCK}) FROM mx_s3) GROUP BY source),
mx_h AS (SELECT d.doc_id, d.size, d.draw, d.source, s.source_size, s.target, coalesce(source_quota, 0) AS source_quota, ('0x' || substr(draw, 25, 8))::BIGINT % shards AS shard
  FROM mx_rows d JOIN mx_s3 s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN mx_won q ON s.source IS NOT DISTINCT FROM q.source),
mx_w AS (SELECT source, shard, sum(size)::BIGINT AS words, any_value(source_quota) AS source_quota FROM mx_h GROUP BY source, shard),
mx_hq AS (SELECT source, shard, source_quota, words, unnest(range(1, ceil({MOST_REPEATS} * words / {BLOCK})::BIGINT + 1)) AS k FROM mx_w),
mx_hwon AS (SELECT source, shard, count(*) AS quota FROM (SELECT source, shard, source_quota, row_number() OVER (PARTITION BY source ORDER BY words / (2 * k - 1) DESC, shard) AS r FROM mx_hq)
  WHERE r <= source_quota GROUP BY source, shard),
mx_p AS (SELECT h.*, words, least(coalesce(quota, 0) * {BLOCK}, words * {MOST_REPEATS}) AS laid,
  (sum(size) OVER (PARTITION BY h.source, h.shard ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS begins
  FROM mx_h h JOIN mx_w w ON h.source IS NOT DISTINCT FROM w.source AND h.shard = w.shard LEFT JOIN mx_hwon q ON h.source IS NOT DISTINCT FROM q.source AND h.shard = q.shard),
mixed_sizes AS (SELECT doc_id, size, source_size, target, (CASE WHEN words = 0 THEN 0 ELSE size * (laid // words) + least(size, greatest(0, laid - (laid // words) * words - begins)) END)::BIGINT AS taken FROM mx_p)"""


OP2_SQL = f"WITH {mixing_ctes()} SELECT doc_id, size, source_size, target, taken FROM mixed_sizes"
