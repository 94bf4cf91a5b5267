"""Exact URL lists as Bloom filter cascades, in DataFrame operations only.

A rule is a host with a path prefix. The listed keys of an action are its rules' ``host + path``
strings; the key universe is every ``host suffix + path prefix`` of a shape that some rule has,
over all urls of the corpus. Level 0 of a cascade is a Bloom filter of the listed keys, level 1 one
of the universe's keys that pass level 0 without being listed, level 2 one of the listed keys that
pass level 1, and so on until a level lets nothing wrong through. Looking a key of the universe
up in the levels in turn is then exact, and takes no join.

A level is one row of 64-bit words, made by an aggregate and broadcast. Its size is bounded by the list, whatever
the corpus: level 0 takes as many bits a key as leave about as many false positives as there are listed keys,
all further levels hold a part of those of the level before.

Defined cases: null urls and urls without ``://`` have empty host and path, fit no rule and get the
default verdict; an empty table gives an empty result, an empty list fits nothing; a key on both
lists blocks; of rules of equal length the greater string wins; rows are never merged; very long urls are judged
whole; other columns of the input, whatever their names, are not looked at.
"""

from __future__ import annotations

import math
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, materialize

BITS_PER_KEY, MAX_LEVELS = 8, 64

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def ascii_lower(c) -> F.Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url) -> tuple[F.Column, F.Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.coalesce(ascii_lower(F.regexp_extract(rest, "(?s)^([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def shapes(rules: list[tuple[str, str, str]]) -> list[tuple[int, int]]:
    """The distinct (labels in the host, characters in the path) of the rules."""
    return sorted({(host.count(".") + 1, len(path)) for _, host, path in rules})


def keys(host: F.Column, path: F.Column, kinds: list[tuple[int, int]]) -> F.Column:
    """The candidate keys of a url: a host suffix and a path prefix of each shape that it is long enough for."""
    labels = F.size(F.split(host, r"\."))
    found = [
        F.when((host != "") & (labels >= n) & (F.length(path) >= size), F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, size)))
        for n, size in kinds
    ]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def table_of(spark: SparkSession, keys: list[str]) -> DataFrame:
    """A list as rows of ``key``, made by the JVM from one string."""
    rows = spark.range(1).select(F.explode(F.split(F.lit("\0".join(keys)), "\0")).alias("key"))
    return rows if keys else rows.where(F.lit(False))


class Bloom:
    """A Bloom filter: a one-row table ``row`` whose column ``name`` holds its 64-bit words."""

    def __init__(self, name: str, members: DataFrame, n: int, bits_per_key: int):
        self.name, self.seed = name, zlib.crc32(name.encode())
        self.words, self.hashes = max(1, -(-n * bits_per_key // 64)), max(1, round(bits_per_key * math.log(2)))
        at = members.select(F.explode(F.array(*(self._place(F.col("key"), i) for i in range(self.hashes)))).alias("at"))
        bits = at.select(F.expr("at div 64").alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bits"))
        none = members.sparkSession.range(self.words).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits"))
        dense = bits.unionByName(none).groupBy("word").agg(F.bit_or("bits").alias("bits"))
        row = dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias(name))  # self.words numbers
        self.row = materialize(row, "url-filter")

    def _place(self, key: F.Column, i: int) -> F.Column:
        return F.pmod(F.xxhash64(key, F.lit(self.seed), F.lit(i)), F.lit(64 * self.words))

    def has(self, key: F.Column) -> F.Column:
        """For rows beside which the filter's row stands."""
        out = F.lit(True)
        for i in range(self.hashes):
            at = self._place(key, i)
            out = out & (F.getbit(F.element_at(F.col(self.name), (F.floor(at / 64) + 1).cast("int")), (at % 64).cast("int")) == 1)
        return out

    def passing(self, rows: DataFrame) -> DataFrame:
        return rows.crossJoin(F.broadcast(self.row)).where(self.has(F.col("key"))).drop(self.name)  # one row


def cascade(name: str, listed: DataFrame, n: int, universe: DataFrame, size: int) -> list[Bloom]:
    """The levels for n keys ``listed.key`` within ``universe.key`` of about ``size`` rows. One pass over the universe; what
    later levels hold are the few false positives of the level before."""
    first = BITS_PER_KEY + math.ceil(math.log2(max(1, size / max(1, n))) / math.log(2))
    levels = [Bloom(f"_{name}0", listed, n, first)]
    outside = materialize(levels[0].passing(universe).distinct().join(listed, "key", "left_anti"), "url-level")
    inside = listed
    while n_out := outside.count():
        if len(levels) == MAX_LEVELS:
            raise ValueError("the cascade does not end")
        levels.append(Bloom(f"_{name}{len(levels)}", outside, n_out, BITS_PER_KEY))
        inside, outside = outside, materialize(levels[-1].passing(inside), "url-level")
    return levels


def member(levels: list[Bloom], key: F.Column) -> F.Column:
    """Exact membership of a key of the universe: the first level that it fails tells."""
    out = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels) - 1, -1, -1):
        out = F.when(~levels[i].has(key), F.lit(i % 2 == 1)).otherwise(out)
    return out


def longest(found: F.Column) -> F.Column:
    best = F.array_max(F.transform(found, lambda k: F.struct(F.length(k).alias("n"), k.alias("k"))))
    return best["k"]


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """Per row: key, host, path, rule (null if none fits), verdict (the longest rule's, else the default)."""
    spark, kinds = pages.sparkSession, shapes(rules)
    host, path = host_and_path(column(url))
    rows = pages.select(column(key).alias("_key"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_keys", keys(F.col("host"), F.col("path"), kinds))
    universe, size = rows.select(F.explode("_keys").alias("key")), pages.count() * len(kinds)
    levels = {}
    for action in ("block", "allow"):
        listed = sorted({h + p for x, h, p in rules if x == action})
        levels[action] = cascade(action, table_of(spark, listed), len(listed), universe, size)
    filters = None
    for f in (*levels["block"], *levels["allow"]):
        filters = f.row if filters is None else filters.crossJoin(f.row)  # one row each
    fits = F.filter("_keys", lambda k: member(levels["block"], k) | member(levels["allow"], k))
    judged = rows.crossJoin(F.broadcast(filters)).withColumn("rule", longest(fits))
    verdict = F.when(F.col("rule").isNull(), F.lit(default)).when(member(levels["block"], F.col("rule")), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(F.col("_key").alias(key), "host", "path", "rule", verdict.alias("verdict"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


OP10_SQL = """
WITH rules(action, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
r AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, row_number() OVER () AS n,
  coalesce(translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1), '') AS path FROM r),
best AS (SELECT n, max({'n': length(rhost || rpath), 'rule': rhost || rpath, 'action': action}) AS b
  FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY n)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.action, 'allow') AS verdict FROM p LEFT JOIN best USING (n)
"""
