"""The search's side tables, stored: identifiers sorted by value, and postings from pieces of values to the values.

Both are tables of a Store (sources.store), bucketed by value and by piece. A batch of queries reads the buckets
of its own pieces, then those of the values it found; parts are not read at all. After a merge of the
catalogue, update() rewrites the identifiers' buckets that changed and appends the postings of values that are
new; postings of values that are gone lead nowhere, and go when a bucket is compacted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged
from ..sources.store import Store
from . import search as S

SIZES, SORT, VERSIONS = (1, 2, 3), {"identifiers": ["value", "kind", "id"], "postings": ["gram", "value"]}, 8


def _identifiers(store: Store, parts: DataFrame, aliases: DataFrame) -> DataFrame:
    return S._keyed(parts, aliases).select("value", "kind", "id").distinct().withColumn("bucket", store.bucket("value"))


def _postings(store: Store, values: DataFrame) -> DataFrame:
    pieces = F.flatten(F.array(*(S.grams(F.col("value"), F.lit(n)) for n in SIZES)))
    return values.select("value", F.explode(pieces).alias("gram")).withColumn("bucket", store.bucket("gram"))


def build(store: Store, parts: DataFrame, aliases: DataFrame) -> int:
    """Both tables anew."""
    rows = staged(_identifiers(store, parts, aliases), "index-identifiers")
    return store.commit({"identifiers": (rows, None), "postings": (_postings(store, rows.select("value").distinct()), None)}, sort=SORT)


def update(store: Store, gone: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame], batch: int | None = None) -> int:
    """After a merge: (parts, aliases) that went, and those that came. The same update again changes nothing."""
    out, come = _identifiers(store, *gone), _identifiers(store, *new)
    buckets = store.touched(out.select("bucket").union(come.select("bucket")))
    old = store.read("identifiers", buckets).select(*come.columns)
    rows = staged(old.join(out.select("value", "kind", "id"), ["value", "kind", "id"], "left_anti").unionByName(come).distinct(), "index-identifiers")
    values = rows.select("value").distinct().join(old.select("value"), "value", "left_anti")
    return store.commit({"identifiers": (rows, buckets), "postings": (_postings(store, values), [])}, append=("postings",), sort=SORT, batch=batch)


def compact(store: Store, versions: int = VERSIONS) -> int:
    """Rewrite the postings' buckets that are spread over more than so many commits, without values that are gone."""
    held = store.manifest()["tables"].get("postings", {})
    many = [int(b) for b, vs in held.items() if len(vs) > versions]
    if not many:
        return store.manifest()["version"]
    known = store.read("identifiers").select("value").distinct()
    return store.commit({"postings": (store.read("postings", many).distinct().join(known, "value", "left_semi"), many)}, sort=SORT)


def contains_hits(store: Store, needles: DataFrame) -> DataFrame:
    """As search.contains_hits(): (needle, id, rank) of needles of three characters or more that an identifier contains."""
    asked = staged(S.longest_runs(needles.where(F.length("needle") >= 3)), "index-needles")
    own = asked.where("n > 0").select(F.explode(S.grams(F.col("run"), F.col("n"))).alias("gram"))
    pieces = store.read("postings", store.touched(own.select(store.bucket("gram").alias("bucket")))).select("value", "gram").distinct()
    if not asked.where("n = 0").isEmpty():  # nothing but wildcards: all values
        pieces = pieces.unionByName(store.read("identifiers").select("value").distinct().withColumn("gram", F.lit("")))
    return _ids(store, S.meeting(pieces, asked), 20)


def prefix_hits(store: Store, needles: DataFrame) -> DataFrame:
    """As search.prefix_hits(), through the postings of the needles' heads; heads of wildcards alone meet all values."""
    asked = staged(needles.where(F.length("needle") >= 4).withColumn("head", F.regexp_extract("needle", "^([^%_]*)", 1)).withColumn("gram", F.substring("head", 1, 3)), "index-heads")
    pieces = store.read("postings", store.touched(asked.where("gram <> ''").select(store.bucket("gram").alias("bucket")))).select("value", "gram").distinct()
    if not asked.where("gram = ''").isEmpty():
        pieces = pieces.unionByName(store.read("identifiers").select("value").distinct().withColumn("gram", F.lit("")))
    met = pieces.join(asked, "gram").where(F.col("value").startswith(F.col("head")) & (S._literal("needle") | S._like_column("", "%")))
    return _ids(store, met.select("value", "needle"), 10)


def exact_hits(store: Store, needles: DataFrame) -> DataFrame:
    return _ids(store, needles.select(F.col("needle").alias("value"), "needle"), 0)


def _ids(store: Store, found: DataFrame, rank: int) -> DataFrame:
    """The parts of the values that were found, from those values' buckets."""
    found = staged(found.withColumn("bucket", store.bucket("value")), "index-found")
    known = store.read("identifiers", store.touched(found))
    return known.join(found, ["bucket", "value"]).select("needle", "id", (F.col("kind") + rank).alias("rank"))


def needle_hits(store: Store, queries: DataFrame, contains: bool = True) -> DataFrame:
    """As search.needle_hits(): the best rank of each part for each distinct query text."""
    needles = staged(S._asked(queries).select("needle").distinct(), "index-asked")
    out = exact_hits(store, needles).unionByName(prefix_hits(store, needles))
    return S.best(out.unionByName(contains_hits(store, needles)) if contains else out)
