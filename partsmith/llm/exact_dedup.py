"""Exact deduplication through content-defined chunk recipes, in DataFrame operations only.

A text is cut where its own content says so: at the first sentence or line end after
``MIN_CHUNK`` characters, at ``MAX_CHUNK`` at the latest. Each chunk gets a short identifier, and
the identifiers are verified over the whole corpus: if two different chunks (by SHA-256) share
one, the next wider identifier is taken. A text is then its recipe, the ordered list of its
chunks' identifiers, and equal texts are equal recipes. Only recipes are shuffled; no text is.

Defined cases: a null text is the empty text (an empty recipe), so nulls and empty texts are one
group; repeated rows are members like any other; a null key never stays unless its whole group has
null keys (then all of them do); an empty table gives an empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, materialize

MIN_CHUNK, MAX_CHUNK = 256, 2048

#: From short to wide. The first that is one-to-one on the corpus's chunks is used.
IDENTIFIERS = (
    ("xxhash64", lambda chunk: F.xxhash64(chunk)),
    ("sha256", lambda chunk: F.sha2(chunk, 256)),
    ("sha512", lambda chunk: F.sha2(chunk, 512)),
)


def chunks(text, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> F.Column:
    """The content-defined chunks of a text, in order; joined they give the text again."""
    cut = rf"(?s).{{{least},{most - 2}}}?(?:[\n]|[.!?] )|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(cut), F.lit(0))


def one_to_one(pieces: DataFrame, identify) -> bool:
    """True if no two different chunks have the same identifier. Moves a digest per chunk, no text."""
    pairs = pieces.select(identify(F.col("chunk")).alias("id"), F.sha2("chunk", 256).alias("digest"))
    clashes = pairs.groupBy("id", "digest").agg(F.lit(1)).groupBy("id").count().where("count > 1")
    return clashes.isEmpty()


def recipes(docs: DataFrame, key: str = "doc_id", text: str = "text", identifiers=IDENTIFIERS) -> DataFrame:
    """Per row: key, text_sha256, recipe (the ordered list of its chunks' verified identifiers)."""
    rows = docs.select(F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    pieces = rows.select(F.explode(chunks(F.col("_text"))).alias("chunk"))
    for _, identify in identifiers:
        if one_to_one(pieces, identify):
            return rows.select(
                key,
                F.sha2("_text", 256).alias("text_sha256"),
                F.transform(chunks(F.col("_text")), identify).alias("recipe"),
            )
    raise ValueError("no identifier tells all chunks apart")


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", identifiers=IDENTIFIERS) -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, text_sha256.

    Of rows with equal texts, the one with the largest key stays. Groups are pre-aggregated before
    the shuffle, and only those of two rows or more are joined to their rows: by broadcast if their
    table proves small, else by a sort-merge join whose hot recipes adaptive execution splits.
    """
    rows = recipes(docs, key, text, identifiers)
    groups = rows.groupBy("recipe").agg(F.max(key).alias("keep_id"), F.count("*").alias("group_size"))
    copied = materialize(groups.where("group_size > 1"), "exact-groups")
    found = rows.join(copied, "recipe", "left").select(
        key, F.when(F.col("group_size").isNull(), F.col(key)).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), "text_sha256"
    )
    return found.select(key, "keep_id", "group_size", F.col(key).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def survivors(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The input's rows without copies, all columns as they came; of repeated rows one stays."""
    sha, own, same = (free(docs, n) for n in ("_sha", "_kept_key", "_kept_sha"))
    kept = exact_dedup(docs, key, text).where("kept").select(F.col(key).alias(own), F.col("text_sha256").alias(same))
    rows = docs.withColumn(sha, F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    on = (F.col(sha) == F.col(same)) & F.col(key).eqNullSafe(F.col(own))
    return rows.join(kept, on, "left_semi").dropDuplicates([sha, key]).drop(sha)


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
