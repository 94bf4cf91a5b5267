"""Assembly hierarchy: parents from indentation levels, duplicate rows, ancestors, relatives, details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.staging import staged

MAX_DEPTH, MAX_SIBLINGS, MAX_CHILDREN = 12, 20, 40
NARROW = 500_000  # rows (id, survivor) of a table that is broadcast
# The columns that tell rows apart.
ROW_KEY = ("document_id", "page_num", "figure_code", "fig_item_raw", "fig_item_no", "not_illustrated", "part_number_cell", "nomenclature_clean", "effectivity", "units_per_assy", "nom_level")


def figure_key() -> Column:
    return F.coalesce("figure_code", F.concat(F.lit("PAGE "), F.col("page_num").cast("string")))


def assign_parents(parts: DataFrame, order: str = "id", deepest: int | None = None) -> DataFrame:
    """Adds parent_part_id: the nearest earlier row of a lower level in the same figure, by reading order.

    Null for level 0 and where no row can be the parent; 0 where a level is skipped (a placeholder
    stands there). ``deepest`` is the greatest level; when not given it is read off the table.
    """
    deepest = deepest_level(parts) if deepest is None else deepest
    level = F.coalesce("nom_level", F.lit(0))
    group = Window.partitionBy("document_id", figure_key()).orderBy(order)
    before = group.rowsBetween(Window.unboundedPreceding, -1)
    seq = F.row_number().over(group)
    rows = parts.withColumn("_seq", seq)
    me = F.struct(F.col("id").alias("id"), level.alias("level"), F.col("_seq").alias("seq"))
    lower = [F.last(F.when(level < k, me), ignorenulls=True).over(before).alias(f"_below{k}") for k in range(1, deepest + 1)]
    rows = rows.select("*", *lower)
    p = F.lit(None).cast("struct<id:bigint,level:int,seq:int>")
    for k in range(deepest, 0, -1):
        p = F.when(level == k, F.col(f"_below{k}")).otherwise(p)
    rows = rows.withColumn("_p", p)
    parent = (
        F.when(level <= 0, None)
        .when(F.col("_p.level") == level - 1, F.col("_p.id"))
        .when((F.col("_seq") == 1) | (F.col("_p.seq") == F.col("_seq") - 1), None)
        .otherwise(F.lit(0).cast("bigint"))
    )
    return rows.withColumn("parent_part_id", parent).drop("_seq", "_p", *(f"_below{k}" for k in range(1, deepest + 1)))


def deepest_level(parts: DataFrame) -> int:
    """The greatest level of the table; rows without one are of level 0."""
    return parts.agg(F.max("nom_level")).first()[0] or 0


def _ended() -> Column:
    return -1 - F.abs("id")  # no row's id


def copies(parts: DataFrame, deepest: int | None = None) -> DataFrame:
    """(id, survivor) of the rows that are left out, a table: rows that agree in the row key and parent are one, the first.

    Parents are one when they agree in turn, so rows are one when the keys of their whole chains agree. Only rows whose own key comes again can be
    copies; (id, key, parent) is staged once, one join of these rows with it per level gathers their chains, and a pre-aggregated
    minimum names the first. Rows whose chain has ended meet nothing and are spread over all tasks.
    """
    deepest = deepest_level(parts) if deepest is None else deepest
    missing = [c for c in ROW_KEY if c not in parts.columns]
    rows = parts.select("*", *(F.lit(None).cast("string").alias(c) for c in missing))
    kind = dict(rows.dtypes)
    key = F.to_json(F.struct(*(F.coalesce(c, F.lit("")) if kind[c] == "string" else F.coalesce(c, F.lit(0)) for c in ROW_KEY)))
    rows = staged(rows.select("id", F.col("parent_part_id").alias("parent"), F.unhex(F.sha2(key, 256)).alias("key")), "dedup-keys")
    short = F.xxhash64("key")  # tells enough apart to find what may come again
    again = rows.groupBy(short.alias("_short")).agg(F.count("*").alias("_n")).where("_n > 1").select("_short")
    known = rows.select(F.col("id").alias("_at"), F.col("key").alias("_key"), F.col("parent").alias("_next"))
    chain = rows.withColumn("_short", short).join(again, "_short", "left_semi")
    chain = chain.select("id", F.array("key").alias("chain"), F.coalesce("parent", F.lit(0)).alias("leads"), F.when(F.col("parent") != 0, F.col("parent")).otherwise(_ended()).alias("_at"))
    for _ in range(deepest):
        chain = chain.join(known, "_at", "left").select(
            "id", F.when(F.col("_key").isNull(), F.col("chain")).otherwise(F.concat("chain", F.array("_key"))).alias("chain"),
            F.when(F.col("_key").isNull(), F.col("leads")).otherwise(F.coalesce("_next", F.lit(0))).alias("leads"), F.when(F.col("_next") != 0, F.col("_next")).otherwise(_ended()).alias("_at"),
        )
    same = F.unhex(F.sha2(F.concat_ws(",", F.array_join(F.transform("chain", F.hex), ","), "leads"), 256))  # what is left of a chain is where it leads out of the table
    chain = staged(chain.select("id", same.alias("same")), "dedup-chains")
    first = chain.groupBy("same").agg(F.min("id").alias("survivor"), F.count("*").alias("n")).where("n > 1").drop("n")
    return staged(chain.join(first, "same").where("id <> survivor").select("id", "survivor"), "dedup-copies")


def with_first_parents(rows: DataFrame, found: DataFrame, parent: str) -> DataFrame:
    """Rows with the survivor's id in place of a parent that is left out."""
    of = found.select(F.col("id").alias("_up"), F.col("survivor").alias("_of"))
    up = F.when(F.col(parent) != 0, F.col(parent)).otherwise(_ended())
    return rows.withColumn("_up", up).join(of, "_up", "left").withColumn(parent, F.coalesce("_of", parent)).drop("_up", "_of")


def drop_duplicates(parts: DataFrame, deepest: int | None = None) -> DataFrame:
    """(id, survivor, parent) of all rows: rows that copies() leaves out name the first of their kind, whose id then acts as parent."""
    found = copies(parts, deepest)
    rows = parts.select("id", F.col("parent_part_id").alias("parent")).join(found, "id", "left").select("id", F.coalesce("survivor", "id").alias("survivor"), "parent")
    return with_first_parents(rows, found, "parent").select("id", "survivor", "parent")


def first_ones(parts: DataFrame, deepest: int | None = None) -> DataFrame:
    """The parts without copies, with parents that are not left out. Whole rows move only where there are too many copies to broadcast."""
    found = copies(parts, deepest)
    return without(parts, found, found.count())


def without(parts: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """The parts without the n copies that were found."""
    if n <= NARROW:
        found = F.broadcast(found)
    return with_first_parents(parts.join(found.select("id"), "id", "left_anti"), found, "parent_part_id")


def ancestors(parts: DataFrame, ids: DataFrame | None = None, depth: int = MAX_DEPTH) -> DataFrame:
    """(id, ancestors): each part's chain of parents, root first, at most ``depth``; stops at a missing parent or a cycle.

    Chains grow by doubling: the way of four steps up is staged, and three of it make twelve. A way that has ended
    meets nothing and is spread over all tasks. Ways of a cycle repeat, and are cut where they do.
    """
    ended = lambda c: F.when(F.col(c).isNotNull(), F.col(c)).otherwise(-1 - F.abs("id"))  # noqa: E731  no part's id
    links = parts.select("id", F.col("parent_part_id").alias("up"))
    links = staged(links.withColumn("up", ended("up")).join(parts.select(F.col("id").alias("up"), F.lit(True).alias("_known")), "up", "left").select("id", F.when(F.col("_known"), F.col("up")).alias("jump")), "part-links")
    ways = links.select("id", F.array_compact(F.array("jump")).alias("path"), "jump")

    def joined(a: DataFrame, b: DataFrame) -> DataFrame:
        further = b.select(F.col("id").alias("_at"), F.col("path").alias("_path"), F.col("jump").alias("_jump"))
        met = a.withColumn("_at", ended("jump")).join(further, "_at", "left")
        return met.select("id", F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.concat("path", "_path")).alias("path"), F.col("_jump").alias("jump"))

    two = joined(ways, ways)
    four = staged(joined(two, two), "part-ways")
    out = four if ids is None else four.join(ids.select("id").distinct(), "id", "left_semi")
    for _ in range((depth + 3) // 4 - 1):
        out = joined(out, four)
    cut = F.slice(F.array_remove(F.array_distinct("path"), F.col("id")), 1, depth)
    return out.select("id", F.reverse(cut).alias("ancestors"))


def roots(parts: DataFrame) -> DataFrame:
    return ancestors(parts).select("id", F.coalesce(F.get("ancestors", F.lit(0)), "id").alias("root_id"))


def siblings(parts: DataFrame, most: int = MAX_SIBLINGS) -> DataFrame:
    """(id, sibling_id): parts of the same parent and level, the first by id."""
    rows = parts.where(F.coalesce("parent_part_id", F.lit(0)) != 0)
    first = Window.partitionBy("parent_part_id", "nom_level").orderBy("id")
    pool = rows.select("parent_part_id", "nom_level", F.col("id").alias("sibling_id"), F.row_number().over(first).alias("r")).where(F.col("r") <= most + 1)
    found = rows.select("id", "parent_part_id", "nom_level").join(pool, ["parent_part_id", "nom_level"]).where("id <> sibling_id")
    return found.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("sibling_id"))).where(F.col("n") <= most).select("id", "sibling_id")


def children(parts: DataFrame, of: DataFrame | None = None, most: int = MAX_CHILDREN) -> DataFrame:
    """(id, child_id): the first parts by id whose parent it is; ``of`` names the parents, all parts by default."""
    nth = F.row_number().over(Window.partitionBy("parent_part_id").orderBy("id"))
    rows = parts.where(F.coalesce("parent_part_id", F.lit(0)) != 0).select(F.col("parent_part_id").alias("id"), F.col("id").alias("child_id"), nth.alias("n"))
    return rows.where(F.col("n") <= most).join((parts if of is None else of).select("id"), "id", "left_semi").select("id", "child_id")


# The columns of a part's detail, in order; those of its page are PAGE_COLUMNS.
PAGE_COLUMNS = ("figure_label", "date_text", "page_token", "rf_text")
DETAIL = (
    "id", "pdf_name", "source_relative_path", "document_id", "page_num", "page_end", "extractor", "meta_data_raw", "figure_code", "figure_label", "date_text", "page_token", "rf_text", "row_kind",
    "fig_item_raw", "fig_item_no", "fig_item_no_source", "not_illustrated", "part_number_cell", "part_number_extracted", "part_number_canonical", "pn_corrected", "pn_method", "pn_best_similarity",
    "pn_needs_review", "correction_note", "nom_level", "nomenclature_clean", "parent_part_id", "attached_to_part_id", "nomenclature", "effectivity", "units_per_assy",
)


def detail(parts: DataFrame, documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Parts with their document and page: the columns of DETAIL as they are stored, and the figure item as it is shown."""
    docs = documents.select(F.col("id").alias("document_id"), "pdf_name", F.col("relative_path").alias("source_relative_path"))
    rows = parts.join(docs, "document_id").join(pages.select("document_id", "page_num", *PAGE_COLUMNS), ["document_id", "page_num"], "left")
    return rows.select(*DETAIL, T.fig_item_display("fig_item_raw", "fig_item_no", "not_illustrated").alias("fig_item"))


def api(rows: DataFrame) -> DataFrame:
    """The fields of detail() that the service gives, with its types: flags are booleans, an empty path is the file name."""
    flag = lambda c: (F.coalesce(c, F.lit(0)) != 0).alias(c)
    return rows.select(
        "id", "document_id", "page_num", "page_end", "extractor", "figure_code", "fig_item_no", flag("not_illustrated"), F.col("part_number_canonical").alias("part_number"), flag("pn_corrected"), "pn_method",
        "nom_level", "nomenclature", "nomenclature_clean", "effectivity", "units_per_assy", *PAGE_COLUMNS, "pdf_name", "source_relative_path",
    )


def api_short(rows: DataFrame) -> DataFrame:
    """The same under the short names of the service's lists."""
    names = {"id": "id", "pn": "part_number_canonical", "pn_cell": "part_number_cell", "nom": "nomenclature", "nom_clean": "nomenclature_clean", "nom_level": "nom_level", "fig": "figure_code", "fig_item": "fig_item_no", "eff": "effectivity", "units": "units_per_assy", "page": "page_num", "pdf": "pdf_name"}
    source = F.coalesce(T.null_if_empty("source_relative_path"), "pdf_name").alias("source_relative_path")
    return rows.select(*(F.col(c).alias(n) for n, c in names.items()), (F.coalesce("pn_corrected", F.lit(0)) != 0).alias("pn_corrected"), *PAGE_COLUMNS, source)


def nested_detail(parts: DataFrame, documents: DataFrame, pages: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per id: its detail with arrays of ancestors, siblings, children and cross references. Parts are staged: each step reads them once."""
    parts = staged(parts, "detail-parts")
    want = staged(ids.select("id").distinct(), "detail-ids")
    listed = lambda df, c, name: df.join(want, "id", "left_semi").groupBy("id").agg(F.sort_array(F.collect_list(c)).alias(name))  # noqa: E731  at most MAX_* per id
    own = parts.join(want, "id", "left_semi")
    near = parts.join(own.where("parent_part_id <> 0").select("parent_part_id").union(own.select("id")).distinct(), "parent_part_id", "left_semi")  # rows of the parents asked for
    out = detail(own, documents, pages).withColumn("xrefs", F.array_sort(T.cross_references("nomenclature_clean"))).join(ancestors(parts, want), "id", "left")
    near = staged(near.select("id", "parent_part_id", "nom_level"), "detail-near")
    out = out.join(listed(siblings(near), "sibling_id", "siblings"), "id", "left").join(listed(children(near, want), "child_id", "children"), "id", "left")
    empty = F.array().cast("array<bigint>")
    return out.withColumn("siblings", F.coalesce("siblings", empty)).withColumn("children", F.coalesce("children", empty))
