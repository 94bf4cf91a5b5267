"""Ranked catalogue search for one query.

Hits are found in one pass over the parts (no scan per branch) and one over the aliases; the best
rank of a part is the least of its hits. Filters on parts run before documents and pages are joined.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

PAGE_SIZE, MAX_PAGE_SIZE = 20, 100
# A part's identifiers, in order of rank.
IDENTIFIERS = ("part_number_canonical", "part_number_extracted", "part_number_cell")
# So many neighbouring ids at most share an array where a batch's parts meet its queries.
BLOCK = 8192


@dataclass(frozen=True)
class Request:
    query: str
    match: str = "all"  # pn, term or all
    page: int = 1
    size: int = PAGE_SIZE
    sort: str = "relevance"
    notes: bool = False
    pdf: str = ""
    folder: str = ""
    contains: bool = False

    @property
    def q(self) -> str:
        return (self.query or "").strip().upper()

    @property
    def limit(self) -> int:
        return min(max(self.size, 1), MAX_PAGE_SIZE)

    @property
    def dots(self) -> bool:
        return self.q.startswith(".") and not self.q.strip(".")

    @property
    def term_like(self) -> bool:
        return self.q.startswith(".") or len(self.q) >= 3 or (len(self.q) >= 2 and any(c.isdigit() for c in self.q))

    @property
    def pn_like(self) -> bool:
        q = self.q
        return bool(q) and q[0].isascii() and q[0].isalnum() and all(c.isascii() and (c.isalnum() or c in "./-") for c in q) and any(c.isdigit() for c in q)


def _like(pattern: str) -> str:
    return pattern.replace("\\", "\\\\")


def identifier_rank(columns: list[str], q: str, contains: bool, first: int = 0) -> Column:
    """0.. for equality with a column, 10.. for a prefix, 20.. for containment; null without a hit."""
    arms = []
    for i, c in enumerate(columns, first):
        hit = F.when(F.col(c) == q, i)
        if len(q) >= 4:
            hit = hit.when(F.col(c).like(_like(q) + "%"), 10 + i)
        if contains and len(q) >= 3:
            hit = hit.when(F.col(c).like("%" + _like(q) + "%"), 20 + i)
        arms.append(hit)
    return F.least(*arms) if len(arms) > 1 else arms[0]


def pn_hits(parts: DataFrame, aliases: DataFrame, r: Request, offset: int = 0, contains: bool | None = None) -> DataFrame:
    contains = r.contains if contains is None else contains
    own = parts.select("id", identifier_rank(list(IDENTIFIERS), r.q, contains).alias("rank"))
    other = aliases.select(F.col("part_id").alias("id"), identifier_rank(["alias_value"], r.q, contains, 3).alias("rank"))
    return own.unionByName(other).where("rank is not null").withColumn("rank", F.col("rank") + offset)


def term_hits(parts: DataFrame, r: Request, offset: int = 0) -> DataFrame:
    if not r.q or not r.term_like:
        return parts.select("id", F.lit(0).alias("rank")).where(F.lit(False))
    if r.dots:
        return parts.where(F.col("nom_level") >= len(r.q)).select("id", F.lit(offset).alias("rank"))
    text = F.upper(F.coalesce("nomenclature_clean", "nomenclature", F.lit("")))
    found = parts.where(text.like("%" + _like(r.q) + "%"))
    ranked = [F.struct("id", F.lit(offset).alias("rank"))]
    if not r.q.startswith("."):
        ranked.append(F.when(F.col("attached_to_part_id").isNotNull(), F.struct(F.col("attached_to_part_id").alias("id"), F.lit(offset + 1).alias("rank"))))
    return found.select(F.inline(F.array_compact(F.array(*ranked))))


def best_rank(hits: DataFrame) -> DataFrame:
    return hits.groupBy("id").agg(F.min("rank").alias("rank"))


def hits(parts: DataFrame, aliases: DataFrame, r: Request) -> DataFrame:
    if not r.q:
        return parts.select("id", F.lit(0).alias("rank")).where(F.lit(False))
    if r.match == "pn":
        return pn_hits(parts, aliases, r)
    if r.match == "term":
        return term_hits(parts, r)
    pn = pn_hits(parts, aliases, r, 0 if r.pn_like else 1000, contains=True)
    return pn.unionByName(term_hits(parts, r, 1000 if r.pn_like else 0))


def scoped(rows: DataFrame, r: Request) -> DataFrame:
    """Only the document or folder that is asked for."""
    folder = r.folder.replace("\\", "/").strip().strip("/")
    if r.pdf:
        rows = rows.where((F.col("pdf_name") == r.pdf) | (F.col("relative_path") == r.pdf))
    if folder:
        rows = rows.where((F.col("relative_path") == folder) | F.col("relative_path").startswith(folder + "/"))
    return rows


def matched(parts: DataFrame, documents: DataFrame, aliases: DataFrame, r: Request) -> DataFrame:
    """All parts that match, with rank and document."""
    kept = parts if r.notes else parts.where(F.col("row_kind") == "part")
    docs = scoped(documents.select(F.col("id").alias("document_id"), "pdf_name", "relative_path"), r)
    return kept.join(best_rank(hits(parts, aliases, r)), "id").join(docs, "document_id")


def order(r: Request) -> list[Column]:
    if r.sort == "name":
        return [F.upper(F.coalesce("part_number_canonical", "part_number_cell", F.lit(""))), F.col("pdf_name"), F.col("page_num"), F.col("id")]
    doubt = [F.col("pn_needs_review").desc(), F.coalesce("pn_best_similarity", F.lit(0.0)).desc()]
    by_pn = r.match == "pn" or (r.match == "all" and r.pn_like)
    return [F.col("rank"), *(doubt if by_pn else []), F.col("pdf_name"), F.col("figure_code"), F.col("page_num"), F.col("id")]


def search(parts: DataFrame, documents: DataFrame, pages: DataFrame, aliases: DataFrame, r: Request) -> DataFrame:
    """One page of results, in order. Only the page's rows meet the pages table and are formatted."""
    text = F.coalesce("nomenclature_clean", "nomenclature", F.lit(""))
    top = matched(parts, documents, aliases, r).orderBy(*order(r)).offset((max(r.page, 1) - 1) * r.limit).limit(r.limit)
    with_hits = r.match != "pn" and not r.dots
    rows = top.join(pages.select("document_id", "page_num", "figure_label", "date_text"), ["document_id", "page_num"], "left")
    return rows.select(
        "id", F.col("pdf_name").alias("source_pdf"), F.col("relative_path").alias("source_relative_path"), "page_num", "page_end", "figure_code", "figure_label", "date_text",
        T.fig_item_display("fig_item_raw", "fig_item_no", "not_illustrated").alias("fig_item"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("not_illustrated", "pn_corrected", "nom_level")), "part_number_canonical", "part_number_cell",
        T.preview(text).alias("nomenclature_preview"), (T.hit_snippet(text, F.lit(r.q)) if with_hits else T.preview(text)).alias("nomenclature_hit_snippet"),
        "effectivity", "units_per_assy", "pn_needs_review", "rank",
    )


def total(parts: DataFrame, documents: DataFrame, aliases: DataFrame, r: Request) -> DataFrame:
    return matched(parts, documents, aliases, r).agg(F.count("*").alias("total"))


def with_fallback(parts: DataFrame, documents: DataFrame, aliases: DataFrame, r: Request) -> Request:
    """For part numbers without a hit and three characters or more, containment counts as well."""
    if r.match == "pn" and not r.contains and len(r.q) >= 3 and matched(parts, documents, aliases, r).limit(1).isEmpty():
        return Request(**{**r.__dict__, "contains": True})
    return r


def envelope(parts: DataFrame, documents: DataFrame, aliases: DataFrame, r: Request) -> DataFrame:
    r = with_fallback(parts, documents, aliases, r)
    page = max(r.page, 1)
    found = total(parts, documents, aliases, r)
    return found.select("total", F.lit(page).alias("page"), F.lit(r.limit).alias("page_size"), F.lit(r.match).alias("match"), (F.col("total") > page * r.limit).alias("has_more"))


def lookup(parts: DataFrame, documents: DataFrame, aliases: DataFrame, number: str) -> DataFrame:
    """Parts that have exactly this number, under any of its names, by document, figure, page and item.

    A row with the number among its own identifiers comes once for each of its aliases, one that only an alias
    names once for each alias that does. The filters run before the joins, on each table by itself.
    """
    q = (number or "").strip().upper()
    own = F.lit(False)
    for c in IDENTIFIERS:
        own = own | F.coalesce(F.col(c) == q, F.lit(False))
    names = aliases.select(F.col("part_id").alias("id"), "alias_value")
    rows = parts.where(own).join(names, "id", "left").unionByName(parts.where(~own).join(names.where(F.col("alias_value") == q), "id"))
    docs = documents.select(F.col("id").alias("document_id"), "pdf_name")
    out = rows.join(docs, "document_id").select("id", "pdf_name", "page_num", "figure_code", "fig_item_no", "part_number_canonical", T.shorten("nomenclature_clean").alias("title"))
    return out.orderBy("pdf_name", "figure_code", "page_num", "fig_item_no", "id")


def xrefs_of(hits: DataFrame, parts: DataFrame) -> DataFrame:
    """Cross references of the parts of column id."""
    kept = parts.join(hits.select("id").distinct(), "id", "left_semi")
    return kept.select(F.col("id").alias("part_id"), F.inline(T.cross_references("nomenclature_clean")))


# many queries at once


def _keyed(parts: DataFrame, aliases: DataFrame) -> DataFrame:
    own = parts.select("id", F.inline(F.array(*(F.struct(F.lit(i).alias("kind"), F.col(c).alias("value")) for i, c in enumerate(IDENTIFIERS)))))
    return own.unionByName(aliases.select(F.col("part_id").alias("id"), F.lit(3).alias("kind"), F.col("alias_value").alias("value"))).where("value is not null")


def _asked(queries: DataFrame) -> DataFrame:
    """(qid, needle) of the queries that ask for something."""
    return queries.select("qid", F.upper(F.trim("q")).alias("needle")).where("needle <> ''")


def _like_column(before: str, after: str) -> Column:
    """value LIKE needle between two wildcards; the needle's own % and _ are wildcards too, a backslash is itself."""
    return F.expr(f"value LIKE concat('{before}', replace(needle, '\\\\', '\\\\\\\\'), '{after}')")


def _literal(c: str) -> Column:
    return ~F.col(c).rlike("[%_]")


def exact_hits(keyed: DataFrame, needles: DataFrame) -> DataFrame:
    """(needle, id, rank) of needles that equal an identifier: one equi-join."""
    return keyed.join(needles, F.col("value") == F.col("needle")).select("needle", "id", F.col("kind").alias("rank"))


def prefix_hits(keyed: DataFrame, needles: DataFrame) -> DataFrame:
    """(needle, id, rank) of needles of four characters or more that begin an identifier.

    Identifiers are cut to the length of each needle's literal head and meet it in one equi-join; wildcards after the head are tested.
    """
    asked = needles.where(F.length("needle") >= 4).withColumn("head", F.regexp_extract("needle", "^([^%_]*)", 1))
    lengths = asked.select(F.length("head").alias("n")).distinct()
    cut = keyed.join(F.broadcast(lengths), F.length("value") >= F.col("n"))  # as many rows as there are head lengths
    met = cut.select("id", "kind", "value", F.substr("value", F.lit(1), F.col("n")).alias("head")).join(asked, "head")
    return met.where(_literal("needle") | _like_column("", "%")).select("needle", "id", (F.col("kind") + 10).alias("rank"))


def grams(c: Column, n: Column) -> Column:
    """The distinct pieces of n characters of a text (n = 0: the empty one)."""
    last = F.length(c) - n + 1
    return F.when(n == 0, F.array(F.lit(""))).when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(c, i, n)))).otherwise(F.array().cast("array<string>"))


def longest_runs(needles: DataFrame) -> DataFrame:
    """Needles with run, their longest run without wildcards, and n, the size of the pieces of it that are looked up: three characters at most."""
    run = F.array_max(F.transform(F.split("needle", "[%_]+"), lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    return needles.withColumn("run", run).withColumn("n", F.least(F.length("run"), F.lit(3)))


def meeting(pieces: DataFrame, asked: DataFrame) -> DataFrame:
    """(value, needle) of pieces (value, gram) and needles of longest_runs() for which value LIKE %needle%."""
    own = asked.select("needle", F.explode(grams(F.col("run"), F.col("n"))).alias("gram"))
    spread = pieces.join(own.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = own.join(spread, "gram", "left").groupBy("needle").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), F.col("gram"))).alias("gram"))
    met = pieces.join(rarest, "gram")
    return met.where(F.when(_literal("needle"), F.col("value").contains(F.col("needle"))).otherwise(_like_column("%", "%"))).select("value", "needle")


def containing(values: DataFrame, needles: DataFrame) -> DataFrame:
    """(value, needle) of distinct values and needles for which value LIKE %needle%.

    A needle meets the values that have the rarest piece, of three characters at most, of its longest run
    without wildcards, and is then tested. Only a needle of nothing but wildcards meets all values, as it must.
    """
    asked = longest_runs(needles)
    sizes = asked.select("n").distinct()  # 0 to 3
    return meeting(values.join(F.broadcast(sizes)).select("value", F.explode(grams(F.col("value"), F.col("n"))).alias("gram")), asked)


def contains_hits(keyed: DataFrame, needles: DataFrame) -> DataFrame:
    """(needle, id, rank) of needles of three characters or more that an identifier contains. Equal identifiers are tested once."""
    found = containing(keyed.select("value").distinct(), needles.where(F.length("needle") >= 3))
    return keyed.join(found, "value").select("needle", "id", (F.col("kind") + 20).alias("rank"))


def term_hits_of(parts: DataFrame, needles: DataFrame) -> DataFrame:
    """(needle, id, rank) of needles that a nomenclature contains, with the part that a note is attached to; dots alone ask for levels."""
    text = F.upper(F.coalesce("nomenclature_clean", "nomenclature", F.lit("")))
    rows = parts.select("id", "attached_to_part_id", "nom_level", text.alias("value"))
    dots = F.col("needle").rlike("^[.]+$")
    words = needles.where(~dots & (F.col("needle").startswith(".") | (F.length("needle") >= 3) | ((F.length("needle") >= 2) & F.col("needle").rlike("[0-9]"))))
    found = rows.join(containing(rows.select("value").distinct(), words), "value")
    own = found.select("needle", "id", F.lit(0).alias("rank"))
    other = found.where("attached_to_part_id is not null and not startswith(needle, '.')").select("needle", F.col("attached_to_part_id").alias("id"), F.lit(1).alias("rank"))
    levels = rows.where("nom_level > 0").select("id", F.explode(F.sequence(F.lit(1), F.col("nom_level"))).alias("n"))
    deep = levels.join(needles.where(dots).withColumn("n", F.length("needle")), "n").select("needle", "id", F.lit(0).alias("rank"))
    return own.unionByName(other).unionByName(deep)


def best(hits: DataFrame, by: str = "needle") -> DataFrame:
    return hits.groupBy(by, "id").agg(F.min("rank").alias("rank"))


def by_query(found: DataFrame, queries: DataFrame) -> DataFrame:
    """What was found for a needle, for each query that asks for it: hits are multiplied last."""
    return _asked(queries).join(found, "needle").drop("needle")


def all_by_query(ranked: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, id, rank): as by_query(), for all the parts of a needle.

    Parts and queries of a needle meet in arrays, by BLOCK neighbouring ids, and are multiplied after the join. Each query's rows then hold
    the same parts in the same order, which Parquet writes as runs and repeats. The arrays hold bare numbers, parts of each rank by themselves, so
    that a row costs no more than reading one. Partitions are not merged: their rows multiply.
    """
    tasks = int(ranked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = ranked.withColumn("block", F.expr(f"id div {BLOCK}")).repartition(tasks, "needle", "block").groupBy("needle", "block", "rank").agg(F.collect_list(F.struct("id")).alias("parts"))
    asked = _asked(queries).withColumn("block", F.expr(f"qid div {BLOCK}")).groupBy("needle", "block").agg(F.collect_list(F.struct("qid")).alias("asked"))
    met = parts.select("needle", "rank", F.col("parts.id").alias("parts")).join(asked.drop("block"), "needle")
    return met.select("parts", "rank", F.col("asked.qid").alias("asked")).select("parts", "rank", F.explode("asked").alias("qid")).select("qid", F.explode("parts").alias("id"), "rank")


def needle_hits(parts: DataFrame, aliases: DataFrame, queries: DataFrame, contains: bool = True) -> DataFrame:
    """(needle, id, rank): the best rank of each part for each distinct query text."""
    keyed, needles = _keyed(parts, aliases), _asked(queries).select("needle").distinct()
    out = exact_hits(keyed, needles).unionByName(prefix_hits(keyed, needles))
    return best(out.unionByName(contains_hits(keyed, needles)) if contains else out)


def batch_search(parts: DataFrame, aliases: DataFrame, queries: DataFrame, contains: bool = True) -> DataFrame:
    """(qid, id, rank): the best rank of each part for each query."""
    return all_by_query(needle_hits(parts, aliases, queries, contains), queries)


def batch_contains(parts: DataFrame, aliases: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, id, rank) of every query of three characters or more that an identifier contains."""
    return all_by_query(best(contains_hits(_keyed(parts, aliases), _asked(queries).select("needle").distinct())), queries)


def batch_terms(parts: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, id, rank) of every query that a nomenclature contains."""
    return all_by_query(best(term_hits_of(parts, _asked(queries).select("needle").distinct())), queries)


def top_k(ranked: DataFrame, k: int, by: str = "qid") -> DataFrame:
    """The k best parts of each query or needle; of salted parts first, so that one with very many hits is not one task's."""
    salted = ranked.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(32)))
    kept = salted.withColumn("r", F.row_number().over(Window.partitionBy(by, "salt").orderBy("rank", "id"))).where(F.col("r") <= k).drop("r", "salt")
    return kept.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy("rank", "id"))).where(F.col("position") <= k)


def batch_top_k(parts: DataFrame, aliases: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, id, rank, position): the k best parts of each query, ranked once per distinct query text."""
    return by_query(top_k(needle_hits(parts, aliases, queries), k, "needle"), queries)
