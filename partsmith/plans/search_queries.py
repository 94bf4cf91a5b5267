"""Search queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import search as S
from ..operators import search_index
from ..sources.fixtures import Catalogue, ctes
from ..sources.staging import new_path
from ..sources.store import Store

QUERIES, ORACLE = {}, {}

FIG = "CASE WHEN trim(coalesce(fig_item_raw,''))='-' AND trim(coalesce(fig_item_no,''))<>'' THEN '- '||trim(fig_item_no) WHEN trim(coalesce(fig_item_raw,''))<>'' AND trim(coalesce(fig_item_no,''))<>'' THEN trim(fig_item_raw)||' '||trim(fig_item_no) WHEN trim(coalesce(fig_item_raw,''))<>'' THEN trim(fig_item_raw) WHEN trim(coalesce(fig_item_no,''))<>'' AND not_illustrated<>0 THEN '- '||trim(fig_item_no) ELSE trim(coalesce(fig_item_no,'')) END"
FLAT = "replace(coalesce(nomenclature_clean, nomenclature, ''), chr(10), ' ')"


def _pn_hits(q: str, contains: bool, offset: int = 0) -> list[str]:
    out = []
    for i, c in enumerate([*S.IDENTIFIERS, "alias_value"]):
        source = "SELECT part_id AS id, {} AS rank FROM f_aliases WHERE {}" if i == 3 else "SELECT id, {} AS rank FROM f_parts WHERE {}"
        out.append(source.format(offset + i, f"{c} = '{q}'"))
        if len(q) >= 4:
            out.append(source.format(offset + 10 + i, f"{c} LIKE '{q}%'"))
        if contains and len(q) >= 3:
            out.append(source.format(offset + 20 + i, f"{c} LIKE '%{q}%'"))
    return out


def _term_hits(r: S.Request, offset: int = 0) -> list[str]:
    if not r.q or not r.term_like:
        return ["SELECT id, 0 AS rank FROM f_parts WHERE false"]
    if r.dots:
        return [f"SELECT id, {offset} AS rank FROM f_parts WHERE nom_level >= {len(r.q)}"]
    like = f"upper(coalesce(nomenclature_clean, nomenclature, '')) LIKE '%{r.q}%'"
    return [f"SELECT id, {offset} AS rank FROM f_parts WHERE {like}", f"SELECT attached_to_part_id, {offset + 1} FROM f_parts WHERE attached_to_part_id IS NOT NULL AND {like}"]


def _matched(r: S.Request) -> str:
    if r.match == "pn":
        hits = _pn_hits(r.q, r.contains)
    elif r.match == "term":
        hits = _term_hits(r)
    else:
        hits = _pn_hits(r.q, True, 0 if r.pn_like else 1000) + _term_hits(r, 1000 if r.pn_like else 0)
    where = ["true"] + ([] if r.notes else ["row_kind = 'part'"])
    if r.pdf:
        where.append(f"(pdf_name = '{r.pdf}' OR relative_path = '{r.pdf}')")
    if r.folder:
        where.append(f"(relative_path = '{r.folder}' OR starts_with(relative_path, '{r.folder}/'))")
    return f"""{ctes("f_parts", "f_documents", "f_pages", "f_aliases")}, best AS (SELECT id, min(rank) AS rank FROM ({" UNION ALL ".join(hits)}) GROUP BY id),
m AS (SELECT p.*, rank, pdf_name, relative_path FROM f_parts p JOIN best USING (id) JOIN f_documents d ON d.id = p.document_id WHERE {" AND ".join(where)})"""


def _rows(r: S.Request) -> str:
    doubt = "pn_needs_review DESC, coalesce(pn_best_similarity, 0) DESC, " if r.match == "pn" or (r.match == "all" and r.pn_like) else ""
    by = "upper(coalesce(part_number_canonical, part_number_cell, '')), pdf_name, page_num, id" if r.sort == "name" else f"rank, {doubt}pdf_name, figure_code NULLS FIRST, page_num, id"
    snippet = f"substr({FLAT}, 1, 220)"
    if r.match != "pn" and not r.dots:
        snippet = f"CASE WHEN instr(upper({FLAT}), '{r.q}') <= 0 THEN {snippet} ELSE trim(substr({FLAT}, greatest(instr(upper({FLAT}), '{r.q}') - 80, 1), 260)) END"
    return f"""{_matched(r)}, top AS (SELECT * FROM m ORDER BY {by} LIMIT {r.limit} OFFSET {(r.page - 1) * r.limit})
SELECT id, pdf_name AS source_pdf, relative_path AS source_relative_path, page_num, page_end, figure_code, figure_label, date_text, {FIG} AS fig_item, not_illustrated, pn_corrected, effectivity, part_number_canonical, part_number_cell, nom_level,
 substr({FLAT}, 1, 220) AS nomenclature_preview, {snippet} AS nomenclature_hit_snippet, units_per_assy, pn_needs_review, rank FROM top LEFT JOIN f_pages USING (document_id, page_num)"""


def _search(name: str, r: S.Request) -> None:
    def run(spark, sf_dir):
        c = Catalogue(spark, sf_dir)
        return S.search(c.f_parts, c.f_documents, c.f_pages, c.f_aliases, r)

    QUERIES[name], ORACLE[name] = run, _rows(r)


def _count(name: str, r: S.Request) -> None:
    def run(spark, sf_dir):
        c = Catalogue(spark, sf_dir)
        return S.total(c.f_parts, c.f_documents, c.f_aliases, r)

    QUERIES[name], ORACLE[name] = run, f"{_matched(r)} SELECT count(*) AS total FROM m"


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE[name] = (lambda spark, sf_dir: f(Catalogue(spark, sf_dir))), sql
        return f

    return add


_search("pn_search", S.Request("108A4001-1", "pn"))
_search("pn_search_prefix", S.Request("108a4", "pn", size=50))
_search("pn_search_contains", S.Request("A40", "pn", contains=True))
_search("term_search", S.Request("ring", "term"))
_search("level_search", S.Request("...", "term"))
_search("all_search", S.Request("A4100", "all"))
_search("all_search_term", S.Request("optional", "all"))
_search("search_scoped", S.Request("108A4", "pn", folder="dir1"))
_search("search_by_name", S.Request("108A4", "pn", sort="name"))
_search("search_page2", S.Request("108A4", "pn", page=2))
_search("search_with_notes", S.Request("108A4", "all", notes=True, size=100))
_search("hit_snippet", S.Request("stock", "term", size=30))
_count("search_total", S.Request("108A4", "pn"))
_count("all_total", S.Request("A4100", "all"))


@query("search_envelope", f"{_matched(S.Request('108A4', 'all'))} SELECT count(*) AS total, 2 AS page, 20 AS page_size, 'all' AS match, count(*) > 40 AS has_more FROM m")
def _envelope(c):
    return S.envelope(c.f_parts, c.f_documents, c.f_aliases, S.Request("108A4", "all", page=2))


@query("pn_search_fallback", _rows(S.Request("A4100-2", "pn", contains=True)))
def _fallback(c):
    r = S.with_fallback(c.f_parts, c.f_documents, c.f_aliases, S.Request("A4100-2", "pn"))
    return S.search(c.f_parts, c.f_documents, c.f_pages, c.f_aliases, r)


@query("best_rank", f"{ctes('f_parts', 'f_aliases')} SELECT id, min(rank) AS rank FROM ({' UNION ALL '.join(_pn_hits('A40', True))}) GROUP BY id")
def _best(c):
    return S.best_rank(S.pn_hits(c.f_parts, c.f_aliases, S.Request("A40", "pn", contains=True)))


@query("query_classify", f"{ctes('f_queries')} SELECT qid, q, regexp_full_match(upper(trim(q)), '[A-Z0-9][A-Z0-9./-]*') AND regexp_matches(q, '[0-9]') AS pn_like FROM f_queries")
def _classify(c):
    return c.f_queries.select("qid", "q", T.is_pn_query("q").alias("pn_like"))


@query("preview", f"{ctes('f_parts')} SELECT id, substr({FLAT}, 1, 220) AS preview FROM f_parts")
def _preview(c):
    return c.f_parts.select("id", T.preview(F.coalesce("nomenclature_clean", "nomenclature")).alias("preview"))


@query("fig_item_display", f"{ctes('f_parts')} SELECT id, {FIG} AS fig_item FROM f_parts")
def _fig(c):
    return c.f_parts.select("id", T.fig_item_display("fig_item_raw", "fig_item_no", "not_illustrated").alias("fig_item"))


_TITLE = "CASE WHEN length(t) <= 90 THEN t ELSE regexp_extract(substr(t, 1, 90), '^(.{0,89})\\s', 1) || '…' END"


@query("pn_lookup", f"{ctes('f_parts', 'f_documents', 'f_aliases')}, x AS (SELECT p.*, pdf_name, trim(regexp_replace(coalesce(nomenclature_clean, ''), '\\s+', ' ', 'g')) AS t FROM (SELECT * FROM f_parts WHERE '108A4001-1' IN (part_number_canonical, part_number_extracted, part_number_cell) OR id IN (SELECT part_id FROM f_aliases WHERE alias_value = '108A4001-1')) p LEFT JOIN f_aliases a ON a.part_id = p.id JOIN f_documents d ON d.id = document_id WHERE '108A4001-1' IN (part_number_canonical, part_number_extracted, part_number_cell, alias_value)) SELECT id, pdf_name, page_num, figure_code, fig_item_no, part_number_canonical, {_TITLE} AS title FROM x")
def _lookup(c):
    return S.lookup(c.f_parts, c.f_documents, c.f_aliases, "108a4001-1")


@query("shorten_title", f"WITH x AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, {_TITLE} AS title FROM x")
def _shorten(c):
    return c.table("documents").select("doc_id", T.shorten("text").alias("title"))


def _xrefs_sql(source: str) -> str:
    arms = " UNION ALL ".join(f"SELECT id AS part_id, '{k}' AS kind, upper(unnest(regexp_extract_all(coalesce(nomenclature_clean, ''), '(?i)FOR\\s+{k}\\s+SEE:\\s*([0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}[A-Z]?)', 1))) AS target FROM {source}" for k in ("NHA", "DETAILS"))
    return arms


@query("xrefs_of_hits", f"{_matched(S.Request('A40', 'pn', contains=True))} SELECT * FROM ({_xrefs_sql('m')})")
def _xrefs_of(c):
    r = S.Request("A40", "pn", contains=True)
    return S.xrefs_of(S.matched(c.f_parts, c.f_documents, c.f_aliases, r), c.f_parts)


@query("extract_xrefs", f"{ctes('f_parts')} SELECT * FROM ({_xrefs_sql('f_parts')})")
def _extract(c):
    return c.f_parts.select(F.col("id").alias("part_id"), F.inline(T.cross_references("nomenclature_clean")))


@query("keyword_flags", f"{ctes('f_parts')} SELECT id, regexp_matches(nomenclature_clean, '(?i)\\boptional\\b') AS optional, regexp_matches(nomenclature_clean, '(?i)\\breplace\\b') AS replace FROM f_parts")
def _flags(c):
    return c.f_parts.select("id", T.keyword_flags("nomenclature_clean").alias("f")).select("id", "f.optional", "f.replace")


_SEGMENTS = f"""{ctes('f_parts')}, s AS (SELECT id, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS text FROM (SELECT id, list_filter(string_split(regexp_replace(nomenclature_clean, '(?i)(\\b(?:optional|replace)\\b)', chr(1) || chr(2) || '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS l FROM f_parts))
SELECT id, i::INTEGER AS pos, replace(text, chr(2), '') AS text, starts_with(text, chr(2)) AS hit FROM s"""


@query("highlight_segments", _SEGMENTS)
def _segments(c):
    return c.f_parts.select("id", F.posexplode(T.highlight_segments("nomenclature_clean")).alias("pos", "s")).select("id", "pos", "s.text", "s.hit")


_ASKED = "asked AS (SELECT qid, id, nomenclature_clean AS t, CASE WHEN qid % 5 = 0 THEN ' a ' ELSE q || '  ' || lower(split_part(nomenclature_clean, ' ', 1)) || ' x ' || q || ' ' || substr(nomenclature_clean, 2, 3) END AS q FROM f_queries JOIN f_parts ON id % 1000 = qid)"
_ESCAPED = "list_transform(list_filter(list_distinct(regexp_split_to_array(trim(q), '\\s+')), lambda w: length(w) >= 2), lambda w: {'at': instr(' ' || regexp_replace(trim(q), '\\s+', ' ', 'g') || ' ', ' ' || w || ' '), 'w': regexp_escape(w)})"


@query("query_segments", f"""{ctes('f_parts', 'f_queries')}, {_ASKED}, e AS (SELECT *, list_transform(list_sort({_ESCAPED}), lambda w: w.w) AS ws FROM asked),
s AS (SELECT qid, id, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS text FROM (SELECT qid, id, list_filter(string_split(CASE WHEN len(ws) = 0 THEN t ELSE regexp_replace(t, '(?i)(' || array_to_string(ws, '|') || ')', chr(1) || chr(2) || '\\1' || chr(1), 'g') END, chr(1)), lambda x: x <> '') AS l FROM e))
SELECT qid, id, i::INTEGER AS pos, replace(text, chr(2), '') AS text, starts_with(text, chr(2)) AS hit FROM s""")
def _query_segments(c):
    t = F.col("nomenclature_clean")
    q = F.when(F.col("qid") % 5 == 0, " a ").otherwise(F.concat("q", F.lit("  "), F.lower(F.substring_index(t, " ", 1)), F.lit(" x "), "q", F.lit(" "), F.substring(t, 2, 3)))
    rows = c.f_queries.join(c.f_parts.select("id", "nomenclature_clean", (F.col("id") % 1000).cast("int").alias("qid")), "qid")
    return rows.select("qid", "id", F.posexplode(T.query_segments(t, q)).alias("pos", "s")).select("qid", "id", "pos", "s.text", "s.hit")


@query("page_window", """SELECT c_custkey, greatest(ceil((c_custkey % 400) / 20), 1)::BIGINT AS total_pages, least(greatest(c_custkey % 31, 1), greatest(ceil((c_custkey % 400) / 20), 1))::BIGINT AS page,
 greatest(least(least(greatest(c_custkey % 31, 1), greatest(ceil((c_custkey % 400) / 20), 1)) - 5, greatest(ceil((c_custkey % 400) / 20), 1) - 9), 1)::BIGINT AS first,
 least(greatest(least(least(greatest(c_custkey % 31, 1), greatest(ceil((c_custkey % 400) / 20), 1)) - 5, greatest(ceil((c_custkey % 400) / 20), 1) - 9), 1) + 9, greatest(ceil((c_custkey % 400) / 20), 1))::BIGINT AS last FROM customer""")
def _window(c):
    w = T.page_window(F.col("c_custkey") % 31, F.col("c_custkey") % 400)
    return c.table("customer").select("c_custkey", w.alias("w")).select("c_custkey", "w.total_pages", "w.page", "w.first", "w.last")


_KEYED = " UNION ALL ".join([f"SELECT id, {i} AS kind, {c} AS value FROM f_parts WHERE {c} IS NOT NULL" for i, c in enumerate(S.IDENTIFIERS)] + ["SELECT part_id, 3, alias_value FROM f_aliases"])
_BATCH = f"{ctes('f_parts', 'f_aliases', 'f_queries')}, v AS ({_KEYED}), u AS (SELECT qid, upper(trim(q)) AS q FROM f_queries), uq AS (SELECT DISTINCT q FROM u)"
_BATCH_HITS = "SELECT q, id, kind AS rank FROM v JOIN uq ON value = q UNION ALL SELECT q, id, kind + 10 FROM v JOIN uq ON length(q) >= 4 AND starts_with(value, q)"
_BATCH_IN = "SELECT q, id, kind + 20 AS rank FROM v JOIN uq ON length(q) >= 3 AND contains(value, q)"


@query("batch_pn_search", f"{_BATCH}, h AS (SELECT q, id, min(rank) AS rank FROM ({_BATCH_HITS}) GROUP BY ALL) SELECT qid, id, rank FROM u JOIN h USING (q)")
def _batch(c):
    return S.batch_search(c.f_parts, c.f_aliases, c.f_queries, contains=False)


@query("batch_contains_search", f"{_BATCH}, h AS (SELECT q, id, min(rank) AS rank FROM ({_BATCH_IN}) GROUP BY ALL) SELECT qid, count(*) AS hits, min(id) AS first_id, sum(rank)::BIGINT AS ranks FROM u JOIN h USING (q) GROUP BY qid")
def _batch_contains(c):
    needles = S._asked(c.f_queries).select("needle").distinct()
    found = S.best(S.contains_hits(S._keyed(c.f_parts, c.f_aliases), needles)).groupBy("needle").agg(F.count("*").alias("hits"), F.min("id").alias("first_id"), F.sum("rank").alias("ranks"))
    return S.by_query(found, c.f_queries)


def stored_index(c) -> Store:
    """The side tables of this folder's catalogue, in the shared folder."""
    store = Store(c.spark, new_path(c.spark, "search-index"))
    search_index.build(store, c.f_parts, c.f_aliases)
    return store


@query("batch_contains_stored", ORACLE["batch_contains_search"])
def _batch_contains_stored(c):
    store, needles = stored_index(c), S._asked(c.f_queries).select("needle").distinct()
    found = S.best(search_index.contains_hits(store, needles)).groupBy("needle").agg(F.count("*").alias("hits"), F.min("id").alias("first_id"), F.sum("rank").alias("ranks"))
    return S.by_query(found, c.f_queries)


@query("batch_stored", f"{_BATCH}, h AS (SELECT q, id, min(rank) AS rank FROM ({_BATCH_HITS} UNION ALL {_BATCH_IN}) GROUP BY ALL) SELECT qid, count(*) AS hits, min(id) AS first_id, sum(rank)::BIGINT AS ranks FROM u JOIN h USING (q) GROUP BY qid")
def _batch_stored(c):
    found = search_index.needle_hits(stored_index(c), c.f_queries).groupBy("needle").agg(F.count("*").alias("hits"), F.min("id").alias("first_id"), F.sum("rank").alias("ranks"))
    return S.by_query(found, c.f_queries)


@query("batch_topk", f"{_BATCH}, h AS (SELECT q, id, min(rank) AS rank FROM ({_BATCH_HITS} UNION ALL {_BATCH_IN}) GROUP BY ALL), k AS (SELECT q, id, rank, row_number() OVER (PARTITION BY q ORDER BY rank, id)::INTEGER AS position FROM h) SELECT qid, id, rank, position FROM u JOIN k USING (q) WHERE position <= 10")
def _topk(c):
    return S.batch_top_k(c.f_parts, c.f_aliases, c.f_queries, 10)


_WILD = "CASE WHEN c_custkey % 3 = 0 THEN '1__A4' || (c_custkey % 10)::VARCHAR WHEN c_custkey % 3 = 1 THEN 'A4' || lpad((c_custkey % 50)::VARCHAR, 2, '0') || '%-' || (1 + c_custkey % 9)::VARCHAR ELSE '%' || (c_custkey % 10)::VARCHAR || '_-' END"


def wild(c):
    k = F.col("c_custkey")
    q = F.when(k % 3 == 0, F.concat(F.lit("1__A4"), (k % 10).cast("string"))).when(k % 3 == 1, F.concat(F.lit("A4"), F.lpad((k % 50).cast("string"), 2, "0"), F.lit("%-"), (1 + k % 9).cast("string"))).otherwise(F.concat(F.lit("%"), (k % 10).cast("string"), F.lit("_-")))
    return c.table("customer").select(k.cast("int").alias("qid"), q.alias("q"))


@query("batch_wildcard_search", f"{ctes('f_parts', 'f_aliases')}, v AS ({_KEYED}), u AS (SELECT CAST(c_custkey AS INTEGER) AS qid, {_WILD} AS q FROM customer), uq AS (SELECT DISTINCT q FROM u), dv AS (SELECT DISTINCT value FROM v), m AS (SELECT value, q, CASE WHEN length(q) >= 4 AND value LIKE q || '%' THEN 10 ELSE 20 END AS far FROM dv JOIN uq ON value LIKE '%' || q || '%'), h AS (SELECT q, id, min(kind + far) AS rank FROM v JOIN m USING (value) GROUP BY ALL) SELECT qid, count(*) AS hits, min(id) AS first_id, sum(rank)::BIGINT AS ranks FROM u JOIN h USING (q) GROUP BY qid")
def _wildcards(c):
    found = S.needle_hits(c.f_parts, c.f_aliases, wild(c)).groupBy("needle").agg(F.count("*").alias("hits"), F.min("id").alias("first_id"), F.sum("rank").alias("ranks"))
    return S.by_query(found, wild(c))


@query("batch_term_search", f"{ctes('f_parts', 'f_queries')}, u AS (SELECT qid, upper(trim(q)) AS q FROM f_queries), uq AS (SELECT DISTINCT q FROM u), t AS (SELECT id, attached_to_part_id, nom_level, upper(coalesce(nomenclature_clean, nomenclature, '')) AS value FROM f_parts), f AS (SELECT q, id, attached_to_part_id FROM t JOIN uq ON contains(value, q) WHERE NOT regexp_full_match(q, '[.]+') AND length(q) >= 3), h AS (SELECT q, id, min(rank) AS rank FROM (SELECT q, id, 0 AS rank FROM f UNION ALL SELECT q, attached_to_part_id, 1 FROM f WHERE attached_to_part_id IS NOT NULL UNION ALL SELECT q, id, 0 FROM t JOIN uq ON regexp_full_match(q, '[.]+') AND nom_level >= length(q)) GROUP BY ALL), n AS (SELECT q, count(*) AS hits, min(id) AS first_id, sum(rank)::BIGINT AS ranks FROM h GROUP BY q) SELECT qid, hits, first_id, ranks FROM u JOIN n USING (q)")
def _batch_terms(c):
    needles = S._asked(c.f_queries).select("needle").distinct()
    found = S.best(S.term_hits_of(c.f_parts, needles)).groupBy("needle").agg(F.count("*").alias("hits"), F.min("id").alias("first_id"), F.sum("rank").alias("ranks"))
    return S.by_query(found, c.f_queries)
