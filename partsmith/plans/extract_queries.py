"""Extraction queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import build as B
from ..operators import extract as E
from ..sources.fixtures import Catalogue, ctes

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Catalogue(spark, sf_dir))
        if sql:
            ORACLE[name] = sql
        return f

    return add


PT = f"{E.PT!r}"
_W = ctes("f_words", "f_word_pages")
_COLS = " UNION ALL ".join(f"SELECT '{n}' AS col, {a * E.PT!r}::DOUBLE AS a, {b * E.PT!r}::DOUBLE AS b" for n, (a, b) in E.COLUMNS.items())
_IN_TABLE = f"(x0 + x1) / 2 BETWEEN {2.3 * E.PT!r} AND {19.5 * E.PT!r} AND (y0 + y1) / 2 BETWEEN {2.5 * E.PT!r} AND {25.4 * E.PT!r}"
_CW = f"{_W}, cols AS ({_COLS}), cw AS (SELECT w.*, col, (y0 + y1) / 2 AS cy FROM f_words w JOIN cols ON (x0 + x1) / 2 BETWEEN a AND b)"
# In these tables a line's words lie within the tolerance, so that gaps alone mark the lines.
_ANCHORS = f"""{_CW}, pnw AS (SELECT doc_id, page_num, y0 AS y, trim(word) AS pn FROM cw WHERE col = 'part_number' AND cy BETWEEN {E.SCAN_FROM!r} AND {E.SCAN_TO!r}),
anchors AS (SELECT * FROM pnw WHERE regexp_full_match(pn, '[A-Z0-9][A-Z0-9./-]*') AND regexp_matches(pn, '[0-9]') AND NOT regexp_full_match(pn, '[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}[A-Z]?')),
runs AS (SELECT * FROM (SELECT *, sum(CASE WHEN is_table THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY page_num) AS run FROM f_word_pages) WHERE is_table),
spans AS (SELECT *, coalesce(min(CASE WHEN last_y IS NOT NULL THEN page_num END) OVER (PARTITION BY doc_id, run ORDER BY page_num ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), max(page_num) OVER (PARTITION BY doc_id, run)) AS e
  FROM runs LEFT JOIN (SELECT doc_id, page_num, max(y) AS last_y FROM anchors GROUP BY ALL) USING (doc_id, page_num)),
ps AS (SELECT doc_id, page_num, run, y, pn, CASE WHEN y = last_y THEN e ELSE page_num END AS page_end FROM anchors JOIN spans USING (doc_id, page_num))"""
_RECORDS = f"""{_ANCHORS}, u AS (SELECT doc_id, run, page_num, y AS ya, 0 AS kind, {{'page': page_num, 'y': y, 'pn': pn, 'page_end': page_end}} AS anchor, NULL AS col, NULL AS x0, NULL AS y0, NULL AS word FROM ps
  UNION ALL SELECT doc_id, run, page_num, cy, 1, NULL, col, x0, y0, word FROM cw JOIN runs USING (doc_id, page_num) WHERE cy < {E.SCAN_TO!r}),
a AS (SELECT *, last_value(anchor IGNORE NULLS) OVER (PARTITION BY doc_id, run ORDER BY page_num, ya, kind ROWS UNBOUNDED PRECEDING) AS r FROM u),
k AS (SELECT * FROM a WHERE kind = 1 AND r IS NOT NULL AND (r.page = page_num OR (col IN ('nomenclature', 'effect', 'units') AND ya >= {E.SCAN_FROM!r}))),
cells AS (SELECT doc_id, r, col, page_num, string_agg(t, chr(10) ORDER BY y0) FILTER (t <> '') AS t FROM (SELECT doc_id, r, col, page_num, x0, y0, trim(regexp_replace(trim(word), '\\s+', ' ', 'g')) AS t FROM k) GROUP BY ALL),
texts AS (SELECT doc_id, r, col, string_agg(t, chr(10) ORDER BY page_num) FILTER (t <> '') AS t FROM cells GROUP BY ALL),
records AS (SELECT doc_id, r.page AS page_num, r.page_end AS page_end, r.y AS y, r.pn AS pn, string_split(coalesce(max(t) FILTER (col = 'fig_item'), ''), chr(10))[1] AS fig_item, coalesce(max(t) FILTER (col = 'nomenclature'), '') AS nomenclature, coalesce(max(t) FILTER (col = 'effect'), '') AS effect, coalesce(max(t) FILTER (col = 'units'), '') AS units FROM texts GROUP BY doc_id, r)"""


@query("table_pages", f"{_W} SELECT doc_id, page_num, (doc_id + page_num) % 5 <> 4 AS is_table FROM f_word_pages")
def _table_pages(c):
    k = (F.col("doc_id") + F.col("page_num")) % 5
    mark = F.when(k == 0, "see fig. 2")
    header = F.when(k == 1, "Part Number").when(k == 2, "nomenclature").when(k == 3, "fig / item").otherwise("item")
    return c.word_pages.select("doc_id", "page_num", E.is_table_page(mark, header).alias("is_table"))


@query("clip_text", f"{_W} SELECT doc_id, page_num, string_agg(word, ' ' ORDER BY y0, x0, word) AS text FROM f_words WHERE (x0 + x1) / 2 BETWEEN {2.3 * E.PT!r} AND {19.5 * E.PT!r} AND (y0 + y1) / 2 BETWEEN {2.5 * E.PT!r} AND {5.2 * E.PT!r} GROUP BY doc_id, page_num")
def _clip(c):
    return E.clip_text(c.boxes, E.HEADER)


@query("word_columns", f"{_CW} SELECT doc_id, page_num, col, count(*) AS n, min(word) AS first_word FROM cw GROUP BY doc_id, page_num, col")
def _columns(c):
    return E.with_columns(c.words).groupBy("doc_id", "page_num", "col").agg(F.count("*").alias("n"), F.min("word").alias("first_word"))


_GAPS = "SELECT *, sum(opens) OVER (PARTITION BY doc_id, page_num ORDER BY y0, x0, word ROWS UNBOUNDED PRECEDING) AS band FROM (SELECT *, CASE WHEN y0 - lag(y0) OVER (PARTITION BY doc_id, page_num ORDER BY y0, x0, word) <= 2 THEN 0 ELSE 1 END AS opens FROM f_words)"


@query("line_bands", f"{_W} SELECT doc_id, page_num, band::INTEGER AS band, min(y0) AS y, trim(regexp_replace(string_agg(trim(word), ' ' ORDER BY x0, y0) FILTER (trim(word) <> ''), '\\s+', ' ', 'g')) AS text FROM ({_GAPS}) GROUP BY doc_id, page_num, band")
def _bands(c):
    return E.line_bands(c.boxes)


@query("column_text", f"{_CW} SELECT doc_id, page_num, col, coalesce(string_agg(trim(regexp_replace(trim(word), '\\s+', ' ', 'g')), chr(10) ORDER BY y0) FILTER (trim(word) <> ''), '') AS text FROM cw GROUP BY doc_id, page_num, col")
def _column_text(c):
    return E.cell_texts(c.boxes)


@query("pn_anchors", f"{_ANCHORS} SELECT doc_id, page_num, y, pn FROM anchors")
def _anchors(c):
    return E.anchors(c.boxes)


@query("row_segments", f"{_ANCHORS}, s AS (SELECT w.doc_id, w.page_num, col, word, max(a.y) AS row_y, max_by(a.pn, a.y) AS pn FROM cw w JOIN anchors a ON a.doc_id = w.doc_id AND a.page_num = w.page_num AND a.y <= w.cy WHERE w.cy < {E.SCAN_TO!r} GROUP BY w.doc_id, w.page_num, col, x0, y0, word) SELECT doc_id, page_num, row_y, pn, count(*) AS n_words, count(DISTINCT col) AS n_cols FROM s GROUP BY doc_id, page_num, row_y, pn")
def _segments(c):
    return E.segments(c.boxes).select("doc_id", "page_num", "row_y", "pn", "n_words", "n_cols")


@query("row_page_span", f"{_ANCHORS} SELECT doc_id, page_num, y, pn, page_end FROM ps")
def _spans(c):
    return E.page_spans(E.anchors(c.boxes), c.word_pages).drop("run")


@query("raw_rows", f"{_RECORDS} SELECT * FROM records")
def _records(c):
    return E.records(c.boxes, c.word_pages)


_FIGP = "CASE WHEN starts_with(trim(fig_item), '-') THEN nullif(regexp_extract(fig_item, '([0-9]+[A-Z]?)', 1), '') WHEN regexp_full_match(trim(fig_item), '[0-9]+[A-Z]?') THEN trim(fig_item) END"


@query("parts_project", f"""{_RECORDS}, p AS (SELECT *, {_FIGP} AS no, regexp_replace(regexp_replace(nomenclature, '(?i)^(?:[ \\t]*(?:of|date|out)[ \\t]*(?:\\n|$))+', ''), '\\s+$', '') AS n FROM records)
SELECT doc_id, page_num, page_end, pn AS part_number_cell, nullif(CASE WHEN no IS NOT NULL THEN CASE WHEN starts_with(trim(fig_item), '-') THEN '-' ELSE '' END ELSE trim(fig_item) END, '') AS fig_item_raw, no AS fig_item_no, CASE WHEN starts_with(trim(fig_item), '-') THEN 1 ELSE 0 END AS not_illustrated,
 length(regexp_extract(n, '^\\s*(\\.*)', 1))::INTEGER AS nom_level, nullif(trim(regexp_replace(n, '^\\.+[ \\t]*', ''), chr(10) || ' '), '') AS nomenclature_clean, nullif(trim(effect), '') AS effectivity, nullif(trim(units), '') AS units_per_assy, 'part' AS row_kind FROM p""")
def _project(c):
    return E.project(E.records(c.boxes, c.word_pages))


# How the fixture's part numbers are read: by their page's text, see fixtures.build_pages.
_READ = "CASE (doc_id + 2 * (ascii(pn[-1:]) - 65)) % 8 WHEN 3 THEN 'fuzzy' WHEN 5 THEN 'unverified' WHEN 6 THEN 'loose' ELSE 'exact' END"
_BUILT = f"""{_RECORDS}, p0 AS (SELECT *, {_FIGP} AS no, regexp_replace(regexp_replace(nomenclature, '(?i)^(?:[ \\t]*(?:of|date|out)[ \\t]*(?:\\n|$))+', ''), '\\s+$', '') AS n, {_READ} AS method, CASE {_READ} WHEN 'fuzzy' THEN replace(pn, '-7088-', '-7Z88-') WHEN 'loose' THEN replace(pn, '-7088-', '-7O88-') ELSE pn END AS canonical FROM records),
p1 AS (SELECT row_number() OVER (ORDER BY p0.doc_id, p0.page_num, y, pn)::BIGINT AS id, p0.*, meta_text, '21-1' || (p0.doc_id % 10)::VARCHAR || '-00-0' || (1 + p0.page_num // 2 % 9)::VARCHAR AS figure_code, length(regexp_extract(n, '^\\s*(\\.*)', 1))::INTEGER AS nom_level FROM p0 JOIN f_word_pages USING (doc_id, page_num)),
p2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, figure_code ORDER BY id) AS seq FROM p1),
up AS (SELECT a.id, max_by(b.id, b.seq) AS pid, max_by(b.nom_level, b.seq) AS plevel, max(b.seq) AS pseq FROM p2 a JOIN p2 b ON a.doc_id = b.doc_id AND a.figure_code = b.figure_code AND b.seq < a.seq AND b.nom_level < a.nom_level GROUP BY a.id),
allbuilt AS (SELECT id, doc_id::BIGINT AS document_id, page_num, page_end, 'pdf_coords' AS extractor, meta_text AS meta_data_raw, figure_code, nullif(CASE WHEN no IS NOT NULL THEN CASE WHEN starts_with(trim(fig_item), '-') THEN '-' ELSE '' END ELSE trim(fig_item) END, '') AS fig_item_raw, no AS fig_item_no,
 CASE WHEN no IS NOT NULL THEN 'pdf_coords' END AS fig_item_no_source, CASE WHEN starts_with(trim(fig_item), '-') THEN 1 ELSE 0 END AS not_illustrated, pn AS part_number_cell, pn AS part_number_extracted, canonical AS part_number_canonical, (method = 'fuzzy')::INTEGER AS pn_corrected, method AS pn_method,
 CASE WHEN method = 'fuzzy' THEN (2 * length(pn) - 2)::DOUBLE / (2 * length(pn)) END AS pn_best_similarity, (method = 'unverified')::INTEGER AS pn_needs_review, CASE WHEN method = 'fuzzy' THEN pn || ' -> ' || canonical || ' (sim ' || printf('%.3f', (length(pn) - 1)::DOUBLE / length(pn)) || ')' END AS correction_note,
 'part' AS row_kind, nom_level, nullif(trim(regexp_replace(n, '^\\.+[ \\t]*', ''), chr(10) || ' '), '') AS nomenclature_clean, CASE WHEN nom_level <= 0 THEN NULL WHEN plevel = nom_level - 1 THEN pid WHEN seq = 1 OR pseq = seq - 1 THEN NULL ELSE 0 END::BIGINT AS parent_part_id, NULL::BIGINT AS attached_to_part_id, nullif(n, '') AS nomenclature, nullif(trim(effect), '') AS effectivity, nullif(trim(units), '') AS units_per_assy, NULL::VARCHAR AS miner_table_img_path FROM p2 LEFT JOIN up USING (id)),
firsts AS (SELECT id AS fid, min(id) OVER (PARTITION BY document_id, page_num, figure_code, fig_item_raw, fig_item_no, not_illustrated, part_number_cell, nomenclature_clean, effectivity, units_per_assy, nom_level, coalesce(parent_part_id, 0)) AS first_id FROM allbuilt),
built AS (SELECT a.* REPLACE (coalesce(p.first_id, a.parent_part_id) AS parent_part_id) FROM allbuilt a JOIN firsts f ON f.fid = a.id AND f.first_id = a.id LEFT JOIN firsts p ON p.fid = a.parent_part_id)"""


@query("build_parts", f"{_BUILT} SELECT * FROM built")
def _build(c):
    return B.build(c.boxes, c.build_pages)["parts"]


@query("build_summary", f"{_BUILT} SELECT (SELECT count(DISTINCT document_id) FROM allbuilt) AS docs, (SELECT count(*) FROM built) AS parts, (SELECT count(*) FROM allbuilt) - (SELECT count(*) FROM built) AS parts_dedup, (SELECT count(*) FROM allbuilt WHERE pn_corrected = 1) AS pn_corrected")
def _build_summary(c):
    return B.build(c.boxes, c.build_pages)["totals"]


@query("build_totals", f"{_BUILT} SELECT (SELECT count(DISTINCT doc_id) FROM f_word_pages) AS docs, (SELECT count(*) FROM built) AS parts, (SELECT count(*) FROM allbuilt) - (SELECT count(*) FROM built) AS parts_dedup, (SELECT count(*) FROM allbuilt WHERE pn_corrected = 1) AS pn_corrected")
def _totals(c):
    return B.corpus_totals(c.boxes, c.build_pages, c.word_pages)


_META = "'21-1' || ((doc_id % 10)::VARCHAR) || '-00-0' || (1 + page_num // 2 % 9)::VARCHAR AS figure_code, 'FIG. ' || (1 + page_num // 2 % 9)::VARCHAR AS figure_label, 'APR ' || (10 + page_num % 18)::VARCHAR || '/21' AS date_text, 'PAGE ' || page_num::VARCHAR AS page_token, 'RF 21-1' || (doc_id % 8)::VARCHAR || '-00' AS rf_text"


@query("footer_meta", f"{_W} SELECT doc_id, page_num, {_META} FROM f_word_pages")
def _footer(c):
    return c.word_pages.withColumn("m", T.footer_meta("meta_text")).select("doc_id", "page_num", "m.*")


@query("pages_dim", f"{_ANCHORS} SELECT doc_id, page_num, {_META} FROM (SELECT DISTINCT doc_id, page_num FROM ps)")
def _pages_dim(c):
    return E.pages_dim(E.page_spans(E.anchors(c.boxes), c.word_pages), c.word_pages)


@query("page_text_meta", f"{_W} SELECT doc_id, page_num, CASE WHEN page_num % 2 = 0 THEN '21-10-00-02A' ELSE '21-10-00-01' END AS figure_code, 'FIG. ' || (1 + page_num // 2 % 9)::VARCHAR AS figure_label, 'APR ' || (10 + page_num % 18)::VARCHAR || '/21' AS date_text, 'PAGE ' || page_num::VARCHAR AS page_token, 'RF 21-1' || (doc_id % 8)::VARCHAR || '-00' AS rf_text FROM f_word_pages")
def _text_meta(c):
    codes = F.when(F.col("page_num") % 2 == 0, "\nFOR 21-10-00-02A AND 21-10-00-03").otherwise("\nFOR 33-10-00-99A AND 21-10-00-01")
    return c.word_pages.withColumn("m", T.page_text_meta(F.concat("meta_text", codes), "21-1")).select("doc_id", "page_num", "m.*")


@query("page_token", f"{_W} SELECT doc_id, page_num, 'PAGE ' || (page_num + 1)::VARCHAR || 'A' AS token FROM f_word_pages")
def _token(c):
    return c.word_pages.select("doc_id", "page_num", T.page_token(F.concat("meta_text", F.lit("\npage "), (F.col("page_num") + 1).cast("string"), F.lit("a"))).alias("token"))


_Q = ctes("f_parts")


@query("figure_suffix", f"{_Q} SELECT id, CASE WHEN id % 4 = 0 THEN lpad((id % 10)::VARCHAR, 2, '0') WHEN id % 4 = 1 THEN lpad((id % 10)::VARCHAR, 2, '0') || 'B' WHEN id % 4 = 2 THEN (10 + id % 80)::VARCHAR || 'A' ELSE 'X' || id::VARCHAR END AS suffix FROM f_parts")
def _suffix(c):
    raw = "CASE WHEN id % 4 = 0 THEN concat(' ', id % 10) WHEN id % 4 = 1 THEN concat(id % 10, ' b') WHEN id % 4 = 2 THEN concat(10 + id % 80, 'a ') ELSE concat('x', id) END"
    return c.f_parts.select("id", T.figure_suffix(F.expr(raw)).alias("suffix"))


@query("fig_item_parse", f"{_Q}, x AS (SELECT id, CASE WHEN id % 3 = 0 THEN '- ' || fig_item_no WHEN id % 3 = 1 THEN fig_item_no || 'A' ELSE '* ' || fig_item_no END AS fig_item FROM f_parts) SELECT id, CASE WHEN id % 3 = 0 THEN CASE WHEN fig_item IS NOT NULL THEN '-' END WHEN id % 3 = 2 THEN fig_item END AS raw, {_FIGP} AS no, CASE WHEN fig_item IS NOT NULL AND id % 3 < 2 THEN 'pdf_coords' END AS source, CASE WHEN id % 3 = 0 AND fig_item IS NOT NULL THEN 1 ELSE 0 END AS not_illustrated FROM x")
def _fig_parse(c):
    cell = F.when(F.col("id") % 3 == 0, F.concat(F.lit("- "), "fig_item_no")).when(F.col("id") % 3 == 1, F.concat("fig_item_no", F.lit("A"))).otherwise(F.concat(F.lit("* "), "fig_item_no"))
    return c.f_parts.select("id", T.fig_item_parse(cell).alias("f")).select("id", "f.*")


_MESSY = "CASE WHEN id % 3 = 0 THEN lower(replace(part_number_cell, '0', 'O')) WHEN id % 3 = 1 THEN replace(replace(part_number_cell, '-', '–'), 'A', 'A0B ') WHEN id % 7 = 2 THEN id::VARCHAR ELSE part_number_cell END"


def _twice(x: str, a: str, b: str, to: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '({a}){b}({a})', '\\1{to}\\2', 'g'), '({a}){b}({a})', '\\1{to}\\2', 'g')"


_CELL = _twice("regexp_replace(replace(upper(coalesce(raw, '')), '–', '-'), '\\s+', '', 'g')", "[0-9]", "O", "0")
_LOOSE = _twice("cell", "[A-Z]", "0", "O")
_NORM = f"{_Q}, x AS (SELECT id, {_MESSY} AS raw FROM f_parts), y AS (SELECT id, raw, {_CELL} AS cell FROM x), z AS (SELECT *, {_LOOSE} AS loose FROM y)"


def messy(c):
    return c.f_parts.select("id", F.expr(_MESSY.replace("id::VARCHAR", "cast(id as string)")).alias("raw"))


@query("pn_normalize", f"{_NORM} SELECT id, cell, loose FROM z")
def _normalize(c):
    return messy(c).select("id", T.pn_cell_form("raw").alias("cell"), T.pn_loose_form("raw").alias("loose"))


_LEGAL = "regexp_full_match({0}, '[A-Z0-9][A-Z0-9./-]*') AND regexp_matches({0}, '[0-9]') AND NOT regexp_full_match({0}, '[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}[A-Z]?')"


@query("pn_classify", f"{_NORM} SELECT id, {_LEGAL.format('loose')} AND NOT regexp_full_match(loose, '[0-9]+') AS token, {_LEGAL.format('cell')} AND (NOT regexp_full_match(cell, '[0-9]+') OR length(cell) >= 3) AS in_cell FROM z")
def _classify(c):
    return messy(c).select("id", T.is_part_number("raw").alias("token"), T.is_part_number_cell("raw").alias("in_cell"))


_PAGE_TEXT = "SELECT document_id AS doc_id, page_num, string_agg(coalesce(part_number_canonical, 'NOTE') || ' ' || coalesce(fig_item_no, ''), ' ' ORDER BY id) AS text FROM f_parts GROUP BY document_id, page_num"
_TOKENS = f"{_Q}, pt AS ({_PAGE_TEXT}), raw_tokens AS (SELECT DISTINCT doc_id, page_num, unnest(list_concat(regexp_extract_all(upper(text), '[A-Z0-9][A-Z0-9./-]{{3,}}'), regexp_extract_all(upper(text), '\\b[A-Z]{{1,3}}[0-9]{{1,4}}[A-Z]?\\b'))) AS token FROM pt), tokens AS (SELECT * FROM raw_tokens WHERE {_LEGAL.format('token')} AND NOT regexp_full_match(token, '[0-9]+'))"


def page_texts(c):
    line = F.concat(F.coalesce("part_number_canonical", F.lit("NOTE")), F.lit(" "), F.coalesce("fig_item_no", F.lit("")))
    rows = c.f_parts.groupBy(F.col("document_id").alias("doc_id"), "page_num").agg(F.array_sort(F.collect_list(F.struct("id", line.alias("t")))).alias("l"))
    return rows.select("doc_id", "page_num", F.array_join(F.transform("l", lambda x: x["t"]), " ").alias("text"))


@query("pn_candidates", f"{_TOKENS} SELECT doc_id, page_num, token FROM tokens")
def _candidates(c):
    return E.candidates(page_texts(c), "text")


def _cells(c):
    raw = F.when(F.col("id") % 5 == 0, F.lower("part_number_cell")).when(F.col("id") % 5 == 1, F.replace("part_number_cell", F.lit("0"), F.lit("O"))).otherwise(F.coalesce("part_number_cell", F.lit("")))
    return c.f_parts.select(F.col("document_id").alias("doc_id"), "page_num", raw.alias("raw"))


_CANON = f"""{_TOKENS}, c0 AS (SELECT DISTINCT document_id AS doc_id, page_num, trim(CASE WHEN id % 5 = 0 THEN lower(part_number_cell) WHEN id % 5 = 1 THEN replace(part_number_cell, '0', 'O') ELSE coalesce(part_number_cell, '') END) AS raw FROM f_parts),
c1 AS (SELECT *, {_CELL} AS cell FROM c0), c2 AS (SELECT *, {_LOOSE} AS loose FROM c1), t1 AS (SELECT doc_id, page_num, token, token AS raw FROM tokens), t2 AS (SELECT doc_id, page_num, token, {_CELL} AS cell FROM t1), t3 AS (SELECT doc_id, page_num, {_LOOSE} AS loose, min(token) AS l FROM t2 GROUP BY ALL)
SELECT c.doc_id, c.page_num, c.raw, coalesce(e.token, l, upper(c.raw)) AS canonical, CASE WHEN c.raw = '' THEN 'empty' WHEN e.token IS NOT NULL THEN 'exact' WHEN l IS NOT NULL THEN 'loose' ELSE 'unverified' END AS method, c.raw <> '' AND e.token IS NULL AND l IS NULL AS needs_review, false AS corrected
FROM c2 c LEFT JOIN tokens e ON e.doc_id = c.doc_id AND e.page_num = c.page_num AND e.token = upper(c.raw) LEFT JOIN t3 ON t3.doc_id = c.doc_id AND t3.page_num = c.page_num AND t3.loose = c.loose WHERE c.raw IS NOT NULL"""


@query("pn_canonicalize", _CANON)
def _canonicalize(c):
    return E.canonicalize(_cells(c).where("raw is not null"), E.candidates(page_texts(c), "text"), fuzzy=False).drop("similarity", "note")


@query("pn_canonicalize_fuzzy", None)
def _fuzzy(c):
    return E.canonicalize(_cells(c).where("raw is not null"), E.candidates(page_texts(c), "text"))


_DIRTY = "CASE WHEN id % 23 = 0 THEN 'DATE' || chr(10) ELSE '' END || CASE WHEN id % 31 = 0 THEN '资料失效' || chr(10) ELSE '' END || CASE WHEN id % 29 = 0 THEN ' of ' || chr(10) ELSE '' END || nomenclature"


@query("nomenclature_watermark", f"{_Q} SELECT id, nomenclature AS clean FROM f_parts")
def _watermark(c):
    return c.f_parts.select("id", T.strip_watermark(F.expr(_DIRTY.replace("chr(10)", "'\\n'"))).alias("clean"))


@query("nomenclature_level", f"{_Q} SELECT id, nom_level AS level, nomenclature_clean AS clean FROM f_parts")
def _level(c):
    return c.f_parts.select("id", T.nomenclature_level("nomenclature").alias("level"), T.nomenclature_clean("nomenclature").alias("clean"))


@query("rows_near_anchor", f"""{_ANCHORS}, n AS (SELECT a.doc_id, a.page_num, a.y, a.pn, col, x0, y0, trim(word) AS w FROM anchors a JOIN cw ON cw.doc_id = a.doc_id AND cw.page_num = a.page_num AND col IN ('fig_item', 'nomenclature') AND cy BETWEEN {E.SCAN_FROM!r} AND {E.SCAN_TO!r} AND abs(cy - y) <= CASE WHEN col = 'fig_item' THEN 6 ELSE 9 END)
SELECT doc_id, page_num, y, pn, coalesce(string_agg(w, ' ' ORDER BY x0, y0, w) FILTER (col = 'fig_item'), '') AS fig_item, coalesce(string_agg(w, ' ' ORDER BY x0, y0, w) FILTER (col = 'nomenclature'), '') AS nomenclature FROM n GROUP BY doc_id, page_num, y, pn""")
def _near(c):
    return E.rows_near(c.boxes)
