"""Column expressions for catalogue text: part numbers, figures, footers, nomenclature, paths, display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and constants of the catalogue format.
DATE = r"(?i)\b(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)\s+[0-9]{1,2}/[0-9]{2}\b"
RF = r"(?i)\bRF\s+[0-9]{2}-[0-9]{2}-[0-9]{2}\b"
FIGURE_CODE = r"\b[0-9]{2}-[0-9]{2}-[0-9]{2}-[0-9]{2}[A-Z]?\b"
PAGE = r"(?i)\bPAGE\s+[0-9A-Z]+\b"
FIG_LINE, FIGURE_LINE = r"(?i)^FIG\.?\s+(.+)$", r"(?i)^FIGURE\s+(.+)$"
PART = r"^[A-Z0-9][A-Z0-9\-\./]*$"
CJK = r"[\x{4e00}-\x{9fff}]"
CODE_AFTER = r"([0-9]{2}-[0-9]{2}-[0-9]{2}-[0-9]{2}[A-Z]?)"
WATERMARK = ("OF", "DATE", "OUT")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_or_empty(c) -> Column:
    return F.coalesce(_c(c), F.lit(""))


def null_if_empty(c) -> Column:
    return F.nullif(F.trim(_c(c)), F.lit(""))


def _lines(c) -> Column:
    """Trimmed lines that are not empty."""
    return F.filter(F.transform(F.split(text_or_empty(c), r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


# part numbers


def pn_cell_form(c) -> Column:
    """Upper case, plain dashes, no white space, O between digits read as 0."""
    bare = F.regexp_replace(F.translate(F.upper(text_or_empty(c)), "–—", "--"), r"\s+", "")
    return F.regexp_replace(bare, "(?<=[0-9])O(?=[0-9])", "0")


def pn_loose_form(c) -> Column:
    """The cell form with 0 between letters read as O."""
    return F.regexp_replace(pn_cell_form(c), "(?<=[A-Z])0(?=[A-Z])", "O")


def _whole_figure_code(t: Column) -> Column:
    return t.rlike("^[0-9]{2}-[0-9]{2}-[0-9]{2}-[0-9]{2}[A-Z]?$")


def is_part_number(c) -> Column:
    """For free text: legal characters, a digit, more than digits, not a figure code."""
    t = pn_loose_form(c)
    return t.rlike(PART) & t.rlike("[0-9]") & ~t.rlike("^[0-9]+$") & ~_whole_figure_code(t)


def is_part_number_cell(c) -> Column:
    """For the part number column: digits alone will do if there are three."""
    t = pn_cell_form(c)
    return t.rlike(PART) & t.rlike("[0-9]") & ~_whole_figure_code(t) & (~t.rlike("^[0-9]+$") | (F.length(t) >= 3))


def is_part_number_truth(c) -> Column:
    """The independent rule of the checks: legal characters and a digit; digits alone will do if there are three."""
    t = F.upper(F.trim(text_or_empty(c)))
    return F.when(t.rlike("^[0-9]+$"), F.length(t) >= 3).otherwise(t.rlike(PART) & t.rlike("[0-9]"))


def candidate_tokens(page_text) -> Column:
    """Distinct part number candidates of a page's text, sorted."""
    up = F.upper(text_or_empty(page_text))
    long = F.regexp_extract_all(up, F.lit("[A-Z0-9][A-Z0-9./-]{3,}"), F.lit(0))
    short = F.regexp_extract_all(up, F.lit(r"\b[A-Z]{1,3}[0-9]{1,4}[A-Z]?\b"), F.lit(0))
    return F.array_sort(F.filter(F.array_union(long, short), lambda t: t.rlike("[0-9]") & is_part_number(t)))  # most words have no digit and go first


# figures and footers


def figure_suffix(c) -> Column:
    """9 -> 09, 1B -> 01B; others upper without spaces."""
    s = F.regexp_replace(F.upper(text_or_empty(c)), r"\s+", "")
    one = s.rlike("^[0-9][A-Z]?$")
    return F.when(one, F.concat(F.lit("0"), s)).otherwise(s)


def fig_item_parse(c) -> Column:
    """struct(raw, no, source, not_illustrated) of a fig-item cell."""
    t = F.regexp_replace(text_or_empty(c), r"^\s+|\s+$", "")
    dash, found = t.startswith("-"), F.nullif(F.regexp_extract(t, "([0-9]+[A-Z]?)", 1), F.lit(""))
    whole = t.rlike("^[0-9]+[A-Z]?$")
    no = F.when(dash, found).when(whole, t)
    raw = F.when(dash & found.isNotNull(), "-").when(~dash & whole, "").otherwise(t)
    return F.struct(F.nullif(raw, F.lit("")).alias("raw"), no.alias("no"), F.when(no.isNotNull(), "pdf_coords").alias("source"), dash.cast("int").alias("not_illustrated"))


def fig_item_display(raw, no, not_illustrated) -> Column:
    raw, no = F.trim(text_or_empty(raw)), F.trim(text_or_empty(no))
    return (
        F.when((raw == "-") & (no != ""), F.concat(F.lit("- "), no))
        .when((raw != "") & (no != ""), F.concat_ws(" ", raw, no))
        .when(raw != "", raw)
        .when((no != "") & (F.coalesce(_c(not_illustrated), F.lit(0)) != 0), F.concat(F.lit("- "), no))
        .otherwise(no)
    )


def _first(lines: Column, pattern: str) -> Column:
    """The first match of a pattern in the lines, in upper case."""
    return F.upper(F.regexp_extract(F.get(F.filter(lines, lambda x: x.rlike(pattern)), F.lit(0)), pattern, 0))


def _once(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _figure_line(lines: Column) -> Column:
    """struct(label, rest): the label, and what follows the word, of the first line that names a figure."""

    def parts(line: Column) -> Column:
        fig = line.rlike(FIG_LINE)
        rest = F.trim(F.when(fig, F.regexp_extract(line, FIG_LINE, 1)).otherwise(F.regexp_extract(line, FIGURE_LINE, 1)))
        return F.struct(F.concat(F.when(fig, "FIG. ").otherwise("FIGURE "), rest).alias("label"), rest.alias("rest"))

    return _once(F.get(F.filter(lines, lambda x: x.rlike(FIG_LINE) | x.rlike(FIGURE_LINE)), F.lit(0)), parts)


def rf_text(c) -> Column:
    return F.nullif(F.upper(F.regexp_extract(text_or_empty(c), RF, 0)), F.lit(""))


def page_token(c) -> Column:
    """The last page token of a text."""
    found = F.regexp_extract_all(text_or_empty(c), F.lit(PAGE), F.lit(0))
    return F.upper(F.when(F.size(found) > 0, F.element_at(found, -1)))


def _code(lines: Column, figure: Column) -> Column:
    """A footer's figure code, of its lines and the one that names the figure."""
    return F.when(figure["label"].isNotNull(), F.concat(F.upper(F.get(lines, F.lit(0))), F.lit("-"), figure_suffix(figure["rest"])))


def figure_code(c) -> Column:
    """The figure code of footer_meta() alone."""
    return _once(_lines(c), lambda lines: _once(_figure_line(F.slice(lines, 2, 11)), lambda figure: _code(lines, figure)))


def footer_meta(c) -> Column:
    """struct(figure_code, figure_label, date_text, page_token, rf_text) of the footer clip."""

    def meta(lines: Column) -> Column:
        body = F.slice(lines, 2, 11)
        return _once(_figure_line(body), lambda figure: F.struct(
            _code(lines, figure).alias("figure_code"), figure["label"].alias("figure_label"), _first(body, DATE).alias("date_text"),
            _first(body, PAGE).alias("page_token"), rf_text(c).alias("rf_text"),
        ))

    return _once(_lines(c), meta)


def page_text_meta(c, prefix: str) -> Column:
    """The same fields from a whole page's text: the longest figure code with the prefix (the last of equals), lines from the end."""
    codes = F.filter(F.regexp_extract_all(text_or_empty(c), F.lit(FIGURE_CODE), F.lit(0)), lambda x: x.startswith(prefix))
    ranked = F.array_max(F.transform(codes, lambda x, i: F.struct(F.length(x).alias("n"), i.alias("i"), x.alias("code"))))
    lines = _lines(c)
    last = F.reverse(F.when(F.size(lines) > 30, F.slice(lines, -30, 30)).otherwise(lines))
    label = _figure_line(last)["label"]
    return F.struct(ranked["code"].alias("figure_code"), label.alias("figure_label"), _first(last, DATE).alias("date_text"), page_token(c).alias("page_token"), rf_text(c).alias("rf_text"))


# nomenclature


def _right_trimmed(c) -> Column:
    return F.transform(F.split(text_or_empty(c), r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"\s+$", ""))


def strip_watermark(c) -> Column:
    """Drops lines with CJK characters, then leading OF / DATE / OUT lines."""
    lines = F.filter(_right_trimmed(c), lambda x: (F.trim(x) != "") & ~x.rlike(CJK))

    def rest(own: Column) -> Column:
        kept = F.array_position(F.transform(own, lambda x: F.upper(F.trim(x)).isin(*WATERMARK)), False)
        return F.when(kept > 0, F.slice(own, F.greatest(kept, F.lit(1)).cast("int"), F.greatest(F.size(own), F.lit(1)))).otherwise(F.array().cast("array<string>"))

    return F.regexp_replace(F.array_join(_once(lines, rest), "\n"), r"^\s+|\s+$", "")


def nomenclature_level(c) -> Column:
    """The number of leading dots of the first visible line."""
    return F.length(F.regexp_extract(text_or_empty(c), r"^\s*(\.*)", 1))


def nomenclature_clean(c) -> Column:
    """The text without those dots."""
    t = F.regexp_replace(F.array_join(_right_trimmed(c), "\n"), r"^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(t, r"^\.+[^\S\n]*", ""), r"^\s+|\s+$", "")


def cross_references(c) -> Column:
    """array<struct<kind,target>>: all NHA references, then all details references."""
    out = []
    for kind in ("NHA", "DETAILS"):
        found = F.regexp_extract_all(text_or_empty(c), F.lit(rf"(?i)FOR\s+{kind}\s+SEE:\s*{CODE_AFTER}"), F.lit(1))
        label = F.lit(kind).alias("kind")
        out.append(F.transform(found, lambda x: F.struct(label, F.upper(x).alias("target"))))  # noqa: B023  called at once
    return F.concat(*out)


# paths


def path_clean(c) -> Column:
    """A safe relative path: forward slashes, no empty, . or .. parts; of an absolute path the file name only."""
    src = F.translate(text_or_empty(c), "\\", "/")
    absolute = src.startswith("/") | src.rlike("^[A-Za-z]:/")
    parts = F.filter(F.split(src, "/"), lambda x: ~x.isin("", ".", ".."))
    return F.when(absolute & (F.size(parts) > 0), F.element_at(parts, F.when(F.size(parts) > 0, -1).otherwise(1))).when(absolute, "").otherwise(F.array_join(parts, "/"))


def folder_of(c) -> Column:
    return F.regexp_extract(text_or_empty(c), "^(.*)/[^/]*$", 1)


def relative_to(c, base: str) -> Column:
    """A stored path: relative to the base if below it, else the file name of an absolute path."""
    src = F.translate(text_or_empty(c), "\\", "/")
    base = base.replace("\\", "/").rstrip("/") + "/"
    absolute = src.startswith("/") | src.rlike("^[A-Za-z]:/")
    return F.when(src.startswith(base), F.substr(src, F.lit(len(base) + 1))).when(absolute, F.element_at(F.split(src, "/"), -1)).otherwise(src)


def path_violation(c) -> Column:
    """Why a document identifier is refused, null if it is not."""
    raw = F.regexp_replace(F.trim(F.translate(text_or_empty(c), "\\", "/")), "^/+|/+$", "")
    parts = F.filter(F.split(raw, "/"), lambda x: x != "")
    return (
        F.when(raw == "", "missing")
        .when(F.exists(parts, lambda x: x.isin(".", "..")), "invalid")
        .when(F.size(parts) > 2, "too_deep")
        .when(~F.lower(F.array_join(parts, "/")).endswith(".pdf"), "not_pdf")
    )


# display


def preview(c, n: int = 220) -> Column:
    return F.substring(F.translate(text_or_empty(c), "\n", " "), 1, n)


def hit_snippet(c, query) -> Column:
    """260 characters from 80 before the first hit; the preview without one."""
    flat, q = F.translate(text_or_empty(c), "\n", " "), F.upper(_c(query))
    at = F.when(q == "", 0).otherwise(F.position(q, F.upper(flat)))
    return F.when(at <= 0, F.substring(flat, 1, 220)).otherwise(F.trim(F.substr(flat, F.greatest(at - 80, F.lit(1)), F.lit(260))))


def shorten(c, width: int = 90) -> Column:
    """White space collapsed; longer texts end at a word, with an ellipsis, within the width."""
    t = F.trim(F.regexp_replace(text_or_empty(c), r"\s+", " "))
    cut = F.regexp_extract(t, rf"^(.{{0,{width - 1}}})(?=\s)", 1)
    return F.when(F.length(t) <= width, t).otherwise(F.concat(cut, F.lit("…")))


def keyword_flags(c) -> Column:
    t = text_or_empty(c)
    return F.struct(t.rlike(r"(?i)\boptional\b").alias("optional"), t.rlike(r"(?i)\breplace\b").alias("replace"))


def highlight_segments(c, pattern: str = r"\b(?:optional|replace)\b") -> Column:
    """array<struct<text,hit>>: the text cut at the matches of a pattern, case ignored."""
    t = text_or_empty(c)
    marked = F.regexp_replace(t, f"(?i)({pattern})", "\x01\x02$1\x01")
    parts = F.filter(F.split(marked, "\x01"), lambda x: x != "")
    cut = F.transform(parts, lambda x: F.struct(F.ltrim(x, F.lit("\x02")).alias("text"), x.startswith("\x02").alias("hit")))
    return F.when(t == "", F.array(F.struct(F.lit("").alias("text"), F.lit(False).alias("hit")))).otherwise(cut)


def query_segments(c, query) -> Column:
    """array<struct<text,hit>>: the text cut at the query's words of two characters and more, case ignored; an earlier word goes before a later one."""
    t = text_or_empty(c)
    tokens = F.array_distinct(F.filter(F.split(F.trim(F.regexp_replace(text_or_empty(query), r"\s+", " ")), " "), lambda x: F.length(x) >= 2))
    pattern = F.array_join(F.transform(tokens, lambda x: F.regexp_replace(x, r"([.*+?^${}()|\[\]\\])", r"\\$1")), "|")
    marked = F.regexp_replace(t, F.concat(F.lit("(?iu)("), pattern, F.lit(")")), F.lit("\x01\x02$1\x01"))
    parts = F.filter(F.split(marked, "\x01"), lambda x: x != "")
    cut = F.transform(parts, lambda x: F.struct(F.ltrim(x, F.lit("\x02")).alias("text"), x.startswith("\x02").alias("hit")))
    return F.when((t == "") | (F.size(tokens) == 0), F.array(F.struct(t.alias("text"), F.lit(False).alias("hit")))).otherwise(cut)


def is_pn_query(c) -> Column:
    q = F.upper(F.trim(text_or_empty(c)))
    return q.rlike("^[A-Z0-9][A-Z0-9./-]*$") & q.rlike("[0-9]")


def page_window(page, total, size: int = 20, width: int = 10) -> Column:
    """struct(total_pages, page, first, last): page clamped, and the window of page numbers around it."""
    pages = F.greatest(F.ceil(F.greatest(_c(total), F.lit(0)) / size), F.lit(1))
    at = F.least(F.greatest(_c(page), F.lit(1)), pages)
    first = F.greatest(F.least(at - width // 2, pages - width + 1), F.lit(1))
    return F.struct(pages.alias("total_pages"), at.alias("page"), first.alias("first"), F.least(first + width - 1, pages).alias("last"))
