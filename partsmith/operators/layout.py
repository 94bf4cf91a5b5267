"""Words of pages to lines and cells, a batch of pages at a time: Arrow columns in, Arrow columns out. All joins are Spark's."""

from __future__ import annotations

import difflib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = "[ \t\n\x0b\f\r]+"
LINE = pa.list_(pa.struct([("y", pa.float64()), ("text", pa.string())]))


class Words:
    """The words of a batch of pages: page (place in the batch), centre, corner and trimmed text."""

    def __init__(self, boxes: pa.Array, keep=None):
        flat, sizes = boxes.flatten(), pc.fill_null(pc.list_value_length(boxes), 0).to_numpy(zero_copy_only=False)
        x0, y0, x1, y1 = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("x0", "y0", "x1", "y1"))
        self.page, self.x, self.y, self.cx, self.at = np.repeat(np.arange(len(boxes)), sizes), x0, y0, (x0 + x1) / 2, (y0 + y1) / 2
        self.w = pc.utf8_trim(flat.field("word"), " ")
        if keep is not None:
            self._cut(np.flatnonzero((self.cx >= keep[0]) & (self.cx <= keep[2]) & (self.at >= keep[1]) & (self.at <= keep[3])))

    def _cut(self, at) -> Words:
        for n in ("page", "x", "y", "cx", "at"):
            setattr(self, n, getattr(self, n)[at])
        self.w = self.w.take(pa.array(at))
        return self

    def only(self, mask) -> Words:
        out = object.__new__(Words)
        out.__dict__.update(self.__dict__)
        return out._cut(np.flatnonzero(mask))


def joined(groups, n: int, texts: pa.Array, separator: str) -> pa.Array:
    """The texts of each of n groups, in order, joined; groups ascend, empty texts are left out."""
    kept = pc.fill_null(pc.not_equal(texts, ""), False).to_numpy(zero_copy_only=False)
    texts, groups = texts.filter(pa.array(kept)), groups[kept]
    offsets = np.searchsorted(groups, np.arange(n + 1)).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), texts), separator)


def lines(group, x, y, w: pa.Array, separator: str, tolerance: float):
    """(group, y, text) of the lines of each group, by group and y. A line ends where y leaves its first y by more than the tolerance."""
    order = np.lexsort((x, y, group))
    group, x, y, w = group[order], x[order], y[order], w.take(pa.array(order))
    if not len(y):
        return group, y, pa.array([], pa.string())
    opens = np.r_[True, (group[1:] != group[:-1]) | (y[1:] - y[:-1] > tolerance)]
    start = np.flatnonzero(opens)
    end = np.r_[start[1:], len(y)]
    for i in np.flatnonzero(y[end - 1] - y[start] > tolerance):  # a gapless stretch that is higher than a line
        low = y[start[i]]
        for j in range(start[i] + 1, end[i]):
            if y[j] - low > tolerance:
                opens[j], low = True, y[j]
    line, start = np.cumsum(opens) - 1, np.flatnonzero(opens)
    order = np.lexsort((y, x, line))
    a, b = order[1:], order[:-1]
    if ((line[a] == line[b]) & (x[a] == x[b]) & (y[a] == y[b])).any():  # words in one place go by name
        table = pa.table({"l": line, "x": x, "y": y, "w": w})
        order = pc.sort_indices(table, sort_keys=[(n, "ascending") for n in table.column_names], null_placement="at_start").to_numpy()
    texts = joined(line[order], len(start), w.take(pa.array(order)), separator)
    return group[start], y[start], pc.utf8_trim(pc.replace_substring_regex(texts, SPACE, " "), " ")


def listed(page, n: int, columns: dict[str, pa.Array]) -> pa.Array:
    """One list of structs per page of the batch; pages ascend."""
    offsets = np.searchsorted(page, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(list(columns.values()), list(columns)))


def line_batch(batch: pa.RecordBatch, keep, inside, separator: str, tolerance: float) -> pa.RecordBatch:
    """Adds lines: of each page's words in ``keep`` and ``inside`` (rectangles; None: all)."""
    words = Words(batch.column("boxes"), keep)
    if inside is not None:
        words = words.only((words.cx >= inside[0]) & (words.cx <= inside[2]) & (words.at >= inside[1]) & (words.at <= inside[3]))
    page, y, text = lines(words.page, words.x, words.y, words.w, separator, tolerance)
    return pa.RecordBatch.from_arrays([*batch.columns, listed(page, len(batch), {"y": pa.array(y), "text": text})], [*batch.schema.names, "lines"])


def upper(t: pa.Array) -> pa.Array:
    """Upper case; what is not ASCII as Python (and Spark) have it, which may be longer."""
    out, plain = pc.ascii_upper(t), pc.fill_null(pc.string_is_ascii(t), True)
    if not pc.all(plain).as_py():
        full = pa.array([None if p else x.upper() for x, p in zip(t.to_pylist(), plain.to_pylist(), strict=True)], t.type)
        out = pc.if_else(plain, out, full)
    return out


def _matches(t: pa.Array, pattern: str) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(t, pattern), False).to_numpy(zero_copy_only=False)


def _number(t: pa.Array) -> np.ndarray:
    """Legal characters and a digit; digits alone will do if there are three."""
    enough = pc.fill_null(pc.greater_equal(pc.utf8_length(t), 3), False).to_numpy(zero_copy_only=False)
    return _matches(t, r"^[A-Z0-9][A-Z0-9./-]*$") & _matches(t, "[0-9]") & (enough | ~_matches(t, "^[0-9]+$"))


def is_part_number_cell(t: pa.Array) -> np.ndarray:
    """``functions.text.is_part_number_cell`` of an Arrow column. O read as 0 between digits changes none of its answers."""
    for dash in "–—":
        t = pc.replace_substring(t, dash, "-")
    t = pc.replace_substring_regex(upper(t), SPACE, "")
    return _number(t) & ~_matches(t, "^[0-9]{2}-[0-9]{2}-[0-9]{2}-[0-9]{2}[A-Z]?$")


def is_part_number_truth(t: pa.Array) -> np.ndarray:
    """``functions.text.is_part_number_truth`` of an Arrow column."""
    return _number(upper(pc.utf8_trim(t, " ")))


def repeats(page, y, pn: pa.Array, tolerance: float) -> np.ndarray:
    """Which marks, in order of page and y, come again: the number of the last mark that stays, within the tolerance of it."""
    out = np.zeros(len(y), bool)
    if len(y) > 1:
        same = np.r_[False, (page[1:] == page[:-1]) & pc.equal(pn[1:], pn[:-1]).to_numpy(zero_copy_only=False)]
        start = np.flatnonzero(~same)
        end = np.r_[start[1:], len(y)]
        close = np.r_[False, same[1:] & (y[1:] - y[:-1] <= tolerance)]
        for k in np.unique(np.searchsorted(start, np.flatnonzero(close), "right") - 1):
            low = y[start[k]]
            for i in range(start[k] + 1, end[k]):
                if y[i] - low <= tolerance:
                    out[i] = True
                else:
                    low = y[i]
    return out


def mark_batch(batch: pa.RecordBatch, own, keep, inside, rule, upper_case: bool, tolerance: float, repeat: float) -> pa.RecordBatch:
    """The columns ``own`` and marks: of each page the lines of its words in ``keep`` and ``inside``, without blanks, that ``rule`` takes for part numbers."""
    words = Words(batch.column("boxes"), keep)
    words = words.only((words.cx >= inside[0]) & (words.cx <= inside[2]) & (words.at >= inside[1]) & (words.at <= inside[3]))
    page, y, text = lines(words.page, words.x, words.y, words.w, "", tolerance)
    pn = pc.replace_substring(text, " ", "")
    pn = upper(pn) if upper_case else pn
    at = np.flatnonzero(rule(pn))
    page, y, pn = page[at], y[at], pn.take(pa.array(at))
    at = np.flatnonzero(~repeats(page, y, pn, repeat))
    marks = listed(page[at], len(batch), {"y": pa.array(y[at]), "pn": pn.take(pa.array(at))})
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), marks], [*own, "marks"])


def row_of(words: Words, marks: pa.Array):
    """For each word the place of the last mark at or above its centre on its page, among all marks of the batch; -1: none. And the marks' pages and heights."""
    page = np.repeat(np.arange(len(marks)), pc.fill_null(pc.list_value_length(marks), 0).to_numpy(zero_copy_only=False))
    y = marks.flatten().field("y").to_numpy(zero_copy_only=False)
    m = len(y)
    pages, at = np.r_[page, words.page], np.r_[y, words.at]
    order = np.lexsort((np.arange(len(at)) >= m, at, pages))
    last = np.maximum.accumulate(np.where(order < m, np.arange(len(order)), -1))
    found = np.full(len(at), -1)
    found[order] = np.where(last >= 0, order[np.maximum(last, 0)], -1)
    found = found[m:]
    found[(found >= 0) & (page[np.maximum(found, 0)] != words.page if m else True)] = -1
    return found, page, y


def cell_batch(batch: pa.RecordBatch, keep, columns: dict, marked: bool, continued, scan, tolerance: float) -> pa.RecordBatch:
    """(doc_id, page_num, rows): per page a struct for each mark, and for the words above the first (y null; of the continued columns only), with the texts of its columns, their first lines and the number of words.

    Without marks a page has one row of all its words.
    """
    n, words = len(batch), Words(batch.column("boxes"), keep)
    if marked:
        words = words.only(words.at < scan[1])
        row, page, y = row_of(words, batch.column("marks"))
        pn = batch.column("marks").flatten().field("pn")
    else:
        row, page, y, pn = np.full(len(words.page), -1), np.zeros(0, int), np.zeros(0), pa.array([], pa.string())
    # rows of the batch in order: each page's head, then its marks
    head = np.arange(n) + np.searchsorted(page, np.arange(n))
    place = np.arange(len(page)) + page + 1
    total = n + len(page)
    slot = np.where(row >= 0, place[np.maximum(row, 0)] if len(place) else 0, head[words.page])
    names = list(columns)
    group, pick = [], []
    for k, c in enumerate(names):
        a, b = columns[c]
        own = (words.cx >= a) & (words.cx <= b)
        if marked:
            own &= (row >= 0) | ((words.at >= scan[0]) if c in continued else False)
        at = np.flatnonzero(own)
        group.append(slot[at] * len(names) + k)
        pick.append(at)
    group, pick = np.concatenate(group), np.concatenate(pick)
    count = np.bincount(group, minlength=total * len(names))
    line, _, text = lines(group, words.x[pick], words.y[pick], words.w.take(pa.array(pick)), " ", tolerance)
    cell = joined(line, total * len(names), text, "\n")
    full = pc.fill_null(pc.not_equal(text, ""), False).to_numpy(zero_copy_only=False)
    filled, first = np.unique(line[full], return_index=True)
    heads = np.full(total * len(names), -1)
    heads[filled] = np.flatnonzero(full)[first]
    out = {}
    mark = np.full(total, -1)
    mark[place] = np.arange(len(place))
    none = pa.array(np.maximum(mark, 0), mask=mark < 0)
    out["y"], out["pn"] = pa.array(y).take(none), pn.take(none)
    by = lambda k: np.arange(total) * len(names) + k
    for k, c in enumerate(names):
        out[c] = cell.take(pa.array(by(k), mask=count[by(k)] == 0))
        at = heads[by(k)]
        out[f"first_{c}"] = text.take(pa.array(np.maximum(at, 0), mask=at < 0))
    out["n_words"] = pa.array(count.reshape(total, -1).sum(1))
    out["n_cols"] = pa.array((count.reshape(total, -1) > 0).sum(1))
    of = np.empty(total, np.int64)
    of[head], of[place] = np.arange(n), page
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("page_num"), listed(of, n, out)], ["doc_id", "page_num", "rows"])


def near_batch(batch: pa.RecordBatch, columns: dict, scan) -> pa.RecordBatch:
    """(doc_id, page_num, rows): per page a struct (y, pn and a text per column) for each mark that has words within the columns' reach: columns: name to (left, right, reach)."""
    n, marks, words = len(batch), batch.column("marks"), Words(batch.column("boxes"))
    _, page, y = row_of(words.only(np.zeros(len(words.page), bool)), marks)
    seen, out = np.zeros(len(y), bool), {}
    for c, (a, b, reach) in columns.items():
        own = words.only((words.cx >= a) & (words.cx <= b) & (words.at >= scan[0]) & (words.at <= scan[1]))
        start, end = np.searchsorted(own.page, page), np.searchsorted(own.page, page, "right")
        size = end - start
        mark = np.repeat(np.arange(len(y)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
        hit = np.abs(own.at[at] - y[mark]) <= reach
        mark, at = mark[hit], at[hit]
        order = np.lexsort((own.y[at], own.x[at], mark))
        i, j = order[1:], order[:-1]
        if ((mark[i] == mark[j]) & (own.x[at[i]] == own.x[at[j]]) & (own.y[at[i]] == own.y[at[j]])).any():
            table = pa.table({"m": mark, "x": own.x[at], "y": own.y[at], "w": own.w.take(pa.array(at))})
            order = pc.sort_indices(table, sort_keys=[(k, "ascending") for k in table.column_names], null_placement="at_start").to_numpy()
        mark, at = mark[order], at[order]
        seen[mark] = True
        texts = own.w.take(pa.array(at))
        offsets = np.searchsorted(mark, np.arange(len(y) + 1)).astype(np.int32)
        out[c] = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), texts), " ")
    kept = np.flatnonzero(seen)
    flat = marks.flatten()
    columns = {"y": flat.field("y").take(pa.array(kept)), "pn": flat.field("pn").take(pa.array(kept)), **{c: t.take(pa.array(kept)) for c, t in out.items()}}
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "marks"), listed(page[kept], n, columns)], [*(c for c in batch.schema.names if c != "marks"), "rows"])


def _characters(t: pa.Array) -> np.ndarray:
    """How often each byte, of 64 kinds, comes in each text."""
    offsets = np.frombuffer(t.buffers()[1], np.int32)[t.offset : t.offset + len(t) + 1]
    bytes_ = np.frombuffer(t.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return np.bincount(np.repeat(np.arange(len(t)), np.diff(offsets)) * 64 + (bytes_ & 63), minlength=64 * len(t)).reshape(-1, 64)


def similar_pairs(texts: pa.Array, forms: pa.Array, least: float, most: int = 1 << 16):
    """(place, text, form, token) of the texts and their forms (lists of struct<token,form>; no form: the token) whose similarity 2 m / n may reach ``least``: n their length, m at most the characters that both have."""
    of = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(forms), 0).to_numpy(zero_copy_only=False))
    flat = forms.flatten()
    token = flat.field("token").cast(pa.string())
    form, texts = pc.coalesce(flat.field("form").cast(pa.string()), token), texts.cast(pa.string())
    length = lambda t: pc.fill_null(pc.utf8_length(t), 0).to_numpy(zero_copy_only=False)
    a, b = length(texts)[of], length(form)
    near = np.flatnonzero(2 * np.minimum(a, b) >= least * (a + b))
    for k in range(0, len(near), most):
        at = near[k : k + most]
        x, y, t = texts.take(pa.array(of[at])), form.take(pa.array(at)), token.take(pa.array(at))
        shared = np.minimum(_characters(x), _characters(y)).sum(1)
        kept = np.flatnonzero(2.0 * shared >= least * (a[at] + b[at]))
        i = pa.array(kept)
        yield from zip(of[at][kept].tolist(), x.take(i).to_pylist(), y.take(i).to_pylist(), t.take(i).to_pylist(), strict=True)


def nearest(texts: pa.Array, forms: pa.Array, least: float) -> list[tuple[str, float] | None]:
    """For each text the token of the greatest Ratcliff-Obershelp similarity of its form, and it: ``least`` at least, of equal ones the first by name; the order of arguments matters."""
    found: list[tuple[str, float] | None] = [None] * len(texts)
    matcher, at = difflib.SequenceMatcher(None), -1
    for i, x, y, token in similar_pairs(texts, forms, least):
        if i != at:
            matcher.set_seq2(x)
            at = i
        matcher.set_seq1(y)
        r = matcher.ratio()
        if r >= least and (found[i] is None or (-r, token) < (-found[i][1], found[i][0])):
            found[i] = (token, r)
    return found


def _between(t: pa.Array, beside: str, old: str, new: str) -> pa.Array:
    hit = _matches(t, f"{beside}{old}{beside}")
    if not hit.any():
        return t
    rule = re.compile(f"(?<={beside}){old}(?={beside})")
    return pc.replace_with_mask(t, pa.array(hit), pa.array([rule.sub(new, x) for x in t.filter(pa.array(hit)).to_pylist()], t.type))


def loose_form(t: pa.Array) -> pa.Array:
    """``functions.text.pn_loose_form`` of an Arrow column."""
    for dash in "–—":
        t = pc.replace_substring(t, dash, "-")
    return _between(_between(pc.replace_substring_regex(upper(t), SPACE, ""), "[0-9]", "O", "0"), "[A-Z]", "0", "O")


def read_batch(raws: pa.Array, forms: pa.Array, least: float | None = None) -> pa.Array:
    """Lists of struct<exact,loose,near,ratio> for lists of numbers and lists of struct<token,form> of the same pages; near and ratio only of what is neither, and if a least similarity is given."""
    sizes = pc.fill_null(pc.list_value_length(raws), 0).to_numpy(zero_copy_only=False)
    known = pc.fill_null(pc.list_value_length(forms), 0).to_numpy(zero_copy_only=False)
    of, at = np.repeat(np.arange(len(raws)), sizes), np.repeat(np.arange(len(raws)), known)
    raw, flat = raws.flatten().cast(pa.string()), forms.flatten()
    token = flat.field("token").cast(pa.string())
    form, up, loose = pc.coalesce(flat.field("form").cast(pa.string()), token), upper(raw), loose_form(raw)
    n, k = len(raw), len(token)
    names = pa.chunked_array([up, loose, token, form]).combine_chunks().dictionary_encode()
    codes, names = names.indices.to_numpy(zero_copy_only=False).astype(np.int64), names.dictionary
    order, wide = pc.sort_indices(names).to_numpy(), len(names) + 1
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    codes = place[codes]  # by name
    up_at, loose_at, token_at, form_at = np.split(codes, [n, 2 * n, 2 * n + k])
    exact = np.isin(of * wide + up_at, at * wide + token_at)
    by = np.lexsort((token_at, at * wide + form_at))
    keys, want = (at * wide + form_at)[by], of * wide + loose_at
    first = np.searchsorted(keys, want)
    same = first < k
    same[same] = keys[first[same]] == want[same]
    loosely = token.take(pa.array(by[np.minimum(first, k - 1)], mask=~same)) if k else pa.nulls(n, pa.string())
    near, ratio = np.full(n, None, object), np.full(n, np.nan)
    rest = np.flatnonzero(~exact & ~same & pc.fill_null(pc.not_equal(raw, ""), False).to_numpy(zero_copy_only=False))
    if least is not None and len(rest):
        for i, hit in zip(rest, nearest(loose.take(pa.array(rest)), forms.take(pa.array(of[rest])), least), strict=True):
            if hit:
                near[i], ratio[i] = hit
    fields = {"exact": up.take(pa.array(np.arange(n), mask=~exact)), "loose": loosely, "near": pa.array(near, pa.string()), "ratio": pa.array(ratio, mask=np.isnan(ratio))}
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.StructArray.from_arrays(list(fields.values()), list(fields)))
