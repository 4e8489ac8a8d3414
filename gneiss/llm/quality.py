"""Quality rules by repetition coverage.

Words are hashed in numpy for many texts at once; windows of several lengths are
hashes rolled over those, and windows that come again in their text mark the
characters they cover. The same is taken of lines. Rows are independent: there
is no shuffle.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import IS_SPACE, WORD, mix, pieces, spans, table, windows, words

#: Most of a text's word characters that repeated windows of n words may cover.
WINDOW_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Most of a text's line characters, and of its lines, that repeated lines may hold.
LINE_CHAR_LIMIT, LINE_LIMIT = 0.20, 0.30

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_U = np.uint64
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _again(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of windows that their text holds twice or more, which of
    them came before, and the number of words."""
    key, first = windows(hashes, row, n)
    if len(key):
        key = mix(key ^ (row[first].astype(_U) * _U(0x9E3779B97F4A7C15)))
        order = np.sort(key)
        twice = order[1:][order[1:] == order[:-1]]
        if len(twice):
            twice = np.unique(twice)
            at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
            hit = np.flatnonzero(twice[at] == key)
            by = hit[np.argsort(at[hit], kind="stable")]
            later = np.zeros(len(key), bool)
            later[by[1:]] = at[by[1:]] == at[by[:-1]]
            return first[hit], later[hit], key
    return np.empty(0, np.int64), np.empty(0, bool), key


def _covered(n_words: int, first: np.ndarray, n: int) -> np.ndarray:
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + n, -1)
    return np.cumsum(edge[:-1]) > 0


def _lines(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Number and bytes of the lines of each text that hold a word, and of those
    that are equal to an earlier one; a line's hash is rolled over its bytes."""
    n = len(off) - 1
    feeds = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([off[:-1], feeds + 1]))
    starts = starts[starts < len(data)]
    row = np.searchsorted(off, starts, "right") - 1
    ends = np.minimum(np.append(feeds, len(data))[np.searchsorted(feeds, starts)], off[row + 1])
    held = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~IS_SPACE[data], out=held[1:])
    some = np.flatnonzero(held[ends] > held[starts])
    start, end, row = starts[some], ends[some], row[some]
    size = end - start
    key = mix(spans(data, start, end) ^ (row.astype(_U) * _U(0x9E3779B97F4A7C15)))
    order = np.lexsort((start, key))
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    add = lambda weight: np.bincount(row, weight, n).astype(np.int64)
    return {"n_dup_lines": add(again), "lines": np.bincount(row, minlength=n), "line_chars": add(size), "dup_line_chars": add(size * again)}


def measure(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The fields of each text of a buffer, and what the rules look at."""
    n = len(off) - 1
    hashes, start, end, row = words(data, off)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    length = points[end] - points[start]
    symbols = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_SYMBOL[data], out=symbols[1:])
    count = np.bincount(row, minlength=n)
    out = {
        "n_words": count,
        "word_chars": np.bincount(row, length, n).astype(np.int64),
        "n_symbols": symbols[off[1:]] - symbols[off[:-1]],
        "n_repeat_words": np.zeros(n, np.int64),
    }
    out |= _lines(data, off)
    for k in WINDOW_LIMITS:
        out[f"cover_{k}"] = np.zeros(n)
    first, later, _ = _again(hashes, row, min(WINDOW_LIMITS))
    if len(first):
        # Longer windows repeat only where the shortest do.
        rows = np.zeros(n, bool)
        rows[row[first]] = True
        own = np.flatnonzero(rows[row])
        h, r, c = hashes[own], row[own], length[own]
        for k in WINDOW_LIMITS:
            first, later, _ = _again(h, r, k)
            if k == 8:
                out["n_repeat_words"] = np.bincount(r[_covered(len(h), first, k)], minlength=n)
            more = _covered(len(h), first[later], k)
            out[f"cover_{k}"] = np.bincount(r[more], c[more], n) / np.maximum(out["word_chars"], 1)
    out["base_failed"] = (count < 20) | (100 * out["n_repeat_words"] > 30 * count)
    bad = out["base_failed"].copy()
    for k, limit in WINDOW_LIMITS.items():
        bad |= out[f"cover_{k}"] > limit
    bad |= out["dup_line_chars"] > LINE_CHAR_LIMIT * out["line_chars"]
    bad |= out["n_dup_lines"] > LINE_LIMIT * out["lines"]
    out["kept"] = ~bad
    return out


def score(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept and cover_5 to cover_10, one row per row.

    cover_n is the share of word characters in windows of n words that came
    before in the text (a character counts once; the first showing does not).
    Kept: the base did not fail, and no cover and no share of repeated lines is
    over its limit (at the limit is kept). Null and empty texts have no words
    and fail the base. Repeated rows are rows of their own. Texts of any length are
    read whole; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    ints = ", ".join(f"{f} long" for f in FIELDS)
    covers = [f"cover_{k}" for k in WINDOW_LIMITS]

    def run(batches):
        import pyarrow as pa

        for part, data, off in pieces(batches, "text"):
            m = measure(data, off)
            names = [*FIELDS, "base_failed", "kept", *covers]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(m[f]) for f in names)], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {ints}, base_failed boolean, kept boolean, " + ", ".join(f"{c} double" for c in covers))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose text the rules keep.

    The verdict is taken beside each row in one pass, so that repeated ids and
    columns of any name do no harm. Null and empty texts go; an empty table stays
    empty.
    """

    def run(batches):
        import pyarrow as pa

        for part, data, off in pieces(batches, "text"):
            kept = part.filter(pa.array(measure(data, off)["kept"]))
            if kept.num_rows:
                yield kept

    return docs.mapInArrow(run, docs.schema)


def op4_repetition_coverage(spark, sf_dir: str) -> DataFrame:
    out = score(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *FIELDS, "base_failed", "kept")


def _sql() -> str:
    """The rules by their definitions, over words as rows."""
    lengths = sorted(WINDOW_LIMITS)
    spans = ", ".join(f"case when i + {n - 1} <= n_words then array_to_string(ws[i : i + {n - 1}], ' ') end as s{n}" for n in lengths)
    flags = ", ".join(f"s{n} is not null and row_number() over (partition by rid, s{n} order by i) > 1 as later{n}" for n in lengths)
    marks = ", ".join(f"bool_or(later{n}) over (partition by rid order by i rows {n - 1} preceding) as in{n}" for n in lengths)
    covers = ", ".join(f"coalesce(sum(c) filter (in{n}), 0) / greatest(sum(c), 1) as cover{n}" for n in lengths)
    over = " or ".join(f"coalesce(cover{n}, 0) > {limit}" for n, limit in WINDOW_LIMITS.items())
    return f"""
with t as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
d as (select *, regexp_extract_all(text, '{WORD}') as ws, [x for x in string_split(text, chr(10)) if regexp_matches(x, '{WORD}')] as lines from t),
b as (select rid, doc_id, ws, len(ws) as n_words, coalesce(list_sum([length(x) for x in ws]), 0)::bigint as word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols, len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines,
  coalesce(list_sum([strlen(x) for x in lines]), 0)::double as line_bytes, coalesce(list_sum([strlen(x) for x in list_distinct(lines)]), 0)::double as once_bytes from d),
w as (select rid, n_words, ws, unnest(range(1, n_words + 1)) as i from b),
s as (select rid, i, length(ws[i]) as c, {spans} from w),
f as (select *, {flags}, s8 is not null and count(*) over (partition by rid, s8) > 1 as twice from s),
m as (select rid, c, {marks}, bool_or(twice) over (partition by rid order by i rows 7 preceding) as again from f),
k as (select rid, count(*) filter (again) as n_repeat_words, {covers} from m group by rid),
a as (select b.*, k.* exclude (rid, n_repeat_words), coalesce(n_repeat_words, 0) as n_repeat_words,
  n_words < 20 or 100 * coalesce(n_repeat_words, 0) > 30 * n_words as base_failed from b left join k using (rid))
select doc_id, n_words::bigint as n_words, word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
  not (base_failed or {over} or line_bytes - once_bytes > {LINE_CHAR_LIMIT} * line_bytes or n_dup_lines > {LINE_LIMIT} * n_lines) as kept from a"""


ORACLE = {"op4_repetition_coverage": _sql()}
