"""Repeated byte strings by common-prefix interval trees of suffix arrays.

All positions of a corpus need not be sorted to find every string of ``least``
bytes that occurs twice. Each such string holds a sampled place (the smallest of
the hashes of its ``key``-byte strings), and equal strings hold it at the same
offset. So only suffixes at sampled places are kept, grouped by their first
``key`` bytes, and of those only the ones whose first ``key`` bytes occur again.
Suffixes with equal surroundings within ``least`` bytes are one member of a
group, so that common passages and copies don't make it grow.

A group is an enhanced suffix array once it is sorted: a stack scan finds its
common-prefix intervals, and within each the texts to the left, sorted from
their end, tell how far its members extend to the left together. An interval
that members of different left extensions and different branches meet in is a
maximal repeat with all its occurrences; those of ``least`` bytes and more mark
what they cover.

A group with more than ``MEMBERS`` different surroundings is split by content
until each part fits: of its strings of ``least`` bytes, those that begin up to
so many bytes before the place share their middle, which is the key of a part,
and the others form the other half. Members that are alone in a part leave; of
members that are equal in all bytes a part looks at one stays, as their strings
repeat anyway. Parts are scanned as groups are. Only keys are counted in the
splitting, so that a group of any size is never gathered.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import drop_since, materialize, mix, pieces, powers, prefix_sums, release, scratch, table

MEMBERS = 1000
_U = np.uint64
_SPAN = 1 << 19
#: A text by two 64-bit fingerprints with different seeds.
TEXT = ("c1", "c2")


def fingerprint(data) -> tuple[F.Column, F.Column]:
    """The columns ``TEXT`` of a binary column."""
    return F.xxhash64(data).alias("c1"), F.xxhash64(F.lit("second"), data).alias("c2")


def _runs(width: int, values: np.ndarray, least: bool) -> np.ndarray:
    """Minimum (or maximum) of each ``width`` neighbouring values."""
    pick = np.minimum if least else np.maximum
    fill = np.iinfo(values.dtype).max if least else 0
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, fill, values.dtype)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = pick.accumulate(grid, axis=1).ravel()
    back = pick.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[:n], ahead[width - 1 : width - 1 + n])


def places(data: np.ndarray, off: np.ndarray, least: int, key: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, position and hash of the key bytes of the sampled places of each
    text of a buffer, by text and position."""
    at, keys = [], []
    width = least - key + 1
    step = _SPAN
    for lo in range(0, max(len(data) - least, 0) + 1, step):
        hi = min(len(data), lo + step + least - 1)
        if hi - lo < least:
            break
        part = data[lo:hi]
        sums = prefix_sums(part)
        _, down = powers(len(part))
        m = len(part) - key + 1
        h = mix((sums[key:] - sums[:-key]) * down[:m])
        low = _runs(width, h, True)
        for edge in off[np.searchsorted(off, lo, "right") : np.searchsorted(off, hi, "left")] - lo:
            low[max(0, edge - least + 1) : edge] = 0  # windows over two texts
        padded = np.zeros(len(low) + 2 * (width - 1), low.dtype)
        padded[width - 1 : width - 1 + len(low)] = low
        found = np.flatnonzero((_runs(width, padded, False) == h) & (h > 0))
        at.append(found + lo)
        keys.append(h[found])
    if not at:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, _U)
    spots, first = np.unique(np.concatenate(at), return_index=True)
    row = np.searchsorted(off, spots, "right") - 1
    return row, spots - off[row], np.concatenate(keys)[first]


def intervals(common: list[int]) -> list[tuple[int, int, int]]:
    """(length, first, last) of the common-prefix intervals of a sorted array;
    common[i] is the common prefix of its entries i and i + 1."""
    out, stack = [], []
    for i, c in enumerate([*common, -1]):
        left = i
        while stack and stack[-1][0] > c:
            length, left = stack.pop()
            out.append((length, left, i))
        if c >= 0 and (not stack or stack[-1][0] < c):
            stack.append((c, left))
    return out


def _shared(a: bytes, b: bytes) -> int:
    if a == b:
        return len(a)
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def _sorted(texts: list[bytes]) -> tuple[list[int], list[int]]:
    """Order of the texts, and what neighbours share."""
    order = sorted(range(len(texts)), key=texts.__getitem__)
    return order, [_shared(texts[a], texts[b]) for a, b in zip(order, order[1:])]


def maximal_repeats(before: list[bytes], after: list[bytes], least: int):
    """(length before, length after, members) of the maximal repeats of ``least``
    bytes or more around the members' places. ``before`` is reversed."""
    order, right = _sorted(after)
    for length, lo, hi in intervals(right):
        own = order[lo : hi + 1]
        branch, at = {own[0]: 0}, 0
        for k in range(lo, hi):
            at += right[k] == length
            branch[order[k + 1]] = at
        own.sort(key=before.__getitem__)
        left = [_shared(before[a], before[b]) for a, b in zip(own, own[1:])]
        for back, a, b in intervals(left):
            # Diverse to the left by construction, to the right if branches meet.
            if back + length >= least and len({branch[m] for m in own[a : b + 1]}) > 1:
                yield back, length, own[a : b + 1]


def reaches(before: list[bytes], after: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray]:
    """How far the repeats of ``least`` bytes or more around each member's place
    reach to the left and to the right; -1 and 0 where there is none.

    In each interval a member extends furthest to the left with a neighbour in
    the order of the texts before; what an interval's order holds between two of
    them is the least of the whole order there.
    """
    m = len(after)
    back, ahead = np.full(m, -1, np.int64), np.zeros(m, np.int64)
    if m == 2:
        left, right = _shared(*before), _shared(*after)
        if left + right >= least:
            back[:], ahead[:] = left, right
        return back, ahead
    order, right = _sorted(after)
    by_left, shared = _sorted(before)
    rank = np.empty(m, np.int64)
    rank[by_left] = np.arange(m)
    rank, shared = rank[order], np.array(shared, np.int64)
    far_back, far_ahead = back.copy(), ahead.copy()  # by rank
    for length, lo, hi in intervals(right):
        own = np.sort(rank[lo : hi + 1])
        between = np.minimum.reduceat(shared[: own[-1]], own[:-1])
        best = np.maximum(np.append(between, -1), np.append(-1, between))
        ok = best + length >= least
        if ok.any():
            own, best = own[ok], best[ok]
            far_back[own] = np.maximum(far_back[own], best)
            far_ahead[own] = np.maximum(far_ahead[own], length)
    back[by_left], ahead[by_left] = far_back, far_ahead
    return back, ahead


def _covered(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(zip(starts, ends)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


class _Rows:
    """Collects columns and gives them out as batches of bounded size."""

    def __init__(self, kinds: dict[str, str], rows: int = 20_000):
        import pyarrow as pa

        self.pa, self.rows = pa, rows
        self.kinds = {k: {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}.get(v, v) for k, v in kinds.items()}
        self.held = {k: [] for k in kinds}

    def add(self, *values) -> None:
        for held, v in zip(self.held.values(), values):
            held.append(v)

    def full(self) -> bool:
        return len(next(iter(self.held.values()))) >= self.rows

    def batch(self):
        arrays = [self.pa.array(v, self.kinds[k]) for k, v in self.held.items()]
        self.held = {k: [] for k in self.held}
        return self.pa.RecordBatch.from_arrays(arrays, list(self.held))

    def rest(self):
        if next(iter(self.held.values())):
            yield self.batch()


def _schema(kinds: dict[str, str]) -> str:
    return ", ".join(f"{k} {v}" for k, v in kinds.items())


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _spot(c1: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A number for a place in a text; within a group of equal keys it tells
    places apart."""
    return mix(c1.view(_U) + mix(at.astype(_U) + _U(0x9E3779B97F4A7C15))).view(np.int64)


def _contexts(least: int, key: int, wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """The surroundings of wanted places (c1, c2, h, at, m), at most ``least``
    bytes on either side of the key's first byte."""
    side = least - key
    kinds = {"h": "long", "c1": "long", "c2": "long", "at": "int", "m": "long", "before": "binary", "after": "binary"}

    def run(batches):
        out = _Rows(kinds)
        for batch in batches:
            for c1, c2, data, spots in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                data = data.as_buffer().to_pybytes()
                for s in spots:
                    p = s["at"]
                    out.add(s["h"], c1, c2, p, s["m"], data[max(0, p - side) : p][::-1], data[p : p + least])
                    if out.full():
                        yield out.batch()
        yield from out.rest()

    spots = wanted.groupBy(*TEXT).agg(F.collect_list(F.struct("h", "at", "m")).alias("spots"))
    return texts.select(*TEXT, "data").join(spots.hint("shuffle_hash"), list(TEXT)).select(*TEXT, "data", "spots").mapInArrow(run, _schema(kinds))


def _halves(least: int):
    """The halves of a row's range of offsets: of each the key of its part, the
    middle that all its strings share, and a hash of all bytes they cover (of
    the place itself where they leave the text)."""
    kinds = {"id": "long", "of": "int", "c1": "long", "c2": "long", "at": "int", "from": "int", "to": "int", "part": "long", "whole": "long"}

    def run(batches):
        out = _Rows(kinds)
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for part, i, c1, c2, at, lo, hi, before, after in zip(*(batch.column(k).to_pylist() for k in range(9))):
                text, p = before[::-1] + after, len(before)
                mid = (lo + hi) // 2
                for a, b in ((lo, mid), (mid + 1, hi)):
                    if p < a or len(after) < least - b:
                        continue
                    seed = (part ^ (a * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
                    inner = digest(text[p - a : p + least - b], seed)
                    outer = digest(text[p - b : p + least - a], seed) if p >= b and len(after) >= least - a else i ^ 0x5851F42D4C957F2D
                    out.add(i, lo, c1, c2, at, a, b, _signed(inner), _signed(outer & 0xFFFFFFFFFFFFFFFF))
                    if out.full():
                        yield out.batch()
        yield from out.rest()

    return run, _schema(kinds)


def _split(hot: DataFrame, least: int, side: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Rows of parts that fit (part, c1, c2, at, before, after), and the spans
    (c1, c2, start, end) that were decided on the way."""
    run, schema = _halves(least)
    whole = ["part", "id", *TEXT, "at", "from", "to", "before", "after"]
    id_ = F.xxhash64(*TEXT, "at")
    live = hot.select(F.col("h").alias("part"), id_.alias("id"), *TEXT, "at", F.lit(0).alias("from"), F.lit(side).alias("to"), "before", "after")
    fit, decided = [], []
    for _ in range(side.bit_length() + 1):
        kids = materialize(live.select(whole).mapInArrow(run, schema), "halves")
        same = kids.groupBy("part", "whole").agg(F.count("*").alias("n"), F.min("id").alias("one"))
        parts = same.groupBy("part").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1")
        # Equal in all that the half looks at: every string of it repeats.
        twice = same.where("n > 1").select("part", "whole")
        decided.append(kids.join(twice, ["part", "whole"], "left_semi").select(*TEXT, F.greatest(F.col("at") - F.col("to"), F.lit(0)).alias("start"), (F.col("at") + least - F.col("from")).alias("end")))
        ones = kids.join(same.select("part", "whole", F.col("one").alias("id")), ["part", "whole", "id"], "left_semi")
        ones = ones.join(parts.select("part", "m"), "part").select("id", F.col("of").alias("from"), F.col("from").alias("a"), F.col("to").alias("b"), F.col("part").alias("p"), "m")
        now = live.select("id", *TEXT, "at", "from", "before", "after").join(ones, ["id", "from"])
        now = materialize(now.select(F.col("p").alias("part"), "id", *TEXT, "at", F.col("a").alias("from"), F.col("b").alias("to"), "before", "after", "m"), "split")
        fit.append(now.where(F.col("m") <= MEMBERS).select("part", *TEXT, "at", "before", "after"))
        live = now.where(F.col("m") > MEMBERS)
        if not live.select(F.lit(1)).limit(1).count():
            break
    return fit, decided


def repeated_spans(docs: DataFrame, least: int = 400) -> tuple[DataFrame, DataFrame]:
    """c1, c2, start, end: bytes of each distinct text that a string of ``least``
    bytes covers which also starts elsewhere, in it or in another distinct text.

    docs: c1, c2 (``fingerprint``), rid (a hash of the row) and data (binary),
    any number of rows to a text. Spans may touch or overlap. Copies of a whole
    text are left to the caller: they repeat all of it. Also returns the texts
    that hold a candidate place, one row each: c1, c2, data, hs.
    """
    key = max(1, min(200, least // 2))
    side = least - key
    docs = docs.where(F.octet_length("data") >= least).select(*TEXT, "rid", "data")

    def sample(batches):
        import pyarrow as pa

        for part, data, off in pieces(batches, "data"):
            row, at, h = places(data, off, least, key)
            if not len(row):
                continue
            own = np.asarray(part.column(0).to_numpy())[row]
            spot = _spot(own, at)
            # Of a text's equal places (it may be one word again and again) the least and the last.
            order = np.lexsort((spot, h, row))
            row, spot, h = row[order], spot[order], h[order]
            new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])]))
            last = np.append(new[1:], len(row)) - 1
            texts = pa.array(row[new])
            yield pa.RecordBatch.from_arrays([*(part.column(k).take(texts) for k in range(3)), pa.array(spot[new]), pa.array(spot[last]), pa.array(h[new].view(np.int64))], ["c1", "c2", "rid", "lo", "hi", "h"])

    sampled = materialize(docs.mapInArrow(sample, "c1 long, c2 long, rid long, lo long, hi long, h long"), "places")
    # Written on its own, so that a join with a common key can be split.
    again = materialize(sampled.groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("h"), "again")
    found = sampled.join(again, "h", "left_semi").groupBy(*TEXT).agg(F.collect_set("h").alias("hs"), F.min("rid").alias("rid"))
    # One copy of each text that holds such a place.
    one = docs.join(found.hint("shuffle_hash"), [*TEXT, "rid"]).dropDuplicates([*TEXT, "rid"])
    one = materialize(one.select(*TEXT, "data", "hs"), "repeat-texts")
    release(sampled, again)
    pairs = "array<struct<start:int,end:int>>"

    def around(batches):
        import pyarrow as pa

        kinds = {"c1": "long", "c2": "long", "at": "int", "lo": "long", "hi": "long", "h": "long", "ctx": "long", "spans": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))}
        out = _Rows(kinds)
        for batch in batches:
            for c1, c2, data, hs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                data, held = data.as_buffer().to_pybytes(), {}
                _, at, h = places(np.frombuffer(data, np.uint8), np.array([0, len(data)]), least, key)
                take = np.isin(h.view(np.int64), hs.values.to_numpy())
                at, h = at[take], h[take].view(np.int64)
                for p, k in zip(at.tolist(), h.tolist()):
                    lo = max(0, p - side)
                    held.setdefault((k, xxhash.xxh3_64_intdigest(data[lo : p + least], p - lo)), []).append(p)
                for (k, ctx), ats in held.items():
                    spots = _spot(np.full(len(ats), c1, np.int64), np.array(ats))
                    spans = _covered([max(0, p - side) for p in ats], [min(len(data), p + least) for p in ats])
                    out.add(c1, c2, ats[0], int(spots.min()), int(spots.max()), k, _signed(ctx), [{"start": a, "end": b} for a, b in spans])
                    if out.full():
                        yield out.batch()
        yield from out.rest()

    around_all = materialize(one.mapInArrow(around, f"c1 long, c2 long, at int, lo long, hi long, h long, ctx long, spans {pairs}"), "around")
    members = around_all.groupBy("h", "ctx").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), *(F.first(c).alias(c) for c in (*TEXT, "at")))
    members = materialize(members.select("h", "ctx", *TEXT, "at", (F.col("lo") != F.col("hi")).alias("twice")), "members")
    groups = members.groupBy("h").agg(F.count("*").alias("m"), F.min("twice").alias("all"))
    groups = materialize(groups.where("m > 1 and not all").select("h", "m"), "groups")
    # Equal surroundings: the whole of them is covered in every occurrence.
    doubled = members.where("twice").select("h", "ctx")
    sure = around_all.join(doubled, ["h", "ctx"], "left_semi").select(*TEXT, F.explode("spans").alias("s")).select(*TEXT, "s.start", "s.end")
    # Groups with a member that stands alone and others to meet.
    open_ = members.join(groups, "h").select("h", *TEXT, "at", "m")
    contexts = materialize(_contexts(least, key, open_, one), "contexts")
    release(groups)
    fit, decided = [contexts.where(F.col("m") <= MEMBERS).select(F.col("h").alias("part"), *TEXT, "at", "before", "after")], []
    hot = contexts.where(F.col("m") > MEMBERS)
    if hot.select(F.lit(1)).limit(1).count():
        more, decided = _split(hot, least, side)
        fit += more

    def solve(batches):
        kinds = {"c1": "long", "c2": "long", "start": "int", "end": "int"}

        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in range(6)))

        out = _Rows(kinds)
        for _, group in groupby(rows(), key=lambda r: r[0]):
            _, c1, c2, at, before, after = zip(*group)  # MEMBERS rows at most
            for k, (back, ahead) in enumerate(zip(*(x.tolist() for x in reaches(before, after, least)))):
                if back >= 0:
                    out.add(c1[k], c2[k], at[k] - back, at[k] + ahead)
            if out.full():
                yield out.batch()
        yield from out.rest()

    parts = fit[0]
    for more in fit[1:]:
        parts = parts.union(more)
    spans = parts.repartition("part").sortWithinPartitions("part").mapInArrow(solve, "c1 long, c2 long, start int, end int")
    for more in (*decided, sure):
        spans = spans.union(more)
    return spans, one


def remove_repeats(docs: DataFrame, least: int = 400, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, one row per row; with
    ``with_text`` also c1 and c2 (``fingerprint`` of the text) and kept, the text
    left (null where nothing goes; bytes of a character that a cut splits are
    left out).

    Every byte goes that a ``least``-byte string covers which also starts
    anywhere else in the table, the same text included; strings overlap and are
    judged on the input. Null and short texts lose nothing; a repeated row is
    another place. Texts are UTF-8 bytes of any length. An empty table gives no
    rows.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    base = docs.select("doc_id", text.alias("data")).select("doc_id", "data", *fingerprint("data"), F.xxhash64("doc_id").alias("rid"))
    there = scratch()
    spans, texts = repeated_spans(base, least)
    merged = materialize(spans.groupBy(*TEXT).agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans")
    drop_since(there, merged, texts)
    n_bytes = F.octet_length("data").cast("long")
    long = base.where(n_bytes >= least)
    copied = materialize(long.groupBy(*TEXT).agg(F.count("*").alias("n")).where("n > 1").select(*TEXT), "copied")
    # Copied texts go whole; of the others those with spans are read again.
    touched = merged.join(copied, list(TEXT), "left_anti")
    read = texts.join(touched.hint("shuffle_hash"), list(TEXT)).select(*TEXT, "data", "spans")
    kinds = {"c1": "long", "c2": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string", "kept": "string"}

    def cut(batches):
        out = _Rows(kinds, 2000)
        for batch in batches:
            for c1, c2, data, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                data = data.as_buffer().to_pybytes()
                runs = _covered([s["start"] for s in spans], [min(s["end"], len(data)) for s in spans])
                kept, at = [], 0
                for a, b in runs:
                    kept.append(data[at:a])
                    at = b
                kept = b"".join([*kept, data[at:]])
                out.add(c1, c2, len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None)
                if out.full():
                    yield out.batch()
            yield from out.rest()

    done = read.mapInArrow(cut, _schema(kinds)).withColumn("copied", F.lit(False))
    whole = copied.select(*TEXT, F.lit(None).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"), F.lit("").alias("kept"), F.lit(True).alias("copied"))
    brief = base.select("doc_id", *TEXT, n_bytes.alias("n_bytes"), F.sha2("data", 256).alias("sha"))
    out = brief.join(done.union(whole), list(TEXT), "left")
    removed = F.when(F.col("copied"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0)))
    out = out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), *TEXT, "kept")
    return out if with_text else out.drop(*TEXT, "kept")


def op2_interval_tree(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), 400)


ORACLE = {
    # By definition: all strings of 400 bytes, in pieces of 800 places each.
    "op2_interval_tree": """
with t as (select row_number() over () as rid, doc_id, hex(coalesce(text, '')) as hx from documents),
p as (select rid, b, substr(hx, 2 * b + 1, 2398) as piece from (select rid, hx, unnest(range(0, length(hx) // 2, 800)) as b from t)),
w as (select rid, b + j as place, hash(substr(piece, 2 * j + 1, 800)) as h from (select *, unnest(range(0, least(800, length(piece) // 2 - 399))) as j from p)),
g as (select rid, place, count(*) over (partition by h) > 1 as again from w),
y as (select rid, b + j as place, substr(piece, 2 * j + 1, 2) as x from (select *, unnest(range(0, least(800, length(piece) // 2))) as j from p)),
z as (select rid, place, x, bool_or(coalesce(again, false)) over (partition by rid order by place rows 399 preceding) as gone from y left join g using (rid, place)),
v as (select *, lag(gone, 1, false) over (partition by rid order by place) as before from z),
k as (select rid, count(*) as n_bytes, count_if(gone) as n_removed, count_if(gone and not before) as n_spans, string_agg(x, '' order by place) filter (not gone) as kept from v group by rid)
select doc_id, coalesce(n_bytes, 0)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(unhex(coalesce(kept, ''))) as kept_sha256 from t left join k using (rid)"""
}
