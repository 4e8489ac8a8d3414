"""Shards of near-equal bytes by sampled splitters.

Records are ordered by fingerprints of text and doc_id: equal texts lie side by side
and stay in one shard unless a shard's edge has to cut a group that is too
heavy to move. The order is never sorted as a whole: a sample weighted by size
gives quantile splitters of fine ranges, the bytes of each range are summed
exactly, ranges that came out overfull are subdivided, and each range is then
swept on its own with the sum of the ranges before it.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.llm.common import CRC_TABLE, crc_sql, materialize, release, table


def shard_by_bytes(
    docs: DataFrame,
    shards: int = 24,
    ranges_per_shard: int = 8,
    rows_per_range: int = 1_000_000,
    sample_per_range: int = 40,
    snap: float = 0.01,
    seed: int = 7,
) -> DataFrame:
    """doc_id, size, text_crc32, shard (0..shards-1) and slot (gapless from 0).

    size is the text's UTF-8 bytes plus 8 (null: 8, crc32 of nothing: 0).
    A shard's edge falls at the first record whose middle passes the ideal edge,
    or at the start or end of a group of equal texts that is within ``snap`` of
    a shard's bytes. Rows with equal key and text share their place up to
    ``size``; repeated rows count each. An empty table gives no rows.

    There are ``ranges_per_shard`` ranges for each shard, and more where they would
    hold over ``rows_per_range`` rows, the most that a task sorts. Ranges, their
    sums and the sampled keys reach the driver: 25,000 ranges for 25 thousand
    million rows. Texts of any length are hashed whole.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = materialize(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            _number(text).alias("h"),
            _number(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")).alias("t"),
        ),
        "shard-rows",
    )
    total, n = rows.agg(F.sum("size"), F.count("*")).first()
    if not n:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).where("false")
    ranges = max(shards * ranges_per_shard, -(-n // rows_per_range))
    # Poisson sample: a record is drawn with probability in proportion to its size.
    want = ranges * sample_per_range
    drawn = rows.where(F.rand(seed) * total < F.col("size") * want).select("h", "t").orderBy(F.rand(seed + 1)).limit(4 * want).collect()
    keys = sorted({(r.h, r.t) for r in drawn})
    cuts = sorted({keys[len(keys) * k // ranges] for k in range(1, ranges)}) if keys else []
    limit = 3 * (n // ranges + 1)
    for _ in range(12):
        placed = _in_range(rows, cuts)
        sums = {r.g: r for r in placed.groupBy("g").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}
        over = [g for g, r in sums.items() if r.n > limit]
        if not over:
            break
        # An overfull range gets splitters of its own from a new sample of it.
        more = placed.where(F.col("g").isin(over)).where(F.rand(seed + 2) * n < ranges * sample_per_range).select("h", "t").limit(4 * want).collect()
        fresh = set(cuts)
        for g in over:
            own = sorted({(r.h, r.t) for r in more if bisect_right(cuts, (r.h, r.t)) == g})
            parts = min(len(own), 2 * sums[g].n // limit + 2)
            fresh |= {own[len(own) * k // parts] for k in range(1, parts)} if parts > 1 else set()
        if len(fresh) == len(cuts):
            break
        cuts = sorted(fresh)
    before, cum = [], 0
    for g in range(len(cuts) + 1):
        before.append(cum)
        cum += sums[g].b if g in sums else 0
    step, ideal = total / shards, [total * s / shards for s in range(1, shards)]
    order = Window.partitionBy("g").orderBy("h", "t", "size").rowsBetween(Window.unboundedPreceding, 0)
    swept = _in_range(rows, cuts, before).withColumn("upto", F.sum("size").over(order) + F.col("base"))
    run = materialize(swept.withColumn("place", F.count("*").over(order)), "shard-sweep")
    # Groups of equal texts that an ideal edge cuts: a few rows for each edge.
    mid = F.col("upto") - F.col("size") / 2
    crossing = run.groupBy("h").agg(F.min(F.col("upto") - F.col("size")).alias("lo"), F.max("upto").alias("hi"))
    cut = F.array(*[F.lit(float(e)) for e in ideal]) if ideal else F.expr("cast(array() as array<double>)")
    groups = crossing.where(F.exists(cut, lambda e: (e > F.col("lo")) & (e < F.col("hi")))).collect()
    edges = []
    for e in ideal:
        for g in groups:
            if g.lo < e < g.hi:
                near = min((g.lo, g.hi), key=lambda x: abs(x - e))
                e = float(near) if abs(near - e) <= snap * step else e
                break
        edges.append(e)
    cut = F.array(*[F.lit(float(e)) for e in edges]) if edges else cut
    run = run.withColumn("shard", F.size(F.filter(cut, lambda e: e <= mid)))
    first = run.groupBy("shard", "g").agg(F.count("*").alias("n"), F.min("place").alias("p")).orderBy("shard", "g").collect()
    shift, seen = [], {}
    for r in first:  # at most a row for each range and each edge
        shift.append((r.shard, r.g, seen.get(r.shard, 0) - r.p))
        seen[r.shard] = seen.get(r.shard, 0) + r.n
    back = F.broadcast(docs.sparkSession.createDataFrame(shift, "shard int, g int, shift long"))
    return run.join(back, ["shard", "g"]).select("doc_id", "size", "text_crc32", "shard", (F.col("place") + F.col("shift")).alias("slot"))


def _number(data) -> F.Column:
    """The first 60 bits of the md5."""
    return F.conv(F.substring(F.md5(data), 1, 15), 16, 10).cast("long")


def _in_range(rows: DataFrame, cuts: list[tuple[int, int]], before: list[int] | None = None) -> DataFrame:
    """g: how many cuts lie at or before the row's key; base: before[g]."""
    cut_h, cut_t = (np.array([c[i] for c in cuts], np.int64) for i in (0, 1))
    base = np.array(before if before is not None else [0] * (len(cuts) + 1), np.int64)

    def place(batches):
        import pyarrow as pa

        for b in batches:
            h, t = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("h", "t"))
            g = np.searchsorted(cut_h, h, "left")
            upper = np.searchsorted(cut_h, h, "right")
            for at in np.unique(g[upper > g]):  # cuts inside a group of equal texts
                own = (g == at) & (upper > at)
                to = upper[own][0]
                g[own] = at + np.searchsorted(cut_t[at:to], t[own], "right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(g.astype(np.int32)), pa.array(base[g])], [*b.schema.names, "g", "base"])

    return rows.mapInArrow(place, T.StructType([*rows.schema.fields, T.StructField("g", T.IntegerType()), T.StructField("base", T.LongType())]))


def op1_sampled_splitters(spark, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


ORACLE = {
    # The law by definition: one sort, and the edges from its running sums.
    "op1_sampled_splitters": f"""
with {CRC_TABLE},
x as (select doc_id, coalesce(text, '') as text from documents),
d as (select doc_id, octet_length(encode(text)) + 8 as size, substr(md5(text), 1, 15) as h, substr(md5(coalesce(doc_id::varchar, 'null')), 1, 15) as t,
  {crc_sql('text')} as crc from x, c),
r as (select *, sum(size) over (order by h, t, size rows unbounded preceding) as upto, row_number() over (order by h, t, size) as place from d),
g as (select h, min(upto - size) as lo, max(upto) as hi from r group by h),
e as (select s, (select sum(size)::double from d) * s / 24 as edge, (select sum(size)::double from d) / 24 as step from range(1, 24) as y(s)),
n as (select s, edge, step, case when abs(lo - edge) <= abs(hi - edge) then lo else hi end as near from e left join g on lo < edge and edge < hi),
k as (select list(case when abs(near - edge) <= 0.01 * step then near::double else edge end) as cuts from n),
p as (select *, len([u for u in cuts if u <= upto - size / 2::double])::int as shard from r, k)
select doc_id, size::bigint as size, crc::bigint as text_crc32, 'bytes' as law, shard,
  (row_number() over (partition by shard order by place) - 1)::bigint as slot, null::int as grown_shard from p"""
}
