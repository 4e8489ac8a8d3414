"""Mixing sources to target weights by min-cost flow.

Documents are summed by membership pattern (the set of sources that hold them),
in Spark. A small network then routes the patterns' words to the sources'
quotas: each pattern offers its words once for nothing, a second time at cost 1,
a third time at cost 2, so that repetition is convex and is spread before it is
deepened. The flow of a pattern is realised by whole documents in a seeded
order; the cut in that order is found from sums over the digits of the drawn
numbers, so that no source is ever sorted or gathered in one task.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.common import WORD, materialize, table

WEIGHTS = (1, 2, 3)


def fill_to_caps(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Shares sum(sizes) by weight; nobody gets over most times its size, and
    what is cut off goes to the others by weight, until none is above."""
    target = [0.0] * len(sizes)
    free, left = set(range(len(sizes))), float(sum(sizes))
    while free:
        unit = left / sum(weights[i] for i in free)
        above = {i for i in free if unit * weights[i] > most * sizes[i]}
        if not above:
            for i in free:
                target[i] = unit * weights[i]
            break
        for i in above:
            target[i] = float(most * sizes[i])
            left -= target[i]
        free -= above
    return target


def min_cost_flow(supply: list[int], quota: list[int], member: list[list[int]], epochs: int) -> list[dict[int, int]]:
    """Words that each pattern sends to each of its sources.

    Pattern p has ``epochs`` arcs of capacity supply[p] and cost 0, 1, 2, ...;
    arcs to its sources are free; source s takes at most quota[s]. The dual
    method: potentials by shortest paths, then all that can flow along arcs of
    reduced cost 0 in rounds of level graphs; there are few different costs and
    so few searches for them, however many patterns there are.
    """
    n_p, n_s = len(supply), len(quota)
    start, end = 0, 1 + n_p + n_s
    arcs: list[list[int]] = []  # to, capacity, cost; its reverse is at index ^ 1
    out: list[list[int]] = [[] for _ in range(end + 1)]

    def arc(a: int, b: int, cap: int, cost: int) -> int:
        out[a].append(len(arcs))
        arcs.append([b, cap, cost])
        out[b].append(len(arcs))
        arcs.append([a, 0, -cost])
        return len(arcs) - 2

    sent = []
    for p in range(n_p):
        for e in range(epochs):
            arc(start, 1 + p, supply[p], e)
        sent.append({s: arc(1 + p, 1 + n_p + s, epochs * supply[p], 0) for s in member[p]})
    for s in range(n_s):
        arc(1 + n_p + s, end, quota[s], 0)
    potential = [0] * (end + 1)

    def shorten() -> bool:
        """Potentials by shortest paths; whether the end can be reached."""
        far: list[int | None] = [None] * (end + 1)
        far[start], heap = 0, [(0, start)]
        while heap:
            d, v = heapq.heappop(heap)
            if d > far[v]:
                continue
            for k in out[v]:
                to, cap, cost = arcs[k]
                if cap > 0:
                    step = d + cost + potential[v] - potential[to]
                    if far[to] is None or step < far[to]:
                        far[to] = step
                        heapq.heappush(heap, (step, to))
        if far[end] is None:
            return False
        for v, d in enumerate(far):
            potential[v] += far[end] if d is None else min(d, far[end])
        return True

    def open_(v: int, k: int) -> bool:
        to, cap, cost = arcs[k]
        return cap > 0 and cost + potential[v] == potential[to]

    def levels() -> list[int] | None:
        level, row = [-1] * (end + 1), [start]
        level[start] = 0
        while row and level[end] < 0:
            after = []
            for v in row:
                for k in out[v]:
                    to = arcs[k][0]
                    if level[to] < 0 and open_(v, k):
                        level[to] = level[v] + 1
                        after.append(to)
            row = after
        return level if level[end] >= 0 else None

    while shorten():
        while (level := levels()) is not None:
            at, path, v = [0] * (end + 1), [], start
            while True:
                if v == end:
                    push = min(arcs[k][1] for k in path)
                    for k in path:
                        arcs[k][1] -= push
                        arcs[k ^ 1][1] += push
                    # Back to before the first arc that is now full.
                    cut = next(i for i, k in enumerate(path) if not arcs[k][1])
                    v = arcs[path[cut] ^ 1][0]
                    del path[cut:]
                while at[v] < len(out[v]):
                    k = out[v][at[v]]
                    if level[arcs[k][0]] == level[v] + 1 and open_(v, k):
                        break
                    at[v] += 1
                if at[v] < len(out[v]):
                    path.append(out[v][at[v]])
                    v = arcs[path[-1]][0]
                elif path:
                    level[v] = -1
                    v = arcs[path.pop() ^ 1][0]
                else:
                    break
    return [{s: arcs[k ^ 1][1] for s, k in links.items()} for links in sent]


def mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    sources: F.Column | None = None,
    weights: tuple[float, ...] = WEIGHTS,
    most: int = 3,
    rows_at_edge: int = 2000,
    most_patterns: int = 20_000,
    seed: int = 11,
) -> DataFrame:
    """id, size, pattern (sorted array of sources), source_size, target, taken,
    serves.

    ``sources``: array column of the sources that hold a document; by default
    the one in ``source``. Sources are ordered by code point, null last, and
    weigh ``weights`` in turn. A null text has size 0, is never taken and
    belongs to its source all the same. source_size and target are those of the
    pattern's first source (with one source each: of its own). ``taken`` is size
    times the passes over the document, 0 to ``most``; ``serves`` names the source
    that each pass counts for, drawn by the shares of the pattern's flow.
    Documents are taken by the md5 of id, seed and text; repeated rows count as
    documents of their own and fall in the same place of the order. Texts of any
    length are counted whole. An empty table gives no rows. More than
    ``most_patterns`` distinct patterns raise: their sums reach the driver.
    """
    pattern = F.array("source") if sources is None else sources
    text = F.coalesce(text_column, F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    draw = F.md5(F.concat(F.coalesce(F.col(id_column).cast("string"), F.lit("null")), F.lit(f":{seed}:"), text))
    kept = materialize(docs.select(F.col(id_column).alias("id"), size.alias("size"), pattern.alias("pattern"), draw.alias("draw")), "mix-rows")
    rows = kept.withColumn("name", F.to_json(F.struct("pattern")))
    sums = rows.groupBy("name").agg(F.first("pattern").alias("pattern"), F.sum("size").alias("size"), F.count("*").alias("n")).limit(most_patterns + 1).collect()
    if len(sums) > most_patterns:
        raise ValueError(f"more than {most_patterns} membership patterns")
    sums.sort(key=lambda r: r.name)
    names = sorted({s for r in sums for s in r.pattern}, key=lambda s: (s is None, (s or "").encode()))
    at = {s: i for i, s in enumerate(names)}
    # An overlapping document counts for each of its sources' size, once in the total.
    source_size = [0] * len(names)
    share = [0] * len(names)
    for r in sums:
        for s in set(r.pattern):
            source_size[at[s]] += r.size
        share[at[r.pattern[0]]] += r.size
    turn = [weights[i % len(weights)] for i in range(len(names))]
    target = fill_to_caps(source_size, turn, most) if sum(share) == sum(source_size) else _fit(share, source_size, turn, most)
    flow = min_cost_flow([r.size for r in sums], [round(x) for x in target], [sorted({at[s] for s in r.pattern}) for r in sums], most)
    plan = []
    for r, sent in zip(sums, flow):
        through = sum(sent.values())
        passes, rest = divmod(through, r.size) if r.size else (0, 0)
        upto, shares = 0, []
        for s, words in sorted(sent.items()):
            upto += words
            if words:
                shares.append((names[s], upto / through))
        plan.append((r.name, int(passes), int(rest), source_size[at[r.pattern[0]]], float(target[at[r.pattern[0]]]), shares))
    # The plan is as long as the patterns are many: bounded above.
    spark = docs.sparkSession
    source = docs.schema["source"].dataType.simpleString() if sources is None else "string"
    plan_df = F.broadcast(spark.createDataFrame(plan or [("", 0, 0, 0, 0.0, [])], f"name string, passes long, rest long, source_size long, target double, shares array<struct<source:{source},upto:double>>"))
    rows = rows.join(plan_df, "name")
    edge = _edges(rows, {r.name: r.n for r in sums}, rows_at_edge)
    rows = rows.join(F.broadcast(edge), "name", "left")
    at_edge = F.col("edge").isNotNull() & F.startswith("draw", F.col("edge"))
    inside = rows.where(at_edge)
    order = Window.partitionBy("name").orderBy("draw", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    # A document is in if the sum before its middle is under the rest.
    inside = inside.withColumn("more", F.when(F.col("before") + F.sum("size").over(order) - F.col("size") / 2 < F.col("rest"), 1).otherwise(0))
    early = (F.col("rest") > 0) & (F.col("edge").isNull() | (F.col("draw") < F.col("edge")))
    outside = rows.where(~at_edge).withColumn("more", F.when(early, 1).otherwise(0))
    out = inside.unionByName(outside)
    times = F.col("passes") + F.when(F.col("passes") < most, F.col("more")).otherwise(0)
    place = lambda k: F.pmod(F.xxhash64("draw", k), F.lit(1 << 30)) / (1 << 30)
    drawn = F.transform(F.sequence(F.lit(1), F.col("times")), lambda k: F.filter("shares", lambda x: place(k) < x.upto)[0]["source"])
    out = out.withColumn("times", F.when(F.col("size") > 0, times).otherwise(0).cast("int"))
    serves = F.when(F.col("times") > 0, drawn).otherwise(F.array().cast(f"array<{source}>"))
    return out.select("id", "size", "pattern", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), serves.alias("serves"))


def _edges(rows: DataFrame, counts: dict[str, int], rows_at_edge: int) -> DataFrame:
    """name, edge, before: the beginning of the draws among which a pattern's
    last pass ends, and the words before them. Two digits of the draw are summed
    at a time, 256 sums for a pattern at most, until few rows have the edge."""
    spark = rows.sparkSession
    within = rows.withColumn("edge", F.lit("")).withColumn("before", F.lit(0).cast("long")).where("rest > 0")
    edge, left = None, max(counts.values(), default=0)
    for _ in range(16):
        digits = F.substring("draw", F.length("edge") + 1, F.lit(2))
        sums = within.groupBy("name", "edge", digits.alias("digits")).agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.first("rest").alias("rest"), F.first("before").alias("before"))
        upto = F.sum("b").over(Window.partitionBy("name").orderBy("digits"))
        sums = sums.withColumn("start", F.col("before") + upto - F.col("b"))
        found = sums.where("start <= rest and rest < start + b")
        edge = materialize(found.select("name", F.concat("edge", "digits").alias("edge"), F.col("start").alias("before"), "n"), "mix-edges")
        now = edge.agg(F.max("n")).first()[0] or 0
        if now <= rows_at_edge or now == left:
            break
        left = now
        within = rows.join(F.broadcast(edge.drop("n")), "name").where(F.startswith("draw", F.col("edge")))
    return edge.drop("n") if edge is not None else spark.createDataFrame([], "name string, edge string, before long")


def _fit(share: list[int], source_size: list[int], turn: list[float], most: int) -> list[float]:
    """Targets where sources overlap: the total counts each document once."""
    scale = sum(share) / max(1, sum(source_size))
    return [min(x * scale, float(most * s)) for x, s in zip(fill_to_caps(source_size, turn, most), source_size)]


def op7_min_cost_flow(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


ORACLE = {
    "op7_min_cost_flow": r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
    md5(coalesce(doc_id::varchar, 'null') || ':11:' || coalesce(text, '')) as draw from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as i from d group by source),
w as (select *, ((i - 1) % 3 + 1)::double as weight, 3.0 * source_size as cap from s),
-- The sources that are cut off at their cap are the first ones by cap to weight.
o as (select *, row_number() over (order by cap / weight, i) as k, sum(source_size) over () as total from w),
u as (select *, (total - coalesce(sum(cap) over (order by k rows between unbounded preceding and 1 preceding), 0))::double
    / sum(weight) over (order by k rows between current row and unbounded following) as unit from o),
f as (select min(k) as k from u where unit * weight <= cap),
t as (select source, source_size, case when k < (select k from f) then cap::double
    else (select unit from u join f using (k)) * weight end as target from u),
q as (select *, least(round_even(target, 0)::bigint, 3 * source_size) as flow from t),
r as (select d.*, source_size, target, case when source_size > 0 then flow // source_size else 0 end as passes,
    case when source_size > 0 then flow % source_size else 0 end as rest,
    sum(size) over (partition by d.source order by draw, doc_id, size rows unbounded preceding) as upto
  from d join q on d.source is not distinct from q.source)
select doc_id, size::bigint as size, source_size, target,
  (size * (passes + case when passes < 3 and upto - size / 2.0 < rest then 1 else 0 end))::bigint as taken from r"""
}
