"""Exact top-k inner products by multi-resolution segment statistics.

A vector is cut into 1, 4, 16 equal segments; of each the mean and the deviation
are kept. For segments of length l, q.x is at most the sum of
l * (mean_q * mean_x + dev_q * dev_x) (Cauchy-Schwarz on the centred segments;
the same as a lower bound of the distance between them). Candidates that cannot
reach a query's k-th best score so far leave from coarse to fine; for the pairs
that are left the exact product is taken.

Both sides are packed into blocks of rows; every query block meets every
candidate block by an equi-join on the block's number, so neither side is
broadcast or collected. A task holds one pair of blocks. Each query block meets
one block of candidates first, whose k-th best scores all others must reach.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.common import materialize, table

LEVELS = (1, 4, 16)


def segment_stats(x: np.ndarray, parts: int) -> np.ndarray:
    """Means and deviations of ``parts`` segments, scaled by the root of the
    length, side by side: the bound is the product of two such rows."""
    n, dim = x.shape
    parts = max(1, min(parts, dim))
    edges = np.linspace(0, dim, parts + 1).astype(int)
    length = np.diff(edges).astype(float)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / length
    square = np.add.reduceat(x * x, edges[:-1], axis=1) / length
    dev = np.sqrt(np.maximum(square - mean * mean, 0))
    return np.hstack([mean, dev]) * np.sqrt(np.hstack([length, length]))


def best(q: np.ndarray, q_id: np.ndarray, low: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int, run: int = 1024, count: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, candidate row and score of each query's k best in the block, of
    those that reach ``low``. Scores are exact integers (int64, or Python's where
    they may not fit). ``count`` gets the pairs, and those multiplied out."""
    order = np.argsort(-np.linalg.norm(x, axis=1), kind="stable")  # long vectors first: early thresholds
    x, x_id = x[order], x_id[order]
    stats = [(segment_stats(q, p), segment_stats(x, p)) for p in LEVELS]
    kind = _kind(q, x)
    nothing = np.iinfo(np.int64).min
    top = np.full((len(q), k), nothing, object if kind is object else np.int64)
    at_top = np.full((len(q), k), -1, np.int64)
    for at in range(0, len(x), run):
        to = min(len(x), at + run)
        # The k-th best so far, here or among those that came before this block.
        least = np.where(at_top[:, -1] >= 0, top[:, -1].astype(float), -np.inf)
        least = np.maximum(least, low)
        least -= np.abs(np.where(np.isfinite(least), least, 0)) * 1e-9 + 1e-6
        live_q, live_x = np.arange(len(q)), np.arange(at, to)
        alive = np.ones((len(q), to - at), bool)
        for sq, sx in stats:
            bound = sq[live_q] @ sx[live_x].T
            alive[np.ix_(live_q, live_x - at)] &= bound * (1 + 1e-9) >= least[live_q, None]
            live_q, live_x = np.flatnonzero(alive.any(1)), at + np.flatnonzero(alive.any(0))
            if not len(live_q) or not len(live_x):
                break
        alive &= q_id[:, None] != x_id[None, at:to]
        row, col = np.nonzero(alive)
        if count is not None:
            count.append((alive.size, len(row)))
        if not len(row):
            continue
        score = _products(q, x[at:to], row, col, kind)
        ok = score >= np.maximum(least, float(nothing))[row] if kind is not object else np.array([not np.isfinite(b) or s >= b for s, b in zip(score, least[row])], bool)
        row, col, score = row[ok], col[ok] + at, score[ok]
        # The rows so far join in; by query, score, then the smaller id.
        had = np.unique(row)
        old = at_top[had] >= 0
        row = np.concatenate([row, np.repeat(had, old.sum(1))])
        col, score = np.concatenate([col, at_top[had][old]]), np.concatenate([score, top[had][old]])
        by = np.lexsort((x_id[col], -score, row)) if kind is not object else np.array(sorted(range(len(row)), key=lambda i: (row[i], -score[i], x_id[col[i]])), np.int64)
        row, col, score = row[by], col[by], score[by]
        first = np.searchsorted(row, row)
        place = np.arange(len(row)) - first
        ok = place < k
        top[had], at_top[had] = nothing, -1
        top[row[ok], place[ok]], at_top[row[ok], place[ok]] = score[ok], col[ok]
    row, place = np.nonzero(at_top >= 0)
    return row, x_id[at_top[row, place]], top[row, place]


def _kind(q: np.ndarray, x: np.ndarray):
    """Numbers in which every partial sum of the products is exact."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    return float if most < 2.0**53 else np.int64 if most < 2.0**62 else object


def _products(q: np.ndarray, x: np.ndarray, row: np.ndarray, col: np.ndarray, kind) -> np.ndarray:
    """Integer inner products of the pairs (row, col): of many pairs as a matrix
    product of what they hold, of few ones each on its own."""
    if kind is object:
        q, x = ([[int(v) for v in r] for r in m] for m in (q, x))
        return np.array([sum(a * b for a, b in zip(q[i], x[j])) for i, j in zip(row, col)], object)
    rows, cols = np.unique(row), np.unique(col)
    if kind is float and len(row) * 100 > len(rows) * len(cols):  # a pair on its own costs as much as a hundred
        whole = q[rows] @ x[cols].T
        return whole[np.searchsorted(rows, row), np.searchsorted(cols, col)].astype(np.int64)
    out = np.empty(len(row), np.int64)
    for at in range(0, len(row), 65_536):
        i, j = row[at : at + 65_536], col[at : at + 65_536]
        out[at : at + 65_536] = np.einsum("ij,ij->i", q[i].astype(kind), x[j].astype(kind)).astype(np.int64)
    return out


def top_k(vectors: DataFrame, queries: F.Column, k: int = 5, scale: int = 256, block: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score of integer inner products.

    Components become floor(scale * x). Null vectors and vectors with a null or
    non-finite component take no part; an empty vector scores 0 with any other
    empty one; vectors meet only those of their own length. Ties go to the
    smaller vec_id; repeated rows count once and the query's own id is no
    candidate. Scores are exact and must fit 64 bits, else the job fails. An
    empty table gives no rows.
    """
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale).cast("double"))
    sound = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    rows = vectors.where(sound & F.col("vec_id").isNotNull()).select("vec_id", x.alias("x"), F.size("embedding").alias("dim"), queries.alias("asks")).dropDuplicates(["vec_id", "x"])
    count = materialize(rows, "vectors")
    n = count.count()
    blocks = max(1, -(-n // block))
    numbered = count.withColumn("c", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))

    def pack(df: DataFrame, by: str) -> DataFrame:
        return df.groupBy("dim", by).applyInArrow(_pack, f"dim int, {by} int, ids binary, rows binary")

    asking = numbered.where("asks")
    q_blocks = max(1, -(-(asking.count()) // block))
    asked = materialize(asking.withColumn("q", F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).cast("int")).transform(lambda d: pack(d, "q")), "asked").withColumnsRenamed({"ids": "q_ids", "rows": "q_rows"})
    packed = materialize(pack(numbered, "c"), "candidates")

    def meet(asked: DataFrame, numbers: F.Column) -> DataFrame:
        met = asked.withColumn("c", numbers).hint("shuffle_hash")
        return met.join(packed, ["dim", "c"]).select("dim", "q", "q_ids", "q_rows", "lows", "ids", "rows")

    def score(batches):
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                q, x = (np.frombuffer(r[c], float).reshape(-1, r["dim"]) if r["dim"] else None for c in ("q_rows", "rows"))
                q_id, x_id = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                if not r["dim"]:
                    q, x = np.zeros((len(q_id), 1)), np.zeros((len(x_id), 1))
                low = np.full(len(q_id), -np.inf)
                if r["lows"]:
                    at = np.array([v["at"] for v in r["lows"]], np.int64)
                    known = np.searchsorted(np.sort(q_id), at)
                    low[np.argsort(q_id, kind="stable")[known]] = [v["low"] for v in r["lows"]]
                at, ids, scores = best(q, q_id, low, x, x_id, k)
                yield pa.RecordBatch.from_arrays([pa.array(q_id[at]), pa.array(ids), pa.array(scores.tolist(), pa.int64())], ["query_id", "vec_id", "score"])

    found = "query_id long, vec_id long, score long"
    # One block first: what is k-th best there is the least that the others must reach.
    none = asked.withColumn("lows", F.lit(None).cast("array<struct<at:long,low:double>>"))
    tried = materialize(meet(none, F.pmod("q", F.lit(blocks))).mapInArrow(score, found).distinct(), "tried")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    kth = tried.withColumn("place", place).where(F.col("place") == k).select("query_id", F.col("score").cast("double").alias("low"))
    kth = asking.select("vec_id", "dim", F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).cast("int").alias("q")).distinct().join(kth, F.col("vec_id") == F.col("query_id"))
    lows = kth.groupBy("dim", "q").agg(F.collect_list(F.struct(F.col("query_id").alias("at"), "low")).alias("lows"))
    lows = asked.join(lows, ["dim", "q"], "left")
    others = F.explode(F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda c: c != F.pmod("q", F.lit(blocks))))
    more = meet(lows, others).mapInArrow(score, found).distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return tried.union(more).distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _pack(group):
    import pyarrow as pa

    name = "q" if "q" in group.column_names else "c"
    flat = group.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
    return pa.table({"dim": [group.column("dim")[0].as_py()], name: [group.column(name)[0].as_py()], "ids": [group.column("vec_id").to_numpy().tobytes()], "rows": [flat.tobytes()]}, schema=pa.schema([("dim", pa.int32()), (name, pa.int32()), ("ids", pa.binary()), ("rows", pa.binary())]))


def op6_segment_statistics(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 50 == 0)


ORACLE = {
    "op6_segment_statistics": """
with v as (select distinct vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
s as (select q.vec_id as query_id, c.vec_id as vec_id, list_dot_product(q.e, c.e)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5"""
}
