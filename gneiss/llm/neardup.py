"""MinHash near-duplicates by tensored banding.

Two small collections of half-keys are computed, each half-key of a few
minhashes; the tables' keys are all pairs of one half-key of either, so that
m + m half-keys serve m * m tables. Documents that share no half-key of the
first collection with any other leave before pairs are formed.

Texts of equal shingle sets are one class from the start. Within a table's
bucket the members meet two pivots first: the one that meets most others in all
tables (the original of a group of copies, as a rule) and one by hash. What a
verified link has joined needs no further test. Of the pairs that still lie in
different components, those are tested that a bound allows. Two sets with a
common pivot that share no shingle beside the pivot's differ in all of their
others and in as many of the pivot's as the numbers that they lack of it differ
by; those that do share one meet on it. Sets with different pivots differ at
least in the shingles that only one document has. The bound is taken between
cells of members with equal numbers, so that a large group of copies isn't
paired out. A pair is tested by its minhashes and then on the full
sets.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.llm.common import LOWER, components, drop_since, materialize, mix, pieces, scratch, table, windows, words

PER_HALF = 3
#: Members from which a component counts as one kind of its own: pairs within it
#: need no test. It changes how cells are told apart, not which pairs are tested.
BIG = 8
_U = np.uint64


def half_keys(similarity: float, miss: float = 5e-5) -> int:
    """How many half-keys each collection needs so that a pair at the threshold
    shares no table with a probability of ``miss`` at most."""
    return math.ceil(math.log(miss / 2) / math.log(1 - similarity**PER_HALF))


def shingles(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash (48 bits) of the distinct shingles of each row, in order.
    With fewer words than ``size`` the whole sequence is the only one."""
    h, _, _, row = words(LOWER[data], off)
    n = len(off) - 1
    value, first = windows(h, row, size)
    rows = row[first]
    count = np.bincount(row, minlength=n)
    for k in range(1, size):
        few = np.flatnonzero((count == k)[row])
        if len(few):
            v, at = windows(h[few], row[few], k)
            value, rows = np.concatenate([value, mix(v + _U(k))]), np.concatenate([rows, row[few][at]])
    key = np.unique((rows.astype(_U) << _U(48)) | (value >> _U(16)))
    return (key >> _U(48)).astype(np.int64), key & _U((1 << 48) - 1)


def sketch(docs: DataFrame, size: int, halves: int) -> DataFrame:
    """doc_id, n, s1, s2 (fingerprint of the set), a and b (half-keys), and sig,
    a byte of each minhash."""
    n_hash = 2 * halves * PER_HALF
    factor = _factors(n_hash)

    def run(batches):
        import pyarrow as pa

        for part, data, off in pieces(batches, "text"):
            n = len(off) - 1
            row, h = shingles(data, off, size)
            count = np.bincount(row, minlength=n)
            cut = np.concatenate([[0], np.cumsum(count)])
            prints = np.zeros((n, 2), np.int64)
            for i in np.flatnonzero(count):
                raw = h[cut[i] : cut[i + 1]].tobytes()
                prints[i] = np.frombuffer(xxhash.xxh3_128_digest(raw), np.int64)
            some = np.flatnonzero(count)
            least = np.zeros((n, n_hash), _U)
            if len(some):
                at = cut[:-1][some]
                spread_out = mix(h)
                for k in range(n_hash):
                    least[some, k] = np.minimum.reduceat((spread_out * factor[k]) >> _U(24), at)
            keys = least.reshape(n, 2 * halves, PER_HALF)
            key = np.broadcast_to(np.arange(2 * halves, dtype=_U) * _U(0x9E3779B97F4A7C15), keys.shape[:2]).copy()
            for j in range(PER_HALF):
                key = mix(key ^ keys[:, :, j])
            key = key.view(np.int64)
            lists = pa.FixedSizeListArray.from_arrays
            a, b = (lists(pa.array(np.ascontiguousarray(x).ravel()), halves).cast(pa.list_(pa.int64())) for x in (key[:, :halves], key[:, halves:]))
            sig = [r.tobytes() for r in (mix(least) & _U(255)).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count.astype(np.int64)), pa.array(prints[:, 0]), pa.array(prints[:, 1]), a, b, pa.array(sig, pa.binary())], ["doc_id", "n", "s1", "s2", "a", "b", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, s1 long, s2 long, a array<long>, b array<long>, sig binary")


def _factors(n: int) -> np.ndarray:
    return np.random.RandomState(977).randint(1, 2**62, n).astype(_U) * _U(2) + _U(1)


def _alike(pairs: DataFrame, sigs: DataFrame, similarity: float, n_hash: int) -> DataFrame:
    """Pairs (a, b) whose minhashes don't rule the similarity out: fewer equal
    ones than six standard deviations under the expectation."""
    least = n_hash * similarity - 6 * math.sqrt(n_hash * similarity * (1 - similarity))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, n_hash) for k in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((x == y).sum(1) >= least))

    joined = pairs.join(sigs.toDF("a", "sa"), "a").join(sigs.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    return joined.mapInArrow(run, "a long, b long")


def _common(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, na, nb, i) of pairs: set sizes and the size of the intersection."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = np.zeros((batch.num_rows, 3), np.int64)
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = (np.frombuffer(v.as_buffer(), np.int64) for v in (x, y))
                both = np.sort(np.concatenate([x, y]))
                out[k] = len(x), len(y), (both[1:] == both[:-1]).sum()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(np.ascontiguousarray(out[:, j])) for j in range(3))], ["a", "b", "na", "nb", "i"])

    joined = pairs.join(sets.toDF("a", "xa"), "a").join(sets.toDF("b", "xb"), "b").select("a", "b", "xa", "xb")
    return joined.mapInArrow(run, "a long, b long, na long, nb long, i long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, one row per row.

    Words are cut at ASCII white space, A-Z are lower-cased; a document is the
    set of its distinct ``size``-word shingles, of its whole word sequence if it
    has fewer words; without words or text it is empty and linked to nothing.
    Documents are linked whose sets share ``percent`` hundredths of their union;
    component_id is the smallest doc_id of a connected component. Equal sets
    always link. A doc_id names one text: repeated rows share one result. A row
    without doc_id gets no component and is kept. No pair, bucket or partner is capped.
    Texts are read whole, whatever their length. An empty table gives no rows.
    doc_ids are integers; another type raises TypeError.
    """
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("near_duplicates takes integer doc_ids")
    similarity = percent / 100
    halves, there = half_keys(similarity), scratch()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialize(sketch(docs, size, halves), "sketch")
    named = rows.where("n > 0 and doc_id is not null")
    classes = named.groupBy("s1", "s2").agg(F.min("doc_id").alias("c"))
    whole = named.join(classes.withColumnsRenamed({"s1": "t1", "s2": "t2"}), F.col("doc_id") == F.col("c"))
    whole = materialize(whole.where("s1 = t1 and s2 = t2").select("c", "n", "s1", "s2", "a", "b", "sig").dropDuplicates(["s1", "s2"]), "classes")
    # First collection: half-keys that no other class has lead nowhere.
    first = whole.select("c", "n", "b", F.explode("a").alias("ka"))
    shared = first.groupBy("ka").agg(F.count("*").alias("m")).where("m > 1").select("ka")
    met = materialize(first.join(shared, "ka").select("c", "n", "b", "ka"), "half-met")
    tabled = met.select("c", "n", "ka", F.explode("b").alias("kb")).select("c", "n", F.xxhash64("ka", "kb").alias("k"))
    shared = tabled.groupBy("k").agg(F.count("*").alias("m")).where("m > 1").select("k")
    buckets = materialize(tabled.join(shared, "k").select("k", "c", "n"), "buckets")
    # The sets of all classes that meet another one in a table.
    wanted = buckets.select("c").distinct()
    texts = docs.join(wanted.hint("shuffle_hash"), F.col("doc_id") == F.col("c"), "left_semi")
    sets = materialize(_sets(texts, size).dropDuplicates(["doc_id"]) if _repeats(docs) else _sets(texts, size), "sets")
    sigs = whole.select("c", "sig")
    n_hash = 2 * halves * PER_HALF
    ratio = f"100 * least(n, pn) >= {percent} * greatest(n, pn)"
    # Two pivots of each bucket; each member tries the one that it meets most often.
    sizes = buckets.groupBy("k").agg(F.count("*").alias("m"))
    weight = buckets.join(sizes, "k").groupBy("c").agg(F.sum("m").alias("weight"))
    weighed = materialize(buckets.join(weight, "c").select("k", "c", "n", "weight"), "weighed")
    ranks = {"first": F.struct(-F.col("weight"), "c", "n"), "second": F.struct(F.xxhash64("c"), "c", "n")}
    picks = weighed.groupBy("k").agg(*[F.min(order).alias(name) for name, order in ranks.items()])
    picks = weighed.join(picks, "k").select("k", "c", "n", *[F.col(f"{r}.{f}").alias(f"{r}_{f}") for r in ranks for f in ("c", "n")], F.expr("-first.col1").alias("heavy"))
    picks = materialize(picks, "picks")
    tries = []
    for r in ranks:
        pairs = picks.select("c", "n", F.col(f"{r}_c").alias("p"), F.col(f"{r}_n").alias("pn"), "heavy").where(ratio).where("c <> p")
        pairs = pairs.groupBy("c", "p").agg(F.count("*").alias("m"), F.max("heavy").alias("heavy"))
        tries.append(pairs.groupBy("c").agg(F.max_by("p", F.struct("m", "p")).alias("p"), F.max_by("p", F.struct("heavy", "p")).alias("main")))
    tries = [materialize(tries[0], "pivots"), tries[1]]
    main = tries[0].select("c", F.col("main").alias("p"))
    tried = main.union(tries[0].select("c", "p")).union(tries[1].select("c", "p"))
    tried = tried.select(F.greatest("c", "p").alias("a"), F.least("c", "p").alias("b")).distinct()
    tried = materialize(_common(_alike(tried, sigs, similarity, n_hash), sets), "tried")
    linked = F.expr(f"100 * i >= {percent} * (na + nb - i)")
    links = tried.where(linked).select("a", "b")
    comp = components(links)
    # The rest: pairs of a bucket in different components, not tested so far.
    held = buckets.join(comp.withColumnRenamed("node", "c"), "c", "left").withColumn("g", F.coalesce("component", "c"))
    mixed = held.groupBy("k").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi").select("k")
    held = materialize(held.join(mixed, "k").select("k", "c", "n", "g"), "mixed")
    own = held.select("c").distinct()
    # Pivots are counted among them: what is in a pivot too is then not alone.
    counted = own.union(own.join(main, "c").select("p")).distinct().toDF("doc_id")
    alone = _alone(sets.join(counted.hint("shuffle_hash"), "doc_id", "left_semi"))
    lacks = tried.selectExpr("a AS c", "b AS p", "nb - i AS lacks", "na - i AS others").union(tried.selectExpr("b", "a", "na - i", "nb - i"))
    lacks = own.join(main, "c").join(lacks, ["c", "p"]).select("c", F.col("p").alias("pivot"), "lacks", "others")
    lacks = materialize(lacks, "lacks")
    # Written on its own: a join with the large ones need not deal the members out.
    big = comp.groupBy("component").agg(F.count("*").alias("m")).where(F.col("m") >= BIG).select(F.col("component").alias("g"), F.lit(True).alias("big"))
    big = materialize(big, "big")
    about = own.join(lacks, "c", "left").join(alone, "c", "left")
    about = about.select("c", F.coalesce("pivot", "c").alias("pivot"), *[F.coalesce(x, F.lit(0)).alias(x) for x in ("lacks", "others", "alone")])
    held = held.join(big, "g", "left").withColumn("kind", F.when(F.col("big"), F.col("g")))
    held = materialize(held.join(about, "c").withColumn("cell", F.xxhash64("kind", "pivot", "n", "lacks", "others", "alone")), "held")
    cells = materialize(held.groupBy("k", "cell").agg(*[F.first(x).alias(x) for x in ("kind", "pivot", "n", "lacks", "others", "alone")]), "cells")
    # Nothing is tested within a kind: the one with most of a bucket's cells is met
    # by the others only, so that a large group of copies costs its cells once.
    major = cells.where("kind is not null").groupBy("k", "kind").agg(F.count("*").alias("m"))
    major = major.groupBy("k").agg(F.max_by("kind", F.struct("m", "kind")).alias("major"))
    cells = cells.join(major, "k", "left").withColumn("main", F.coalesce(F.col("kind") == F.col("major"), F.lit(False)))
    other = cells.where("not main").select("k", *[F.col(x).alias(f"p_{x}") for x in ("cell", "kind", "pivot", "n", "lacks", "others", "alone")])
    differ = "case when pivot = p_pivot then others + p_others + abs(lacks - p_lacks) else alone + p_alone end"
    near = cells.join(other, "k").where("(main or cell <= p_cell) and not coalesce(kind = p_kind, false)")
    near = near.where(f"({differ}) * {100 + percent} <= {100 - percent} * (n + p_n)").where(ratio.replace("pn", "p_n"))
    near = near.select("k", "cell", "p_cell")
    some = near.join(held.select("k", "cell", "c", "g"), ["k", "cell"])
    rest = some.join(held.select("k", F.col("cell").alias("p_cell"), F.col("c").alias("p"), F.col("g").alias("pg")), ["k", "p_cell"]).where("g <> pg")
    rest = rest.select("c", "p")
    # Members with a common pivot that share a shingle which it has not.
    known = held.select("c", "n", "g").distinct()
    beside = _beside(lacks.select("c", F.col("pivot").alias("p")), sets).join(known, "c")
    mixed = beside.groupBy("p", "h").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi").select("p", "h")
    beside = materialize(beside.join(mixed, ["p", "h"]), "beside")
    major = beside.groupBy("p", "h", "g").agg(F.count("*").alias("m")).groupBy("p", "h").agg(F.max_by("g", F.struct("m", "g")).alias("major"))
    marked = beside.join(major, ["p", "h"])
    peers = marked.where("g <> major").select("p", "h", F.col("c").alias("q"), F.col("n").alias("pn"), F.col("g").alias("pg"))
    rest = rest.union(marked.join(peers, ["p", "h"]).where("g <> pg and (g = major or c > q)").where(ratio).select("c", "q"))
    rest = rest.select(F.greatest("c", "p").alias("a"), F.least("c", "p").alias("b")).distinct().join(tried.select("a", "b"), ["a", "b"], "left_anti")
    more = materialize(_common(_alike(rest, sigs, similarity, n_hash), sets), "links").where(linked).select("a", "b")
    comp = materialize(components(links.union(more)), "components")
    drop_since(there, rows, whole, comp)
    named = whole.select("s1", "s2", "c").join(comp.withColumnRenamed("node", "c"), "c", "left")
    named = named.select("s1", "s2", F.coalesce("component", "c").alias("component_id"))
    out = rows.select("doc_id", "n", "s1", "s2").join(named, ["s1", "s2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _beside(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(c, p, h): the shingles of c that its pivot p has not."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                found = [np.setdiff1d(*(np.frombuffer(v.as_buffer(), np.int64) for v in both), assume_unique=True) for both in zip(part.column(2), part.column(3))]
                size = [len(x) for x in found]
                c, p = (np.repeat(part.column(k).to_numpy(), size) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(p), pa.array(np.concatenate(found))], ["c", "p", "h"])

    joined = pairs.join(sets.toDF("c", "xc"), "c").join(sets.toDF("p", "xp"), "p").select("c", "p", "xc", "xp")
    return joined.mapInArrow(run, "c long, p long, h long")


def _alone(sets: DataFrame) -> DataFrame:
    """(c, alone): how many of a set's shingles no other of the sets has."""

    def spell(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                sets = [np.frombuffer(v.as_buffer(), np.int64) for v in part.column(1)]
                own = np.repeat(part.column(0).to_numpy(), [len(x) for x in sets])
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.concatenate(sets))], ["c", "h"])

    spelt = sets.select("doc_id", "set").mapInArrow(spell, "c long, h long")
    single = spelt.groupBy("h").agg(F.min("c").alias("c"), F.count("*").alias("m")).where("m = 1")
    return single.groupBy("c").agg(F.count("*").alias("alone"))


def _repeats(docs: DataFrame) -> bool:
    return docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").limit(1).count() > 0


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for part, data, off in pieces(batches, "text"):
            row, h = shingles(data, off, size)
            cut = np.searchsorted(row, np.arange(len(off)))
            sets = [h[a:b].tobytes() for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["doc_id", "set"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, set binary")


def op10_tensored_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


ORACLE = {
    "op10_tensored_minhash": r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (
  select doc_id, case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
    else list_distinct([array_to_string(ws[i:i + 2], ' ') for i in range(1, len(ws) - 1)]) end as sh from w),
n as (select doc_id, len(sh)::bigint as n from s),
e as (select doc_id, unnest(sh) as x from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as i from e a join e b on a.x = b.x and a.doc_id <> b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 85 * (x.n + y.n - i)),
r as (select doc_id as a, doc_id as b from n union select r.a, l.b from r join l on r.b = l.a),
c as (select a as doc_id, min(b) as component_id from r group by a)
select doc_id, n as n_shingles, component_id, doc_id = component_id as kept from n join c using (doc_id)"""
}
