"""Scores by prediction by partial matching over bytes.

A trie of byte contexts up to ``ORDER`` bytes is counted from all training
texts: every task counts its own (ORDER + 1)-byte grams and Spark adds them up.
The code length of a byte follows method D: in a context seen n times with d
different next bytes, a byte seen k times has (2k - 1) / 2n, and d / 2n is left
for an escape to the context without its first byte, where bytes already ruled
out are excluded from the counts. Below the empty context all bytes not
excluded are equally likely. Byte 0xFF, which UTF-8 never uses, stands before
and after each text, so the scores are probabilities of whole texts.

The trie is pretrained and then fixed, so the code length of a byte depends on
its gram alone: it is computed once for every distinct gram of the texts, and
scoring is a table lookup in numpy, or a join for the rarer grams.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import CRC_TABLE, LOWER, WORD, crc_sql, give_back, kept, label_bucket, materialize, pieces, table, trim, words

ORDER = 5
_U = np.uint64
_EDGE = 0xFF


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the (ORDER + 1)-byte grams, text after text, and where each
    text's first one is. A text of n bytes has n + 1."""
    n = len(off) - 1
    row = np.repeat(np.arange(n), np.diff(off))
    padded = np.full(len(data) + n * (ORDER + 1), _EDGE, np.uint8)
    padded[np.arange(len(data)) + row * (ORDER + 1) + ORDER] = LOWER[data]
    size = len(padded) - ORDER
    code = np.zeros(max(size, 0), _U)
    for k in range(ORDER + 1):
        code = (code << _U(8)) | padded[k : k + size].astype(_U)
    start = off[:-1] + np.arange(n)
    # Grams that would end in a text's leading padding are left out.
    ends = np.diff(off) + 1
    take = np.arange(int(ends.sum())) + np.repeat(start + np.arange(n) * ORDER - (np.cumsum(ends) - ends), ends)
    return code[take], np.concatenate([[0], np.cumsum(ends)])


class Table:
    """Values by 64-bit key: open addressing, looked up for arrays of keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, step: int = 100_000):
        """No value is NaN, which marks free places; ``step`` keys at a time are put."""
        bits = max(4, int(np.ceil(np.log2(2.5 * max(1, len(keys))))))
        self.shift, self.mask = _U(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, _U), np.full(1 << bits, np.nan)
        for lo in range(0, len(keys), step):
            self._put(keys[lo : lo + step], values[lo : lo + step])

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        at = self._home(keys)
        while len(keys):
            free = np.flatnonzero(np.isnan(self.values[at]))
            spots, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.keys[spots], self.values[spots] = keys[put], values[put]
            left = np.ones(len(keys), bool)
            left[put] = False
            keys, values, at = keys[left], values[left], (at[left] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Values; NaN where a key is not in the table."""
        at = self._home(keys)
        out, there = self.values[at], self.keys[at]
        # Free places hold key 0, and NaN, which is what an absent key gets.
        left = np.flatnonzero((there != keys) & ~np.isnan(out))
        out[left] = np.nan
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            found, hit = self.values[at], self.keys[at] == keys[left]
            out[left[hit]] = found[hit]
            on = ~hit & ~np.isnan(found)
            left, at = left[on], at[on]
        return out


@dataclass
class Trie:
    """Sorted grams and their weights, 2 * count - 1, for each context length 0 to
    ORDER; an escape weighs as much as the context has next bytes."""

    keys: list[np.ndarray]
    counts: list[np.ndarray]

    def __post_init__(self):
        self.context, self.n, self.d, self.den, self.new = [], [], [], [], []
        for m, (keys, counts) in enumerate(zip(self.keys, self.counts)):
            ctx, first = np.unique(keys >> _U(8), return_index=True)
            n, d = (np.add.reduceat(x, first) if len(first) else np.empty(0) for x in (counts, np.ones(len(keys))))
            self.context.append(ctx)
            self.n.append(n)
            self.d.append(d)
            if m and len(ctx):
                shorter = keys & _U((1 << (8 * m)) - 1)
                below = self.counts[m - 1][np.searchsorted(self.keys[m - 1], shorter)]
                at = np.searchsorted(self.context[m - 1], ctx & _U((1 << (8 * (m - 1))) - 1))
                new = self.d[m - 1][at] - d
                self.new.append(new)
                self.den.append(self.n[m - 1][at] - np.add.reduceat(below, first) + new)
            else:
                self.new.append(np.empty(0))
                self.den.append(np.empty(0))
        top = len(self.keys) - 1
        at = np.searchsorted(self.context[top], self.keys[top] >> _U(8))
        whole = np.log10(self.counts[top] / (self.n[top][at] + self.d[top][at])) if len(at) else np.empty(0)
        self.seen = Table(self.keys[top], whole)

    def spell(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's last byte, by the escape chain."""
        out = np.zeros(len(codes))
        open_ = np.ones(len(codes), bool)
        above = np.full(len(codes), -1)  # the longer context that was escaped from
        for m in range(len(self.keys) - 1, -1, -1):
            gram = codes & _U((1 << (8 * (m + 1))) - 1)
            ctx, keys = self.context[m], self.keys[m]
            if not len(ctx):
                continue
            at = np.minimum(np.searchsorted(ctx, gram >> _U(8)), len(ctx) - 1)
            known = open_ & (ctx[at] == gram >> _U(8))
            g = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
            hit = known & (keys[g] == gram)
            top = above < 0
            den, new = self.n[m][at] + self.d[m][at], self.d[m][at]
            if m + 1 < len(self.keys) and len(self.den[m + 1]):
                den, new = np.where(top, den, self.den[m + 1][above]), np.where(top, new, self.new[m + 1][above])
            out[hit] += np.log10(self.counts[m][g[hit]] / den[hit])
            miss = known & ~hit
            leave = miss & (new > 0) & (den > 0)  # with nothing new below, the escape is certain
            out[leave] += np.log10(new[leave] / den[leave])
            open_ &= ~hit
            above = np.where(miss, at, -1)
        rest = 256 - (len(self.keys[0]))
        out[open_] -= np.log10(rest) if rest else 0
        return out


def count(docs: DataFrame, flush: int = 1_500_000) -> DataFrame:
    """(kind, key, n) over the texts that ``learn`` marks: 0 words by hash, 1 grams,
    2 texts (key 0). Grams of other texts only are there too, with n = 0."""

    def run(batches):
        import pyarrow as pa

        give_back()
        held = {0: [], 1: []}
        texts = 0

        def merged(kind):
            keys, n = (np.concatenate(x) for x in zip(*held[kind]))
            held[kind] = []
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            n = n[order]
            del order
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            held[kind] = [(keys[first], np.add.reduceat(n, first))]

        def rows(kind):
            for keys, n in held[kind]:
                for at in range(0, len(keys), 100_000):
                    k = keys[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), pa.array(k.view(np.int64)), pa.array(n[at : at + 100_000])], ["kind", "key", "n"])
            held[kind] = []

        for part, data, off in pieces(batches, "text", 1 << 20):
            learn = part.column(1).to_numpy(zero_copy_only=False)
            texts += int(learn.sum())
            word, _, _, row = words(LOWER[data], off)
            gram, cut = grams(data, off)
            taught = np.repeat(learn, np.diff(cut))
            for kind, keys, weight in ((0, word[learn[row]], 1), (1, gram[taught], 1), (1, gram[~taught], 0)):
                if len(keys):
                    keys, n = np.unique(keys, return_counts=True)
                    held[kind].append((keys, n * weight))
                if len(held[kind]) > 8:
                    merged(kind)
                    if len(held[kind][0][0]) > flush:
                        yield from rows(kind)
        for kind in held:
            if held[kind]:
                merged(kind)
                yield from rows(kind)
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([2], pa.int8()), pa.array([0], pa.int64()), pa.array([texts], pa.int64())], ["kind", "key", "n"])

    counted = docs.select("text", "learn").mapInArrow(run, "kind byte, key long, n long")
    return counted.groupBy("kind", "key").agg(F.sum("n").alias("n"))


#: Sixteenths of a power of two that a count reaches.
_STEP = "floor(log2(n + 1) * 16)"


def _frequent(counts: DataFrame, most: int) -> int:
    """The least sixteenth power of two (``_STEP``) such that at most ``most`` keys
    have as many or more; there are some hundred sixteenths, whatever the counts."""
    rows = counts.groupBy(F.expr(_STEP).alias("step")).agg(F.count("*").alias("keys")).collect()
    total, least = 0, max((r.step for r in rows), default=0) + 1
    for r in sorted(rows, key=lambda r: -r.step):
        total += r.keys
        if total > most:
            break
        least = r.step
    return least


def _level(keys: np.ndarray, n: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted grams of context length m, and their counts, from longer ones."""
    kinds, inverse = np.unique(keys & _U((1 << (8 * (m + 1))) - 1), return_inverse=True)
    return kinds, np.bincount(inverse, n, len(kinds))


def fit(counts: DataFrame, chunk: int = 500_000) -> DataFrame:
    """(key, n, value): the log10 probability of the last byte of every counted
    gram, by the trie of all grams with n > 0.

    All contexts of a gram but the three shortest end in the same three bytes, so
    the trie falls into parts by these bytes, which are built and asked one after
    another; a part has at most 2^24 grams (two more bytes and the next). Contexts
    of up to two bytes go to every task: 2^24 grams and few more if all bytes
    occurred, some hundred thousand in text.
    """
    spark = counts.sparkSession
    known = counts.where("kind = 1").select("key", "n")
    short = known.where("n > 0").groupBy(F.col("key").bitwiseAND(F.lit(0xFFFFFF)).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    three = short.column("key").to_numpy().view(_U), short.column("n").to_numpy()
    sent = spark.sparkContext.broadcast([_level(*three, m) for m in (0, 1, 2)])

    def run(batches):
        import pyarrow as pa

        give_back()

        def answers(parts):
            key, n = (np.concatenate(x) for x in zip(*parts))
            key = key.view(_U)
            some = n > 0
            levels = sent.value + [_level(key[some], n[some], m) for m in range(3, ORDER + 1)]
            trie = Trie([k for k, _ in levels], [2 * c.astype(float) - 1 for _, c in levels])
            value = trie.seen(key)
            miss = np.flatnonzero(np.isnan(value))
            if len(miss):
                value[miss] = trie.spell(key[miss])
            for at in range(0, len(key), 100_000):
                to = at + 100_000
                yield pa.RecordBatch.from_arrays([pa.array(key[at:to].view(np.int64)), pa.array(n[at:to]), pa.array(value[at:to])], ["key", "n", "value"])

        parts, size = [], 0
        for batch in batches:
            near, key, n = (batch.column(i).to_numpy() for i in range(3))
            if not len(near):
                continue
            # Rows up to the last change of the three bytes complete their part.
            cut = 0
            if size + len(near) > chunk:
                edge = np.flatnonzero(near[1:] != near[:-1]) + 1
                cut = edge[-1] if len(edge) else 0
                if cut or (parts and last != near[0]):
                    yield from answers(parts + [(key[:cut], n[:cut])])
                    parts, size = [], 0
            parts.append((key[cut:], n[cut:]))
            size += len(near) - cut
            last = near[-1]
        if parts:
            yield from answers(parts)

    near = F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFFFF)).alias("near")
    parted = known.select(near, "key", "n").repartition("near").sortWithinPartitions("near")
    return parted.mapInArrow(run, "key long, n long, value double")


def score(docs: DataFrame, learn: F.Column, most_words: int = 400_000, most_grams: int = 1_600_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, one
    row per row; the model learns from the rows that ``learn`` admits.

    The base is a smoothed unigram model of words and one end per text, exact
    for every word: the ``most_words`` most frequent ones are broadcast, the
    others' occurrences are joined to their counts. So it is with the trie's
    grams, of which the ``most_grams`` most frequent are broadcast. Both bounds hold
    whatever the counts are. Null and empty texts consist
    of their end. Repeated rows count each, in training too. With no training
    text every byte has probability 1/256 and the base is 0. Texts of any length
    are scored whole; an empty table gives no rows.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    spark = docs.sparkSession
    counts = materialize(count(docs), "ppm-counts")
    spelt = materialize(fit(counts), "ppm-grams")
    least = _frequent(spelt, most_grams)
    often = spelt.where(f"{_STEP} >= {least}").select("key", "value").toArrow()
    often = often.column("key").to_numpy().view(_U), often.column("value").to_numpy()
    texts = next((r.n for r in counts.where("kind = 2").collect()), 0)
    vocabulary = counts.where("kind = 0")
    size = vocabulary.agg(F.count("*").alias("v"), F.sum("n").alias("n")).first()
    total, distinct = (size.n or 0) + texts, size.v + (1 if texts else 0)
    frequent = vocabulary.where(f"{_STEP} >= {_frequent(vocabulary, most_words)}").select("key", "n").toArrow()
    words_ = frequent.column("key").to_numpy().view(_U), frequent.column("n").to_numpy()
    end = float(np.log10(texts + 0.1))
    sent = spark.sparkContext.broadcast((*often, *words_))
    mark = uuid.uuid4().hex
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        spell, known = kept(mark, lambda: _tables(sent))
        uid = TaskContext.get().partitionId() << 36
        for part, data, off in pieces(batches, "text", 1 << 19):
            n = len(off) - 1
            h, _, _, row = words(LOWER[data], off)
            value = known(h)
            rare = np.flatnonzero(np.isnan(value))
            value[rare] = 0
            codes, cut = grams(data, off)
            length = spell(codes)
            far = np.flatnonzero(np.isnan(length))
            length[far] = 0
            ids = np.arange(n) + uid
            uid += n
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(ids), pa.nulls(n, pa.int8()), pa.nulls(n, pa.int64()), pa.array(np.bincount(row, minlength=n) + 1), pa.array(np.bincount(row, minlength=n) - np.bincount(row[rare], minlength=n) + (1 if texts else 0)), pa.array(np.bincount(row, value, n) + end), pa.array(np.add.reduceat(length, cut[:-1]))],
                _FIELDS,
            )
            # The rare words and grams: distinct ones of each row, with how often they stand there.
            for kind, r, w in ((0, row[rare], h[rare]), (1, np.searchsorted(cut, far, "right") - 1, codes[far])):
                order = np.lexsort((w, r))
                r, w = r[order], w[order]
                if len(r):
                    first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (w[1:] != w[:-1])]))
                    times = np.diff(np.concatenate([first, [len(r)]]))
                    k = len(first)
                    yield pa.RecordBatch.from_arrays([pa.nulls(k, part.column(0).type), pa.nulls(k, pa.bool_()), pa.array(ids[r[first]]), pa.array(np.full(k, kind, np.int8)), pa.array(w[first].view(np.int64)), pa.array(times), pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()), pa.nulls(k, pa.float64())], _FIELDS)

    made = materialize(docs.mapInArrow(run, f"doc_id {kind}, learn boolean, uid long, kind byte, w long, n long, known long, head double, score double"), "ppm-scores")
    sought = vocabulary.select("kind", F.col("key").alias("w"), F.log10(F.col("n") + 0.1).alias("value")).union(spelt.where(f"{_STEP} < {least}").select(F.lit(1).cast("byte"), "key", "value"))
    rare = made.where("w is not null").select("uid", "kind", "w", "n").join(sought, ["kind", "w"], "left")
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x).otherwise(0))
    rare = rare.groupBy("uid").agg(of(0, F.col("n") * F.coalesce("value", F.lit(-1.0))).alias("tail"), of(0, F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("more"), of(1, F.col("n") * F.col("value")).alias("spelt"))
    scale = float(np.log10(total + 0.1 * (distinct + 1)))
    out = made.where("w is null").join(rare, "uid", "left")
    base = F.col("head") + F.coalesce("tail", F.lit(0.0)) - F.col("n") * F.lit(scale)
    return out.select("doc_id", (~F.col("learn")).alias("held_out"), F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("spelt", F.lit(0.0))).alias("score"))


def _tables(sent) -> tuple[Table, Table]:
    """The tables of a worker, of a broadcast that it then holds no more."""
    trim()
    path = getattr(sent, "_path", None)  # none where Spark encrypts what it sends
    gram, value, word, n = sent.load_from_path(path) if path else sent.value
    out = Table(gram, value), Table(word, np.log10(n + 0.1))
    del gram, value, word, n
    trim()
    return out


_FIELDS = ["doc_id", "learn", "uid", "kind", "w", "n", "known", "head", "score"]


def op3_ppm_score(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), label_bucket("doc_id") % 10 != 0)


def base3_ppm_score(spark, sf_dir: str) -> DataFrame:
    """What SQL can say of op3_ppm_score: all but the model's own score."""
    return op3_ppm_score(spark, sf_dir).drop("score").withColumn("base_score", F.round("base_score", 3))


ORACLE = {
    "base3_ppm_score": f"""
with {CRC_TABLE},
x as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as ws,
  coalesce({crc_sql('doc_id::varchar')} % 10 = 0, true) as held_out from documents, c),
y as (select row_number() over () as rid, doc_id, held_out, list_append(ws, chr(10)) as tokens from x),
t as (select rid, held_out, unnest(tokens) as token from y),
k as (select token, count(*) as n from t where not held_out group by token),
z as (select sum(n)::bigint as total, count(*) as distinct_ from k),
s as (select rid, count(*) as n_tokens, count(n) as n_known, sum(log10((coalesce(n, 0) + 0.1::double) / (total + 0.1::double * (distinct_ + 1)))) as score
  from t left join k using (token), z group by rid)
select doc_id, held_out, n_tokens, n_known, (select total from z) as train_tokens, round(score, 3) as base_score from y join s using (rid)"""
}
