"""A factorisation machine for document quality.

Features: hashed words weighted by their root frequency and scaled to length 1,
and statistics of the text's structure as bins whose edges are quantiles of the
training sample, and hashed values of the metadata columns that the caller names.
Two features interact by the product of their low-rank
vectors; the sum over all pairs is taken in linear time as half of (the square
of the sum minus the sum of the squares).

The model is fitted on the driver to a bounded sample of labelled rows
(``sample`` rows, those with the smallest hashes of their ids); its size is set
by ``buckets`` and ``rank`` alone, so that its broadcast is bounded.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import LOWER, label_bucket, pieces, table, words

BINS = 12
STATS = 14
_U = np.uint64


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_UPPER, _DIGIT = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789")
_SYMBOL, _STOP, _PUNCT = _class("#*$%&|<>@^~{}[]\\_=+/"), _class(".!?"), _class(",;:'\"()-")


def structure(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Statistics of each text (rows by STATS), and the row and hash of its words."""
    n = len(off) - 1
    h, start, end, row = words(LOWER[data], off)
    size = np.maximum(np.diff(off), 1).astype(float)

    def share(mask: np.ndarray) -> np.ndarray:
        run = np.zeros(len(data) + 1, np.int64)
        np.cumsum(mask, out=run[1:])
        return (run[off[1:]] - run[off[:-1]]) / size

    count = np.bincount(row, minlength=n)
    length = (end - start).astype(float)
    safe = np.maximum(count, 1)
    mean = np.bincount(row, length, n) / safe
    spread = np.sqrt(np.maximum(np.bincount(row, length**2, n) / safe - mean**2, 0))
    # The same word twice in a row, and the share of distinct words among the first of each hash class.
    twin = np.zeros(len(h), bool)
    twin[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    key = (row.astype(_U) << _U(40)) ^ (h >> _U(24))
    _, index, times = np.unique(key, return_index=True, return_counts=True)
    distinct = np.bincount(row[index], minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, row[index], times)
    alone = length == 1
    ascii_upper_start = _UPPER[data[start]] if len(start) else np.empty(0, bool)
    out = np.column_stack(
        [
            np.log1p(count),
            mean,
            spread,
            share(_UPPER[data]),
            share(_DIGIT[data]),
            share(_SYMBOL[data]),
            share(_STOP[data]),
            share(_PUNCT[data]),
            share(data == 10),
            share(data >= 128),
            distinct / safe,
            most / safe,
            np.bincount(row, twin, n) / safe,
            (np.bincount(row, alone, n) + np.bincount(row, ascii_upper_start, n)) / safe,
        ]
    )
    return out, row, h


def word_features(row: np.ndarray, h: np.ndarray, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and weight of each distinct hashed word of each row."""
    key, times = np.unique(row.astype(_U) * _U(buckets) + h % _U(buckets), return_counts=True)
    r = (key // _U(buckets)).astype(np.int64)
    x = np.sqrt(times)
    return r, (key % _U(buckets)).astype(np.int64), x / np.sqrt(np.bincount(r, x * x, n))[r]


def metadata_features(metadata: tuple[str, ...], buckets: int) -> F.Column:
    """Buckets of the values of the named columns; a null is a value too."""
    return F.array(*[F.pmod(F.xxhash64(F.lit(c), F.col(f"`{c}`").cast("string")), F.lit(buckets)) for c in metadata]).cast("array<long>")


def _met(part, k: int) -> np.ndarray:
    """Rows by k buckets from a batch's column ``met``."""
    return part.column(part.schema.get_field_index("met")).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(part.num_rows, k)


@dataclass
class Model:
    buckets: int
    edges: np.ndarray  # of the bins, by statistic
    bias: float
    w: np.ndarray
    v: np.ndarray
    metadata: tuple[str, ...] = ()

    def features(self, stats: np.ndarray, row: np.ndarray, h: np.ndarray, met: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(stats)
        r, f, x = word_features(row, h, n, self.buckets)
        bins = np.column_stack([np.searchsorted(self.edges[k], stats[:, k], "right") + self.buckets + k * BINS for k in range(STATS)])
        if met is not None:
            bins = np.column_stack([bins, met])
        r = np.concatenate([r, np.repeat(np.arange(n), bins.shape[1])])
        order = np.argsort(r, kind="stable")
        return r[order], np.concatenate([f, bins.ravel()])[order], np.concatenate([x, np.full(bins.size, 0.5)])[order]

    def logits(self, r: np.ndarray, f: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        at = np.searchsorted(r, np.arange(n))  # every row has its bins
        xv = x[:, None] * self.v[f]
        s = np.add.reduceat(xv, at, axis=0)
        pairs = (s**2).sum(1) - np.add.reduceat((xv**2).sum(1), at)
        return self.bias + np.add.reduceat(x * self.w[f], at) + 0.5 * pairs


def fit(f: list[np.ndarray], x: list[np.ndarray], y: np.ndarray, model: Model, epochs: int = 6, batch: int = 256, rate: float = 0.08, decay: float = 1e-5, seed: int = 3, patience: int = 3) -> Model:
    """AdaGrad on the logistic loss; f and x hold an array for each row of the
    sample. Of 500 rows and more every tenth is held out: the weights that do best
    on those stay, and after ``patience`` epochs without a better loss it ends."""
    rng = np.random.default_rng(seed)
    gw, gv, gb = np.full(len(model.w), 1e-2), np.full(model.v.shape, 1e-2), 1e-2
    asked = np.arange(len(y)) % 10 == 9 if len(y) >= 500 else np.zeros(len(y), bool)
    held, taught = np.flatnonzero(asked), np.flatnonzero(~asked)
    best, waited = (np.inf, model.w, model.v, model.bias), 0

    def loss() -> float:
        row = np.repeat(np.arange(len(held)), [len(f[i]) for i in held])
        z = model.logits(row, np.concatenate([f[i] for i in held]), np.concatenate([x[i] for i in held]), len(held))
        return float(np.mean(np.logaddexp(0, np.where(y[held] > 0, -z, z))))

    for _ in range(epochs):
        if len(held):
            now = loss()
            best, waited = ((now, model.w.copy(), model.v.copy(), model.bias), 0) if now < best[0] else (best, waited + 1)
            if waited >= patience:
                break
        order = rng.permutation(taught)
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            rows = np.repeat(np.arange(len(pick)), [len(f[i]) for i in pick])
            fs, xs = np.concatenate([f[i] for i in pick]), np.concatenate([x[i] for i in pick])
            first = np.searchsorted(rows, np.arange(len(pick)))
            own, inv = np.unique(fs, return_inverse=True)
            xv = xs[:, None] * model.v[fs]
            s = np.add.reduceat(xv, first, axis=0)
            z = model.bias + np.add.reduceat(xs * model.w[fs], first) + 0.5 * ((s**2).sum(1) - np.add.reduceat((xv**2).sum(1), first))
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) / len(pick)
            by = np.argsort(inv, kind="stable")
            cut = np.searchsorted(inv[by], np.arange(len(own)))
            dw = np.add.reduceat((e[rows] * xs)[by], cut) + decay * model.w[own]
            dv = np.add.reduceat(((e[rows] * xs)[:, None] * (s[rows] - xv))[by], cut, axis=0) + decay * model.v[own]
            gw[own] += dw**2
            gv[own] += dv**2
            gb += e.sum() ** 2
            model.w[own] -= rate * dw / np.sqrt(gw[own])
            model.v[own] -= rate * dv / np.sqrt(gv[own])
            model.bias -= rate * e.sum() / np.sqrt(gb)
    if len(held) and loss() > best[0]:
        _, model.w, model.v, model.bias = best
    return model


def train(docs: DataFrame, labels: DataFrame, learn: F.Column, sample: int = 8_000, buckets: int = 1 << 14, rank: int = 8, seed: int = 5, metadata: tuple[str, ...] = ()) -> Model:
    """Fits ``quality`` on at most ``sample`` of the labelled ids that ``learn``
    admits. Ids with a null or with two different labels are left out; with no
    label of one kind the model answers by the share of the other. ``metadata``
    names columns of docs whose values are features, as they stand: numbers should
    be binned by the caller. Of an id's rows the one with the least text counts;
    texts of any length are read whole; without a labelled row all score 0.5."""
    known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("z"))
    known = known.where("y = z and doc_id is not null").where(learn).select("doc_id", F.col("y").cast("double").alias("y"))
    ids = known.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample).collect()
    model = Model(buckets, np.zeros((STATS, BINS - 1)), 0.0, np.zeros(buckets + STATS * BINS), np.random.default_rng(seed).normal(0, 0.05, (buckets + STATS * BINS, rank)), tuple(metadata))
    y = {r.doc_id: r.y for r in ids}
    if not y:
        return model
    chosen = F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in y], docs.select("doc_id").schema))

    def gather(batches):
        import pyarrow as pa

        for part, data, off in pieces(batches, "text"):
            stats, row, h = structure(data, off)
            n = len(off) - 1
            r, f, x = word_features(row, h, n, buckets)
            cut = np.searchsorted(r, np.arange(n + 1))
            met = _met(part, len(metadata))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(list(stats), pa.list_(pa.float64())), pa.array([np.concatenate([f[a:b], m]).astype(np.int32) for a, b, m in zip(cut, cut[1:], met)], pa.list_(pa.int32())), pa.array([np.concatenate([x[a:b], np.full(len(metadata), 0.5)]).astype(np.float32) for a, b in zip(cut, cut[1:])], pa.list_(pa.float32()))],
                ["doc_id", "stats", "f", "x"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    # One row of an id, however often it is there.
    found = docs.select("doc_id", F.struct(F.coalesce("text", F.lit("")).alias("text"), metadata_features(metadata, buckets).alias("met")).alias("r")).join(chosen, "doc_id")
    found = found.groupBy("doc_id").agg(F.min("r").alias("r")).select("doc_id", "r.text", "r.met")
    got = found.mapInArrow(gather, f"doc_id {kind}, stats array<double>, f array<int>, x array<float>").toArrow()
    if not got.num_rows:
        return model
    ids = got.column("doc_id").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i], i))
    stats = np.array(got.column("stats").to_pylist())[order]
    label = np.array([y[ids[i]] for i in order])
    model.edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T
    fs, xs = got.column("f").combine_chunks(), got.column("x").combine_chunks()
    bins = np.column_stack([np.searchsorted(model.edges[k], stats[:, k], "right") + buckets + k * BINS for k in range(STATS)])
    f = [np.concatenate([fs[i].values.to_numpy(), bins[k]]) for k, i in enumerate(order)]
    x = [np.concatenate([xs[i].values.to_numpy(), np.full(STATS, 0.5)]) for i in order]
    share = np.clip(label.mean(), 1e-3, 1 - 1e-3)
    model.bias = float(np.log(share / (1 - share)))
    if 0 < label.mean() < 1:
        fit(f, x, label, model, epochs=max(6, min(60, 120_000 // len(label))))
    else:
        model.v[:] = 0
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1), one row per row, by text and the metadata columns
    that the model was trained with; null and empty texts are
    scored by their structure and metadata alone. Texts of any length are read
    whole; an empty table gives no rows."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    k = len(model.metadata)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for part, data, off in pieces(batches, "text", 1 << 19):
            stats, row, h = structure(data, off)
            z = sent.value.logits(*sent.value.features(stats, row, h, _met(part, k)), len(off) - 1)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "score"])

    return docs.select("doc_id", "text", metadata_features(model.metadata, model.buckets).alias("met")).mapInArrow(run, f"doc_id {kind}, score double")


def op8_factorisation_machine(spark, sf_dir: str) -> DataFrame:
    # Language, source and id may not be used; the length is, by powers of two.
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.floor(F.log2(F.greatest("n_chars", F.lit(0)) + 1)).alias("length"))
    fold = label_bucket("doc_id") % 3
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"), fold != 1, metadata=("length",))
    return predict(docs, model).select("doc_id", (fold == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
