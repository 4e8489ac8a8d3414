"""What the text operators share: scratch tables, Arrow batches as numpy
buffers, word hashing and connected components.

Conventions that hold for every operator here:

* a null text is an empty text; texts are handled as UTF-8 bytes;
* only the named columns of an input are read, so further columns may have any
  name;
* an empty table gives an empty result with the same schema.
"""

from __future__ import annotations

import contextlib
import ctypes
import threading
import time
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.scratch import SCRATCH, delete, drop_scratch, new_path, shared_dir  # noqa: F401

WORD = r"[^\x20\x09-\x0D]+"
_U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of what a scratch table is made from, to one of its files.
FILE_BYTES = 8 << 20


def _dealt(df: DataFrame) -> DataFrame:
    """df, its rows dealt to the tasks of a last stage where what df reads is
    little for so many shuffle partitions: what computes the rows stays as it is,
    and the table gets a file for each of those tasks.

    Without Hadoop's native library a local file system starts a process for the
    permissions of each file and of each checksum file. Thousands of small files
    cost that many starts, and a process that starts holds its executor's memory.
    """
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    read = sum(int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size()))
    few = max(2 * spark.sparkContext.defaultParallelism, -(-read // FILE_BYTES))
    return df.repartition(few) if 4 * few <= int(spark.conf.get("spark.sql.shuffle.partitions")) else df


def materialize(df: DataFrame, label: str = "part") -> DataFrame:
    """Cuts lineage: writes df as a table in the shared folder and rereads it.
    ``release`` deletes the table; what is left goes when the process ends."""
    spark = df.sparkSession
    path = new_path(spark, label)
    _dealt(df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gneiss_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Deletes what ``materialize`` wrote for these frames. For tables that all
    readers have been written from: those need no file of them, even where an
    executor is lost."""
    for frame in frames:
        delete(frame._gneiss_path)


def scratch() -> set[str]:
    """The tables of this thread that are there now."""
    return {p for p, (_, maker) in SCRATCH.items() if maker == threading.get_ident()}


def drop_since(there: set[str], *keep: DataFrame) -> None:
    """Deletes the tables that this thread has made since ``there`` was taken, but
    those of the frames to keep."""
    kept = {frame._gneiss_path for frame in keep}
    for path in scratch() - there - kept:
        delete(path)


def label_bucket(doc_id) -> F.Column:
    """crc32 of the decimal doc_id; folds and hold-outs are its remainders."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


#: SQL that holds the table of CRC-32 as the only column, crc, of c.
CRC_TABLE = "c as (select [list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) for i in range(256)] as crc)"


def crc_sql(text: str) -> str:
    """SQL for the CRC-32 of a string's UTF-8 bytes, where c is in scope."""
    byte = "16 * instr('123456789ABCDEF', p[1]) + instr('123456789ABCDEF', p[2])"
    return f"xor(list_reduce(list_prepend(4294967295, [{byte} for p in regexp_extract_all(hex({text}), '..')]), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295)"


# Arrow batches as numpy buffers.


def buffer_of(array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64, first 0) of an Arrow string or binary array."""
    import pyarrow as pa

    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    n = len(array)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(offsets, kind)[array.offset : array.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(batches: Iterator, column: str, most: int = 1 << 20) -> Iterator[tuple]:
    """(slice of the batch, bytes, offsets) of at most ``most`` bytes of text, or
    one row, and of at most 2^15 rows: bounds the memory of what is computed from
    it, and the numbers of its rows. What a task has freed goes back to the system
    at its end, as an idle worker would hold it beside the next stages."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, off = buffer_of(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = min(max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1), at + (1 << 15))
            yield batch.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to
        del batch, data, off
    trim()


# What a worker makes once for many tasks.

_KEPT: dict[str, list] = {}
IDLE = 10.0


def kept(mark: str, make):
    """What ``make`` gives, made once in a worker for all tasks that ask by the
    same mark. One thing is kept, until no task has asked for it for ``IDLE``
    seconds: its memory is then the next stage's. Functions that Spark pickles
    must reach this one by import, as their own globals are copied."""
    found = _KEPT.get(mark)
    if found is None:
        _KEPT.clear()
        made, one = make(), object()
        found = _KEPT[mark] = [time.monotonic(), made, one]
        threading.Thread(target=_forget_idle, args=(mark, one), daemon=True).start()
    found[0] = time.monotonic()
    return found[1]


def give_back() -> None:
    """Forgets what is kept: for a stage that has no use for it."""
    _KEPT.clear()
    trim()


def trim() -> None:
    """Memory that this process has freed goes back to the system."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # of the GNU C library only
        ctypes.CDLL(None).malloc_trim(0)


def _forget_idle(mark: str, one: object) -> None:
    """Holds nothing of what it waits to forget, so that trim() finds it freed."""
    while (found := _KEPT.get(mark)) and found[2] is one:
        left = found[0] + IDLE - time.monotonic()
        del found
        if left <= 0:
            _KEPT.pop(mark, None)
            trim()
            return
        time.sleep(left)


# Hashing. Polynomials modulo 2^64 over a random byte table, then mixed: any
# substring's value comes from two prefix sums.

_RNG = np.random.RandomState(20240917)
BYTE_CODE = _RNG.randint(1, 2**62, 256).astype(_U) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPAN = 1 << 20
_POWERS: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(_SPAN + 4096, n)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(31))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(29)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(32)
    return x


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, _U)
    np.cumsum(BYTE_CODE[data] * up[: len(data)], out=out[1:])
    return out


def spans(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the byte strings from first to last, which are in order."""
    out = np.empty(len(first), _U)
    at = 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(last, first[at] + _SPAN, "right")))
        lo, hi = first[at], last[to - 1]
        sums = prefix_sums(data[lo:hi])
        _, down = powers(hi - lo)
        s, e = first[at:to] - lo, last[at:to] - lo
        out[at:to] = (sums[e] - sums[s]) * down[s]
        at = to
    return mix(out ^ ((last - first).astype(_U) << _U(40)))


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start, end and row of each word; rows are the spans of off."""
    if not len(data):
        none = np.empty(0, np.int64)
        return np.empty(0, _U), none, none, none
    inside = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    first, last = np.flatnonzero(start), np.flatnonzero(end) + 1
    row = np.searchsorted(off, first, "right") - 1
    out = spans(data, first, last)
    return out, first, last, row


def windows(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each n-word window that lies in one row, and its first word."""
    if len(hashes) < n:
        return np.empty(0, _U), np.empty(0, np.int64)
    m = len(hashes) - n + 1
    out = np.zeros(m, _U)
    for k in range(n):
        out = out * _U(0xD6E8FEB86659FD93) + hashes[k : k + m]
        out ^= out >> _U(32)
    whole = np.flatnonzero(row[:m] == row[n - 1 :])
    return mix(out[whole]), whole


# Connected components without the driver: large-star and small-star rounds.


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of the undirected edges (a, b): the smallest node that
    can be reached. Nodes without an edge are not in the result."""
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(rounds):
        both = now.select("a", "b").union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        before, now = now, materialize(small.where("b <> m").select("b", "m").union(small.select("a", "m")).toDF("a", "b").distinct(), "edges")
        release(before)
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark:
            return now.toDF("node", "component").union(now.select(F.col("b").alias("node"), F.col("b")).distinct()).distinct()
        mark = new
    raise RuntimeError("components did not settle")
