"""Traversals by cursor.

A page is its query run again with an offset, so all pages of a result would cost
as many runs as there are pages. A traversal that goes on is stored instead: the
query runs once more, its whole result is written in its order to files of
``ROWS`` rows, and each further page is read from the file that holds it.
"""

from __future__ import annotations

import datetime as dt
import re
import time
from bisect import bisect_right
from collections import OrderedDict
from decimal import Decimal
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions import encode
from gneiss.scratch import delete, new_path

#: Rows of a file, which the driver holds of a traversal.
ROWS = 5_000
#: Pages in a row that are run before the result is stored.
RUN = 8
#: Traversals that are known, the last used ones, and the seconds each may rest.
MOST, IDLE = 16, 600.0
_PLAIN = (type(None), str, bytes, int, float, Decimal, dt.date, dt.time, dt.timedelta)


class Stored:
    """A result in its order."""

    def __init__(self, df: DataFrame):
        self.spark, self.shown = df.sparkSession, df.schema
        numbered = df.toDF(*(f"c{i}" for i in range(len(df.columns))))  # names may be twice there
        self.schema, self.path = numbered.schema, new_path(self.spark, "walk")
        try:
            numbered.write.option("maxRecordsPerFile", ROWS).parquet(self.path)
            files = self.spark.read.schema(self.schema).parquet(self.path).groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count("*").alias("n")).collect()
        except BaseException:
            self.drop()
            raise
        files.sort(key=lambda f: [int(x) for x in re.search(r"^part-(\d+)-.*-c(\d+)\.", f.name).groups()])
        self.names = [f.name for f in files]
        self.starts = list(accumulate((f.n for f in files), initial=0))
        self.held: tuple[int, list[dict]] = (-1, [])

    def _file(self, k: int) -> list[dict]:
        found = self.spark.read.schema(self.schema).parquet(f"{self.path}/{self.names[k]}").select("*", "_metadata.row_index").collect()
        return encode.named(sorted(found, key=lambda r: r[-1]), self.shown)

    def rows(self, at: int, most: int) -> list[dict]:
        out = []
        while len(out) < most:
            k = bisect_right(self.starts, at + len(out)) - 1
            if k >= len(self.names):
                break
            if self.held[0] != k:
                self.held = k, self._file(k)
            lo = at + len(out) - self.starts[k]
            out += self.held[1][lo : lo + most - len(out)]
        return out

    def drop(self) -> None:
        delete(self.path)


class Walk:
    """A traversal: where its next page begins, and the pages run so far."""

    def __init__(self):
        self.at, self.pages, self.used = 0, 0, 0.0
        self.stored: Stored | None = None
        self.runs = False  # its result can't be stored

    def drop(self) -> None:
        if self.stored is not None:
            self.stored.drop()
            self.stored = None


class Walks:
    """The traversals of a gateway. A page belongs to one if it begins where the
    page before ended; any other page is run, and begins a traversal."""

    def __init__(self):
        self.known: OrderedDict[tuple, Walk] = OrderedDict()

    @staticmethod
    def key(query: str, database: str, args: dict | None) -> tuple | None:
        """None where the arguments can't be told apart."""
        if not all(isinstance(v, _PLAIN) for v in (args or {}).values()):
            return None
        return query, database, tuple(sorted((k, type(v).__name__, repr(v)) for k, v in (args or {}).items()))

    def take(self, key: tuple | None, at: int) -> Walk:
        """The traversal that this page goes on with, or a new one; it is the
        caller's until it is put back."""
        late = time.monotonic() - IDLE
        for k in [k for k, w in self.known.items() if w.used < late]:
            self.known.pop(k).drop()
        walk = self.known.pop(key, None)
        if walk is not None and at and walk.at == at:
            return walk
        if walk is not None:
            walk.drop()
        return Walk()

    def put(self, key: tuple | None, walk: Walk, at: int) -> None:
        if key is None:
            walk.drop()
            return
        walk.at, walk.used = at, time.monotonic()
        if key in self.known:
            self.known.pop(key).drop()
        self.known[key] = walk
        while len(self.known) > MOST:
            self.known.popitem(last=False)[1].drop()

    def clear(self) -> None:
        while self.known:
            self.known.popitem()[1].drop()
