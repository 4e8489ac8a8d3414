"""Opaque cursors and pages over ordered queries."""

from __future__ import annotations

import base64
import binascii
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame

from gneiss.errors import InvalidCursor

_INT_MAX = (1 << 31) - 1  # Spark's OFFSET and LIMIT are INT
_U64 = 1 << 64
#: A top-k of more rows would gather them on the driver.
DEEP = 100_000
DEEP_SETTING = "spark.sql.execution.topKSortFallbackThreshold"


@dataclass(frozen=True)
class Cursor:
    offset: int

    def encode(self) -> str:
        return base64.urlsafe_b64encode(json.dumps({"offset": self.offset}, separators=(",", ":")).encode()).decode().rstrip("=")

    @staticmethod
    def decode(text: str) -> Cursor:
        try:
            if "=" in text or "+" in text or "/" in text:
                raise ValueError("not base64url without padding")
            raw = base64.b64decode(text + "=" * (-len(text) % 4), altchars=b"-_", validate=True)
        except (ValueError, binascii.Error) as e:
            raise InvalidCursor(f"invalid cursor: {e}") from e
        try:
            body = json.loads(raw)
        except ValueError as e:
            raise InvalidCursor(f"invalid cursor: {e}") from e
        offset = body.get("offset") if isinstance(body, dict) else None
        if not isinstance(offset, int) or isinstance(offset, bool) or not 0 <= offset < _U64:
            raise InvalidCursor("invalid cursor: offset missing or out of range")
        return Cursor(offset)


class Pager:
    """One row more than a page is fetched; that it is there makes the cursor."""

    def __init__(self, cursor: str | None, size: int):
        self.start = Cursor.decode(cursor).offset if cursor is not None else 0
        self.size = size

    @property
    def limit(self) -> int:
        return self.size + 1

    @property
    def offset(self) -> int:
        """Beyond what Spark can skip a page can't be had, nor one before it."""
        if self.start > _INT_MAX - self.limit:
            raise InvalidCursor(f"invalid cursor: offsets end at {_INT_MAX - self.limit}; page by a condition on the key")
        return self.start

    def window(self, df: DataFrame) -> DataFrame:
        """The page and its extra row: a top-k of offset + limit, or a sort over
        all executors where that is more than ``DEEP`` rows."""
        return df.offset(self.offset).limit(self.limit)

    def page(self, df: DataFrame) -> DataFrame:
        return df.offset(self.offset).limit(self.size)

    def finish(self, items: list) -> tuple[list, str | None]:
        if len(items) <= self.size:
            return items, None
        return items[: self.size], Cursor(self.start + self.size).encode()
