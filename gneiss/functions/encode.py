"""Rows as JSON values, by the frame's schema."""

from __future__ import annotations

import base64
import datetime as dt
import math
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_INT64 = 1 << 63


def encode(value, kind: T.DataType):
    """NULL, NaN and infinities become null; decimals stay exact (a string where
    no JSON number is equal); binary is base64; temporals are ISO 8601 without
    trailing zeros of the fraction, zoned ones in UTC; nested values nest."""
    if value is None:
        return None
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return value if math.isfinite(value) else None
    if isinstance(value, Decimal):
        if value == value.to_integral_value():
            whole = int(value)
            if kind.scale == 0:
                return whole if -_INT64 <= whole < _INT64 else str(whole)
        near = float(value)
        return near if Decimal(repr(near)) == value else str(value)
    if isinstance(kind, T.BinaryType):
        return base64.b64encode(bytes(value)).decode()
    if isinstance(kind, T.TimestampType):
        return _seconds(value.astimezone(dt.timezone.utc).replace(tzinfo=None)) + "Z"
    if isinstance(value, dt.datetime):
        return _seconds(value)
    if isinstance(value, dt.time):
        return value.isoformat().rstrip("0") if value.microsecond else value.isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(kind, T.ArrayType):
        return [encode(v, kind.elementType) for v in value]
    if isinstance(kind, T.MapType):
        return {str(encode(k, kind.keyType)): encode(v, kind.valueType) for k, v in value.items()}
    if isinstance(kind, T.StructType):
        return {f.name: encode(v, f.dataType) for f, v in zip(kind.fields, value)}
    if isinstance(kind, T.VariantType):
        import json

        return json.loads(value.toJson())
    if isinstance(value, (bool, int, str)):
        return value
    return str(value)


def _seconds(value: dt.datetime) -> str:
    text = value.replace(microsecond=0).isoformat()
    return text + f".{value.microsecond:06d}".rstrip("0") if value.microsecond else text


def rows(df: DataFrame) -> list[dict]:
    """All rows of a bounded frame."""
    return named(df.collect(), df.schema)


def named(found: list, schema: T.StructType) -> list[dict]:
    """Rows by column name; of equal column names the last one stands."""
    kinds = [(f.name, f.dataType) for f in schema.fields]
    return [{name: encode(v, kind) for (name, kind), v in zip(kinds, row)} for row in found]


def affected(df: DataFrame) -> int | None:
    """Rows that a write has put out, by the metrics of the command that ran;
    None where the statement wrote none."""
    plan = df._jdf.queryExecution().executedPlan()
    if plan.nodeName() != "CommandResult":
        return None
    found = [plan.commandPhysicalPlan()]
    while found:
        node = found.pop()
        metric = node.metrics().get("numOutputRows")
        if node.nodeName().startswith("Execute ") and metric.isDefined():
            return int(metric.get().value())
        children = node.children()
        found += [children.apply(i) for i in range(children.size())]
    return None


def first_cell(df: DataFrame):
    """The first column of the first row as a JSON value; None without rows."""
    row = df.limit(1).collect()
    return encode(row[0][0], df.schema.fields[0].dataType) if row else None


def first_column(df: DataFrame) -> list:
    """The first column of a bounded frame as JSON values."""
    return [encode(r[0], df.schema.fields[0].dataType) for r in df.select(df[df.columns[0]]).collect()]
