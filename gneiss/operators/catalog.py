"""Catalog listings as sorted frames of names, and table metadata.

Listings are frames of names, so that search, order and page are one small plan;
the metadata of tables is fetched for the names of a page only.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions.ident import quote_ident

MARK = "gneiss.materialized"
CONSTRAINTS, INDEXES = "gneiss.constraints", "gneiss.indexes"


def _names(spark: SparkSession, names: list[str] = ()) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "name string")


def databases(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW DATABASES").select(F.col("namespace").alias("name")).orderBy("name")


def _views(spark: SparkSession, database: str) -> DataFrame:
    found = spark.sql(f"SHOW VIEWS IN {quote_ident(database)}").where("not isTemporary")
    return found.select(F.col("viewName").alias("name"))


def _materialized(spark: SparkSession, database: str) -> list[str]:
    """Names that the database remembers and whose tables bear the mark still."""
    info = spark.sql(f"DESCRIBE DATABASE EXTENDED {quote_ident(database)}").where("info_name = 'Properties'").first()
    # Names are kept in hexadecimal digits, which need no quoting.
    noted = [bytes.fromhex(n).decode() for n in re.findall(rf"{re.escape(MARK)}\.((?:[0-9a-f]{{2}})+),true", info[1] if info else "")]
    at = [(n, f"{quote_ident(database)}.{quote_ident(n)}") for n in noted]
    return sorted(n for n, t in at if spark.catalog.tableExists(t) and spark.sql(f"SHOW TBLPROPERTIES {t} ('{MARK}')").first()[1] == "true")


def mark_materialized(spark: SparkSession, database: str, name: str) -> None:
    spark.sql(f"ALTER TABLE {quote_ident(database)}.{quote_ident(name)} SET TBLPROPERTIES ('{MARK}'='true')")
    spark.sql(f"ALTER DATABASE {quote_ident(database)} SET DBPROPERTIES ('{MARK}.{name.encode().hex()}'='true')")


def tables(spark: SparkSession, database: str, search: str | None = None) -> DataFrame:
    """Names of base tables, sorted, without a look at any table's metadata.
    ``search`` is a substring in any case, in which % and _ are wildcards; a
    blank one filters nothing."""
    found = spark.sql(f"SHOW TABLES IN {quote_ident(database)}").where("not isTemporary").select(F.col("tableName").alias("name"))
    if search and search.strip():
        found = found.where(F.col("name").ilike(f"%{search}%"))
    found = found.join(_views(spark, database), "name", "left_anti")
    if hidden := _materialized(spark, database):
        found = found.where(~F.col("name").isin(hidden))
    return found.orderBy("name")


def kind(spark: SparkSession, database: str, name: str) -> str:
    return "PARTITIONED_TABLE" if any(c.isPartition for c in spark.catalog.listColumns(f"{quote_ident(database)}.{quote_ident(name)}")) else "TABLE"


def views(spark: SparkSession, database: str) -> DataFrame:
    return _views(spark, database).orderBy("name")


def materialized_views(spark: SparkSession, database: str) -> DataFrame:
    return _names(spark, _materialized(spark, database)).orderBy("name")


def functions(spark: SparkSession, database: str) -> DataFrame:
    """User functions of the database; temporary and built-in ones are not."""
    found = spark.sql(f"SHOW USER FUNCTIONS IN {quote_ident(database)}").select(F.col("function").alias("name"))
    return found.where(F.contains("name", F.lit(f".{database}."))).select(F.substring_index("name", ".", -1).alias("name")).orderBy("name")


def procedures(spark: SparkSession, database: str) -> DataFrame:
    """The session catalog has no procedures."""
    return _names(spark)


def triggers(spark: SparkSession, database: str) -> DataFrame:
    """Spark has no triggers."""
    return _names(spark)


def describe(spark: SparkSession, database: str, name: str) -> dict:
    """A table's metadata. The session catalog itself keeps no constraints,
    indexes or triggers and no NOT NULL of file tables: constraints and indexes
    are what the table properties ``CONSTRAINTS`` and ``INDEXES`` say, as JSON
    arrays of objects, of which fields that are not given come out null."""
    at = f"{quote_ident(database)}.{quote_ident(name)}"
    info = json.loads(spark.sql(f"DESCRIBE TABLE EXTENDED {at} AS JSON").first()[0])
    columns = [
        {"name": c["name"], "dataType": _type(c["type"]), "ordinalPosition": i, "nullable": c.get("nullable", True), "default": c.get("default"), "comment": c.get("comment")}
        for i, c in enumerate(info.get("columns", []), 1)
    ]
    said = info.get("table_properties") or {}

    def declared(prop: str, fields: tuple[str, ...]) -> list[dict]:
        return [{f: entry.get(f) for f in fields} for entry in json.loads(said.get(prop, "[]"))]

    parts = {
        "constraints": declared(CONSTRAINTS, ("name", "type", "columns", "definition", "referencedTable", "referencedColumns")),
        "indexes": declared(INDEXES, ("name", "columns", "unique", "primary", "method", "definition")),
    }
    kind = "PARTITIONED_TABLE" if info.get("partition_columns") else "TABLE"
    return {"schema": database, "kind": kind, "owner": info.get("owner"), "comment": info.get("comment"), "columns": columns, **parts, "triggers": []}


def _type(kind: dict) -> str:
    name = kind["name"]
    if name == "array":
        return f"array<{_type(kind['element_type'])}>"
    if name == "map":
        return f"map<{_type(kind['key_type'])},{_type(kind['value_type'])}>"
    if name == "struct":
        return "struct<" + ",".join(f"{f['name']}:{_type(f['type'])}" for f in kind["fields"]) + ">"
    if name == "decimal":
        return f"decimal({kind['precision']},{kind['scale']})"
    return name
