"""Tables that the gateway serves: files, catalog tables, other databases."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gneiss.functions.ident import quote_ident, quote_literal, validate_ident

TABLES = tuple("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())


def register_views(spark: SparkSession, folder: str, names: tuple[str, ...] = TABLES) -> None:
    """Temporary views over a folder's Parquet tables; nothing is read but footers."""
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)


def register_folder(spark: SparkSession, folder: str) -> list[str]:
    """Views over all Parquet tables of a folder that Spark can list."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    names = sorted(f.getPath().getName().removesuffix(".parquet") for f in found if f.getPath().getName().endswith(".parquet"))
    register_views(spark, folder, tuple(map(validate_ident, names)))
    return names


def register_tables(spark: SparkSession, database: str, folder: str, names: tuple[str, ...]) -> None:
    """External catalog tables over the same files, in a database of their own.

    A new database gets a folder that no earlier session has left files in.
    """
    home = f"{spark.conf.get('spark.sql.warehouse.dir')}/{database}-{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {quote_ident(validate_ident(database))} LOCATION {quote_literal(home)}")
    for name in names:
        at = f"{quote_ident(database)}.{quote_ident(validate_ident(name))}"
        spark.sql(f"DROP TABLE IF EXISTS {at}")
        spark.sql(f"CREATE TABLE {at} USING parquet LOCATION {quote_literal(f'{folder}/{name}.parquet')}")


def read_jdbc(spark: SparkSession, url: str, table: str, options: dict[str, str] | None = None) -> DataFrame:
    """A table of another database; its driver must be on the class path. With
    partitionColumn, lowerBound, upperBound and numPartitions it is read in
    parallel; filters and columns are pushed down."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **(options or {})).load()
