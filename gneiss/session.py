"""The SparkSession the gateway works on."""

from __future__ import annotations

from pyspark.sql import SparkSession

from gneiss.plans.paging import DEEP, DEEP_SETTING


def build_session(name: str = "gneiss", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew joins; cluster settings are the caller's."""
    builder = SparkSession.builder.appName(name)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", DEEP_SETTING: str(DEEP)}
    return builder.config(map=fixed | conf).getOrCreate()
