"""The driver's queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gneiss.llm import bpe, fm, licenses, mixing, neardup, ppm, quality, repeats, sharding, topk

_MODULES = (sharding, quality, licenses, topk, mixing, fm, bpe, neardup, ppm, repeats)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: getattr(m, name) for m in _MODULES for name in dir(m) if name.startswith("op") and name[2].isdigit()}
    return found | {"base3_ppm_score": ppm.base3_ppm_score}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in getattr(m, "ORACLE", {}).items()}
