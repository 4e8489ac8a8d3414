"""Runs work under a time limit; what exceeds it is cancelled on the cluster."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark import InheritableThread
from pyspark.sql import SparkSession

from gneiss.errors import QueryTimeout, from_spark

R = TypeVar("R")


def run(spark: SparkSession, work: Callable[[], R], sql: str, limit: float | None) -> R:
    """Spark errors come out as the gateway's. No limit: None or 0."""
    if not limit:
        try:
            return work()
        except Exception as e:
            raise from_spark(e) from e
    group, out, began = uuid.uuid4().hex, {}, time.monotonic()

    def target() -> None:
        spark.sparkContext.setJobGroup(group, sql[:200], interruptOnCancel=True)
        try:
            out["value"] = work()
        except Exception as e:  # handed over to the caller's thread
            out["error"] = e

    thread = InheritableThread(target=target, daemon=True)
    thread.start()
    thread.join(limit)
    if thread.is_alive():
        # Jobs that the work has yet to start are cancelled as they come.
        spark.sparkContext._jsc.sc().cancelJobGroupAndFutureJobs(group)
        raise QueryTimeout(time.monotonic() - began, sql)
    if "error" in out:
        raise from_spark(out["error"]) from out["error"]
    return out["value"]
