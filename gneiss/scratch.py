"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import threading
import uuid

from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session has none, a temporary folder is made and set if Spark runs
    in this one process, as in tests; on a cluster that is an error, as no folder
    of one machine would do.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = at.get() if at.isDefined() else None
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="gneiss-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path


#: Configuration of the file system and maker's thread, by path.
SCRATCH: dict[str, tuple] = {}


def new_path(spark: SparkSession, label: str) -> str:
    """A path for a table that goes with ``delete``, or when the process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/gneiss/{label}-{uuid.uuid4().hex}"
    SCRATCH[path] = spark.sparkContext._jsc.hadoopConfiguration(), threading.get_ident()
    return path


def delete(path: str) -> None:
    conf, _ = SCRATCH.pop(path, (None, None))
    gateway = SparkContext._gateway
    if conf is not None and gateway is not None:
        at = gateway.jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def drop_scratch() -> None:
    """Deletes all tables of this process; frames built on them end too."""
    for path in list(SCRATCH):
        delete(path)


@atexit.register
def _at_exit() -> None:
    with contextlib.suppress(Py4JError, OSError):  # Spark may be gone already
        drop_scratch()
