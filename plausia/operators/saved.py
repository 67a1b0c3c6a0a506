"""Tables that cut lineage: written once to the folder that all executors share, and read as new plans.

A lost executor then costs only the tasks since the last table. A table is written by the job that makes it, where a checkpoint would
compute its rows a second time; what is left is deleted when the driver ends.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names. Only a session on one machine may name none: then one of its warehouse."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return at.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """The same rows, read from a table that is written now."""
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/saved-{uuid.uuid4().hex}"
    df.write.parquet(at)
    _MADE.append((spark, at))
    return spark.read.schema(df.schema).parquet(at)


def sweep() -> None:
    """Deletes all tables made so far; nothing may read them any more."""
    while _MADE:
        spark, at = _MADE.pop()
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _at_exit() -> None:
    with contextlib.suppress(Exception):
        if SparkSession.getActiveSession() is not None:
            sweep()


atexit.register(_at_exit)
