"""What the training-data operators share: word rules, folds, and tables that cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import uuid
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word is a run of anything but space, tab, newline, vertical tab, form feed and return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Stands for a null doc_id inside operators, so that joins and sorts have a value; it orders first, like a null.
NULL_ID = -(2**63)
ROOT = Path(__file__).resolve().parents[2]


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers started from this checkout import the package, and bounds Arrow batches of long texts."""
    env = spark.sparkContext.environment
    if str(ROOT) not in (env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (str(ROOT), env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    return spark


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of doc_id as text, modulo mod; a null id is in no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(mod)


def held_out(doc_id: Column, mod: int, remainder: int) -> Column:
    return F.coalesce(fold(doc_id, mod) == F.lit(remainder), F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CLEAR: dict[str, Callable[[], None]] = {}
_NOW: list[str | None] = [None]


def cached_for(owner: str, clear: Callable[[], None]) -> None:
    """Says how to empty an operator's caches in a Python worker."""
    _CLEAR[owner] = clear


def turn_to(owner: str) -> None:
    """Called by each task of an operator: a worker that served another one lets go of that one's caches, and memory that is
    free goes back to the system, so that a worker never holds more than one operator needs."""
    if _NOW[0] != owner:
        for other, clear in _CLEAR.items():
            if other != owner:
                clear()
        _NOW[0] = owner
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def unused(columns: list[str], *names: str) -> list[str]:
    """A column name for each of names, none of them among columns (nor alike but for case)."""
    taken = {c.lower() for c in columns}
    mark = "__"
    while any((mark + n).lower() in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


_MADE: list[Scratch] = []


class Scratch:
    """Tables written to the shared folder in spark.checkpoint.dir, read again as new plans.

    A lost executor then costs only the tasks since the last table. The folder is read from the session; only a session that
    runs on one machine may name none: then a folder of its warehouse is used.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        self.path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        _MADE.append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        at = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, *names: str) -> None:
        """Deletes tables that no later plan reads."""
        for name in names:
            self._delete(f"{self.path}/{name}")

    def remove(self) -> None:
        """Deletes all tables, once nothing reads them."""
        self._delete(self.path)

    def _delete(self, at: str) -> None:
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def made() -> int:
    """How many Scratch there are: what a caller notes before it calls an operator, to sweep what the operator left."""
    return len(_MADE)


def sweep(since: int = 0) -> None:
    """Deletes the tables of every Scratch made since then; their operators' results must have been written by now."""
    for scratch in _MADE[since:]:
        scratch.remove()
    del _MADE[since:]


def _at_exit() -> None:
    """What is left when the driver ends is deleted, if the session still answers."""
    with contextlib.suppress(Exception):
        if SparkSession.getActiveSession() is not None:
            sweep()


atexit.register(_at_exit)
