"""Sinks: whole tables, appends, and keyed upserts, each safe to run again.

A table is a folder of versions and a small file that names the current one. A version is written beside the others and becomes the
current one by renaming that file, which is one step on file systems that rename in one step; so readers see the old or the new table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

CURRENT = "_CURRENT"


def _context(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration())


def _point(spark: SparkSession, path: str, version: str) -> None:
    jvm, context = _context(spark, path)
    new = jvm.org.apache.hadoop.fs.Path(f"{path}/{CURRENT}.{uuid.uuid4().hex}")
    file_system = new.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = file_system.create(new, True)
    out.writeUTF(version)
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(new, jvm.org.apache.hadoop.fs.Path(f"{path}/{CURRENT}"), overwrite)


def current_version(spark: SparkSession, path: str) -> str | None:
    """The folder of a table's current version; None before the first."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{CURRENT}")
    file_system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not file_system.exists(at):
        return None
    file = file_system.open(at)
    try:
        return f"{path}/{file.readUTF()}"
    finally:
        file.close()


def write_table(df: DataFrame, path: str, *partition_by: str, version: str | None = None) -> None:
    """A table written whole. A version that is named is written anew if the job runs again; older versions stay until vacuumed."""
    name = f"version={version or uuid.uuid4().hex}"
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/{name}")
    _point(df.sparkSession, path, name)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    at = current_version(spark, path)
    if at is None:
        raise FileNotFoundError(path)
    return spark.read.parquet(at)


def vacuumed(spark: SparkSession, path: str) -> list[str]:
    """Deletes all versions but the current one, once no reader needs them; their folders."""
    now = current_version(spark, path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    file_system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = [s.getPath() for s in file_system.listStatus(at) if s.isDirectory() and s.getPath().getName().startswith("version=") and now and not now.endswith("/" + s.getPath().getName())]
    for p in gone:
        file_system.delete(p, True)
    return sorted(p.getName() for p in gone)


def append_records(df: DataFrame, path: str, name: str) -> None:
    """Appends rows under a name; an append that runs again replaces its own rows and adds none."""
    df.write.mode("overwrite").json(f"{path}/append={name}")


def append_batch(path: str):
    """A foreachBatch writer that appends; a batch that runs again replaces itself."""
    return lambda batch, number: append_records(batch, path, str(number))


def upsert_batch(path: str, keys: list[str], order: str, buckets: int = 64):
    """A foreachBatch writer that keeps the newest row of each key. Keys are dealt over buckets; a batch rewrites only buckets that it
    touches, each beside its older form and named by the batch, so a batch that runs again changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        every = new
        before = latest_rows(spark, path, upto=number) if number > 0 else None
        if before is not None:
            every = before.join(F.broadcast(new.select("bucket").distinct()), "bucket", "left_semi").unionByName(new)  # at most `buckets` rows
        own = [c for c in every.columns if c not in (*keys, "bucket")]
        newest = every.groupBy("bucket", *keys).agg(F.max_by(F.struct(*own), F.col(order)).alias("r")).select("bucket", *keys, "r.*")
        newest.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={number}")

    return write


def latest_rows(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame | None:
    """The rows that upserts left: of each bucket the form of its last batch (before `upto`); None before the first batch."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    file_system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    batches = [int(s.getPath().getName()[6:]) for s in file_system.listStatus(at) if s.getPath().getName().startswith("batch=")] if file_system.exists(at) else []
    last: dict[str, int] = {}
    for n in sorted(b for b in batches if upto is None or b < upto):
        for s in file_system.listStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={n}")):
            if s.getPath().getName().startswith("bucket="):
                last[s.getPath().getName()] = n
    if not last:
        return None
    return spark.read.option("basePath", path).parquet(*(f"{path}/batch={n}/{bucket}" for bucket, n in sorted(last.items()))).drop("batch")
