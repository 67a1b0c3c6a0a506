"""Structured Streaming forms: the ledger of checks, a cache with a lifetime, rate limits, windows over late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def events(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream; the source remembers what it has read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def ledger(checks: DataFrame) -> DataFrame:
    """The latest read and last pass of each comment, kept up to date (update mode)."""
    return checks.groupBy("comment_id").agg(F.max("at").alias("at"), F.max_by("outcome", F.struct("at", "outcome")).alias("outcome"), F.max(F.when(F.col("outcome") == "passing", F.col("at"))).alias("last_pass"))


def first_within(checks: DataFrame, hours: int = 48) -> DataFrame:
    """Each url's first check within the lifetime; state older than the watermark is dropped."""
    return checks.withWatermark("at", f"{hours} hours").dropDuplicatesWithinWatermark(["url"])


def windowed_counts(rows: DataFrame, minutes: int = 60, late: str = "2 hours") -> DataFrame:
    """Counts per window and kind, with late rows taken in up to the watermark (append mode)."""
    return rows.withWatermark("at", late).groupBy(F.window("at", f"{minutes} minutes"), "kind").agg(F.count(F.lit(1)).alias("n"))


def rate_limited(requests: DataFrame, limit: int, seconds: float, late: str = "10 minutes") -> DataFrame:
    """requests: client, at, request_id. The seconds that each request must wait, 0 for accepted; only accepted ones count. A client's
    state is its accepted times within the window, at most `limit` numbers; it goes once the watermark, `late` behind the newest
    request, has passed the window, so clients that never come back leave nothing. Requests later than that aren't judged."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["at", "request_id"], kind="stable")
        waits = []
        for at in rows["at"]:
            now = at.timestamp()
            times = [x for x in times if now - x < seconds]
            if len(times) < limit:
                times.append(now)
                waits.append(0)
            else:
                waits.append(max(1, -int(-(seconds - (now - times[0])) // 1)))
        state.update((times,))
        state.setTimeoutTimestamp(max(int((times[-1] + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"request_id": rows["request_id"], "client": key[0], "wait": waits})

    timed = requests.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy("client").applyInPandasWithState(run, "request_id long, client long, wait long", "times array<double>", "update", GroupStateTimeout.EventTimeTimeout)


def flushed(rows: DataFrame, path: str, checkpoint: str, every: str = "300 seconds", most_files: int = 1):
    """A stream written out in batches on a timer, each batch in its own folder; a batch that runs again replaces itself."""
    from plausia.sources.sinks import append_batch

    write = append_batch(path)
    return rows.writeStream.foreachBatch(lambda batch, number: write(batch.coalesce(most_files), number)).option("checkpointLocation", checkpoint).trigger(processingTime=every)


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str) -> DataFrame:
    """Runs a stream over what is there now, into a table in memory of this name; for tests and backfills."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
