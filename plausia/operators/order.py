"""Places in an order over a whole table, without gathering the table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plausia.operators.saved import saved


def numbered(rows: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """rows with their place, from 1 on. The order must leave no ties.

    A distributed sort; each task numbers its own stretch, and what the stretches before it hold is added. Only a count a task
    reaches the driver.
    """
    # the number that Spark gives: the task in the upper bits, the place in the task in the lower 33
    own = saved(rows.orderBy(*order).withColumn("_own", F.monotonically_increasing_id()))
    task = F.shiftright("_own", 33)
    counts = {r.t: r.n for r in own.groupBy(task.alias("t")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, offsets = 0, []
    for t in sorted(counts):
        offsets.append((t, before))
        before += counts[t]
    if not offsets:
        return own.withColumn(name, F.lit(0).cast("long")).drop("_own")
    table = rows.sparkSession.createDataFrame(offsets, "_task long, _before long")
    placed = own.withColumn("_task", task).join(F.broadcast(table), "_task")  # a row a task
    return placed.withColumn(name, F.col("_before") + F.col("_own").bitwiseAND(F.lit(2**33 - 1)) + 1).drop("_task", "_before", "_own")
