"""Evaluation: agreement with gold labels, orderings, intervals, percentiles, tallies, matching, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def precision_recall(rows: DataFrame, gold: Column, predicted: Column) -> DataFrame:
    one = rows.agg(F.count_if(gold & predicted).alias("tp"), F.count_if(~gold & predicted).alias("fp"), F.count_if(gold & ~predicted).alias("fn"))
    return one.select("tp", "fp", "fn", F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), 9).alias("precision"), F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), 9).alias("recall"))


def confusion(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    return rows.groupBy(F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def ordering_pairs(ranked: DataFrame) -> DataFrame:
    """ranked: question, place, grade (null for none). Pairs of a useful and an off-topic item, and those in the right order.

    Counted without making the pairs: going down a ranking, each off-topic item has the useful ones before it as right pairs.
    """
    w = Window.partitionBy("question").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    good = F.coalesce((F.col("grade") >= 1).cast("int"), F.lit(0))
    off = F.coalesce((F.col("grade") == 0).cast("int"), F.lit(0))
    rows = ranked.withColumns({"g": good, "o": off}).withColumn("before", F.coalesce(F.sum("g").over(w), F.lit(0)))
    return rows.groupBy("question").agg(F.sum(F.col("o") * F.col("before")).alias("right"), (F.sum("g") * F.sum("o")).alias("pairs"))


def top_grades(ranked: DataFrame, top: int = 3) -> DataFrame:
    first = ranked.filter(F.col("place") <= top)
    return first.groupBy("question").agg(*(F.count_if(F.col("grade") == g).alias(f"grade_{g}") for g in (2, 1, 0)), F.count_if(F.col("grade").isNull()).alias("unjudged"))


def wilson(wins: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The range that a share of wins lies in; everything when there are none to count."""
    p, n = F.try_divide(wins.cast("double"), total), total.cast("double")
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(total == 0, 0.0).otherwise(F.greatest(F.lit(0.0), middle - half)), F.when(total == 0, 1.0).otherwise(F.least(F.lit(1.0), middle + half))


def nearest_rank(rows: DataFrame, value: str, by: str) -> DataFrame:
    """Percentiles that are values of the data: the least value with at least the share at or below it."""
    at = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")
    return rows.groupBy(by).agg(at(0.5).alias("p50"), at(0.95).alias("p95"), F.max(value).alias("max"))


def matched(lefts: list, rights: list) -> dict:
    """The right side of each matched left one. Pairs come by left, then right; smaller values are tried first."""
    fits: dict = {}
    for left, right in zip(lefts, rights):
        fits.setdefault(left, []).append(right)
    partner: dict = {}
    own: dict = {}
    for start in fits:
        # breadth first to a free right side, then flip the path back
        came, queue, end = {}, [start], None
        for left in queue:
            for right in fits[left]:
                if right in came:
                    continue
                came[right] = left
                if right not in partner:
                    end = right
                    break
                queue.append(partner[right])
            if end is not None:
                break
        while end is not None:
            left = came[end]
            before = own.get(left)
            partner[end], own[left] = left, end
            end = before
    return own


def max_matching(pairs: DataFrame) -> DataFrame:
    """pairs: grp, left, right. As many pairs as possible in each group, each side at most once; smaller values are tried first, and a
    side without a value pairs with nothing. A group is one comment's names, so it is small; the augmenting search is sequential.
    Groups are very many, so they pass through Python as runs of sorted batches and not one by one."""

    def match(batches):
        import numpy as np
        import pyarrow as pa

        kept: list = []  # batches' ends of the group that may go on in the next one

        def done(parts):
            none, grp, left, right = (np.concatenate(x) for x in zip(*parts))
            starts = np.flatnonzero(np.concatenate(([True], (grp[1:] != grp[:-1]) | (none[1:] != none[:-1]))))
            ends = np.append(starts[1:], len(grp)).tolist()
            left, right = left.tolist(), right.tolist()
            sizes, a, b = [], [], []
            for i, j in zip(starts.tolist(), ends):
                own = matched(left[i:j], right[i:j])
                sizes.append(len(own))
                a.extend(own)
                b.extend(own.values())
            keys = pa.array(np.repeat(grp[starts], sizes), pa.int64(), mask=np.repeat(none[starts], sizes).astype(bool))
            return pa.RecordBatch.from_arrays([keys, pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["grp", "left", "right"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
            cut = int(np.argmax(last))
            if cut == 0 and kept and (kept[-1][0][-1], kept[-1][1][-1]) != (cols[0][0], cols[1][0]):
                yield done(kept)
                kept = []
            if cut:
                yield done([*kept, [c[:cut] for c in cols]])
                kept = []
            kept.append([c[cut:] for c in cols])
        if kept:
            yield done(kept)

    none = F.col("grp").isNull().cast("long").alias("none")
    rows = pairs.filter("left is not null and right is not null").select(none, F.coalesce("grp", F.lit(0)).cast("long").alias("grp"), F.col("left").cast("long").alias("left"), F.col("right").cast("long").alias("right"))
    return rows.repartition("none", "grp").sortWithinPartitions("none", "grp", "left", "right").mapInArrow(match, "grp long, left long, right long")


def differences(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Paths at which two flattened answers differ, with both values; a path that one lacks has a null there."""
    a, b = new.select(key, "path", F.col("value").alias("new")), old.select(key, "path", F.col("value").alias("old"))
    return a.join(b, [key, "path"], "full").filter(~F.col("new").eqNullSafe(F.col("old")))
