"""Places over whole tables, reply trees and scans that keep what they could not read."""

import pytest
from pyspark.sql import functions as F

from plausia.operators import names, threads
from plausia.operators.order import numbered


def test_places_follow_the_order(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 37 % 101).alias("k")).repartition(7)
    got = [(r.k, r.id) for r in sorted(numbered(df, F.desc("k"), "id").collect(), key=lambda r: r.place)]
    assert got == sorted(got, key=lambda r: (-r[0], r[1])) and len(got) == 1000
    assert sorted(r.place for r in numbered(df, "id").collect()) == list(range(1, 1001))
    assert numbered(df.limit(0), "id").count() == 0


def test_trees_of_any_depth_keep_every_comment(spark):
    deep = [(1, i, i - 1 if i else None, 1) for i in range(90)]
    wide = [(2, 123456789, None, 5), (2, 123456790, 123456789, 200_000), (2, 123456791, 123456789, 3), (2, 123456792, 123456790, -7), (2, 5, 999, 0)]
    df = spark.createDataFrame(deep + wide, "thread_id long, comment_id long, parent_id long, score long")
    got = {(r.thread_id, r.comment_id): (r.depth, r.place) for r in threads.preorder(df, F.col("score")).collect()}
    assert len(got) == 95 and all(got[1, i] == (i, i + 1) for i in range(90))
    assert [c for (_, c), _ in sorted(((k, v) for k, v in got.items() if k[0] == 2), key=lambda x: x[1][1])] == [123456789, 123456790, 123456792, 123456791, 5]
    assert {r.depth for r in threads.depths(df).filter("thread_id = 1").collect()} == set(range(90))
    circle = spark.createDataFrame([(1, 1, 2, 0), (1, 2, 1, 0)], "thread_id long, comment_id long, parent_id long, score long")
    with pytest.raises(ValueError, match="circle"):
        threads.depths(circle)


def test_words_one_edit_apart_share_a_key(spark):
    words = ["abcd", "abed", "abc", "abccd", "xbcd", "abdc", "a"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.explode(names.without_a_letter(F.col("w"))).alias("k"))
    a, b = df.withColumnRenamed("w", "x"), df.withColumnRenamed("w", "y")
    met = {(r.x, r.y) for r in a.join(b, "k").collect()}
    assert {("abcd", "abed"), ("abcd", "abc"), ("abcd", "abccd")} <= met and ("abcd", "xbcd") not in met
