"""Queries of the evaluation family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plausia.operators import evaluation as e
from plausia.plans.views import COMMENTS, comments, table


def _gold(spark: SparkSession, sf: str) -> DataFrame:
    """Gold labels with the prediction of a plain rule on the text."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    symbols = F.regexp_count("text", F.lit(r"[#*$%&|<>]"))
    predicted = (symbols * 10 <= F.regexp_count("text", F.lit(" ")) + 1).cast("int")
    level = F.when(F.length("text") < 500, "low").when(F.length("text") < 3000, "medium").otherwise("high")
    return d.select("doc_id", "quality", predicted.alias("predicted"), level.alias("level"), F.col("lang"), F.col("toxic"))


_GOLD = r"""gold AS (SELECT doc_id, quality, ((length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g'))) * 10 <= length(text) - length(replace(text, ' ', '')) + 1)::INT AS predicted,
  CASE WHEN length(text) < 500 THEN 'low' WHEN length(text) < 3000 THEN 'medium' ELSE 'high' END AS level, lang, toxic FROM documents JOIN labels USING (doc_id))"""


def precision_recall(spark: SparkSession, sf: str) -> DataFrame:
    return e.precision_recall(_gold(spark, sf), F.col("quality") == 1, F.col("predicted") == 1)


def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return e.confusion(_gold(spark, sf), "quality", "predicted")


def accuracy_by_case(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy overall and for each kind of case."""
    return _gold(spark, sf).rollup("lang").agg(F.round(F.avg((F.col("quality") == F.col("predicted")).cast("double")), 9).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def metric_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics as rows of name, value, count and total."""
    g = _gold(spark, sf)
    one = lambda name, c: g.agg(F.lit(name).alias("metric"), F.count_if(c).alias("n"), F.count(F.lit(1)).alias("out_of"))
    rows = one("agreement", F.col("quality") == F.col("predicted")).unionByName(one("toxic share", F.col("toxic") == 1)).unionByName(one("long texts", F.col("level") == "high"))
    return rows.withColumn("value", F.round(F.try_divide("n", "out_of"), 9))


def other_tag_share(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id").agg(F.round(F.avg((F.col("event_type") == "error").cast("double")), 9).alias("share"))


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    """Questions are brands; what they rank are parts by price; grades come from sizes, some unjudged."""
    grade = F.when(F.col("p_size") % 4 != 3, F.col("p_size") % 3)
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    return table(spark, sf, "part").select(F.col("p_brand").alias("question"), place.alias("place"), grade.alias("grade"))


_RANKED = "ranked AS (SELECT p_brand AS question, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place, CASE WHEN p_size % 4 <> 3 THEN p_size % 3 END AS grade FROM part)"


def ordering_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return e.ordering_pairs(_ranked(spark, sf))


def top3_grades(spark: SparkSession, sf: str) -> DataFrame:
    return e.top_grades(_ranked(spark, sf))


def wilson_interval(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "A").alias("wins"), F.count(F.lit(1)).alias("total"))
    low, high = e.wilson(F.col("wins"), F.col("total"))
    return n.select("l_suppkey", "wins", "total", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


def pairwise_cube(spark: SparkSession, sf: str) -> DataFrame:
    """Wins against each rival in each category, with all totals."""
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 3).alias("rival"), F.col("o_orderpriority").alias("category"), "o_orderstatus")
    return o.cube("rival", "category").agg(F.count_if(F.col("o_orderstatus") == "F").alias("ours"), F.count_if(F.col("o_orderstatus") == "O").alias("theirs"), F.count_if(F.col("o_orderstatus") == "P").alias("same"), F.grouping_id().alias("level"))


def blind_tally(spark: SparkSession, sf: str) -> DataFrame:
    """For each question of a blind test, whose answer came first, and how many answers ours beat by rank."""
    o = table(spark, sf, "orders")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    r = o.withColumn("place", F.row_number().over(w)).withColumn("owner", F.col("o_orderkey") % 3)
    ours = r.groupBy("o_custkey").agg(F.min(F.when(F.col("owner") == 0, F.col("place"))).alias("ours"), F.max_by("owner", -F.col("place")).alias("first"), F.min(F.when(F.col("owner") == 1, F.col("place"))).alias("a"), F.min(F.when(F.col("owner") == 2, F.col("place"))).alias("b"))
    return ours.groupBy("first").agg(F.count(F.lit(1)).alias("questions"), F.count_if(F.col("ours") < F.col("a")).alias("beats_a"), F.count_if(F.col("ours") < F.col("b")).alias("beats_b"))


def feedback_summary(spark: SparkSession, sf: str) -> DataFrame:
    return comments(spark, sf).groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") > 50).alias("useful"))


def nearest_rank_latency(spark: SparkSession, sf: str) -> DataFrame:
    return e.nearest_rank(table(spark, sf, "events"), "value", "event_type")


def max_matching(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of an order's lines and suppliers that could stand for one another."""
    x = table(spark, sf, "lineitem")
    right = F.explode(F.array_distinct(F.array(F.col("l_suppkey") % 5, F.col("l_partkey") % 5)))
    pairs = x.select(F.col("l_orderkey").alias("grp"), F.col("l_linenumber").cast("long").alias("left"), right.alias("right"))
    return e.max_matching(pairs)


def rank_diff(spark: SparkSession, sf: str) -> DataFrame:
    """What differs between two answers, path by path."""
    p = table(spark, sf, "part")
    flat = lambda price: p.select("p_partkey", F.inline(F.array(F.struct(F.lit("name").alias("path"), F.col("p_name").alias("value")), F.struct(F.lit("price").alias("path"), F.floor(price).cast("string").alias("value")), F.struct(F.lit("size").alias("path"), F.col("p_size").cast("string").alias("value")))))
    old = flat(F.col("p_retailprice")).filter("not (path = 'size' and p_partkey % 50 = 0)")
    new = flat(F.col("p_retailprice") + F.when(F.col("p_partkey") % 9 == 0, 10).otherwise(0)).filter("not (path = 'name' and p_partkey % 77 = 0)")
    return e.differences(new, old, "p_partkey")


QUERIES = {
    "precision_recall": (
        precision_recall,
        f"WITH {_GOLD}, c AS (SELECT count(*) FILTER (quality = 1 AND predicted = 1) AS tp, count(*) FILTER (quality <> 1 AND predicted = 1) AS fp, count(*) FILTER (quality = 1 AND predicted <> 1) AS fn FROM gold) "
        "SELECT tp, fp, fn, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall FROM c",
    ),
    "confusion_matrix": (confusion_matrix, f"WITH {_GOLD} SELECT quality AS gold, predicted, count(*) AS n FROM gold GROUP BY ALL"),
    "accuracy_by_case": (accuracy_by_case, f"WITH {_GOLD} SELECT lang, round(avg((quality = predicted)::INT::DOUBLE), 9) AS accuracy, count(*) AS n FROM gold GROUP BY ROLLUP (lang)"),
    "metric_rows": (
        metric_rows,
        f"WITH {_GOLD}, r AS (SELECT 'agreement' AS metric, count(*) FILTER (quality = predicted) AS n, count(*) AS out_of FROM gold UNION ALL SELECT 'toxic share', count(*) FILTER (toxic = 1), count(*) FROM gold "
        "UNION ALL SELECT 'long texts', count(*) FILTER (level = 'high'), count(*) FROM gold) SELECT *, round(n / out_of, 9) AS value FROM r",
    ),
    "other_tag_share": (other_tag_share, "SELECT user_id, round(avg((event_type = 'error')::INT::DOUBLE), 9) AS share FROM events GROUP BY 1"),
    "ordering_pairs": (
        ordering_pairs,
        f"WITH {_RANKED} SELECT q.question, coalesce(r, 0)::BIGINT AS right, coalesce(p, 0)::BIGINT AS pairs FROM (SELECT DISTINCT question FROM ranked) q LEFT JOIN "
        "(SELECT u.question, count(*) FILTER (u.place < o.place) AS r, count(*) AS p FROM ranked u JOIN ranked o ON u.question = o.question AND u.grade >= 1 AND o.grade = 0 GROUP BY 1) x USING (question)",
    ),
    "top3_grades": (top3_grades, f"WITH {_RANKED} SELECT question, count(*) FILTER (grade = 2) AS grade_2, count(*) FILTER (grade = 1) AS grade_1, count(*) FILTER (grade = 0) AS grade_0, count(*) FILTER (grade IS NULL) AS unjudged FROM ranked WHERE place <= 3 GROUP BY 1"),
    "wilson_interval": (
        wilson_interval,
        "WITH n AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS wins, count(*) AS total FROM lineitem GROUP BY 1), x AS (SELECT *, wins / total AS p, 1.96::DOUBLE AS z FROM n) "
        "SELECT l_suppkey, wins, total, round(greatest(0, (p + z * z / (2 * total)) / (1 + z * z / total) - z * sqrt(p * (1 - p) / total + z * z / (4 * total * total)) / (1 + z * z / total)), 9) AS low, "
        "round(least(1, (p + z * z / (2 * total)) / (1 + z * z / total) + z * sqrt(p * (1 - p) / total + z * z / (4 * total * total)) / (1 + z * z / total)), 9) AS high FROM x",
    ),
    "pairwise_cube": (
        pairwise_cube,
        "SELECT o_custkey % 3 AS rival, o_orderpriority AS category, count(*) FILTER (o_orderstatus = 'F') AS ours, count(*) FILTER (o_orderstatus = 'O') AS theirs, count(*) FILTER (o_orderstatus = 'P') AS same, "
        "grouping_id(o_custkey % 3, o_orderpriority) AS level FROM orders GROUP BY CUBE (o_custkey % 3, o_orderpriority)",
    ),
    "blind_tally": (
        blind_tally,
        "WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place, o_orderkey % 3 AS owner FROM orders), "
        "q AS (SELECT o_custkey, min(place) FILTER (owner = 0) AS ours, arg_min(owner, place) AS first, min(place) FILTER (owner = 1) AS a, min(place) FILTER (owner = 2) AS b FROM r GROUP BY 1) "
        "SELECT first, count(*) AS questions, count(*) FILTER (ours < a) AS beats_a, count(*) FILTER (ours < b) AS beats_b FROM q GROUP BY 1",
    ),
    "feedback_summary": (feedback_summary, f"WITH {COMMENTS} SELECT kind, status, count(*) AS n, count(*) FILTER (score > 50) AS useful FROM comments GROUP BY ALL"),
    "nearest_rank_latency": (nearest_rank_latency, "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS max FROM events GROUP BY 1"),
    "max_matching": (max_matching, None),
    "rank_diff": (
        rank_diff,
        "WITH p AS (SELECT * FROM part), o AS (SELECT p_partkey, 'name' AS path, p_name AS value FROM p UNION ALL SELECT p_partkey, 'price', floor(p_retailprice)::BIGINT::VARCHAR FROM p UNION ALL SELECT p_partkey, 'size', p_size::VARCHAR FROM p WHERE p_partkey % 50 <> 0), "
        "n AS (SELECT p_partkey, 'name' AS path, p_name AS value FROM p WHERE p_partkey % 77 <> 0 UNION ALL SELECT p_partkey, 'price', floor(p_retailprice + CASE WHEN p_partkey % 9 = 0 THEN 10 ELSE 0 END)::BIGINT::VARCHAR FROM p UNION ALL SELECT p_partkey, 'size', p_size::VARCHAR FROM p) "
        "SELECT p_partkey, path, n.value AS new, o.value AS old FROM n FULL JOIN o USING (p_partkey, path) WHERE n.value IS DISTINCT FROM o.value",
    ),
}
