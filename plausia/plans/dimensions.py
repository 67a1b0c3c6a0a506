"""Queries of the lists family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plausia.operators import dimensions as d
from plausia.plans.views import MENTIONS, PRICES, mentions, prices, table


def price_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return d.best_price(prices(spark, sf), F.lit("GBP"), "product_key")


def latest_availability(spark: SparkSession, sf: str) -> DataFrame:
    return d.latest_availability(prices(spark, sf), "product_key")


def sold_now(spark: SparkSession, sf: str) -> DataFrame:
    """Products still sold, new; products of which nothing is known stay."""
    a = latest_availability(spark, sf)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("product_key")).join(a.filter("not available").select("product_key"), "product_key", "left_anti")


def price_check(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("product_key"), "p_size").join(price_lookup(spark, sf), "product_key", "left")
    limit = F.when(F.col("p_size") % 7 != 0, F.col("p_size") * 100.0)
    status = d.price_check(F.col("price"), F.col("currency"), F.col("checked_on"), limit, F.lit("GBP"), F.lit("2001-11-01").cast("date"))
    return p.select("product_key", "price", status.alias("status"))


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    facts = F.map_from_entries(F.array_compact(F.array(
        F.when(F.col("p_size") % 2 == 0, F.struct(F.lit("induction").alias("k"), (F.col("p_size") % 4 == 0).cast("string").alias("v"))),
        F.when(F.col("p_size") % 3 == 0, F.struct(F.lit("vegan").alias("k"), (F.col("p_size") % 9 == 0).cast("string").alias("v"))),
    )))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("product_key"), facts.alias("facts"))


def facts_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame([("induction", "true", True), ("vegan", "true", False)], "fact string, value string, hard boolean")
    return d.fact_checks(_facts(spark, sf), rules)


def suited(spark: SparkSession, sf: str) -> DataFrame:
    """Products without a hard clash, fewest unconfirmed requirements first in each type."""
    from pyspark.sql import Window

    f = facts_conflicts(spark, sf).filter("conflict = 0").join(table(spark, sf, "part").select(F.col("p_partkey").alias("product_key"), "p_type"), "product_key")
    return f.withColumn("place", F.row_number().over(Window.partitionBy("p_type").orderBy("unconfirmed", "caution", "product_key"))).filter("place <= 10").select("p_type", "place", "product_key", "unconfirmed", "caution")


def current_model(spark: SparkSession, sf: str) -> DataFrame:
    v = mentions(spark, sf).filter("stance = 'recommend' and voice <> 'low'").select("product_key", F.when(F.col("products_named") != 3, F.to_date("created_at")).alias("written"), F.date_add(F.lit("1998-01-01").cast("date"), (F.col("product_key") % 2000).cast("int")).alias("released"))
    return d.current_model(v).select("product_key", F.round("share", 9).alias("share"), "superseded")


def upsert_list(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    new = p.filter("p_partkey % 10 = 3").select(F.col("p_partkey") + F.when(F.col("p_partkey") % 20 == 3, 1_000_000).otherwise(0), "p_brand", (F.col("p_retailprice") + 1)).toDF("p_partkey", "p_brand", "p_retailprice")
    return d.upserted(p, new, "p_partkey", "p_brand")


def missing_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Recommended products without a current price in the asked currency."""
    have = prices(spark, sf).filter("currency = 'GBP' and checked_on >= date'2001-01-01'").select("product_key")
    return mentions(spark, sf).filter("stance = 'recommend'").select("product_key").distinct().join(have, "product_key", "left_anti")


def release_dates(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    cut = F.when(F.col("o_orderkey") % 3 == 0, F.substring(text, 1, 4)).when(F.col("o_orderkey") % 3 == 1, F.substring(text, 1, 7)).otherwise(text)
    return o.select("o_orderkey", d.released_from(cut).alias("released"))


def clear_leaders(spark: SparkSession, sf: str) -> DataFrame:
    """For each kind of product the brand with the most recommended products, where it leads clearly."""
    n = mentions(spark, sf).filter("stance = 'recommend'").groupBy("kind_key", "category").agg(F.count(F.lit(1)).alias("n"))
    return d.leader(n, "kind_key", "category", "n", 2, 2)


def brand_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Brands that make at least two products of a type."""
    return table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.count_distinct("p_name").alias("names")).filter("names >= 2")


def title_share(spark: SparkSession, sf: str) -> DataFrame:
    """The share of a brand's threads that are titled with the type; at least half makes the brand a line."""
    t = mentions(spark, sf).groupBy("category", "thread_id").agg(F.bool_or(F.col("kind_key") == "ECONOMY").alias("titled"))
    return t.groupBy("category").agg(F.round(F.avg(F.col("titled").cast("double")), 9).alias("share")).withColumn("line", F.col("share") >= 0.5)


def fold_brand_picks(spark: SparkSession, sf: str) -> DataFrame:
    """Brands that step aside for a product of their own that qualifies too."""
    n = mentions(spark, sf).filter("stance = 'recommend' and voice = 'high'")
    products = n.groupBy("category", "product_key").agg(F.count(F.lit(1)).alias("n")).filter("n >= 8")
    brands = n.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return brands.join(products.select("category").distinct().withColumn("aside", F.lit(True)), "category", "left").select("category", "n", F.coalesce("aside", F.lit(False)).alias("aside"))


def customer_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Author enrichment: only empty fields are filled from a profile, and none is active since after their first comment."""
    first = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first"))
    c = table(spark, sf, "customer").join(first, F.col("c_custkey") == F.col("o_custkey"), "left")
    own = F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal"))
    since = F.least(F.date_add(F.lit("1995-01-01").cast("date"), (F.col("c_custkey") % 3000).cast("int")), F.to_date("first"))
    return c.select("c_custkey", F.coalesce(own, F.lit(0.0)).alias("karma"), since.alias("active_since"))


QUERIES = {
    "price_lookup": (price_lookup, f"WITH {PRICES} SELECT product_key, price, currency, shop, checked_on FROM prices QUALIFY row_number() OVER (PARTITION BY product_key ORDER BY currency IS DISTINCT FROM 'GBP', checked_on DESC, price, lower(shop)) = 1"),
    "latest_availability": (latest_availability, f"WITH {PRICES} SELECT product_key, available, second_hand, shop, checked_on FROM prices QUALIFY row_number() OVER (PARTITION BY product_key ORDER BY checked_on DESC, NOT available, second_hand, lower(shop)) = 1"),
    "sold_now": (sold_now, f"WITH {PRICES}, a AS (SELECT product_key, available FROM prices QUALIFY row_number() OVER (PARTITION BY product_key ORDER BY checked_on DESC, NOT available, second_hand, lower(shop)) = 1) SELECT p_partkey AS product_key FROM part WHERE p_partkey NOT IN (SELECT product_key FROM a WHERE NOT available)"),
    "price_check": (
        price_check,
        f"WITH {PRICES}, b AS (SELECT product_key, price, currency, checked_on FROM prices QUALIFY row_number() OVER (PARTITION BY product_key ORDER BY currency IS DISTINCT FROM 'GBP', checked_on DESC, price, lower(shop)) = 1) "
        "SELECT p_partkey AS product_key, price, CASE WHEN p_size % 7 = 0 THEN 'no budget' WHEN price IS NULL THEN 'unknown' WHEN currency IS DISTINCT FROM 'GBP' THEN 'other currency' "
        "WHEN datediff('day', checked_on, DATE '2001-11-01') > 30 THEN 'out of date' WHEN price > p_size * 100.0 THEN 'over' ELSE 'within' END AS status FROM part LEFT JOIN b ON product_key = p_partkey",
    ),
    "facts_conflicts": (
        facts_conflicts,
        "SELECT p_partkey AS product_key, (coalesce(p_size % 2 = 0 AND p_size % 4 = 0, false)::INT + (p_size % 3 = 0 AND p_size % 9 = 0)::INT)::BIGINT AS meets, (p_size % 2 = 0 AND p_size % 4 <> 0)::INT::BIGINT AS conflict, "
        "(p_size % 3 = 0 AND p_size % 9 <> 0)::INT::BIGINT AS caution, ((p_size % 2 <> 0)::INT + (p_size % 3 <> 0)::INT)::BIGINT AS unconfirmed FROM part",
    ),
    "suited": (
        suited,
        "WITH f AS (SELECT p_type, p_partkey AS product_key, (p_size % 3 = 0 AND p_size % 9 <> 0)::INT::BIGINT AS caution, ((p_size % 2 <> 0)::INT + (p_size % 3 <> 0)::INT)::BIGINT AS unconfirmed FROM part WHERE NOT (p_size % 2 = 0 AND p_size % 4 <> 0)) "
        "SELECT p_type, row_number() OVER (PARTITION BY p_type ORDER BY unconfirmed, caution, product_key) AS place, product_key, unconfirmed, caution FROM f QUALIFY place <= 10",
    ),
    "current_model": (
        current_model,
        f"WITH {MENTIONS}, v AS (SELECT product_key, CASE WHEN products_named <> 3 THEN CAST(created_at AS DATE) END AS w, DATE '1998-01-01' + (product_key % 2000)::INT AS r FROM mentions WHERE stance = 'recommend' AND voice <> 'low') "
        "SELECT product_key, round(avg((w < r)::INT::DOUBLE), 9) AS share, coalesce(avg((w < r)::INT::DOUBLE) > 0.5, false) AS superseded FROM v GROUP BY 1",
    ),
    "upsert_list": (
        upsert_list,
        "WITH n AS (SELECT p_partkey + CASE WHEN p_partkey % 20 = 3 THEN 1000000 ELSE 0 END AS p_partkey, p_brand, p_retailprice + 1 AS p_retailprice FROM part WHERE p_partkey % 10 = 3) "
        "SELECT p_partkey, p_brand, p_retailprice FROM part WHERE (p_partkey, p_brand) NOT IN (SELECT p_partkey, p_brand FROM n) UNION ALL SELECT * FROM n",
    ),
    "missing_entries": (missing_entries, f"WITH {PRICES}, {MENTIONS} SELECT DISTINCT product_key FROM mentions WHERE stance = 'recommend' AND product_key NOT IN (SELECT product_key FROM prices WHERE currency = 'GBP' AND checked_on >= DATE '2001-01-01')"),
    "release_dates": (release_dates, "SELECT o_orderkey, CAST(CASE o_orderkey % 3 WHEN 0 THEN date_trunc('year', o_orderdate) WHEN 1 THEN date_trunc('month', o_orderdate) ELSE o_orderdate END AS DATE) AS released FROM orders"),
    "clear_leaders": (
        clear_leaders,
        f"WITH {MENTIONS}, n AS (SELECT kind_key, category, count(*) AS n, row_number() OVER (PARTITION BY kind_key ORDER BY count(*) DESC, category DESC) AS r, coalesce(lead(count(*)) OVER (PARTITION BY kind_key ORDER BY count(*) DESC, category DESC), 0) AS nxt FROM mentions WHERE stance = 'recommend' GROUP BY 1, 2) "
        "SELECT kind_key, category, n FROM n WHERE r = 1 AND n >= 2 AND n >= nxt + 2",
    ),
    "brand_ranges": (brand_ranges, "SELECT p_brand, p_type, count(DISTINCT p_name) AS names FROM part GROUP BY 1, 2 HAVING names >= 2"),
    "title_share": (title_share, f"WITH {MENTIONS}, t AS (SELECT category, thread_id, bool_or(kind_key = 'ECONOMY') AS t FROM mentions GROUP BY 1, 2) SELECT category, round(avg(t::INT::DOUBLE), 9) AS share, avg(t::INT::DOUBLE) >= 0.5 AS line FROM t GROUP BY 1"),
    "fold_brand_picks": (
        fold_brand_picks,
        f"WITH {MENTIONS}, m AS (SELECT * FROM mentions WHERE stance = 'recommend' AND voice = 'high'), p AS (SELECT category FROM m GROUP BY category, product_key HAVING count(*) >= 8) "
        "SELECT category, count(*) AS n, category IN (SELECT category FROM p) AS aside FROM m GROUP BY 1",
    ),
    "customer_profiles": (
        customer_profiles,
        "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal ELSE 0 END AS karma, least(DATE '1995-01-01' + (c_custkey % 3000)::INT, CAST((SELECT min(o_orderdate) FROM orders WHERE o_custkey = c_custkey) AS DATE)) AS active_since FROM customer",
    ),
}
