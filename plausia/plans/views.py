"""Views of the driver's tables in the shape of discussion data, for Spark and (as text) for DuckDB.

lineitem, orders and part stand for mentions of products, events for comments of threads, documents for texts of
writers, conversations for reply chains, part for a price list, labels for gold labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

ORDINAL = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mention for each line of an order; ordinal orders equal mentions by their whole row."""
    line, order, part = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    rows = (
        line.join(order.select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part.select("p_partkey", "p_name", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    )
    priority = F.substring("o_orderpriority", 1, 1)
    return rows.select(
        F.col("l_partkey").alias("product_key"),
        F.concat_ws(" ", "p_name", "p_partkey").alias("product_name"),
        F.col("p_brand").alias("category"),
        F.col("p_type").alias("kind_key"),
        F.floor(F.col("l_orderkey") / 30).alias("thread_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("comment_id"),
        F.when(F.col("l_suppkey") % 10 != 0, F.concat(F.lit("s"), F.col("l_suppkey"))).alias("author"),
        F.expr("CASE l_returnflag WHEN 'A' THEN 'recommend' WHEN 'R' THEN 'warn' ELSE 'neutral' END").alias("stance"),
        F.when(priority.isin("1", "2"), "high").when(priority == "5", "low").otherwise("medium").alias("voice"),
        F.when(F.col("l_quantity") >= 30, "long-term use").when(F.col("l_quantity") >= 10, "short-term use").otherwise("no first-hand use").alias("evidence"),
        F.floor(F.col("l_discount") * 40).cast("int").alias("honesty"),
        F.floor(F.col("l_extendedprice") / 1000).cast("int").alias("upvotes"),
        (F.col("l_linenumber") + F.lit(0)).cast("int").alias("products_named"),
        (F.col("l_tax") >= 0.04).alias("meets_need"),
        F.col("l_shipdate").alias("created_at"),
        F.struct(*ORDINAL).alias("ordinal"),
    )


MENTIONS = f"""mentions AS (
  SELECT l_partkey AS product_key, p_name || ' ' || p_partkey::VARCHAR AS product_name, p_brand AS category, p_type AS kind_key,
    floor(l_orderkey / 30)::BIGINT AS thread_id, l_orderkey * 8 + l_linenumber AS comment_id,
    CASE WHEN l_suppkey % 10 <> 0 THEN 's' || l_suppkey::VARCHAR END AS author,
    CASE l_returnflag WHEN 'A' THEN 'recommend' WHEN 'R' THEN 'warn' ELSE 'neutral' END AS stance,
    CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'high' WHEN substr(o_orderpriority, 1, 1) = '5' THEN 'low' ELSE 'medium' END AS voice,
    CASE WHEN l_quantity >= 30 THEN 'long-term use' WHEN l_quantity >= 10 THEN 'short-term use' ELSE 'no first-hand use' END AS evidence,
    floor(l_discount * 40)::INT AS honesty, floor(l_extendedprice / 1000)::INT AS upvotes, l_linenumber::INT AS products_named,
    l_tax >= 0.04 AS meets_need, l_shipdate AS created_at, {', '.join(ORDINAL)}
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
ORDINAL_SQL = ", ".join(ORDINAL)


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comment for each event: a thread is an hour's events of one kind and user group."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("comment_id"),
        F.concat_ws("-", F.date_format("ts", "yyyyMMdd"), F.col("event_type")).alias("thread_id"),
        F.when(k % 10 != 0, F.concat(F.lit("u"), F.col("user_id"))).alias("author"),
        F.col("event_type").alias("kind"),
        F.floor(F.col("value") - 10).cast("long").alias("score"),
        k.alias("k"),
        F.when(k < 3, "deleted").when(k < 6, "removed").when(k < 12, "not_kept").otherwise("ok").alias("status"),
        F.col("ts").alias("created_at"),
    )


COMMENTS = """comments AS (
  SELECT event_id AS comment_id, strftime(ts, '%Y%m%d') || '-' || event_type AS thread_id,
    CASE WHEN k % 10 <> 0 THEN 'u' || user_id::VARCHAR END AS author, event_type AS kind, floor(value - 10)::BIGINT AS score, k,
    CASE WHEN k < 3 THEN 'deleted' WHEN k < 6 THEN 'removed' WHEN k < 12 THEN 'not_kept' ELSE 'ok' END AS status, ts AS created_at
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("comment_id"), F.col("source").alias("author"), F.col("text").alias("body"), "lang")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of the price of a product at a shop, one for each line."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    rows = line.join(part.select("p_partkey", "p_name", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        F.col("l_partkey").alias("product_key"), "p_name", F.col("p_brand").alias("brand"), F.col("p_type").alias("product_type"),
        F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("double").alias("price"),
        F.when(F.col("l_suppkey") % 3 == 0, "USD").when(F.col("l_suppkey") % 3 == 1, "GBP").alias("currency"),
        F.format_string("shop%03d", F.col("l_suppkey")).alias("shop"), F.to_date("l_shipdate").alias("checked_on"),
        (F.col("l_returnflag") != "R").alias("available"), (F.col("l_linestatus") == "F").alias("second_hand"), F.col("l_orderkey").alias("entry"), F.col("l_linenumber").alias("line"),
    )


PRICES = """prices AS (
  SELECT l_partkey AS product_key, p_name, p_brand AS brand, p_type AS product_type, floor(l_extendedprice / l_quantity)::DOUBLE AS price,
    CASE l_suppkey % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'GBP' END AS currency, printf('shop%03d', l_suppkey) AS shop, CAST(l_shipdate AS DATE) AS checked_on,
    l_returnflag <> 'R' AS available, l_linestatus = 'F' AS second_hand, l_orderkey AS entry, l_linenumber AS line
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comment for each turn, answering the turn before."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("thread_id"), F.col("turn").alias("comment_id"), F.when(F.col("turn") % 3 != 0, F.col("turn") - 1).when(F.col("turn") > 0, F.col("turn") - 2).alias("parent_id"),
        F.col("role").alias("author"), F.col("text").alias("body"),
    )


REPLIES = """replies AS (
  SELECT conv_id AS thread_id, turn AS comment_id, CASE WHEN turn % 3 <> 0 THEN turn - 1 WHEN turn > 0 THEN turn - 2 END AS parent_id,
    role AS author, text AS body FROM conversations)"""


PHRASES = [
    "I have used it for 3 years, but it is overpriced", "sponsored by the shop, use my code", "my sister says it is better than mine", "avoid this one, it broke after 2 weeks", "never tried it, considering it",
    "which one do you recommend?", "still going after 10 years, holy grail", "just got it, so far so good", "I work for the brand", "see https://shop.example/x?ref=abc",
]


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations with a rule's words put in by number, as texts of discussions."""
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), ((F.col("conv_id") * 7 + F.col("turn")) % len(PHRASES) + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(phrase, F.lit(" "), "text").alias("text"))


TURNS = "turns AS (SELECT conv_id, turn, list_extract([" + ", ".join(f"'{p}'" for p in PHRASES) + f"], ((conv_id * 7 + turn) % {len(PHRASES)} + 1)::INT) || ' ' || text AS text FROM conversations)"
