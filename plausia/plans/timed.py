"""Queries of the time-based family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plausia.operators import timed as t
from plausia.plans.views import table

NOW = "2024-01-31 12:00:00"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def _checks(spark: SparkSession, sf: str) -> DataFrame:
    outcome = F.expr("CASE event_type WHEN 'error' THEN 'unreadable' WHEN 'signup' THEN 'changed' WHEN 'purchase' THEN 'deleted' ELSE 'passing' END")
    return table(spark, sf, "events").select(F.col("user_id").alias("comment_id"), F.col("ts").alias("at"), outcome.alias("outcome"))


_CHECKS = "checks AS (SELECT user_id AS comment_id, ts AS t, CASE event_type WHEN 'error' THEN 'unreadable' WHEN 'signup' THEN 'changed' WHEN 'purchase' THEN 'deleted' ELSE 'passing' END AS outcome FROM events)"
_LEDGER = f"""{_CHECKS}, l0 AS (SELECT comment_id, max(t) AS t, arg_max(outcome, t) AS outcome, max(t) FILTER (outcome = 'passing') AS last_pass, max(t) FILTER (outcome <> 'unreadable') AS r FROM checks GROUP BY 1),
ledger AS (SELECT comment_id, t AS "at", outcome, last_pass, (SELECT min(c.t) FROM checks c WHERE c.comment_id = l0.comment_id AND c.outcome = 'unreadable' AND (l0.r IS NULL OR c.t > l0.r)) AS unreadable_since FROM l0)"""


def ledger_latest_pass(spark: SparkSession, sf: str) -> DataFrame:
    return t.ledger(_checks(spark, sf))


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    collected = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval((F.col("comment_id") % 20).cast("int"))
    return t.ledger(_checks(spark, sf)).withColumns({"collected": collected, "use": F.col("comment_id") % 3})


def due_for_verification(spark: SparkSession, sf: str) -> DataFrame:
    e = _entries(spark, sf).withColumn("last_pass", F.col("last_pass") - F.make_dt_interval((F.col("comment_id") % 30).cast("int")))
    return t.due_list(e, _now(), 14, 25).select("comment_id", "deadline", "use")


def applied_checks(spark: SparkSession, sf: str) -> DataFrame:
    kept = spark.range(0, 400).select(F.col("id").alias("comment_id"), (F.lit("2023-12-20").cast("timestamp_ntz") + F.make_dt_interval((F.col("id") % 40).cast("int"))).alias("collected"))
    return t.applied(kept, t.ledger(_checks(spark, sf)), F.lit(NOW).cast("date")).select("comment_id", "state")


def cached_checks(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id")).alias("url"), F.col("ts").cast("timestamp_ntz").alias("at"))
    return t.cached_within(rows)


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select((F.col("user_id") % 10).alias("client"), F.col("ts").cast("timestamp_ntz").alias("at"), F.col("event_id").alias("request_id"))


def rate_limiter(spark: SparkSession, sf: str) -> DataFrame:
    return t.rate_limited(_requests(spark, sf), 2, 3600.0)


def attempts_in_window(spark: SparkSession, sf: str) -> DataFrame:
    """How many requests a client made in the 600 seconds up to each: attempts, accepted or not."""
    w = Window.partitionBy("client").orderBy("s").rangeBetween(-600_000_000, 0)
    return _requests(spark, sf).withColumn("s", F.unix_micros(F.col("at").cast("timestamp"))).withColumn("attempts", F.count(F.lit(1)).over(w)).select("request_id", "client", "attempts")


def token_bucket(spark: SparkSession, sf: str) -> DataFrame:
    return t.token_bucket(_requests(spark, sf), 4, 1800.0)


def fallback_due(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", t.fallback_due(F.col("c_custkey"), F.lit("2026-10-15").cast("date")).alias("due"))


def billing_months(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(t.billing_month(F.col("ts")).alias("month"), F.to_date(F.col("ts") - F.make_dt_interval(F.lit(0), F.lit(8))).alias("quota_day"))
    return e.groupBy("month", "quota_day").agg(F.count(F.lit(1)).alias("n"))


def years_before(spark: SparkSession, sf: str) -> DataFrame:
    """Calendar years before a day: 29 February becomes the 28th."""
    return table(spark, sf, "orders").select("o_orderkey", F.add_months(F.to_date("o_orderdate"), -12 * 3).alias("before"))


def within_calls(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    posts = o.select(F.col("o_custkey").cast("string").alias("request"), place.alias("place"), F.col("o_orderkey").alias("post_id"), (1 + F.floor(F.col("o_totalprice") / 50000)).cast("long").alias("cost"))
    return t.within_budget(posts, 15, 6)


def lapse_projection(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    pool = o.select(F.col("o_orderpriority").alias("library"), F.col("o_orderkey").alias("rank"), (F.col("o_custkey") % 20).cast("int").alias("opens"), (F.col("o_custkey") % 20 + F.col("o_orderkey") % 8).cast("int").alias("closes"))
    return t.projected_lapses(pool, 100)


def cost_projection(spark: SparkSession, sf: str) -> DataFrame:
    use = table(spark, sf, "events").select(F.col("event_type").alias("part"), F.col("ts").alias("at"), F.floor("value").cast("double").alias("seconds"))
    p = t.month_projection(use, F.lit("2024-01-20 12:00:00").cast("timestamp_ntz"), F.lit("2024-02-01 08:00:00").cast("timestamp_ntz"))
    return p.select("part", "spent", F.round("pace", 6).alias("pace"), F.round("projected", 4).alias("projected"))


def merged_candidates(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id")).alias("url"), F.col("event_id").alias("priority"), F.array(F.col("event_type"), F.when(F.col("event_id") % 2 == 0, "odd").otherwise("even")).alias("quotes"))
    return t.merged(c).select("url", "priority", F.array_join("quotes", ",").alias("quotes"))


def recent_union(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", F.col("ts").alias("at"), "event_id", "event_type")
    return t.latest_union(e.filter("event_type = 'view'"), e.filter("event_type = 'click'"), "user_id", "at", F.lit("2024-01-30").cast("timestamp_ntz"), 48).select("user_id", "at", "event_id", "event_type")


def server_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Requests that come while a server has said to wait."""
    e = table(spark, sf, "events")
    asked = e.filter("event_type <> 'error'").select(F.col("user_id").alias("client"), F.col("ts").alias("at"), F.col("event_id").alias("request_id"))
    said = e.filter("event_type = 'error'").select(F.col("user_id").alias("client"), F.col("ts").alias("at"), (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(6))).alias("until"))
    return t.server_blocked(asked, said).select("client", "request_id", "blocked")


def seeded_order(spark: SparkSession, sf: str) -> DataFrame:
    return t.seeded_order(table(spark, sf, "supplier").select("s_suppkey"), "s_suppkey", "2026-10-15")


def queue_waits(spark: SparkSession, sf: str) -> DataFrame:
    """Whole days that a place in a queue waits at a daily capacity, null beyond the month's."""
    place = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_orderdate", "o_orderkey"))
    q = table(spark, sf, "orders").select("o_orderkey", place.alias("place"))
    return q.select("o_orderkey", F.when(F.col("place") <= 2000, F.ceil(F.col("place") / 75)).alias("days"))


QUERIES = {
    "ledger_latest_pass": (ledger_latest_pass, f"WITH {_LEDGER} SELECT * FROM ledger"),
    "due_for_verification": (
        due_for_verification,
        f"WITH {_LEDGER}, e AS (SELECT comment_id, outcome, last_pass - to_days((comment_id % 30)::INT) AS p, TIMESTAMP '2024-01-01' + to_days((comment_id % 20)::INT) AS c, comment_id % 3 AS use FROM ledger) "
        f"SELECT comment_id, CAST(coalesce(p, c) AS DATE) + 30 AS deadline, use FROM e WHERE coalesce(p, c) <= TIMESTAMP '{NOW}' - INTERVAL 14 DAY AND outcome NOT IN ('deleted', 'removed', 'changed') ORDER BY deadline, use, coalesce(p, c), comment_id LIMIT 25",
    ),
    "applied_checks": (
        applied_checks,
        f"WITH {_LEDGER}, k AS (SELECT i AS comment_id, TIMESTAMP '2023-12-20' + to_days((i % 40)::INT) AS collected FROM range(0, 400) t(i)) "
        f"SELECT comment_id, CASE WHEN outcome IN ('deleted', 'removed', 'changed') AND (last_pass IS NULL OR \"at\" > last_pass) THEN 'dropped' WHEN DATE '2024-01-31' > CAST(coalesce(last_pass, collected) AS DATE) + 30 THEN 'expired' "
        "WHEN last_pass IS NOT NULL THEN 'verified' ELSE 'kept' END AS state FROM k LEFT JOIN ledger USING (comment_id)",
    ),
    "cached_checks": (cached_checks, None),
    "rate_limiter": (rate_limiter, None),
    "attempts_in_window": (attempts_in_window, "SELECT event_id AS request_id, user_id % 10 AS client, count(*) OVER (PARTITION BY user_id % 10 ORDER BY ts RANGE BETWEEN INTERVAL 600 SECONDS PRECEDING AND CURRENT ROW) AS attempts FROM events"),
    "token_bucket": (token_bucket, None),
    "fallback_due": (fallback_due, None),
    "billing_months": (billing_months, "SELECT date_trunc('month', ts - INTERVAL 8 HOUR)::TIMESTAMP + INTERVAL 8 HOUR AS month, CAST(ts - INTERVAL 8 HOUR AS DATE) AS quota_day, count(*) AS n FROM events GROUP BY ALL"),
    "years_before": (years_before, "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - INTERVAL 36 MONTH AS DATE) AS before FROM orders"),
    "within_calls": (within_calls, None),
    "lapse_projection": (lapse_projection, None),
    "cost_projection": (
        cost_projection,
        "WITH u AS (SELECT event_type AS part, ts, floor(value) AS s FROM events WHERE ts <= TIMESTAMP '2024-01-20 12:00:00'), p AS (SELECT part, sum(CASE WHEN ts >= TIMESTAMP '2024-01-01 08:00:00' THEN s ELSE 0 END)::DOUBLE AS spent, "
        "sum(CASE WHEN ts >= TIMESTAMP '2024-01-13 12:00:00' THEN s ELSE 0 END) / 7.0::DOUBLE AS pace FROM u GROUP BY 1) SELECT part, spent, round(pace, 6) AS pace, round(spent + (11 + 20 / 24.0::DOUBLE) * pace, 4) AS projected FROM p",
    ),
    "merged_candidates": (
        merged_candidates,
        "WITH q AS (SELECT user_id, event_id, unnest([event_type, CASE WHEN event_id % 2 = 0 THEN 'odd' ELSE 'even' END]) AS q, unnest([0, 1]) AS n FROM events), f AS (SELECT user_id, q, min(event_id * 2 + n) AS o FROM q GROUP BY 1, 2) "
        "SELECT 'u' || user_id::VARCHAR AS url, (SELECT min(event_id) FROM events e WHERE e.user_id = f.user_id) AS priority, string_agg(q, ',' ORDER BY o) AS quotes FROM f GROUP BY user_id",
    ),
    "recent_union": (
        recent_union,
        "SELECT user_id, ts AS \"at\", event_id, event_type FROM events WHERE event_type IN ('view', 'click') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AND ts > TIMESTAMP '2024-01-30' - INTERVAL 48 HOUR",
    ),
    "server_windows": (
        server_windows,
        "SELECT user_id AS client, event_id AS request_id, EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'error' AND x.ts <= e.ts AND e.ts < x.ts + INTERVAL 6 HOUR) AS blocked FROM events e WHERE event_type <> 'error'",
    ),
    "seeded_order": (seeded_order, "SELECT s_suppkey, row_number() OVER (ORDER BY sha256('2026-10-15:' || s_suppkey::VARCHAR), s_suppkey) AS place FROM supplier"),
    "queue_waits": (queue_waits, "WITH q AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS p FROM orders) SELECT o_orderkey, CASE WHEN p <= 2000 THEN ceil(p / 75.0)::BIGINT END AS days FROM q"),
}
