"""Queries of the threads family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plausia.operators import threads as t
from plausia.operators.order import numbered
from plausia.plans.views import COMMENTS, MENTIONS, REPLIES, comments, mentions, replies, table

#: The day that rules about age count from.
TODAY = "2024-02-15"


def readable_comments(spark: SparkSession, sf: str) -> DataFrame:
    return t.without_unusable(comments(spark, sf)).select("comment_id", "thread_id", "author", "score")


def library_stubs(spark: SparkSession, sf: str) -> DataFrame:
    return t.stubs(comments(spark, sf)).select("comment_id", "author", "score", "status")


def well_upvoted(spark: SparkSession, sf: str) -> DataFrame:
    return t.upvotes(comments(spark, sf)).select("comment_id", "thread_comments", F.round("share_beaten", 9).alias("share_beaten"), "sign")


def shown_comments_topk(spark: SparkSession, sf: str) -> DataFrame:
    return t.shown_comments(comments(spark, sf), 15).select("thread_id", "comment_id", "place", "score")


def first_seen(spark: SparkSession, sf: str) -> DataFrame:
    return t.first_seen(comments(spark, sf))


def flair_as_of(spark: SparkSession, sf: str) -> DataFrame:
    return t.flair_as_of(comments(spark, sf), F.when(F.col("k") % 4 == 0, F.concat(F.lit("flair"), F.col("k"))))


def newest_first_spans(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("thread_id"), F.col("o_orderdate").alias("created_at"))
    return t.newest_first_spans(orders).select("thread_id", "span")


def thread_relevance(spark: SparkSession, sf: str) -> DataFrame:
    named = mentions(spark, sf).groupBy("thread_id", "category").agg(F.count_distinct("comment_id").alias("talking"), F.bool_or(F.col("products_named") == 1).alias("titled"), F.bool_or(F.col("products_named") == 2).alias("posted"))
    return named.select("thread_id", "category", F.round(t.relevance(F.col("titled"), F.col("posted"), F.col("talking")), 6).alias("relevance"))


def need_led_order(spark: SparkSession, sf: str) -> DataFrame:
    """Threads of a category by span, by how many needs they meet, then by relevance."""
    m = mentions(spark, sf).groupBy("category", "thread_id").agg(F.max("created_at").alias("created_at"), F.count_if("meets_need").alias("needs"), F.count_distinct("comment_id").alias("talking"))
    spans = t.newest_first_spans(m)
    return spans.withColumn("place", F.row_number().over(Window.partitionBy("category").orderBy("span", F.desc("needs"), F.desc("talking"), "thread_id"))).select("category", "thread_id", "span", "needs", "place")


def post_score(spark: SparkSession, sf: str) -> DataFrame:
    """A ranking of posts by advice asked, age, talk and kind; posts of one kind are left out with a null score."""
    o = table(spark, sf, "orders")
    old = F.col("o_orderdate") < F.add_months(F.lit("1998-08-01").cast("date"), -36)
    score = t.post_score(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("o_orderstatus") == "F", F.col("o_custkey"), F.col("o_custkey") < 15, old, F.col("o_orderstatus") != "P")
    return o.select("o_orderkey", score.alias("score"))


def coverage_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    rows = comments(spark, sf).groupBy(F.to_date("created_at").alias("day")).pivot("kind", ["click", "error", "purchase", "signup", "view"]).agg(F.count(F.lit(1)))
    return rows.fillna(0)


def drop_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """The first rule that drops a comment, counted."""
    rules = [
        ("gone", F.col("status").isin("deleted", "removed")), ("too early", F.col("created_at") < F.lit("2024-01-05").cast("timestamp_ntz")), ("kind", F.col("kind") == "error"), ("score", F.col("score") < 0),
    ]
    return comments(spark, sf).withColumn("reason", t.first_reason(rules, "kept")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def recently_checked(spark: SparkSession, sf: str) -> DataFrame:
    """Threads by when they were last checked: live, else when collected unless from an archive; 14 calendar days."""
    c = comments(spark, sf).groupBy("thread_id").agg(F.max(F.when(F.col("k") > 80, F.col("created_at"))).alias("live"), F.min("created_at").alias("collected"), (F.min("k") == 0).alias("archive"))
    last = t.last_checked(F.col("live"), F.col("archive"), F.col("collected"))
    return c.select("thread_id", F.datediff(F.lit(TODAY).cast("date"), F.to_date(last)).alias("days"), F.coalesce(F.datediff(F.lit(TODAY).cast("date"), F.to_date(last)) <= 14, F.lit(False)).alias("recent"))


def due_for_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """Due after 30 days, or 90 where little happens."""
    c = comments(spark, sf).groupBy("thread_id").agg(F.max("created_at").alias("last"), F.count(F.lit(1)).alias("n"))
    days = t.days_between(F.lit(TODAY).cast("timestamp_ntz"), F.col("last"))
    return c.select("thread_id", days.alias("days"), t.refresh_due(days, F.col("n")).alias("due"))


def retention_expired(spark: SparkSession, sf: str) -> DataFrame:
    """Comments whose words may no longer be kept: unchecked for over 37 days from an archive, over 30 otherwise."""
    c = comments(spark, sf).filter("status = 'ok'")
    age = F.datediff(F.lit(TODAY).cast("date"), F.to_date("created_at"))
    return c.filter(t.retention_over(age, F.col("k") % 2 == 0)).select("comment_id", age.alias("age"))


def live_check_order(spark: SparkSession, sf: str) -> DataFrame:
    """Threads to check: quoted ones unchecked for 14 days first, then the rest unchecked for 30; never checked, oldest, id."""
    c = comments(spark, sf).groupBy("thread_id").agg(F.max(F.when(F.col("k") > 90, F.col("created_at"))).alias("checked"), F.bool_or(F.col("score") > 200).alias("quoted"))
    days = F.datediff(F.lit(TODAY).cast("date"), F.to_date("checked"))
    due = c.withColumn("days", days).withColumn("block", F.when(F.col("quoted") & (F.col("days").isNull() | (F.col("days") > 14)), 0).when(F.col("days").isNull() | (F.col("days") > 30), 1)).filter("block is not null")
    return numbered(due, "block", F.asc_nulls_first("checked"), "thread_id").select("thread_id", "block", "place")


def direct_answers(spark: SparkSession, sf: str) -> DataFrame:
    return replies(spark, sf).filter("parent_id is null or parent_id = 0").select("thread_id", "comment_id")


def reply_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return t.agreeing_replies(replies(spark, sf), F.length("a.body") % 2 == 0)


def thread_depth(spark: SparkSession, sf: str) -> DataFrame:
    return t.depths(replies(spark, sf))


def reply_tree_order(spark: SparkSession, sf: str) -> DataFrame:
    return t.preorder(replies(spark, sf), F.length("body") % 7)


def reading_view(spark: SparkSession, sf: str) -> DataFrame:
    """A thread as text: each comment with the first 120 characters of what it answers."""
    r, p = replies(spark, sf).alias("r"), replies(spark, sf).alias("p")
    joined = r.join(p, (F.col("r.thread_id") == F.col("p.thread_id")) & (F.col("r.parent_id") == F.col("p.comment_id")), "left")
    line = F.concat_ws(" | ", "r.author", F.concat(F.lit("> "), F.substring("p.body", 1, 120)), "r.body")
    rows = joined.select(F.col("r.thread_id").alias("thread_id"), F.col("r.comment_id").alias("comment_id"), line.alias("line"))
    return rows.groupBy("thread_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("comment_id", "line"))), lambda x: x["line"]), "\n").alias("view"))


def integrity_problems(spark: SparkSession, sf: str) -> DataFrame:
    at = F.make_dt_interval(F.lit(0), F.lit(0), F.when(F.col("comment_id") % 5 == 4, -1).otherwise(F.col("comment_id")).cast("int"))
    own = F.when((F.col("thread_id") + F.col("comment_id")) % 13 == 0, F.lit("x")).otherwise(F.col("comment_id").cast("string"))
    r = replies(spark, sf).withColumns({"created_at": F.lit("2024-01-01").cast("timestamp_ntz") + at, "url": F.concat(F.lit("https://site.example/"), F.col("thread_id").cast("string"), F.lit("/"), own, F.lit("/"))})
    broken = r.filter("comment_id <> 1 or thread_id % 5 <> 0")
    return t.integrity_problems(broken.unionByName(broken.filter("comment_id = 2 and thread_id % 7 = 0")))


def voice_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Voice level of customers' comments from the signs of their standing."""
    c = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    age = (F.col("o_orderkey") * 37 % 3000).cast("long")
    karma = F.floor(F.col("c_acctbal")).cast("long")
    signs = t.standing_signs(age, karma, F.col("c_custkey") % 2500)
    rows = c.select("o_orderkey", age.alias("age"), karma.alias("karma"), *(e.alias(n) for n, e in signs.items()))
    flags, worth = F.col("new_account").cast("int") + F.col("low_karma").cast("int"), F.col("established").cast("int") + F.col("well_regarded").cast("int")
    return rows.withColumn("voice", t.voice_level(flags, worth, F.col("o_orderkey") % 10 == 0))


def evidence_merge(spark: SparkSession, sf: str) -> DataFrame:
    """The decision table that merges two readings of a mention's evidence, over all combinations that occur."""
    m = mentions(spark, sf)
    h = F.col("comment_id")
    other = F.element_at(F.array(F.lit("no first-hand use"), F.lit("short-term use"), F.lit("long-term use"), F.lit("none given")), (h % 4 + 1).cast("int"))
    bits = {n: (F.floor(h / 2**i) % 2 == 1) for i, n in enumerate(("secondhand", "concrete", "first_person", "own_use", "someone_else", "verdict", "no_time"), start=2)}
    rows = m.select("evidence", other.alias("other"), *(e.alias(n) for n, e in bits.items())).distinct()
    return rows.withColumn("merged", t.evidence_merged(F.col("evidence"), F.col("other"), *(F.col(n) for n in bits)))


def recency(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a mention was written within three years of 365.25 days before a day."""
    days = t.days_between(F.lit("1999-01-01").cast("timestamp_ntz"), F.col("created_at"))
    return mentions(spark, sf).select("comment_id", "product_key", days.alias("days"), F.when(days / 365.25 <= 3, "recent").otherwise("old post").alias("sign"))


def old_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions kept for fast-moving kinds: not older than five years unless the product is known to be sold; unknown dates stay."""
    sold = table(spark, sf, "part").filter("p_size % 3 = 0").select(F.col("p_partkey").alias("product_key"), F.lit(True).alias("sold"))
    m = mentions(spark, sf).join(sold, "product_key", "left")
    cut = F.date_sub(F.lit("2003-01-01").cast("date"), round(365.25 * 5))
    return m.filter(F.col("created_at").isNull() | (F.to_date("created_at") >= cut) | F.col("sold")).groupBy("product_key").agg(F.count(F.lit(1)).alias("kept"))


def usable_posts(spark: SparkSession, sf: str) -> DataFrame:
    n = mentions(spark, sf).groupBy("thread_id").agg(F.count_distinct("comment_id").alias("comments"), F.min("category").alias("community"))
    return n.filter((F.col("comments") >= 10) & F.col("community").isin("Brand#1", "Brand#10", "Brand#11")).select("thread_id", "comments", "community")


def comment_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Comments of wanted posts only: a semi-join, then a count."""
    wanted = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf, "lineitem").select("l_orderkey").join(wanted, "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


def never_read(spark: SparkSession, sf: str) -> DataFrame:
    """Orders to read: not saved, not set aside."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    saved, aside = o.filter("o_orderpriority = '5-LOW'").select("o_orderkey"), o.filter("o_orderstatus = 'P'").select("o_orderkey")
    return o.select("o_orderkey").join(saved.unionByName(aside).distinct(), "o_orderkey", "left_anti")


def writers_kept(spark: SparkSession, sf: str) -> DataFrame:
    kept = mentions(spark, sf).filter("stance <> 'neutral' and voice = 'high'").select("author").unionByName(mentions(spark, sf).filter("products_named % 5 = 0").select("author"))
    every = mentions(spark, sf).filter("author is not null").select("author").distinct()
    return every.join(kept, "author", "left_semi")


def choose_mix(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    place = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    posts = o.select(F.col("c_mktsegment").alias("request"), place.alias("place"), F.col("o_orderkey").alias("post_id"), F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("community"))
    return t.choose_mix(posts, 12, {"F": 6, "O": 2, "P": 4}, 3)


def apportionment(spark: SparkSession, sf: str) -> DataFrame:
    return t.apportion(16, [("advice", 3), ("warning", 1), ("long_term", 2)], spark)


_AGE = f"datediff('day', CAST(created_at AS DATE), DATE '{TODAY}')"
_SIGNS = """floor(c_acctbal)::BIGINT AS karma, (o_orderkey * 37 % 3000)::BIGINT AS age, c_custkey % 2500 AS contributions"""
QUERIES = {
    "readable_comments": (readable_comments, f"WITH {COMMENTS} SELECT comment_id, thread_id, author, score FROM comments WHERE status = 'ok'"),
    "library_stubs": (library_stubs, f"WITH {COMMENTS} SELECT comment_id, CASE WHEN status NOT IN ('deleted', 'removed') THEN author END AS author, score, status FROM comments"),
    "well_upvoted": (
        well_upvoted,
        f"WITH {COMMENTS}, u AS (SELECT comment_id, score, count(*) OVER (PARTITION BY thread_id) AS thread_comments, percent_rank() OVER (PARTITION BY thread_id ORDER BY score) AS b FROM comments WHERE status IN ('ok', 'not_kept')) "
        "SELECT comment_id, thread_comments, round(b, 9) AS share_beaten, CASE WHEN score < 0 THEN 'downvoted' WHEN thread_comments > 1 AND score >= 3 AND b >= 0.75 THEN 'well upvoted' END AS sign FROM u",
    ),
    "shown_comments_topk": (
        shown_comments_topk,
        f"WITH {COMMENTS}, x AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY score DESC, created_at, comment_id) AS n FROM comments WHERE status = 'ok') "
        "SELECT thread_id, comment_id, row_number() OVER (PARTITION BY thread_id ORDER BY created_at, comment_id) AS place, score FROM x WHERE n <= 15",
    ),
    "first_seen": (first_seen, f"WITH {COMMENTS} SELECT thread_id, author, min(created_at) AS first_seen FROM comments WHERE author IS NOT NULL GROUP BY ALL"),
    "flair_as_of": (
        flair_as_of,
        f"WITH {COMMENTS}, f AS (SELECT *, CASE WHEN k % 4 = 0 THEN 'flair' || k::VARCHAR END AS flair FROM comments) SELECT author, flair, created_at AS as_of FROM f WHERE author IS NOT NULL AND flair IS NOT NULL "
        "QUALIFY row_number() OVER (PARTITION BY author ORDER BY created_at DESC, comment_id DESC) = 1",
    ),
    "newest_first_spans": (newest_first_spans, "SELECT o_orderkey AS thread_id, floor(floor((epoch_us(max(o_orderdate) OVER ()) - epoch_us(o_orderdate)) / 86400000000) / 365.25)::INT AS span FROM orders"),
    "thread_relevance": (
        thread_relevance,
        f"WITH {MENTIONS}, n AS (SELECT thread_id, category, count(DISTINCT comment_id) AS talking, bool_or(products_named = 1) AS titled, bool_or(products_named = 2) AS posted FROM mentions GROUP BY ALL) "
        "SELECT thread_id, category, round(3.0::DOUBLE * titled::INT + posted::INT + least(1.0::DOUBLE, talking / 5.0::DOUBLE), 6) AS relevance FROM n",
    ),
    "need_led_order": (
        need_led_order,
        f"WITH {MENTIONS}, n AS (SELECT category, thread_id, max(created_at) AS c, count(*) FILTER (meets_need) AS needs, count(DISTINCT comment_id) AS talking FROM mentions GROUP BY ALL), "
        "s AS (SELECT *, floor(floor((epoch_us(max(c) OVER ()) - epoch_us(c)) / 86400000000) / 365.25)::INT AS span FROM n) "
        "SELECT category, thread_id, span, needs, row_number() OVER (PARTITION BY category ORDER BY span, needs DESC, talking DESC, thread_id) AS place FROM s",
    ),
    "post_score": (
        post_score,
        "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN round((CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 3.0 ELSE 1.0 END + CASE WHEN o_orderstatus = 'F' THEN 0.5 ELSE 0 END "
        "- CASE WHEN o_custkey < 15 THEN 2.0 ELSE 0 END - CASE WHEN o_orderdate < DATE '1995-08-01' THEN 1.5 ELSE 0 END)::DOUBLE + log10(1 + o_custkey), 6) END AS score FROM orders",
    ),
    "coverage_by_kind": (
        coverage_by_kind,
        f"WITH {COMMENTS} SELECT CAST(created_at AS DATE) AS day, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in ("click", "error", "purchase", "signup", "view")) + " FROM comments GROUP BY 1",
    ),
    "drop_reasons": (
        drop_reasons,
        f"WITH {COMMENTS} SELECT CASE WHEN status IN ('deleted', 'removed') THEN 'gone' WHEN created_at < TIMESTAMP '2024-01-05' THEN 'too early' WHEN kind = 'error' THEN 'kind' WHEN score < 0 THEN 'score' ELSE 'kept' END AS reason, count(*) AS n FROM comments GROUP BY 1",
    ),
    "recently_checked": (
        recently_checked,
        f"WITH {COMMENTS}, c AS (SELECT thread_id, max(created_at) FILTER (k > 80) AS live, min(created_at) AS collected, min(k) = 0 AS archive FROM comments GROUP BY 1), "
        f"l AS (SELECT thread_id, datediff('day', CAST(coalesce(live, CASE WHEN NOT archive THEN collected END) AS DATE), DATE '{TODAY}')::INT AS days FROM c) SELECT thread_id, days, coalesce(days <= 14, false) AS recent FROM l",
    ),
    "due_for_refresh": (
        due_for_refresh,
        f"WITH {COMMENTS}, c AS (SELECT thread_id, floor((epoch_us(TIMESTAMP '{TODAY}') - epoch_us(max(created_at))) / 86400000000)::BIGINT AS days, count(*) AS n FROM comments GROUP BY 1) "
        "SELECT thread_id, days, days >= CASE WHEN n < 60 THEN 90 ELSE 30 END AS due FROM c",
    ),
    "retention_expired": (retention_expired, f"WITH {COMMENTS} SELECT comment_id, {_AGE}::INT AS age FROM comments WHERE status = 'ok' AND {_AGE} > CASE WHEN k % 2 = 0 THEN 37 ELSE 30 END"),
    "live_check_order": (
        live_check_order,
        f"WITH {COMMENTS}, c AS (SELECT thread_id, max(created_at) FILTER (k > 90) AS checked, bool_or(score > 200) AS quoted FROM comments GROUP BY 1), "
        f"d AS (SELECT *, datediff('day', CAST(checked AS DATE), DATE '{TODAY}') AS days FROM c), b AS (SELECT *, CASE WHEN quoted AND (days IS NULL OR days > 14) THEN 0 WHEN days IS NULL OR days > 30 THEN 1 END AS block FROM d) "
        "SELECT thread_id, block, row_number() OVER (ORDER BY block, checked NULLS FIRST, thread_id) AS place FROM b WHERE block IS NOT NULL",
    ),
    "direct_answers": (direct_answers, f"WITH {REPLIES} SELECT thread_id, comment_id FROM replies WHERE parent_id IS NULL OR parent_id = 0"),
    "reply_agreement": (
        reply_agreement,
        f"WITH {REPLIES} SELECT p.thread_id, p.comment_id, count(DISTINCT a.comment_id) AS replies_agree FROM replies a JOIN replies p ON a.thread_id = p.thread_id AND a.parent_id = p.comment_id "
        "WHERE length(a.body) % 2 = 0 AND NOT (a.author IS NOT NULL AND a.author IS NOT DISTINCT FROM p.author) GROUP BY 1, 2",
    ),
    "thread_depth": (
        thread_depth,
        f"WITH RECURSIVE {REPLIES}, t AS (SELECT r.thread_id, r.comment_id, 0 AS depth FROM replies r LEFT JOIN replies p ON p.thread_id = r.thread_id AND p.comment_id = r.parent_id WHERE p.comment_id IS NULL "
        "UNION ALL SELECT r.thread_id, r.comment_id, t.depth + 1 FROM t JOIN replies r ON r.thread_id = t.thread_id AND r.parent_id = t.comment_id) SELECT * FROM t",
    ),
    "reply_tree_order": (
        reply_tree_order,
        f"WITH RECURSIVE {REPLIES}, t AS (SELECT thread_id, comment_id, 0 AS depth, [(100000 - length(body) % 7) * 100000000 + comment_id] AS path FROM replies WHERE parent_id IS NULL "
        "UNION ALL SELECT r.thread_id, r.comment_id, t.depth + 1, list_append(t.path, (100000 - length(r.body) % 7) * 100000000 + r.comment_id) FROM t JOIN replies r ON r.thread_id = t.thread_id AND r.parent_id = t.comment_id) "
        "SELECT thread_id, comment_id, depth, row_number() OVER (PARTITION BY thread_id ORDER BY path) AS place FROM t",
    ),
    "reading_view": (
        reading_view,
        f"WITH {REPLIES} SELECT r.thread_id, string_agg(concat_ws(' | ', r.author, '> ' || substr(p.body, 1, 120), r.body), chr(10) ORDER BY r.comment_id) AS view FROM replies r "
        "LEFT JOIN replies p ON p.thread_id = r.thread_id AND p.comment_id = r.parent_id GROUP BY 1",
    ),
    "integrity_problems": (
        integrity_problems,
        f"WITH {REPLIES}, b AS (SELECT *, CASE WHEN comment_id % 5 = 4 THEN -1 ELSE comment_id END AS at, (thread_id + comment_id) % 13 = 0 AS wrong FROM replies WHERE comment_id <> 1 OR thread_id % 5 <> 0), "
        "c AS (SELECT * FROM b UNION ALL SELECT * FROM b WHERE comment_id = 2 AND thread_id % 7 = 0) "
        "SELECT thread_id, comment_id, 'repeated id' AS problem FROM c GROUP BY ALL HAVING count(*) > 1 "
        "UNION ALL SELECT thread_id, comment_id, 'parent not found' FROM c WHERE parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c p WHERE p.thread_id = c.thread_id AND p.comment_id = c.parent_id) "
        "UNION ALL SELECT DISTINCT c.thread_id, c.comment_id, 'older than its parent' FROM c JOIN c p ON p.thread_id = c.thread_id AND p.comment_id = c.parent_id AND c.at < p.at "
        "UNION ALL SELECT DISTINCT thread_id, comment_id, 'link of another comment' FROM c WHERE wrong",
    ),
    "voice_level": (
        voice_levels,
        f"WITH s AS (SELECT o_orderkey, {_SIGNS} FROM customer JOIN orders ON c_custkey = o_custkey), "
        "f AS (SELECT *, age < 30 AS new_account, age >= 730.5 AND karma >= 1000 AS established, CASE WHEN karma < 0 THEN true WHEN contributions > 0 THEN karma / contributions < 1 ELSE false END AS low_karma, "
        "coalesce(CASE WHEN karma < 0 THEN false WHEN contributions > 0 THEN karma / contributions >= 5 ELSE karma / nullif(age / 365.25, 0) >= 2000 END, false) AS well_regarded FROM s) "
        "SELECT o_orderkey, age, karma, new_account, established, low_karma, well_regarded, CASE WHEN new_account::INT + low_karma::INT >= 2 THEN 'low' "
        "WHEN established::INT + well_regarded::INT >= 2 AND new_account::INT + low_karma::INT = 0 AND o_orderkey % 10 <> 0 THEN 'high' ELSE 'medium' END AS voice FROM f",
    ),
    "evidence_merge": (
        evidence_merge,
        f"WITH {MENTIONS}, r AS (SELECT DISTINCT evidence, CASE comment_id % 4 WHEN 0 THEN 'no first-hand use' WHEN 1 THEN 'short-term use' WHEN 2 THEN 'long-term use' ELSE 'none given' END AS other, "
        + ", ".join(f"(comment_id >> {i}) % 2 = 1 AS {n}" for i, n in enumerate(("secondhand", "concrete", "first_person", "own_use", "someone_else", "verdict", "no_time"), start=2))
        + " FROM mentions) SELECT *, CASE WHEN other IN ('short-term use', 'long-term use') AND secondhand AND evidence <> 'no first-hand use' AND NOT own_use AND (someone_else OR verdict) THEN 'no first-hand use' "
        "WHEN other IN ('short-term use', 'long-term use') AND evidence = 'no first-hand use' AND NOT secondhand AND (concrete OR first_person) THEN other "
        "WHEN other = 'long-term use' AND evidence = 'short-term use' AND (no_time OR verdict) AND NOT secondhand AND (concrete OR first_person) THEN 'long-term use' "
        "WHEN other = 'no first-hand use' AND evidence <> 'no first-hand use' AND NOT (verdict AND NOT secondhand) THEN 'no first-hand use' ELSE evidence END AS merged FROM r",
    ),
    "recency": (
        recency,
        f"WITH {MENTIONS}, d AS (SELECT comment_id, product_key, floor((epoch_us(TIMESTAMP '1999-01-01') - epoch_us(created_at)) / 86400000000)::BIGINT AS days FROM mentions) SELECT *, CASE WHEN days / 365.25 <= 3 THEN 'recent' ELSE 'old post' END AS sign FROM d",
    ),
    "old_evidence": (
        old_evidence,
        f"WITH {MENTIONS} SELECT product_key, count(*) AS kept FROM mentions WHERE created_at IS NULL OR CAST(created_at AS DATE) >= DATE '2003-01-01' - 1826 OR product_key IN (SELECT p_partkey FROM part WHERE p_size % 3 = 0) GROUP BY 1",
    ),
    "usable_posts": (usable_posts, f"WITH {MENTIONS} SELECT thread_id, count(DISTINCT comment_id) AS comments, min(category) AS community FROM mentions GROUP BY 1 HAVING comments >= 10 AND community IN ('Brand#1', 'Brand#10', 'Brand#11')"),
    "comment_counts": (comment_counts, "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1"),
    "never_read": (never_read, "SELECT o_orderkey FROM orders WHERE NOT (o_orderpriority = '5-LOW' OR o_orderstatus = 'P')"),
    "writers_kept": (writers_kept, f"WITH {MENTIONS} SELECT DISTINCT author FROM mentions WHERE author IS NOT NULL AND ((stance <> 'neutral' AND voice = 'high') OR products_named % 5 = 0)"),
    "choose_mix": (choose_mix, None),
    "apportionment": (
        apportionment,
        "WITH k(o, kind, w) AS (VALUES (0, 'advice', 3), (1, 'warning', 1), (2, 'long_term', 2)), s AS (SELECT *, 16 * w / 6.0 AS x FROM k), "
        "r AS (SELECT *, floor(x)::BIGINT AS b, row_number() OVER (ORDER BY x - floor(x) DESC, o) AS n FROM s) SELECT kind, b + CASE WHEN n <= 16 - sum(b) OVER () THEN 1 ELSE 0 END AS target FROM r",
    ),
}
