"""Queries from ranked groups to what is shown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plausia.operators import answers as a, assembly as s, ranking as r
from plausia.operators.order import numbered
from plausia.plans.ranking import _CREDIBLE, _RANKED, placements
from plausia.plans.ranking import _kinds as kinds_of
from plausia.plans.ranking import _ranked as ranked
from plausia.plans.views import COMMENTS, MENTIONS, ORDINAL_SQL, PRICES, REPLIES, comments, mentions, prices, replies, table

HOSTS = ("shop001.example", "shop007.example", "shop012.example")


def groups_to_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of a request by why they are left out."""
    asked = F.when(F.col("p_partkey") % 2 == 0, "SMALL")
    kind = F.when(F.col("p_size") % 10 != 0, F.col("p_type"))
    why = s.exclusion(F.col("p_brand"), F.when(F.col("p_partkey") % 7 == 0, "Brand#1").otherwise(F.col("p_brand")), kind, asked, F.col("p_size") % 4 == 1, F.col("p_size") % 9 == 2)
    return table(spark, sf, "part").groupBy(F.coalesce(why, F.lit("ranked")).alias("reason")).agg(F.count(F.lit(1)).alias("groups"))


def sets_left_out(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat_ws(" ", "p_name", F.when(F.col("p_size") % 5 == 0, "Set"))
    asked = F.when(F.col("p_partkey") % 2 == 0, "set")
    return table(spark, sf, "part").filter(s.without_sets(name, ("set", "bolt"), asked)).groupBy("p_type").agg(F.count(F.lit(1)).alias("kept"))


def other_kinds_left_out(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions left in each group once those typed as another kind are gone."""
    p = table(spark, sf, "part").select("p_name", F.when(F.col("p_size") % 6 != 0, F.col("p_type")).alias("kind"))
    return s.of_majority_kind(p, "p_name").groupBy("p_name").agg(F.count(F.lit(1)).alias("mentions"), F.count_distinct("kind").alias("kinds"))


def formulas_folded(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat("p_name", F.when(F.col("p_partkey") % 4 == 0, " (New Formula)").when(F.col("p_partkey") % 4 == 1, " old version").otherwise(""))
    m = table(spark, sf, "part").select(F.col("p_brand").alias("category"), name.alias("name"))
    return s.folded_formulas(m).groupBy("category", "name").agg(F.count(F.lit(1)).alias("n"))


def _branded(rows: DataFrame) -> DataFrame:
    return rows.withColumn("brand", F.split("product_name", " ")[0])


def brand_skips(spark: SparkSession, sf: str) -> DataFrame:
    """What to skip, and what is a downside of a pick of its brand instead."""
    products = _branded(ranked(spark, sf))
    left, folded = s.folded_skips(r.picks(products), r.skip_list(products))
    return left.select("category", "product_key", F.lit(None).cast("long").alias("of_pick")).unionByName(folded.select("category", "product_key", "of_pick"))


def worth_beside_picks(spark: SparkSession, sf: str) -> DataFrame:
    products = _branded(ranked(spark, sf))
    chosen = r.picks(products)
    return s.worth_left_out(r.worth_a_look(products, chosen), chosen).select("category", "product_key", "brand")


def worth_items(spark: SparkSession, sf: str) -> DataFrame:
    """Products worth a look, each with two quotes at most."""
    products = ranked(spark, sf)
    worth = r.worth_a_look(products, r.picks(products))
    rows = r.thread_upvotes(mentions(spark, sf)).withColumn("weight", r.mention_weight())
    best = a.best_mentions(rows, worth, "recommend", 2, [F.desc("weight"), F.desc("upvotes"), F.col("ordinal")])
    return best.select("category", "product_key", "shown", "comment_id")


def kinds_left_out(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds that clash with what a category's request asks for, and the kind that it names itself."""
    k = placements(spark, sf).select("category", F.col("kind_key").alias("kind")).distinct()
    facts = k.withColumns({"fact": F.lit("size"), "value": F.when(F.col("kind").isin("SMALL", "MEDIUM"), "small").when(F.col("kind") == "LARGE", "large").otherwise("any")})
    asked = k.select("category").distinct().withColumns({"fact": F.lit("size"), "value": F.when(F.length("category") == 7, "small").otherwise("any"), "kind_asked": F.lit("PROMO")})
    return s.unsuited_kinds(k, facts, asked)


def warnings_counted(spark: SparkSession, sf: str) -> DataFrame:
    return s.counted_warnings(mentions(spark, sf), ~F.col("meets_need") & (F.col("products_named") > 3)).select("category", "product_key", "warnings", "counted", "could_skip")


def brand_entries(spark: SparkSession, sf: str) -> DataFrame:
    """The entry of a list for each brand and kind: written in another order of words, of the kind asked for or of none."""
    p = table(spark, sf, "part")
    entries = p.filter("p_partkey % 3 = 0").select(F.lit("x").alias("category"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("kind"), F.concat_ws(" ", F.reverse(F.split("p_name", " "))).alias("name"), F.col("p_retailprice").alias("price"), F.col("p_partkey").alias("entry"))
    asked = p.select(F.lit("x").alias("category"), F.col("p_type").alias("kind"), F.col("p_name").alias("name")).distinct()
    return s.entry_by_words(asked, entries, [F.col("price"), F.col("entry")], ["price", "entry"]).select("kind", "name", "price", "entry")


def brand_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The line that a brand's name, or another name of it, stands for with a kind."""
    p = table(spark, sf, "part")
    lines = p.groupBy("p_brand", "p_type").agg(F.min("p_retailprice").alias("from_price"), F.count(F.lit(1)).alias("products"))
    names = F.array(F.col("p_brand"), F.regexp_replace("p_brand", "Brand#", "House "))
    entries = lines.select(F.lit("x").alias("category"), F.col("p_type").alias("kind"), F.explode(names).alias("name"), "p_brand", "from_price", "products")
    asked = p.select(F.lit("x").alias("category"), F.col("p_type").alias("kind"), F.concat(F.lit("house "), F.regexp_extract("p_brand", "#(.*)", 1)).alias("name")).distinct()
    return s.entry_by_words(asked, entries, [F.col("from_price"), F.col("p_brand")], ["p_brand", "from_price", "products"]).select("kind", "name", "p_brand", "from_price", "products")


def sales(spark: SparkSession, sf: str) -> DataFrame:
    e = prices(spark, sf).withColumn("url", F.concat(F.lit("https://www."), "shop", F.lit(".example/p/1")))
    return s.sale(e, HOSTS, F.lit("2001-06-30").cast("date"))


def quote_gate(spark: SparkSession, sf: str) -> DataFrame:
    q = replies(spark, sf).select(F.col("thread_id").alias("answer"), "body", F.when((F.col("thread_id") * 3 + F.col("comment_id")) % 11 == 0, F.concat(F.substring("body", 1, 20), F.lit(" zz"))).otherwise(F.element_at(F.split("body", r"[.,]"), 1)).alias("quote"))
    return s.gated(q)


def kinds_to_look_for(spark: SparkSession, sf: str) -> DataFrame:
    kinds = kinds_of(spark, sf)
    shown = r.picks(ranked(spark, sf)).filter("pick = 1").select("category", "kind_key")
    return s.look_for(kinds, shown, r.warned_off_kinds(kinds)).select("category", "kind_key", "place", "support")


def tips_for_picks(spark: SparkSession, sf: str) -> DataFrame:
    t = mentions(spark, sf).filter("products_named in (2, 3)").select("category", "product_key", (F.col("upvotes") % 5).alias("cluster"), "voice", F.col("comment_id").alias("ordinal"))
    return s.tips_shown(t, r.picks(ranked(spark, sf))).select("category", "product_key", "cluster", "given", "shown")


def check_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """What checks of quotes from turns would say."""
    status = F.when(F.col("turn") % 6 == 5, F.lit(None).cast("string")).when(F.col("turn") % 5 == 4, "deleted").otherwise("ok")
    body = F.when(F.col("conv_id") % 9 != 0, F.when(F.col("conv_id") % 4 == 0, F.replace("text", F.lit("e"), F.lit("a"))).otherwise(F.col("text")))
    quote = F.element_at(F.split("text", "[.,]"), 1)
    return table(spark, sf, "conversations").select("conv_id", "turn", s.check_outcome(status, body, quote).alias("outcome"))


def edited_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items kept once some comments are edited."""
    items = replies(spark, sf).select((F.col("thread_id") * 100 + F.col("comment_id")).alias("comment_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("item"), "body").withColumn("quote", F.element_at(F.split("body", "[.,]"), F.col("item")))
    items = items.filter("quote is not null and trim(quote) <> ''")
    edited = replies(spark, sf).filter("thread_id % 3 = 0").select((F.col("thread_id") * 100 + F.col("comment_id")).alias("comment_id"), F.element_at(F.split("body", "[.,]"), 1).alias("body"))
    return s.kept_after_edit(items.drop("body"), edited).groupBy("item").agg(F.count_if("kept").alias("kept"), F.count(F.lit(1)).alias("items"))


def words_to_restore(spark: SparkSession, sf: str) -> DataFrame:
    c = comments(spark, sf)
    checks = c.select("comment_id", F.col("created_at").alias("at"), F.when(F.col("k") % 3 == 0, "changed").otherwise("passing").alias("outcome"))
    return s.restorable(c.filter("k < 60").select("thread_id", "comment_id", "score"), c.filter("score > 40").select("thread_id", "comment_id"), checks).groupBy("thread_id").agg(F.count(F.lit(1)).alias("restored"))


def read_ahead(spark: SparkSession, sf: str) -> DataFrame:
    """Requests in the order in which to read ahead for them: by priority, the stalest, the most asked."""
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderpriority").alias("priority"), F.max("o_orderdate").alias("last"), F.count(F.lit(1)).alias("asked"))
    return numbered(o, "priority", "last", F.desc("asked"), "o_custkey").select("o_custkey", "place")


def own_site_signs(spark: SparkSession, sf: str) -> DataFrame:
    brand = F.split("p_name", " ")[1]
    link = F.concat(F.lit("https://www."), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.split("p_name", " ")[0], F.lit("-"), brand)).otherwise("other"), F.lit(".example/x"))
    body = F.concat(F.lit("Nice thread.\n"), F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("The team at "), F.initcap(brand))).otherwise("Bye"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(s.own_site(link, F.initcap("p_name"), body, brand), ";").alias("signs"))


def mention_badges(spark: SparkSession, sf: str) -> DataFrame:
    voice = F.when(F.col("voice") == "high", F.array(F.lit("established"), F.lit("verified"))).when(F.col("voice") == "medium", F.array(F.lit("established")))
    evidence = F.when(F.col("evidence") == "long-term use", F.array(F.lit("long use"), F.lit("verified")))
    return mentions(spark, sf).groupBy(F.array_join(s.badges(voice, evidence), ",").alias("badges")).agg(F.count(F.lit(1)).alias("n"))


def categories_of_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Threads by their category for a request."""
    c = comments(spark, sf).select("thread_id", "kind").distinct()
    return c.groupBy(s.request_category(F.col("kind"), F.col("kind").isin("click", "view"), F.lit("signup")).alias("category")).agg(F.count(F.lit(1)).alias("threads"))


def slim_check(spark: SparkSession, sf: str) -> DataFrame:
    """What answers would read differently from a slimmed library."""
    whole = replies(spark, sf).select("thread_id", F.lower(F.split("body", " ")[0]).alias("word"))
    slim = replies(spark, sf).filter("comment_id % 4 <> 3").select("thread_id", F.lower(F.split("body", " ")[0]).alias("word"))
    return s.slim_differences(whole, slim).groupBy("thread_id", "side").agg(F.count(F.lit(1)).alias("n"))


def comments_of_posts(spark: SparkSession, sf: str) -> DataFrame:
    wanted = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("post_id"))
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("post_id"), (F.col("l_linenumber") * 100_000 + F.col("l_partkey")).alias("comment_id"), F.col("l_quantity").cast("int").alias("score"))
    return s.collected(rows, wanted).select("post_id", F.size("comments").alias("n"), F.array_join(F.transform("comments", lambda x: F.concat(x["comment_id"].cast("string"), F.lit(":"), x["score"].cast("string"))), ",").alias("comments"))


RENAMES = {"cold": "KOLD", "large bolt": "Big Bolt", "red": "Rouge"}


def shown_spelling(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", s.maker_spelling(F.col("p_name"), RENAMES).alias("shown"), s.line_name(F.col("p_brand"), F.lower("p_type"), F.when(F.col("p_size") > 40, F.array(F.lit("retinol"))).otherwise(F.array().cast("array<string>"))).alias("line"))


def need_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mentions(spark, sf).groupBy("category").agg(F.round(s.need_share(F.col("meets_need"), r.is_credible()), 9).alias("share"))


def case_scores(spark: SparkSession, sf: str) -> DataFrame:
    """End-to-end cases: what was expected of a request and what came out, aspect by aspect."""
    p = table(spark, sf, "part")
    cases = p.select(
        F.when(F.col("p_size") % 4 != 0, F.col("p_type")).alias("want_type"), F.when(F.col("p_partkey") % 10 != 0, F.col("p_type")).alias("got_type"),
        F.lit("ok").alias("want_status"), F.when(F.col("p_size") == 7, "clarify").otherwise("ok").alias("got_status"), F.when(F.col("p_size") > 45, F.lit(1)).alias("want_need"), F.lit(2).alias("got_need"),
    )
    return s.case_scores(cases, "type", "status", "need")


def items_verified(spark: SparkSession, sf: str) -> DataFrame:
    c = comments(spark, sf)
    checks = c.select("comment_id", F.col("created_at").alias("at"), F.when(F.col("k") % 4 == 0, "changed").otherwise("passing").alias("outcome"))
    return s.verified_items(c.select("comment_id", "thread_id"), checks, F.lit("2024-01-20").cast("timestamp_ntz")).groupBy("thread_id").agg(F.count(F.lit(1)).alias("items"))


def ethics_review(spark: SparkSession, sf: str) -> DataFrame:
    """Items once a review's decisions are applied."""
    items = replies(spark, sf).select("thread_id", "comment_id", F.substring("body", 1, 12).alias("quote"))
    action = F.when(F.col("comment_id") % 3 == 0, "remove").otherwise("requote")
    decisions = replies(spark, sf).filter("thread_id % 4 = 1").select("thread_id", "comment_id", action.alias("action"), F.substring("body", 1, 5).alias("quote"))
    return s.reviewed(items, decisions, "thread_id", "comment_id")


def naming_points(spark: SparkSession, sf: str) -> DataFrame:
    n = mentions(spark, sf).groupBy("thread_id", "product_key").agg(F.count_distinct("comment_id").alias("comments"))
    return n.groupBy("thread_id").agg(F.sum(s.naming_points(F.col("comments"))).alias("points"))


def library_search(spark: SparkSession, sf: str) -> DataFrame:
    m = mentions(spark, sf).groupBy("category", "thread_id").agg(F.count_if("meets_need").alias("needs"), F.count_distinct(F.when(F.col("stance") != "neutral", F.col("comment_id"))).alias("relevance"), F.max("created_at").alias("last"))
    span = F.when(F.col("last") >= F.lit("2000-01-01").cast("timestamp_ntz"), 0).otherwise(1)
    return s.searched(m.withColumn("span", span), 10).select("category", "thread_id", "place")


def requirement_rules(spark: SparkSession, sf: str) -> DataFrame:
    """How many products of each request meet, clash with or don't confirm what it asks for."""
    rules = spark.createDataFrame([("gas", None, "hob", "gas", True), ("gas", "SMALL", "size", "small", False), ("light", None, "size", "small", True)], "ask string, kind string, fact string, value string, hard boolean")
    asks = spark.createDataFrame([("r1", "gas"), ("r2", "light"), ("r3", "gas"), ("r3", "light")], "request string, ask string")
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("product_key"), F.col("p_type").alias("kind"), "p_size")
    facts = p.select("product_key", "kind", F.inline(F.array(F.struct(F.lit("hob").alias("fact"), F.when(F.col("p_size") % 3 == 0, "gas").when(F.col("p_size") % 3 == 1, "induction").alias("value")), F.struct(F.lit("size").alias("fact"), F.when(F.col("p_size") < 20, "small").alias("value")))))
    by = s.unconfirmed(asks, rules, facts)
    return by.groupBy("request", "meets", "conflict", "caution", "unconfirmed").agg(F.count(F.lit(1)).alias("products"))


def profiles_in_use(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "customer").select(F.col("c_custkey").alias("writer"), F.floor("c_acctbal").alias("karma"), (F.col("c_custkey") % 7 - 2).alias("contributions"), F.date_sub(F.lit("2024-03-01").cast("date"), (F.col("c_custkey") % 60).cast("int")).alias("looked_up"))
    return s.fresh_profiles(p, F.lit("2024-03-01").cast("date"))


def lines_folded(spark: SparkSession, sf: str) -> DataFrame:
    """Picks that are lines, with the product shown in their place."""
    products = _branded(ranked(spark, sf)).withColumn("is_line", F.col("product_key") % 3 == 0)
    return s.folded_lines(r.picks(products), products.filter("qualifies")).select("category", "pick", "product_key", "is_line", "instead")


def library_pass(spark: SparkSession, sf: str) -> DataFrame:
    c = comments(spark, sf).groupBy("thread_id").agg(F.max(F.when(F.col("k") > 85, F.col("created_at"))).alias("checked"), (F.min("k") == 0).alias("archived"))
    return s.read_or_expired(c, 40, F.lit("2024-02-20").cast("date")).select("thread_id", "place", "state")


_KEY = "array_to_string(list_sort(list_distinct(regexp_extract_all(lower(name), '[\\p{L}\\p{N}'']+'))), ' ')"
_BRAND = "string_split(product_name, ' ')[1]"
_SKIPS = "skips AS (SELECT * FROM ranked WHERE on_skip_list QUALIFY row_number() OVER (PARTITION BY category ORDER BY credible_warnings DESC, score, lower(product_name), product_key) <= 5)"
_WORTH = (
    "rest AS (SELECT *, CASE WHEN on_its_own THEN 0 WHEN worth_a_look AND NOT by_standout THEN 1 WHEN worth_a_look THEN 2 END AS block FROM ranked ANTI JOIN picks USING (category, product_key)), "
    "worth AS (SELECT * FROM rest WHERE block IS NOT NULL QUALIFY row_number() OVER (PARTITION BY category ORDER BY block, place) <= 3)"
)
QUERIES = {
    "items_verified": (items_verified, f"WITH {COMMENTS} SELECT thread_id, count(*) AS items FROM comments WHERE k % 4 <> 0 AND created_at >= TIMESTAMP '2024-01-20' GROUP BY 1"),
    "ethics_review": (
        ethics_review,
        f"WITH {REPLIES} SELECT thread_id, comment_id, CASE WHEN thread_id % 4 = 1 THEN substr(body, 1, 5) ELSE substr(body, 1, 12) END AS quote FROM replies WHERE NOT (thread_id % 4 = 1 AND comment_id % 3 = 0)",
    ),
    "naming_points": (naming_points, f"WITH {MENTIONS}, n AS (SELECT thread_id, product_key, count(DISTINCT comment_id) AS c FROM mentions GROUP BY ALL) SELECT thread_id, sum(least(3.0, 0.5 * c))::DOUBLE AS points FROM n GROUP BY 1"),
    "library_search": (
        library_search,
        f"WITH {MENTIONS}, m AS (SELECT category, thread_id, count(*) FILTER (meets_need) AS needs, count(DISTINCT comment_id) FILTER (stance <> 'neutral') AS rel, max(created_at) >= TIMESTAMP '2000-01-01' AS young FROM mentions GROUP BY ALL) "
        "SELECT category, thread_id, row_number() OVER (PARTITION BY category ORDER BY young DESC, needs DESC, rel DESC, thread_id) AS place FROM m WHERE rel > 0 QUALIFY place <= 10",
    ),
    "requirement_rules": (
        requirement_rules,
        "WITH w(request, kind, fact, wanted, hard) AS (VALUES ('r1', NULL, 'hob', 'gas', true), ('r1', 'SMALL', 'size', 'small', false), ('r2', NULL, 'size', 'small', true), ('r3', NULL, 'hob', 'gas', true), ('r3', 'SMALL', 'size', 'small', false), ('r3', NULL, 'size', 'small', true)), "
        "j AS (SELECT request, p_partkey, wanted, hard, CASE fact WHEN 'hob' THEN CASE p_size % 3 WHEN 0 THEN 'gas' WHEN 1 THEN 'induction' END ELSE CASE WHEN p_size < 20 THEN 'small' END END AS value FROM part JOIN w ON kind IS NULL OR kind = p_type), "
        "b AS (SELECT request, p_partkey, count(*) FILTER (value = wanted) AS meets, count(*) FILTER (value <> wanted AND hard) AS conflict, count(*) FILTER (value <> wanted AND NOT hard) AS caution, count(*) FILTER (value IS NULL) AS unconfirmed FROM j GROUP BY ALL) "
        "SELECT request, meets, conflict, caution, unconfirmed, count(*) AS products FROM b GROUP BY ALL",
    ),
    "profiles_in_use": (
        profiles_in_use,
        "SELECT c_custkey AS writer, CASE WHEN floor(c_acctbal) >= 0 THEN floor(c_acctbal)::BIGINT END AS karma, CASE WHEN c_custkey % 7 >= 2 THEN c_custkey % 7 - 2 END AS contributions, DATE '2024-03-01' - (c_custkey % 60)::INT AS looked_up FROM customer WHERE c_custkey % 60 <= 30",
    ),
    "lines_folded": (
        lines_folded,
        f"WITH {_RANKED}, o AS (SELECT category, {_BRAND} AS brand, arg_min(product_key, place) AS instead FROM ranked WHERE qualifies AND product_key % 3 <> 0 GROUP BY ALL) "
        f"SELECT p.category, pick, p.product_key, p.product_key % 3 = 0 AS is_line, CASE WHEN p.product_key % 3 = 0 THEN instead END AS instead FROM picks p LEFT JOIN o ON o.category = p.category AND o.brand = {_BRAND.replace('product_name', 'p.product_name')}",
    ),
    "library_pass": (
        library_pass,
        f"WITH {COMMENTS}, t AS (SELECT thread_id, max(created_at) FILTER (k > 85) AS checked, min(k) = 0 AS archived FROM comments GROUP BY 1), p AS (SELECT *, row_number() OVER (ORDER BY checked NULLS FIRST, thread_id) AS place FROM t) "
        "SELECT thread_id, place, CASE WHEN place <= 40 THEN 'read' WHEN checked IS NULL OR datediff('day', CAST(checked AS DATE), DATE '2024-02-20') > CASE WHEN archived THEN 37 ELSE 30 END THEN 'expired' ELSE 'kept' END AS state FROM p",
    ),
    "groups_to_rank": (
        groups_to_rank,
        "SELECT CASE WHEN p_partkey % 7 = 0 AND p_brand <> 'Brand#1' THEN 'another category' WHEN p_size % 10 <> 0 AND p_partkey % 2 = 0 AND p_type <> 'SMALL' THEN 'another kind' WHEN p_size % 9 = 2 THEN 'names no one product' "
        "WHEN p_size % 4 = 1 THEN 'fits several products' ELSE 'ranked' END AS reason, count(*) AS groups FROM part GROUP BY 1",
    ),
    "sets_left_out": (
        sets_left_out,
        "WITH p AS (SELECT p_type, p_partkey % 2 = 0 AS asked, CASE WHEN p_size % 5 = 0 THEN 'set' ELSE string_split(p_name, ' ')[-1] END AS last FROM part) SELECT p_type, count(*) AS kept FROM p WHERE last NOT IN ('set', 'bolt') OR (asked AND last = 'set') GROUP BY 1",
    ),
    "other_kinds_left_out": (
        other_kinds_left_out,
        "WITH p AS (SELECT p_name, CASE WHEN p_size % 6 <> 0 THEN p_type END AS kind FROM part), n AS (SELECT p_name, kind, count(*) AS n FROM p WHERE kind IS NOT NULL GROUP BY ALL), t AS (SELECT p_name, max(n) AS top FROM n GROUP BY 1), "
        "m AS (SELECT p_name, min(kind) AS most FROM n JOIN t USING (p_name) WHERE n = top GROUP BY 1 HAVING count(*) = 1) "
        "SELECT p_name, count(*) AS mentions, count(DISTINCT kind) AS kinds FROM p LEFT JOIN m USING (p_name) WHERE most IS NULL OR kind IS NULL OR kind = most GROUP BY 1",
    ),
    "formulas_folded": (
        formulas_folded,
        "WITH m AS (SELECT p_brand AS category, p_name AS base, p_name || CASE p_partkey % 4 WHEN 0 THEN ' (New Formula)' WHEN 1 THEN ' old version' ELSE '' END AS name FROM part) "
        "SELECT category, CASE WHEN (category, base) IN (SELECT (category, name) FROM m) THEN base ELSE name END AS name, count(*) AS n FROM m GROUP BY ALL",
    ),
    "brand_skips": (
        brand_skips,
        f"WITH {_RANKED}, {_SKIPS}, b AS (SELECT category, {_BRAND} AS brand, arg_min(product_key, pick) AS of_pick FROM picks GROUP BY ALL) SELECT s.category, s.product_key, of_pick FROM skips s LEFT JOIN b ON s.category = b.category AND {_BRAND.replace('product_name', 's.product_name')} = b.brand",
    ),
    "worth_beside_picks": (worth_beside_picks, f"WITH {_RANKED}, {_WORTH} SELECT category, product_key, {_BRAND} AS brand FROM worth WHERE (category, {_BRAND}) NOT IN (SELECT (category, {_BRAND}) FROM picks)"),
    "worth_items": (
        worth_items,
        f"WITH {_RANKED}, {_WORTH}, m AS (SELECT f.* FROM flagged f SEMI JOIN worth USING (category, product_key) WHERE f.credible AND stance = 'recommend') "
        f"SELECT category, product_key, row_number() OVER (PARTITION BY category, product_key ORDER BY weight DESC, upvotes DESC, {ORDINAL_SQL}) AS shown, comment_id FROM m QUALIFY shown <= 2",
    ),
    "kinds_left_out": (
        kinds_left_out,
        "WITH k AS (SELECT DISTINCT p_brand AS category, p_type AS kind FROM part), v AS (SELECT *, CASE WHEN kind IN ('SMALL', 'MEDIUM') THEN 'small' WHEN kind = 'LARGE' THEN 'large' ELSE 'any' END AS value, CASE WHEN length(category) = 7 THEN 'small' ELSE 'any' END AS wanted FROM k) "
        "SELECT category, kind FROM v WHERE value <> wanted OR kind = 'PROMO'",
    ),
    "warnings_counted": (
        warnings_counted,
        f"WITH {MENTIONS}, w AS (SELECT category, product_key, count(*) FILTER (stance = 'warn') AS warnings, count(*) FILTER (stance = 'warn' AND NOT (NOT meets_need AND products_named > 3)) AS counted FROM mentions GROUP BY ALL) SELECT *, counted >= 2 AS could_skip FROM w",
    ),
    "brand_entries": (
        brand_entries,
        f"WITH e AS (SELECT CASE WHEN p_size % 2 = 0 THEN p_type END AS ek, string_split(p_name, ' ')[2] || ' ' || string_split(p_name, ' ')[1] AS name, p_retailprice AS price, p_partkey AS entry FROM part WHERE p_partkey % 3 = 0), "
        f"x AS (SELECT *, {_KEY} AS w FROM e), q AS (SELECT DISTINCT p_type AS kind, p_name AS name FROM part), y AS (SELECT *, {_KEY} AS w FROM q) "
        "SELECT kind, y.name, arg_min(price, {'a': ek IS NULL, 'p': price, 'e': entry}) AS price, arg_min(entry, {'a': ek IS NULL, 'p': price, 'e': entry}) AS entry FROM y JOIN x USING (w) WHERE ek IS NULL OR ek = kind GROUP BY ALL",
    ),
    "brand_lines": (brand_lines, "SELECT p_type AS kind, 'house ' || regexp_extract(p_brand, '#(.*)', 1) AS name, p_brand, min(p_retailprice) AS from_price, count(*) AS products FROM part GROUP BY ALL"),
    "sales": (
        sales,
        f"WITH {PRICES}, f AS (SELECT product_key, price, checked_on, shop || '.example' AS host FROM prices WHERE shop || '.example' IN {HOSTS} AND available AND datediff('day', checked_on, DATE '2001-06-30') <= 30) "
        "SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY product_key ORDER BY checked_on DESC, price, host) = 1",
    ),
    "quote_gate": (
        quote_gate,
        f"WITH {REPLIES}, q AS (SELECT thread_id, body, CASE WHEN (thread_id * 3 + comment_id) % 11 = 0 THEN substr(body, 1, 20) || ' zz' ELSE string_split_regex(body, '[.,]')[1] END AS quote FROM replies), f AS (SELECT thread_id, trim(quote) = '' OR NOT contains(body, quote) AS fails FROM q) "
        "SELECT thread_id AS answer, count(*) AS quotes, count(*) FILTER (fails) AS failing, count(*) FILTER (fails) > 0 AS refused FROM f GROUP BY 1",
    ),
    "kinds_to_look_for": (
        kinds_to_look_for,
        f"WITH {_RANKED}, s AS (SELECT category, kind_key FROM picks WHERE pick = 1) SELECT category, kind_key, row_number() OVER (PARTITION BY category ORDER BY support DESC, lower(kind_key), kind_key) AS place, support "
        "FROM (SELECT category, kind_key, support FROM leads ANTI JOIN s USING (category, kind_key) WHERE support > 0 AND NOT warned) QUALIFY place <= 3",
    ),
    "tips_for_picks": (
        tips_for_picks,
        f"WITH {_RANKED}, t AS (SELECT category, product_key, upvotes % 5 AS cluster, count(*) AS given, min(comment_id) AS ordinal FROM mentions WHERE products_named IN (2, 3) AND voice IN ('high', 'medium') GROUP BY ALL) "
        "SELECT category, product_key, cluster, given, row_number() OVER (PARTITION BY category, product_key ORDER BY given DESC, ordinal) AS shown FROM t SEMI JOIN picks USING (category, product_key) QUALIFY shown <= 2",
    ),
    "check_outcomes": (
        check_outcomes,
        "WITH c AS (SELECT *, string_split_regex(text, '[.,]')[1] AS q, CASE WHEN conv_id % 9 <> 0 THEN CASE WHEN conv_id % 4 = 0 THEN replace(text, 'e', 'a') ELSE text END END AS b FROM conversations) "
        "SELECT conv_id, turn, CASE WHEN turn % 6 = 5 THEN 'unknown' WHEN turn % 5 = 4 THEN 'deleted' WHEN b IS NULL THEN 'unreadable' WHEN trim(q) = '' OR NOT contains(b, q) THEN 'changed' ELSE 'passing' END AS outcome FROM c",
    ),
    "edited_items": (
        edited_items,
        f"WITH {REPLIES}, i AS (SELECT thread_id, body, i AS item, string_split_regex(body, '[.,]')[i] AS q FROM replies, range(1, 3) AS t(i)), w AS (SELECT *, thread_id % 3 <> 0 OR regexp_matches(' ' || regexp_replace(string_split_regex(body, '[.,]')[1], '\\s+', ' ', 'g') || ' ', '[^\\p{{L}}\\p{{N}}]' || regexp_escape(trim(regexp_replace(q, '\\s+', ' ', 'g'))) || '[^\\p{{L}}\\p{{N}}]') AS kept FROM i WHERE q IS NOT NULL AND trim(q) <> '') "
        "SELECT item::INT AS item, count(*) FILTER (kept) AS kept, count(*) AS items FROM w GROUP BY 1",
    ),
    "words_to_restore": (words_to_restore, f"WITH {COMMENTS} SELECT thread_id, count(*) AS restored FROM comments WHERE k < 60 AND score > 40 AND k % 3 <> 0 GROUP BY 1"),
    "read_ahead": (read_ahead, "WITH o AS (SELECT o_custkey, min(o_orderpriority) AS p, max(o_orderdate) AS l, count(*) AS n FROM orders GROUP BY 1) SELECT o_custkey, row_number() OVER (ORDER BY p, l, n DESC, o_custkey) AS place FROM o"),
    "own_site_signs": (
        own_site_signs,
        "SELECT p_partkey, concat_ws(';', CASE WHEN p_partkey % 3 = 0 AND length(replace(p_name, ' ', '')) >= 4 THEN 'links to a site of their name' END, CASE WHEN p_partkey % 4 = 0 THEN 'signs for the brand' END) AS signs FROM part",
    ),
    "mention_badges": (
        mention_badges,
        f"WITH {MENTIONS} SELECT concat_ws(',', CASE WHEN voice IN ('high', 'medium') THEN 'established' END, CASE WHEN voice = 'high' THEN 'verified' END, CASE WHEN evidence = 'long-term use' THEN 'long use' END, CASE WHEN evidence = 'long-term use' AND voice <> 'high' THEN 'verified' END) AS badges, count(*) AS n FROM mentions GROUP BY 1",
    ),
    "categories_of_requests": (categories_of_requests, f"WITH {COMMENTS}, c AS (SELECT DISTINCT thread_id, kind FROM comments) SELECT CASE WHEN kind IN ('click', 'view') THEN 'signup' ELSE kind END AS category, count(*) AS threads FROM c GROUP BY 1"),
    "slim_check": (
        slim_check,
        f"WITH {REPLIES}, w AS (SELECT thread_id, lower(string_split(body, ' ')[1]) AS word, comment_id % 4 <> 3 AS slim FROM replies), d AS (SELECT thread_id, word FROM w EXCEPT ALL SELECT thread_id, word FROM w WHERE slim) SELECT thread_id, 'whole' AS side, count(*) AS n FROM d GROUP BY 1",
    ),
    "comments_of_posts": (
        comments_of_posts,
        "WITH r AS (SELECT l_orderkey AS post_id, l_linenumber * 100000 + l_partkey AS c, l_quantity::INT AS s FROM lineitem SEMI JOIN (SELECT o_orderkey AS l_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') USING (l_orderkey)) "
        "SELECT post_id, count(*)::INT AS n, string_agg(c::VARCHAR || ':' || s::VARCHAR, ',' ORDER BY c, s) AS comments FROM r GROUP BY 1",
    ),
    "shown_spelling": (
        shown_spelling,
        "SELECT p_partkey, CASE WHEN starts_with(p_name, 'large bolt') THEN 'Big Bolt' || substr(p_name, 11) WHEN starts_with(p_name, 'cold ') THEN 'KOLD' || substr(p_name, 5) WHEN starts_with(p_name, 'red ') THEN 'Rouge' || substr(p_name, 4) ELSE p_name END AS shown, "
        "p_brand || ' ' || CASE WHEN p_size > 40 THEN 'retinol' ELSE '' END || ' ' || lower(p_type) || ' line' AS line FROM part",
    ),
    "need_shares": (need_shares, f"WITH {MENTIONS} SELECT category, round(count(*) FILTER ({_CREDIBLE} AND meets_need) / nullif(count(*) FILTER ({_CREDIBLE}), 0), 9) AS share FROM mentions GROUP BY 1"),
    "case_scores": (
        case_scores,
        "WITH c AS (SELECT 'type' AS aspect, count(*) FILTER (p_size % 4 <> 0) AS cases, count(*) FILTER (p_size % 4 <> 0 AND p_partkey % 10 <> 0) AS right FROM part UNION ALL SELECT 'status', count(*), count(*) FILTER (p_size <> 7) FROM part "
        "UNION ALL SELECT 'need', count(*) FILTER (p_size > 45), 0 FROM part) SELECT *, round(\"right\" / nullif(cases, 0), 9) AS share FROM c",
    ),
}
