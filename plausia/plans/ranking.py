"""Queries of the ranking family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plausia.operators import ranking as r
from plausia.plans.views import MENTIONS, ORDINAL_SQL, mentions, table


def scored_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return r.thread_upvotes(mentions(spark, sf)).withColumn("weight", r.mention_weight())


def notes(spark: SparkSession, sf: str) -> DataFrame:
    """Notes about kinds: every fifth mention read as a note."""
    return mentions(spark, sf).filter("products_named % 5 = 0")


def placements(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_brand").alias("category"), F.col("p_type").alias("kind_key"), F.col("p_partkey").alias("product_key"))


def _kinds(spark: SparkSession, sf: str) -> DataFrame:
    heard = r.one_vote(notes(spark, sf).withColumn("weight", r.note_weight()), "category", "kind_key")
    return r.kind_support(heard, placements(spark, sf))


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    return r.rank_products(r.thread_upvotes(mentions(spark, sf)), notes(spark, sf), placements(spark, sf))


RANKED = (
    "category", "product_key", "product_name", "score", "points", "kind_bonus", "kind_key", "recommends", "warnings", "neutral", "credible_recommends", "credible_warnings",
    "threads", "credible_threads", "twice", "standouts", "shortfall", "qualifies", "on_skip_list", "disputed", "worth_a_look", "by_standout", "place",
)


def credible_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(spark, sf).select(*RANKED)


def mention_weights(spark: SparkSession, sf: str) -> DataFrame:
    rows = mentions(spark, sf).withColumn("weight", r.mention_weight())
    return rows.groupBy("voice", "evidence", "stance", "honesty").agg(F.round(F.max("weight"), 6).alias("weight"), F.count(F.lit(1)).alias("n"))


def one_vote_per_writer(spark: SparkSession, sf: str) -> DataFrame:
    votes = r.one_vote(mentions(spark, sf).withColumn("weight", r.mention_weight()), "product_key")
    return votes.select("product_key", "comment_id", "author", "stance", F.round("weight", 6).alias("weight"), F.col("ordinal.l_extendedprice").alias("ordinal_price"))


def share_beaten(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored_mentions(spark, sf).select("thread_id", "comment_id", "thread_comments", F.round("share_beaten", 9).alias("share_beaten"))
    return rows.distinct()


def counted_twice(spark: SparkSession, sf: str) -> DataFrame:
    """The mentions that count twice or stand out."""
    rows = scored_mentions(spark, sf).withColumns({"counts_twice": r.counts_twice(), "stands_out": r.stands_out(), "stands_out_with_need": r.stands_out(True)})
    return rows.filter("counts_twice or stands_out").select("product_key", "comment_id", "upvotes", "thread_comments", "counts_twice", "stands_out", "stands_out_with_need")


def kind_support(spark: SparkSession, sf: str) -> DataFrame:
    return _kinds(spark, sf)


def leading_kind(spark: SparkSession, sf: str) -> DataFrame:
    return r.leading_kinds(_kinds(spark, sf)).select("category", "kind_key", "support", "place", "leads")


def warned_off_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return r.warned_off_kinds(_kinds(spark, sf)).select("category", "kind_key", "warning_writers", "credible_notes")


def level_histogram(spark: SparkSession, sf: str) -> DataFrame:
    votes = r.one_vote(mentions(spark, sf).withColumn("weight", r.mention_weight()), "category", "product_key")
    return votes.groupBy("product_key").agg(*r.level_counts())


def picks(spark: SparkSession, sf: str) -> DataFrame:
    return r.picks(_ranked(spark, sf)).select("category", "pick", "product_key", "score")


def worth_a_look(spark: SparkSession, sf: str) -> DataFrame:
    products = _ranked(spark, sf)
    return r.worth_a_look(products, r.picks(products)).select("category", "shown", "block", "product_key", "score")


def skip_list(spark: SparkSession, sf: str) -> DataFrame:
    return r.skip_list(_ranked(spark, sf)).select("category", "shown", "product_key", "credible_warnings", "score")


def thin_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """For each category, whether no product, or fewer than three, meet the bar, and the best candidate."""
    return _ranked(spark, sf).groupBy("category").agg(
        F.count_if("qualifies").alias("qualifying"), (F.count_if("qualifies") == 0).alias("thin_evidence"),
        (F.count_if("qualifies") < r.RULES.picks_shown).alias("needs_more_threads"), F.min_by("product_key", "place").alias("best_candidate"),
    )


def reason_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The line that says what a pick rests on."""
    line = F.format_string("%d credible recommendations in %d threads, %d warnings", "credible_recommends", "credible_threads", "credible_warnings")
    return r.picks(_ranked(spark, sf)).select("category", "pick", line.alias("reason"))


def products_named(spark: SparkSession, sf: str) -> DataFrame:
    return mentions(spark, sf).groupBy("comment_id").agg(F.count_distinct("product_name").alias("products_named"))


def typed_majority(spark: SparkSession, sf: str) -> DataFrame:
    """For each product name without its key, the type that most mentions give it; null for a tie."""
    from pyspark.sql import Window

    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    n = part.groupBy("p_name", "p_type").agg(F.count(F.lit(1)).alias("n"))
    top = n.withColumn("rank", F.rank().over(Window.partitionBy("p_name").orderBy(F.desc("n")))).filter("rank = 1")
    return top.groupBy("p_name").agg(F.when(F.count(F.lit(1)) == 1, F.min("p_type")).alias("kind"), F.max("n").alias("n"))


def names_and_stances(spark: SparkSession, sf: str) -> DataFrame:
    """How often each spelling and stance of a product occurs."""
    return mentions(spark, sf).groupBy("product_key", "product_name", "stance").agg(F.count(F.lit(1)).alias("n"))


def upvotes_change_nothing(spark: SparkSession, sf: str) -> DataFrame:
    """Categories whose picks are the same without the upvote and stand-out rules."""
    with_rules = picks(spark, sf).select("category", "pick", "product_key")
    plain = mentions(spark, sf).withColumns({"thread_comments": F.lit(0).cast("long"), "share_beaten": F.lit(0.0)})
    without = r.picks(r.rank_products(plain, notes(spark, sf), placements(spark, sf))).select("category", "pick", "product_key")
    changed = with_rules.exceptAll(without).unionByName(without.exceptAll(with_rules)).select("category").distinct().withColumn("changed", F.lit(True))
    every = placements(spark, sf).select("category").distinct()
    return every.join(changed, "category", "left").select("category", F.coalesce("changed", F.lit(False)).alias("changed"))


_WEIGHT = "(CASE voice WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.5 ELSE 0.25 END)::DOUBLE"
_EVIDENCE = "((CASE evidence WHEN 'long-term use' THEN 1.0 WHEN 'short-term use' THEN 0.5 ELSE 0.25 END)::DOUBLE * (1 + 0.1::DOUBLE * honesty))"
_SIGN = "(CASE stance WHEN 'recommend' THEN 1 WHEN 'warn' THEN -1 ELSE 0 END)"
_CREDIBLE_NOTE = "(stance <> 'neutral' AND voice IN ('high', 'medium'))"
_CREDIBLE = f"({_CREDIBLE_NOTE} AND evidence IN ('long-term use', 'short-term use'))"
_VOTER = "coalesce('w:' || author, 'c:' || comment_id::VARCHAR)"
_SCORED = f"""{MENTIONS},
tc AS (SELECT thread_id, comment_id, max(upvotes) AS s FROM mentions GROUP BY ALL),
tu AS (SELECT thread_id, comment_id, count(*) OVER (PARTITION BY thread_id) AS thread_comments,
  percent_rank() OVER (PARTITION BY thread_id ORDER BY s) AS share_beaten FROM tc),
scored AS (SELECT m.*, thread_comments, share_beaten, {_WEIGHT} * {_EVIDENCE} * {_SIGN} AS weight,
  {_CREDIBLE} AS credible FROM mentions m JOIN tu USING (thread_id, comment_id)),
flagged AS (SELECT *, credible AND stance = 'recommend' AND upvotes >= 10 AND thread_comments >= 20 AND share_beaten >= 0.9 AS twice,
  credible AND stance = 'recommend' AND upvotes >= 25 AND thread_comments >= 20 AND products_named <= 5 AND upvotes / thread_comments >= 0.75 AS standout FROM scored)"""
_VOTES = f"""{_SCORED},
votes AS (SELECT * FROM flagged QUALIFY row_number() OVER (PARTITION BY category, product_key, {_VOTER} ORDER BY abs(weight) DESC, {ORDINAL_SQL}) = 1)"""
_KINDS = f"""notes AS (SELECT *, {_WEIGHT} * {_SIGN} AS w FROM mentions WHERE products_named % 5 = 0),
heard AS (SELECT * FROM notes QUALIFY row_number() OVER (PARTITION BY category, kind_key, {_VOTER} ORDER BY abs(w) DESC, {ORDINAL_SQL}) = 1),
sums AS (SELECT category, kind_key, round(coalesce(sum(w) FILTER ({_CREDIBLE_NOTE}), 0), 6) AS support,
  count(*) FILTER ({_CREDIBLE_NOTE} AND stance = 'recommend') AS credible_notes,
  count(DISTINCT {_VOTER}) FILTER ({_CREDIBLE_NOTE} AND stance = 'warn') AS warning_writers FROM heard GROUP BY ALL),
placed AS (SELECT DISTINCT p_brand AS category, p_type AS kind_key FROM part),
kinds AS (SELECT category, kind_key, coalesce(support, 0) AS support, coalesce(credible_notes, 0) AS credible_notes,
  coalesce(warning_writers, 0) AS warning_writers FROM placed FULL JOIN sums USING (category, kind_key)),
lead1 AS (SELECT *, row_number() OVER w AS place, greatest(coalesce(lead(support) OVER w, 0), 0) AS nxt FROM kinds
  WINDOW w AS (PARTITION BY category ORDER BY support DESC, lower(kind_key), kind_key)),
leads AS (SELECT *, place = 1 AND credible_notes >= 2 AND support > 0 AND support > nxt AND support >= 2 * nxt AS leads,
  warning_writers >= 2 AND warning_writers > credible_notes AS warned FROM lead1)"""
_RANKED = f"""{_VOTES}, {_KINDS},
own AS (SELECT p_brand AS category, p_partkey AS product_key, l.kind_key, CASE WHEN l.leads THEN 1.0 WHEN l.warned THEN -1.0 ELSE 0.0 END::DOUBLE AS kind_bonus
  FROM part JOIN leads l ON l.category = p_brand AND l.kind_key = p_type
  QUALIFY row_number() OVER (PARTITION BY p_brand, p_partkey ORDER BY NOT l.leads, l.place) = 1),
p0 AS (SELECT category, product_key, min(product_name) AS product_name, round(sum(weight), 6) + 0.0::DOUBLE AS points,
  count(*) FILTER (stance = 'recommend') AS recommends, count(*) FILTER (stance = 'warn') AS warnings, count(*) FILTER (stance = 'neutral') AS neutral,
  count(*) FILTER (credible AND stance = 'recommend') AS credible_recommends, count(*) FILTER (credible AND stance = 'warn') AS credible_warnings,
  count(DISTINCT thread_id) AS threads, count(DISTINCT thread_id) FILTER (credible AND stance = 'recommend') AS credible_threads,
  count(DISTINCT thread_id) FILTER (credible AND stance = 'warn') AS warning_threads,
  count(*) FILTER (credible AND stance = 'recommend' AND voice = 'high') AS high_voices,
  count(*) FILTER (twice) AS could, count(*) FILTER (standout) AS standouts FROM votes GROUP BY ALL),
p1 AS (SELECT p0.*, kind_key, coalesce(kind_bonus, 0) AS kind_bonus, least(could, greatest(0, 3 - credible_recommends)) AS t,
  credible_warnings >= 2 AND credible_warnings > credible_recommends AS warned_off,
  credible_warnings >= 2 AND credible_warnings > credible_recommends AND warning_threads >= 2 AS on_skip_list,
  credible_recommends > 0 AND credible_warnings >= 2 AS disputed FROM p0 LEFT JOIN own USING (category, product_key)),
p2 AS (SELECT *, nullif(concat_ws('; ', CASE WHEN warned_off THEN 'more credible warnings than recommendations' || CASE WHEN on_skip_list THEN ' (on the skip-these list)' ELSE '' END END,
  CASE WHEN credible_recommends + t < 3 THEN (credible_recommends + t)::VARCHAR || ' of 3 credible recommendations' ||
    CASE WHEN t > 0 THEN ' (' || t::VARCHAR || ' counted twice for ' || CASE WHEN t = 1 THEN 'its' ELSE 'their' END || ' upvotes)' ELSE '' END END,
  CASE WHEN credible_threads < 2 THEN 'credible recommendations in ' || credible_threads::VARCHAR || ' of 2 threads' END,
  CASE WHEN points <= 0 THEN 'warnings outweigh its support' END), '') AS s0 FROM p1),
p3 AS (SELECT *, standouts > 0 AND s0 IS NOT NULL AND points > 0 AND NOT warned_off AND credible_warnings < credible_recommends AS by_standout FROM p2),
p4 AS (SELECT *, by_standout AND credible_recommends >= 2 AND credible_recommends + standouts >= 3 AS fills FROM p3),
p5 AS (SELECT *, CASE WHEN NOT fills THEN s0 END AS shortfall, (CASE WHEN fills THEN 0 ELSE t END)::BIGINT AS twice, round(points + kind_bonus, 6) AS score FROM p4),
p6 AS (SELECT *, shortfall IS NULL AS qualifies FROM p5),
p7 AS (SELECT *, ((credible_recommends = 2 AND credible_threads >= 2 AND points > 0 AND NOT warned_off) OR by_standout) AND (NOT qualifies OR twice > 0 OR by_standout) AS worth_a_look,
  qualifies AND twice > 0 AND credible_recommends < 3 AS lifted FROM p6),
ranked AS (SELECT *, qualifies AND NOT lifted AND NOT by_standout AS on_its_own, row_number() OVER (PARTITION BY category
  ORDER BY score DESC, credible_recommends DESC, credible_threads DESC, high_voices DESC, lower(product_name), product_key) AS place FROM p7),
picks AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY by_standout OR lifted, place) AS pick FROM ranked WHERE qualifies QUALIFY pick <= 3)"""

_LEVELS = ", ".join(
    f"count(*) FILTER (stance = '{s}' AND {c} = '{v}') AS {s}_{v.split('-')[0].split(' ')[0]}_{c}"
    for s in ("recommend", "warn") for c, vs in (("voice", ("high", "medium", "low")), ("evidence", ("long-term use", "short-term use", "no first-hand use"))) for v in vs
)
_PLAIN_RANKED = _RANKED.replace("thread_comments,\n  percent_rank() OVER (PARTITION BY thread_id ORDER BY s) AS share_beaten FROM tc", "x, 0.0 AS share_beaten, 0 AS thread_comments FROM tc")

QUERIES = {
    "credible_ranking": (credible_ranking, f"WITH {_RANKED} SELECT {', '.join(RANKED)} FROM ranked"),
    "mention_weight": (mention_weights, f"WITH {MENTIONS} SELECT voice, evidence, stance, honesty, round(max({_WEIGHT} * {_EVIDENCE} * {_SIGN}), 6) AS weight, count(*) AS n FROM mentions GROUP BY ALL"),
    "one_vote_per_writer": (
        one_vote_per_writer,
        f"WITH {MENTIONS}, w AS (SELECT *, {_WEIGHT} * {_EVIDENCE} * {_SIGN} AS weight FROM mentions) SELECT product_key, comment_id, author, stance, round(weight, 6) AS weight, l_extendedprice AS ordinal_price "
        f"FROM w QUALIFY row_number() OVER (PARTITION BY product_key, {_VOTER} ORDER BY abs(weight) DESC, {ORDINAL_SQL}) = 1",
    ),
    "share_beaten": (share_beaten, f"WITH {_SCORED} SELECT DISTINCT thread_id, comment_id, thread_comments, round(share_beaten, 9) AS share_beaten FROM scored"),
    "counted_twice": (counted_twice, f"WITH {_SCORED} SELECT product_key, comment_id, upvotes, thread_comments, twice AS counts_twice, standout AS stands_out, standout AND meets_need AS stands_out_with_need FROM flagged WHERE twice OR standout"),
    "kind_support": (kind_support, f"WITH {MENTIONS}, {_KINDS} SELECT category, kind_key, support, credible_notes, warning_writers FROM kinds"),
    "leading_kind": (leading_kind, f"WITH {MENTIONS}, {_KINDS} SELECT category, kind_key, support, place, leads FROM leads"),
    "warned_off_kinds": (warned_off_kinds, f"WITH {MENTIONS}, {_KINDS} SELECT category, kind_key, warning_writers, credible_notes FROM leads WHERE warned"),
    "level_histogram": (level_histogram, f"WITH {_VOTES} SELECT product_key, {_LEVELS} FROM votes GROUP BY product_key"),
    "picks": (picks, f"WITH {_RANKED} SELECT category, pick, product_key, score FROM picks"),
    "worth_a_look": (
        worth_a_look,
        f"WITH {_RANKED}, rest AS (SELECT *, CASE WHEN on_its_own THEN 0 WHEN worth_a_look AND NOT by_standout THEN 1 WHEN worth_a_look THEN 2 END AS block FROM ranked "
        "WHERE (category, product_key) NOT IN (SELECT category, product_key FROM picks)) SELECT category, row_number() OVER (PARTITION BY category ORDER BY block, place) AS shown, block, product_key, score "
        "FROM rest WHERE block IS NOT NULL QUALIFY shown <= 3",
    ),
    "skip_list": (skip_list, f"WITH {_RANKED} SELECT category, row_number() OVER (PARTITION BY category ORDER BY credible_warnings DESC, score, lower(product_name), product_key) AS shown, product_key, credible_warnings, score FROM ranked WHERE on_skip_list QUALIFY shown <= 5"),
    "thin_evidence": (thin_evidence, f"WITH {_RANKED} SELECT category, count(*) FILTER (qualifies) AS qualifying, count(*) FILTER (qualifies) = 0 AS thin_evidence, count(*) FILTER (qualifies) < 3 AS needs_more_threads, arg_min(product_key, place) AS best_candidate FROM ranked GROUP BY category"),
    "reason_lines": (reason_lines, f"WITH {_RANKED} SELECT category, pick, credible_recommends::VARCHAR || ' credible recommendations in ' || credible_threads::VARCHAR || ' threads, ' || credible_warnings::VARCHAR || ' warnings' AS reason FROM picks"),
    "products_named": (products_named, f"WITH {MENTIONS} SELECT comment_id, count(DISTINCT product_name) AS products_named FROM mentions GROUP BY comment_id"),
    "typed_majority": (
        typed_majority,
        "WITH n AS (SELECT p_name, p_type, count(*) AS n FROM part GROUP BY ALL), t AS (SELECT *, rank() OVER (PARTITION BY p_name ORDER BY n DESC) AS r FROM n) "
        "SELECT p_name, CASE WHEN count(*) = 1 THEN min(p_type) END AS kind, max(n) AS n FROM t WHERE r = 1 GROUP BY p_name",
    ),
    "names_and_stances": (names_and_stances, f"WITH {MENTIONS} SELECT product_key, product_name, stance, count(*) AS n FROM mentions GROUP BY ALL"),
    "upvotes_change_nothing": (
        upvotes_change_nothing,
        f"WITH a AS (WITH {_RANKED} SELECT category, pick, product_key FROM picks), b AS (WITH {_PLAIN_RANKED} SELECT category, pick, product_key FROM picks), "
        "c AS ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)) "
        "SELECT DISTINCT p_brand AS category, p_brand IN (SELECT category FROM c) AS changed FROM part",
    ),
}
