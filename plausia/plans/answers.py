"""Queries of the answers and signs families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plausia.operators import answers as a, ranking as r, signs as g, threads as t
from plausia.operators.copies import contradicting
from plausia.operators.saved import saved
from plausia.plans.ranking import _CREDIBLE, _RANKED, notes, placements
from plausia.plans.ranking import _ranked as ranked
from plausia.plans.views import MENTIONS, ORDINAL_SQL, REPLIES, TURNS, mentions, replies, table, turns



def independence_signs(spark: SparkSession, sf: str) -> DataFrame:
    t = turns(spark, sf)
    return t.select("conv_id", "turn", F.array_join(g.tags(F.col("text"), g.INDEPENDENCE), ",").alias("signs"), g.red_flags(F.col("text")).alias("red_flags"))


def honesty_tags(spark: SparkSession, sf: str) -> DataFrame:
    return turns(spark, sf).select("conv_id", "turn", F.array_join(g.tags(F.col("text"), g.HONESTY), ",").alias("tags"))


def evidence_levels(spark: SparkSession, sf: str) -> DataFrame:
    return turns(spark, sf).select("conv_id", "turn", g.evidence_level(F.col("text")).alias("evidence"))


def thread_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return turns(spark, sf).filter("turn = 0").select("conv_id", g.first_of(F.col("text"), g.THREAD_KINDS, "other").alias("kind"))


def says_changed(spark: SparkSession, sf: str) -> DataFrame:
    return turns(spark, sf).filter(g.holds(F.col("text"), g.CHANGED)).select("conv_id", "turn")


def time_of_use(spark: SparkSession, sf: str) -> DataFrame:
    return turns(spark, sf).select("conv_id", "turn", F.round(g.longest_use_months(F.col("text")), 6).alias("months"))


def service_filter(spark: SparkSession, sf: str) -> DataFrame:
    about = F.concat_ws(" ", "p_name", F.when(F.col("p_size") % 10 == 0, "treatment").when(F.col("p_size") % 10 == 1, "Clinic"))
    return table(spark, sf, "part").filter(g.holds(about, g.SERVICE)).select("p_partkey")


def unknown_tags(spark: SparkSession, sf: str) -> DataFrame:
    known = ["MEDIUM", "LARGE", "SMALL"]
    found = F.array(F.col("p_type"), F.when(F.col("p_size") % 2 == 0, "MEDIUM").otherwise("odd"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(g.unknown_tags(found, known), ",").alias("unknown")).filter("unknown <> ''")


def summary_problems(spark: SparkSession, sf: str) -> DataFrame:
    t = turns(spark, sf)
    cited = F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(F.lit("no numbers"))
    said = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("Users say: "), "text")).otherwise(F.col("text"))
    return t.select("conv_id", "turn", F.array_join(g.summary_problems(said, cited, 14), ",").alias("problems"))


def tip_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of a conversation's turns that say the same."""
    t = turns(spark, sf).withColumn("w", g.tip_words(F.col("text")))
    x, y = t.alias("x"), t.alias("y")
    j = x.join(y, (F.col("x.conv_id") == F.col("y.conv_id")) & (F.col("x.turn") < F.col("y.turn")))
    return j.filter(g.similar_tips(F.col("x.text"), F.col("y.text"), F.col("x.w"), F.col("y.w"))).select("x.conv_id", F.col("x.turn").alias("a"), F.col("y.turn").alias("b"))


def tip_groups(spark: SparkSession, sf: str) -> DataFrame:
    return g.tip_groups(turns(spark, sf).select(F.col("conv_id").alias("product"), F.col("turn").alias("ordinal"), F.col("text").alias("tip")))


def keyword_families(spark: SparkSession, sf: str) -> DataFrame:
    """Warnings whose text holds a family of words, with the families."""
    families = {"breakage": r"\b(broke|cracked)\b", "money": r"\b(overpriced|cheaper)\b", "trust": r"\b(sponsored|code)\b"}
    return turns(spark, sf).select("conv_id", "turn", F.array_join(g.tags(F.col("text"), families), ",").alias("families")).filter("families <> ''")


def retype(spark: SparkSession, sf: str) -> DataFrame:
    """Types put right by rule, with what changed."""
    new = F.when((F.col("p_type") == "ECONOMY") & F.col("p_name").contains("ring"), "RING").when(F.col("p_size") > 45, "LARGE").otherwise(F.col("p_type"))
    return table(spark, sf, "part").withColumn("new_type", new).filter("new_type <> p_type").select("p_partkey", "p_type", "new_type")


def contradicting_as_low(spark: SparkSession, sf: str) -> DataFrame:
    """Voice levels once writers who contradict themselves count as low."""
    m = mentions(spark, sf)
    flagged = contradicting(m, F.lit(False)).select(F.col("writer").alias("author")).distinct().withColumn("flag", F.lit(True))
    return m.join(flagged, "author", "left").groupBy("product_key", F.when(F.col("flag"), "low").otherwise(F.col("voice")).alias("voice")).agg(F.count(F.lit(1)).alias("n"))


def mention_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions joined with the group of their product on all five parts of the key; what has no group drops out."""
    keys = ["thread_id", "comment_id", "product_key", "category", "stance"]
    m = mentions(spark, sf)
    groups = m.filter("products_named <> 4").select(*keys).distinct().withColumn("grp", F.concat_ws("/", "category", (F.col("product_key") % 50)))
    return m.join(groups, keys).groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


def note_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Notes joined with their kinds; a note may belong to two."""
    n = notes(spark, sf).select("comment_id", "kind_key")
    broader = spark.createDataFrame([("ECONOMY", "value"), ("PROMO", "value"), ("LARGE", "size"), ("SMALL", "size"), ("MEDIUM", "size"), ("STANDARD", "size"), ("STANDARD", "value")], "kind_key string, kind string")
    return n.join(F.broadcast(broader), "kind_key").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("comment_id").alias("comments"))


def ancestor_readable(spark: SparkSession, sf: str) -> DataFrame:
    """Replies whose parent, or a comment further up, is readable: what a reply that names nothing can be about."""
    return t.readable_above(replies(spark, sf), F.col("comment_id") % 4 != 1)


def best_mentions(spark: SparkSession, sf: str) -> DataFrame:
    rows = r.thread_upvotes(mentions(spark, sf)).withColumn("weight", r.mention_weight())
    return a.best_mentions(rows, r.picks(ranked(spark, sf)), "recommend", 3, [F.desc("weight"), F.desc("upvotes"), F.col("ordinal")]).select("category", "product_key", "shown", "comment_id", "upvotes")


def pick_warnings(spark: SparkSession, sf: str) -> DataFrame:
    rows = r.thread_upvotes(mentions(spark, sf)).withColumn("weight", r.mention_weight())
    return a.best_mentions(rows, r.picks(ranked(spark, sf)), "warn", 2, [F.col("weight"), F.desc("upvotes"), F.col("ordinal")]).select("category", "product_key", "shown", "comment_id")


def written_answers(spark: SparkSession, sf: str) -> DataFrame:
    products = ranked(spark, sf)
    chosen = r.picks(products)
    rows = r.thread_upvotes(mentions(spark, sf)).withColumn("weight", r.mention_weight())
    order = [F.desc(F.abs("weight")), F.desc("upvotes"), F.col("ordinal")]
    return a.written(chosen, a.best_mentions(rows, chosen, "recommend", 3, order), a.best_mentions(rows, chosen, "warn", 2, order), r.skip_list(products))


def need_rule(spark: SparkSession, sf: str) -> DataFrame:
    return a.need_rule(ranked(spark, sf)).filter("qualifies").select("category", "product_key", "fitting_need")


def live_checked_picks(spark: SparkSession, sf: str) -> DataFrame:
    read = [c for c in r.SCORED if c != "weight"]
    rows = saved(r.thread_upvotes(mentions(spark, sf)).select(*read, "honesty"))
    failing = rows.filter("comment_id % 9 = 0").select("comment_id").distinct()
    bonuses = saved(r.note_bonuses(notes(spark, sf), placements(spark, sf)))
    return a.live_checked(rows, lambda m: r.rank_products(m, bonuses=bonuses), failing, lambda df, _: saved(df))[0]


def wider_reading(spark: SparkSession, sf: str) -> DataFrame:
    rows = r.thread_upvotes(mentions(spark, sf))
    order = rows.groupBy("category", "thread_id").agg(F.count_distinct("comment_id").alias("n")).withColumn("place", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("n"), "thread_id")))
    return a.wider(rows, order, lambda m: r.rank_products(m), (16, 200))


def pick_labels(spark: SparkSession, sf: str) -> DataFrame:
    topics = mentions(spark, sf).filter(r.is_credible() & (F.col("stance") == "recommend")).select("category", "product_key", F.concat(F.lit("topic"), F.col("honesty")).alias("topic"))
    return a.labels(r.picks(ranked(spark, sf)), topics)


def kind_of_product(spark: SparkSession, sf: str) -> DataFrame:
    heard = r.one_vote(notes(spark, sf).withColumn("weight", r.note_weight()), "category", "kind_key")
    return r.kind_bonus(r.kind_support(heard, placements(spark, sf)), placements(spark, sf))


def first_asked(spark: SparkSession, sf: str) -> DataFrame:
    """Requests of several lists, each once, in the order in which they first occur."""
    p = table(spark, sf, "part").select("p_name", F.col("p_partkey").alias("ordinal"))
    more = table(spark, sf, "part").select(F.concat(F.lit("small "), F.split("p_name", " ")[1]), F.col("p_partkey") + 1_000_000).toDF("p_name", "ordinal")
    return p.unionByName(more).groupBy("p_name").agg(F.min("ordinal").alias("ordinal"))


def union_distinct_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Posts of several searches, each once; the first search that found it wins."""
    o = table(spark, sf, "orders")
    one = lambda n, c: o.filter(c).select("o_orderkey", F.lit(n).alias("search"))
    return one(1, "o_orderpriority = '1-URGENT'").unionByName(one(2, "o_orderstatus = 'F'")).unionByName(one(3, "o_totalprice > 200000")).groupBy("o_orderkey").agg(F.min("search").alias("search"))


def one_per_name(spark: SparkSession, sf: str) -> DataFrame:
    """Groups with the same shown name as one, with all their products."""
    return table(spark, sf, "part").groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("first"), F.count(F.lit(1)).alias("products"))


def reread_merge(spark: SparkSession, sf: str) -> DataFrame:
    """A stored thread and a fresh read of it: what the fresh one lacks counts as deleted, unless it lies too deep to have been read."""
    t = replies(spark, sf)
    stored = t.select("thread_id", "comment_id", F.length("body").alias("old"))
    fresh = t.filter("(thread_id + comment_id) % 6 <> 0").select("thread_id", "comment_id", (F.length("body") + (F.col("comment_id") == 3).cast("int")).alias("new"))
    state = F.when(F.col("new").isNull() & (F.col("comment_id") > 5), "kept").when(F.col("new").isNull(), "deleted").when(F.col("new") != F.col("old"), "edited").otherwise("same")
    return stored.join(fresh, ["thread_id", "comment_id"], "full").select("thread_id", "comment_id", state.alias("state"))


def slim_threads(spark: SparkSession, sf: str) -> DataFrame:
    """Threads cut to the comments that something points to, with a digest of what was dropped."""
    t = replies(spark, sf)
    kept = t.filter("comment_id % 3 = 1").select("thread_id", "comment_id")
    marked = t.join(kept.withColumn("keep", F.lit(True)), ["thread_id", "comment_id"], "left").withColumn("keep", F.coalesce("keep", F.lit(False)))
    return marked.groupBy("thread_id").agg(F.count_if("keep").alias("kept"), F.count_if(~F.col("keep")).alias("dropped"), F.sum(F.when(~F.col("keep"), F.length("body")).otherwise(0)).alias("dropped_chars"), F.min(F.when(~F.col("keep"), F.col("comment_id"))).alias("first_dropped"))


def title_words(spark: SparkSession, sf: str) -> DataFrame:
    """Products whose name has a word that starts with one asked for, of four letters or more."""
    return table(spark, sf, "part").filter(F.exists(F.split("p_name", " "), lambda w: F.startswith(w, F.lit("widg")))).select("p_partkey")


def need_words(spark: SparkSession, sf: str) -> DataFrame:
    """A request's words without the product's, little words and digits."""
    ask = F.concat(F.lit("a quiet "), F.col("p_name"), F.lit(" for 2 small hands"))
    little = F.array(*map(F.lit, ("a", "for", "the", "2")))
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.array_except(F.array_except(F.split(ask, " "), F.split("p_name", " ")), little), " ").alias("words"))


def embed_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Hosts, last path parts and host letters of addresses."""
    host = F.regexp_replace(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1), "^(www|m|old)\\.", "")
    last = F.regexp_extract("url", "([^/?#]+)/?(?:[?#].*)?$", 1)
    return table(spark, sf, "pages").select("page_id", host.alias("host"), last.alias("last"), F.regexp_replace(host, "[^a-z]", "").alias("letters"))


def image_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses with their page key set to a smaller one."""
    return table(spark, sf, "pages").filter(F.col("url").contains("page=")).select("page_id", F.regexp_replace("url", "([?&]page=)[0-9]+", "$1" + "1").alias("url"))


def most_named_model(spark: SparkSession, sf: str) -> DataFrame:
    """For each brand the product that credible voices recommend most, where it leads: two at least, twice the next, a quarter of all."""
    n = mentions(spark, sf).filter(r.is_credible() & (F.col("stance") == "recommend")).groupBy("category", "product_key").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("category")
    o = w.orderBy(F.desc("n"), "product_key")
    x = n.withColumns({"place": F.row_number().over(o), "next": F.coalesce(F.lead("n").over(o), F.lit(0)), "total": F.sum("n").over(w)})
    return x.filter("place = 1").select("category", "product_key", "n", ((F.col("n") >= 2) & (F.col("n") >= 2 * F.col("next")) & (4 * F.col("n") >= F.col("total"))).alias("leads"))


def label_import(spark: SparkSession, sf: str) -> DataFrame:
    """Labels with one file's rows replaced: the old rows of its documents go, the new come."""
    old = table(spark, sf, "labels")
    new = old.filter("doc_id % 7 = 0").select("doc_id", (1 - F.col("quality")).alias("quality"), "toxic")
    return old.join(new.select("doc_id"), "doc_id", "left_anti").unionByName(new)


def same_brand_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Names that begin with all words of another name: a line and its products."""
    names = table(spark, sf, "part").select("p_name").distinct()
    lines = names.select(F.split("p_name", " ")[0].alias("line")).distinct()
    return names.join(lines, F.split("p_name", " ")[0] == F.col("line")).select("line", "p_name")


def _rx(p: str) -> str:
    return p.replace("'", "''")


def _tags_sql(patterns: dict[str, str]) -> str:
    return "array_to_string([x FOR x IN [" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{_rx(p)}') THEN '{n}' END" for n, p in patterns.items()) + "] IF x IS NOT NULL], ',')"


_USE = {n: f"regexp_matches(lower(text), '{_rx(p)}')" for n, p in g.USE.items()}
_FAMILIES = {"breakage": r"\b(broke|cracked)\b", "money": r"\b(overpriced|cheaper)\b", "trust": r"\b(sponsored|code)\b"}
_TIPS = r"""w AS (SELECT *, list_distinct([regexp_replace(x, '(ing|ed|es|s|ly)$', '') FOR x IN regexp_extract_all(lower(text), '[a-z]{4,}')]) AS w, regexp_matches(lower(text), '\b(don.?t|no|not|never|avoid)\b') AS neg,
  list_distinct(regexp_extract_all(text, '\b(\d+(?:\.\d+)?)\b', 1)) AS nums FROM turns)"""
_BEST = "m AS (SELECT f.*, p.pick FROM flagged f JOIN picks p USING (category, product_key) WHERE f.credible)"
_SHOWN = f"""m AS (SELECT f.*, p.pick FROM flagged f JOIN picks p USING (category, product_key) WHERE f.credible),
o AS (SELECT *, row_number() OVER (PARTITION BY category, product_key, stance ORDER BY abs(weight) DESC, upvotes DESC, {ORDINAL_SQL}) AS shown FROM m WHERE stance IN ('recommend', 'warn')),
q AS (SELECT category, product_key, coalesce(list({{'comment_id': comment_id, 'voice': voice, 'evidence': evidence}} ORDER BY shown) FILTER (stance = 'recommend' AND shown <= 3), []) AS praise,
  coalesce(list({{'comment_id': comment_id}} ORDER BY shown) FILTER (stance = 'warn' AND shown <= 2), []) AS warnings FROM o GROUP BY ALL),
a AS (SELECT category, list({{'pick': pick, 'product_key': product_key, 'product_name': product_name, 'score': score, 'praise': coalesce(q.praise, []), 'warnings': coalesce(q.warnings, [])}} ORDER BY pick) AS picks
  FROM picks LEFT JOIN q USING (category, product_key) GROUP BY 1),
sk AS (SELECT * FROM ranked WHERE on_skip_list QUALIFY row_number() OVER (PARTITION BY category ORDER BY credible_warnings DESC, score, lower(product_name), product_key) <= 5),
s AS (SELECT category, list(product_key ORDER BY credible_warnings DESC, score, lower(product_name), product_key) AS skip FROM sk GROUP BY 1)"""


def _read(width: int) -> str:
    """The ranking over the first threads of each category."""
    return _RANKED.replace(
        "votes AS (SELECT * FROM flagged QUALIFY",
        "toc AS (SELECT category, thread_id, count(DISTINCT comment_id) AS n FROM mentions GROUP BY ALL), "
        f"tor AS (SELECT category, thread_id FROM toc QUALIFY row_number() OVER (PARTITION BY category ORDER BY n DESC, thread_id) <= {width}), votes AS (SELECT * FROM flagged SEMI JOIN tor USING (category, thread_id) QUALIFY",
    )


QUERIES = {
    "independence_signs": (
        independence_signs,
        f"WITH {TURNS} SELECT conv_id, turn, {_tags_sql(g.INDEPENDENCE)} AS signs, " + " + ".join(f"regexp_matches(lower(text), '{_rx(p)}')::INT * {2 if n == 'paid promotion' else 1}" for n, p in g.INDEPENDENCE.items()) + " AS red_flags FROM turns",
    ),
    "honesty_tags": (honesty_tags, f"WITH {TURNS} SELECT conv_id, turn, {_tags_sql(g.HONESTY)} AS tags FROM turns"),
    "evidence_levels": (
        evidence_levels,
        f"WITH {TURNS} SELECT conv_id, turn, CASE WHEN {_USE['untried']} OR {_USE['secondhand']} THEN 'no first-hand use' WHEN {_USE['long']} AND {_USE['own']} THEN 'long-term use' WHEN {_USE['short']} OR {_USE['own']} THEN 'short-term use' ELSE 'no first-hand use' END AS evidence FROM turns",
    ),
    "thread_kinds": (thread_kinds, f"WITH {TURNS} SELECT conv_id, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{_rx(p)}') THEN '{n}'" for n, p in g.THREAD_KINDS.items()) + " ELSE 'other' END AS kind FROM turns WHERE turn = 0"),
    "says_changed": (says_changed, f"WITH {TURNS} SELECT conv_id, turn FROM turns WHERE regexp_matches(lower(text), '{_rx(g.CHANGED)}')"),
    "time_of_use": (
        time_of_use,
        f"WITH {TURNS} SELECT conv_id, turn, round(list_max([x FOR x IN list_concat(" + ", ".join(f"[y::DOUBLE * {m} FOR y IN regexp_extract_all(lower(text), '\\b(\\d+) {u}s?\\b', 1)]" for u, m in (("year", "12.0"), ("month", "1.0"), ("week", "0.25"), ("day", "(1 / 30.0::DOUBLE)"))) + ") IF x <= 720]), 6) AS months FROM turns",
    ),
    "service_filter": (service_filter, f"SELECT p_partkey FROM part WHERE regexp_matches(lower(concat_ws(' ', p_name, CASE p_size % 10 WHEN 0 THEN 'treatment' WHEN 1 THEN 'Clinic' END)), '{g.SERVICE}')"),
    "unknown_tags": (
        unknown_tags,
        "WITH t AS (SELECT p_partkey, array_to_string([x FOR x IN [p_type, CASE WHEN p_size % 2 <> 0 THEN 'odd' END] IF x NOT IN ('MEDIUM', 'LARGE', 'SMALL')], ',') AS unknown FROM part) SELECT * FROM t WHERE unknown <> ''",
    ),
    "summary_problems": (
        summary_problems,
        f"WITH {TURNS}, s AS (SELECT *, CASE WHEN conv_id % 3 = 0 THEN 'Users say: ' || text ELSE text END AS said, CASE WHEN turn % 2 = 0 THEN text ELSE 'no numbers' END AS cited FROM turns) "
        r"SELECT conv_id, turn, array_to_string([x FOR x IN [CASE WHEN len(regexp_split_to_array(trim(said, chr(10) || chr(9) || ' '), '\s+')) > 14 THEN 'too long' END, CASE WHEN regexp_matches(lower(said), '\b(users?|reviewers?|people|redditors?)\b') THEN 'speaks of people' END, "
        r"CASE WHEN NOT list_has_all(regexp_extract_all(cited, '\b(\d+(?:\.\d+)?)\b', 1), regexp_extract_all(said, '\b(\d+(?:\.\d+)?)\b', 1)) THEN 'number not cited' END] IF x IS NOT NULL], ',') AS problems FROM s",
    ),
    "tip_similarity": (
        tip_similarity,
        f"WITH {TURNS}, {_TIPS} SELECT x.conv_id, x.turn AS a, y.turn AS b FROM w x JOIN w y ON x.conv_id = y.conv_id AND x.turn < y.turn WHERE len(list_intersect(x.w, y.w)) >= 2 "
        "AND 2 * len(list_intersect(x.w, y.w)) >= 0.5 * (len(x.w) + len(y.w)) AND x.neg = y.neg AND NOT (len(x.nums) > 0 AND len(y.nums) > 0 AND NOT (list_has_all(x.nums, y.nums) AND list_has_all(y.nums, x.nums)))",
    ),
    "tip_groups": (tip_groups, None),
    "keyword_families": (keyword_families, f"WITH {TURNS}, f AS (SELECT conv_id, turn, {_tags_sql(_FAMILIES)} AS families FROM turns) SELECT * FROM f WHERE families <> ''"),
    "retype": (retype, "WITH t AS (SELECT p_partkey, p_type, CASE WHEN p_type = 'ECONOMY' AND contains(p_name, 'ring') THEN 'RING' WHEN p_size > 45 THEN 'LARGE' ELSE p_type END AS new_type FROM part) SELECT * FROM t WHERE new_type <> p_type"),
    "contradicting_as_low": (
        contradicting_as_low,
        f"WITH {MENTIONS}, x AS (SELECT * FROM mentions WHERE author IS NOT NULL), c AS (SELECT DISTINCT a.author FROM x a JOIN x b ON a.product_key = b.product_key AND a.author = b.author AND a.stance = 'recommend' AND b.stance = 'warn' AND a.comment_id <> b.comment_id) "
        "SELECT product_key, CASE WHEN author IN (SELECT author FROM c) THEN 'low' ELSE voice END AS voice, count(*) AS n FROM mentions GROUP BY ALL",
    ),
    "mention_groups": (
        mention_groups,
        f"WITH {MENTIONS}, g AS (SELECT DISTINCT thread_id, comment_id, product_key, category, stance FROM mentions WHERE products_named <> 4) SELECT category || '/' || (product_key % 50)::VARCHAR AS grp, count(*) AS n FROM mentions JOIN g USING (thread_id, comment_id, product_key, category, stance) GROUP BY 1",
    ),
    "note_kinds": (
        note_kinds,
        f"WITH {MENTIONS}, k(kind_key, kind) AS (VALUES ('ECONOMY', 'value'), ('PROMO', 'value'), ('LARGE', 'size'), ('SMALL', 'size'), ('MEDIUM', 'size'), ('STANDARD', 'size'), ('STANDARD', 'value')) "
        "SELECT kind, count(*) AS n, count(DISTINCT comment_id) AS comments FROM mentions JOIN k USING (kind_key) WHERE products_named % 5 = 0 GROUP BY 1",
    ),
    "ancestor_readable": (
        ancestor_readable,
        f"WITH RECURSIVE {REPLIES}, up AS (SELECT thread_id, comment_id, parent_id AS above, 1 AS d FROM replies WHERE parent_id IS NOT NULL UNION ALL SELECT u.thread_id, u.comment_id, r.parent_id, d + 1 FROM up u JOIN replies r ON r.thread_id = u.thread_id AND r.comment_id = u.above WHERE r.parent_id IS NOT NULL), "
        "o AS (SELECT thread_id, comment_id, coalesce(bool_or(above % 4 <> 1) FILTER (d = 1), false) AS parent, coalesce(bool_or(above % 4 <> 1) FILTER (d > 1), false) AS earlier FROM up SEMI JOIN (SELECT thread_id, comment_id AS above FROM replies) x USING (thread_id, above) GROUP BY ALL) "
        "SELECT r.thread_id, r.comment_id, coalesce(parent, false) AS parent, coalesce(earlier, false) AS earlier FROM replies r LEFT JOIN o USING (thread_id, comment_id)",
    ),
    "best_mentions": (best_mentions, f"WITH {_RANKED}, {_BEST} SELECT category, product_key, row_number() OVER (PARTITION BY category, product_key ORDER BY weight DESC, upvotes DESC, {ORDINAL_SQL}) AS shown, comment_id, upvotes FROM m WHERE stance = 'recommend' QUALIFY shown <= 3"),
    "pick_warnings": (pick_warnings, f"WITH {_RANKED}, {_BEST} SELECT category, product_key, row_number() OVER (PARTITION BY category, product_key ORDER BY weight, upvotes DESC, {ORDINAL_SQL}) AS shown, comment_id FROM m WHERE stance = 'warn' QUALIFY shown <= 2"),
    "written_answers": (written_answers, f"WITH {_RANKED}, {_SHOWN} SELECT category, to_json({{'picks': coalesce(picks, []), 'skip': coalesce(skip, [])}})::VARCHAR AS answer FROM a FULL JOIN s USING (category)"),
    "need_rule": (need_rule, f"WITH {_RANKED}, n AS (SELECT category, product_key, count(*) FILTER (credible AND stance = 'recommend' AND meets_need) AS fitting_need FROM votes GROUP BY ALL) SELECT category, product_key, fitting_need FROM ranked JOIN n USING (category, product_key) WHERE qualifies AND fitting_need > 0"),
    "live_checked_picks": (live_checked_picks, None),
    "wider_reading": (
        wider_reading,
        f"WITH a AS (WITH {_read(16)} SELECT category, count(*) FILTER (qualifies) AS q FROM ranked GROUP BY 1), b AS (WITH {_read(200)} SELECT category, count(*) FILTER (qualifies) AS q FROM ranked GROUP BY 1) "
        "SELECT category, CASE WHEN a.q < 3 AND b.q > a.q THEN b.q ELSE a.q END AS qualifying, CASE WHEN a.q < 3 AND b.q > a.q THEN 200 ELSE 16 END AS width FROM a LEFT JOIN b USING (category)",
    ),
    "pick_labels": (
        pick_labels,
        f"WITH {_RANKED}, n AS (SELECT m.category, 'topic' || honesty::VARCHAR AS topic, m.product_key, pick, count(*) AS n FROM mentions m JOIN picks p ON p.category = m.category AND p.product_key = m.product_key WHERE {_CREDIBLE} AND stance = 'recommend' GROUP BY ALL), "
        "a AS (SELECT *, coalesce(lead(n) OVER w, 0) AS nxt, row_number() OVER w AS place FROM n WINDOW w AS (PARTITION BY category, topic ORDER BY n DESC, pick)) "
        "SELECT category, pick, product_key, topic, n FROM a WHERE place = 1 AND n >= 2 AND n >= nxt + 2 QUALIFY row_number() OVER (PARTITION BY category, product_key ORDER BY n - nxt DESC, topic) = 1",
    ),
    "kind_of_product": (kind_of_product, f"WITH {_RANKED} SELECT o.category, o.product_key, o.kind_key, support AS kind_support, o.kind_bonus FROM own o JOIN kinds k ON k.category = o.category AND k.kind_key = o.kind_key"),
    "first_asked": (first_asked, "WITH u AS (SELECT p_name, p_partkey AS ordinal FROM part UNION ALL SELECT 'small ' || string_split(p_name, ' ')[2], p_partkey + 1000000 FROM part) SELECT p_name, min(ordinal) AS ordinal FROM u GROUP BY 1"),
    "union_distinct_posts": (union_distinct_posts, "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 WHEN o_orderstatus = 'F' THEN 2 ELSE 3 END AS search FROM orders WHERE o_orderpriority = '1-URGENT' OR o_orderstatus = 'F' OR o_totalprice > 200000"),
    "one_per_name": (one_per_name, "SELECT p_brand, p_name, min(p_partkey) AS first, count(*) AS products FROM part GROUP BY 1, 2"),
    "reread_merge": (
        reread_merge,
        f"WITH {REPLIES} SELECT thread_id, comment_id, CASE WHEN (thread_id + comment_id) % 6 = 0 THEN CASE WHEN comment_id > 5 THEN 'kept' ELSE 'deleted' END WHEN comment_id = 3 THEN 'edited' ELSE 'same' END AS state FROM replies",
    ),
    "slim_threads": (
        slim_threads,
        f"WITH {REPLIES} SELECT thread_id, count(*) FILTER (comment_id % 3 = 1) AS kept, count(*) FILTER (comment_id % 3 <> 1) AS dropped, sum(CASE WHEN comment_id % 3 <> 1 THEN length(body) ELSE 0 END)::BIGINT AS dropped_chars, min(comment_id) FILTER (comment_id % 3 <> 1) AS first_dropped FROM replies GROUP BY 1",
    ),
    "title_words": (title_words, "SELECT p_partkey FROM part WHERE len([w FOR w IN string_split(p_name, ' ') IF starts_with(w, 'widg')]) > 0"),
    "need_words": (need_words, "SELECT p_partkey, array_to_string([w FOR w IN ['quiet', 'small', 'hands'] IF NOT list_contains(string_split(p_name, ' '), w)], ' ') AS words FROM part"),
    "embed_urls": (
        embed_urls,
        r"WITH h AS (SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '^(www|m|old)\.', '') AS host, regexp_extract(url, '([^/?#]+)/?(?:[?#].*)?$', 1) AS last FROM pages) SELECT *, regexp_replace(host, '[^a-z]', '', 'g') AS letters FROM h",
    ),
    "image_sizes": (image_sizes, r"SELECT page_id, regexp_replace(url, '([?&]page=)[0-9]+', '\11') AS url FROM pages WHERE contains(url, 'page=')"),
    "most_named_model": (
        most_named_model,
        f"WITH {MENTIONS}, n AS (SELECT category, product_key, count(*) AS n FROM mentions WHERE {_CREDIBLE} AND stance = 'recommend' GROUP BY ALL), x AS (SELECT *, row_number() OVER o AS place, coalesce(lead(n) OVER o, 0) AS nxt, sum(n) OVER (PARTITION BY category) AS total FROM n WINDOW o AS (PARTITION BY category ORDER BY n DESC, product_key)) "
        "SELECT category, product_key, n, n >= 2 AND n >= 2 * nxt AND 4 * n >= total AS leads FROM x WHERE place = 1",
    ),
    "label_import": (label_import, "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS quality, toxic FROM labels"),
    "same_brand_pairs": (same_brand_pairs, "SELECT DISTINCT string_split(p_name, ' ')[1] AS line, p_name FROM part"),
}
