"""From ranked groups to what is shown: exclusions with their reasons, folding of brands, lookups by words, gates on quotes, notes, tips,
and what becomes of kept words when a comment changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plausia.functions.registry import find_quote
from plausia.operators.understanding import tokens
from plausia.rules import RULES, Rules


def exclusion(category: Column, asked_category: Column, kind: Column, asked_kind: Column, loose: Column, generic: Column) -> Column:
    """Why a group isn't ranked for a request, the first reason that holds; null for none. An unknown kind never excludes."""
    return (
        F.when(category != asked_category, "another category").when(kind.isNotNull() & asked_kind.isNotNull() & (kind != asked_kind), "another kind")
        .when(generic, "names no one product").when(loose, "fits several products")
    )


def without_sets(names: Column, set_words, asked: Column) -> Column:
    """Whether a name stays: its last word names no set or accessory, or that is what is asked for."""
    last = F.element_at(F.split(F.lower(names), " "), -1)
    return ~last.isin(*set_words) | last.eqNullSafe(F.lower(asked))


def of_majority_kind(mentions: DataFrame, *keys: str) -> DataFrame:
    """Mentions without those that are typed as another kind than most of their group; untyped ones stay, and a group without a
    majority loses none."""
    n = mentions.filter("kind is not null").groupBy(*keys, "kind").agg(F.count(F.lit(1)).alias("n"))
    top = n.groupBy(*keys).agg(F.max("n").alias("n")).join(n, [*keys, "n"]).groupBy(*keys).agg(F.min("kind").alias("most"), F.count(F.lit(1)).alias("ties")).filter("ties = 1").select(*keys, "most")
    return mentions.join(top, list(keys), "left").filter("most is null or kind is null or kind = most").drop("most")


def base_name(name: Column) -> Column:
    """A name without a remark that it is a new or an old formula."""
    return F.trim(F.regexp_replace(name, r"(?i)\s*[(\[]?\b(new|old|original|reformulated) (formula|version)\b[)\]]?", ""))


def folded_formulas(mentions: DataFrame) -> DataFrame:
    """Mentions of a new formula counted with the product itself, where that is named too; else they stay as written."""
    named = mentions.select("category", F.col("name").alias("base")).distinct().withColumn("known", F.lit(True))
    based = mentions.withColumn("base", base_name(F.col("name")))
    return based.join(named, ["category", "base"], "left").withColumn("name", F.when(F.col("known"), F.col("base")).otherwise(F.col("name"))).drop("base", "known")


def folded_skips(picks: DataFrame, skips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What to skip without products of a shown pick's brand, and these, as downsides of that pick. Both carry category and brand."""
    best = picks.groupBy("category", "brand").agg(F.min_by("product_key", "pick").alias("of_pick"))
    return skips.join(best, ["category", "brand"], "left_anti"), skips.join(best, ["category", "brand"])


def worth_left_out(worth: DataFrame, picks: DataFrame) -> DataFrame:
    """Products worth a look whose brand no pick has."""
    return worth.join(picks.select("category", "brand"), ["category", "brand"], "left_anti")


def unsuited_kinds(kinds: DataFrame, facts: DataFrame, asked: DataFrame) -> DataFrame:
    """Kinds to leave out: those that a fact clashes with a request's rule (category, fact, value), and the kind asked for itself."""
    clash = facts.join(asked.select("category", "fact", F.col("value").alias("wanted")), ["category", "fact"]).filter("value <> wanted").select("category", "kind").distinct()
    own = asked.select("category", F.col("kind_asked").alias("kind")).distinct()
    return kinds.join(clash.unionByName(own).distinct(), ["category", "kind"], "left_semi")


def counted_warnings(mentions: DataFrame, opposite: Column, rules: Rules = RULES) -> DataFrame:
    """Warnings of each product, and those that count towards skipping it: a warning from a writer of the opposite need doesn't."""
    bad = F.col("stance") == "warn"
    by = mentions.groupBy("category", "product_key").agg(F.count_if(bad).alias("warnings"), F.count_if(bad & ~F.coalesce(opposite, F.lit(False))).alias("counted"))
    return by.withColumn("could_skip", F.col("counted") >= rules.skip_min_warnings)


def entry_by_words(asked: DataFrame, entries: DataFrame, order: list[Column], columns: list[str]) -> DataFrame:
    """For each asked name (category, kind, name) the best entry (category, kind, name, ...) with the same words; entries without a kind
    stand for every kind."""
    key = lambda c: F.array_join(F.array_sort(F.array_distinct(tokens(F.col(c)))), " ")
    a = asked.withColumn("words", key("name"))
    e = entries.withColumn("words", key("name")).withColumnRenamed("kind", "entry_kind").drop("name")
    fits = a.join(e, ["category", "words"]).filter("entry_kind is null or kind is null or entry_kind = kind")
    return fits.groupBy("category", "kind", "name").agg(F.min_by(F.struct(*columns), F.struct(F.col("entry_kind").isNull().alias("_any"), *order)).alias("e")).select("category", "kind", "name", "e.*")


def sale(entries: DataFrame, hosts, today: Column, rules: Rules = RULES) -> DataFrame:
    """For each product the newest, then cheapest, fresh price at shops of a country, told by their hosts exactly."""
    host = F.regexp_replace(F.lower(F.regexp_extract("url", r"^[a-z]+://([^/?#:]+)", 1)), r"^www\.", "")
    fresh = entries.filter(host.isin(*hosts) & F.col("available") & (F.datediff(today, "checked_on") <= rules.price_max_age_days))
    return fresh.groupBy("product_key").agg(F.min_by(F.struct("price", "checked_on", host.alias("host")), F.struct((-F.unix_date("checked_on")).alias("d"), "price", host.alias("h"))).alias("s")).select("product_key", "s.*")


def gated(quotes: DataFrame) -> DataFrame:
    """Answers with the number of their quotes and of those that don't stand in their comment; an answer with one such is refused.
    quotes: answer, body, quote."""
    fails = find_quote("body", "quote")["start"].isNull()
    return quotes.withColumn("fails", fails).groupBy("answer").agg(F.count(F.lit(1)).alias("quotes"), F.count_if("fails").alias("failing")).withColumn("refused", F.col("failing") > 0)


def look_for(kinds: DataFrame, shown: DataFrame, refused: DataFrame, most: int = 3) -> DataFrame:
    """The best supported kinds of a category that are neither the shown picks' own kind, nor refused, nor warned off."""
    left = kinds.filter("support > 0").join(shown.select("category", "kind_key"), ["category", "kind_key"], "left_anti").join(refused.select("category", "kind_key"), ["category", "kind_key"], "left_anti")
    place = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("support"), F.lower("kind_key"), "kind_key"))
    return left.withColumn("place", place).filter(F.col("place") <= most)


def tips_shown(tips: DataFrame, picks: DataFrame, most: int = 2) -> DataFrame:
    """Of the tips of credible writers (category, product_key, cluster, tip, voice, ordinal) one of each cluster, by how many give it, and
    the best few for each pick."""
    heads = tips.filter(F.col("voice").isin("high", "medium")).groupBy("category", "product_key", "cluster").agg(F.count(F.lit(1)).alias("given"), F.min("ordinal").alias("ordinal"))
    mine = heads.join(picks.select("category", "product_key"), ["category", "product_key"], "left_semi")
    place = F.row_number().over(Window.partitionBy("category", "product_key").orderBy(F.desc("given"), "ordinal"))
    return mine.withColumn("shown", place).filter(F.col("shown") <= most)


def check_outcome(status: Column, body: Column, quote: Column) -> Column:
    """What a read of a comment says of a quote from it."""
    return F.when(status.isNull(), "unknown").when(status.isin("deleted", "removed"), status).when(body.isNull(), "unreadable").when(find_quote(body, quote)["start"].isNull(), "changed").otherwise("passing")


def kept_after_edit(items: DataFrame, edited: DataFrame) -> DataFrame:
    """Items (comment_id, item, quote) with whether they are kept once their comment reads as edited (comment_id, body): all items of
    comments that weren't edited, and those whose quote is still there."""
    j = items.join(edited.select("comment_id", F.col("body").alias("_body"), F.lit(True).alias("_edited")), "comment_id", "left")
    return j.withColumn("kept", F.col("_edited").isNull() | find_quote("_body", "quote")["start"].isNotNull()).drop("_body", "_edited")


def restorable(backup: DataFrame, pairs: DataFrame, checks: DataFrame) -> DataFrame:
    """Words to put back: comments of the backup that are wanted and whose latest check passed."""
    good = checks.groupBy("comment_id").agg(F.max_by("outcome", F.struct("at", "outcome")).alias("outcome")).filter("outcome = 'passing'").select("comment_id")
    return backup.join(pairs.distinct(), ["thread_id", "comment_id"]).join(good, "comment_id")


def own_site(link: Column, writer: Column, body: Column, brand: Column) -> Column:
    """Signs that a writer speaks for a brand: a link whose host holds the writer's name, or a sign-off that names the brand."""
    letters = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    host = letters(F.regexp_extract(link, r"^[a-z]+://(?:www\.)?([^/?#:]+)", 1))
    name = letters(writer)
    last = F.element_at(F.split(F.rtrim(body), r"\n"), -1)
    return F.array_compact(F.array(F.when((F.length(name) >= 4) & F.contains(host, name), "links to a site of their name"), F.when(F.rlike(F.lower(last), F.lit("^(- ?|from |your friends at |the team at )")) & F.contains(F.lower(last), F.lower(brand)), "signs for the brand")))


def badges(voice: Column, evidence: Column) -> Column:
    """The good reasons of a mention, voice first, each once."""
    return F.array_distinct(F.concat(F.coalesce(voice, F.array().cast("array<string>")), F.coalesce(evidence, F.array().cast("array<string>"))))


def request_category(category: Column, several: Column, asked: Column) -> Column:
    """A thread's category for a request: that of the request where the community is one of several categories."""
    return F.when(several, asked).otherwise(category)


def slim_differences(whole: DataFrame, slim: DataFrame) -> DataFrame:
    """Rows that answers would read from one form of the library and not from the other, with their side."""
    return whole.exceptAll(slim).withColumn("side", F.lit("whole")).unionByName(slim.exceptAll(whole).withColumn("side", F.lit("slim")))


def collected(comments: DataFrame, wanted: DataFrame) -> DataFrame:
    """The comments of wanted posts, an array a post in the order of their ids. comments: post_id, comment_id, score."""
    return comments.join(wanted.select("post_id").distinct(), "post_id", "left_semi").groupBy("post_id").agg(F.array_sort(F.collect_list(F.struct("comment_id", "score"))).alias("comments"))


def maker_spelling(name: Column, renames: dict[str, str]) -> Column:
    """A name with its brand as sold here and spelled as its maker does; renames: what it begins with, in lower case, and what is shown."""
    out = F.lit(None).cast("string")
    for old, new in sorted(renames.items(), key=lambda x: (len(x[0]), x[0])):
        out = F.when(F.lower(name).startswith(old + " ") | (F.lower(name) == old), F.concat(F.lit(new), F.substring(name, F.lit(len(old) + 1), F.length(name)))).otherwise(out)
    return F.coalesce(out, name)


def line_name(brand: Column, kind: Column, ingredients: Column) -> Column:
    """What a brand's line is shown as: the brand, the ingredients that tell it, its kind, and that it is a line."""
    return F.concat_ws(" ", brand, F.array_join(ingredients, " "), kind, F.lit("line"))


def need_share(about: Column, credible: Column) -> Column:
    """The share of a reading's credible voices that are about a need; null without any."""
    return F.try_divide(F.count_if(credible & about), F.count_if(credible))


def case_scores(cases: DataFrame, *aspects: str) -> DataFrame:
    """For each aspect of end-to-end cases how many were right, of how many that expect something. cases: want_x and got_x."""
    rows = [F.struct(F.lit(a).alias("aspect"), F.count_if(F.col(f"want_{a}").isNotNull()).alias("cases"), F.count_if(F.col(f"want_{a}") == F.col(f"got_{a}")).alias("right")) for a in aspects]
    one = cases.agg(F.array(*rows).alias("r")).select(F.inline("r"))
    return one.withColumn("share", F.round(F.try_divide("right", "cases"), 9))


def verified_items(items: DataFrame, checks: DataFrame, since: Column) -> DataFrame:
    """Items whose comment passed a check since then. checks: comment_id, at, outcome."""
    good = checks.filter((F.col("outcome") == "passing") & (F.col("at") >= since)).select("comment_id").distinct()
    return items.join(good, "comment_id", "left_semi")


def reviewed(items: DataFrame, decisions: DataFrame, *keys: str) -> DataFrame:
    """Items with the decisions of a review (keys, action, quote): removed ones go, requoted ones get the quote given."""
    j = items.join(decisions.select(*keys, "action", F.col("quote").alias("_quote")), list(keys), "left")
    return j.filter(~F.col("action").eqNullSafe("remove")).withColumn("quote", F.when(F.col("action") == "requote", F.col("_quote")).otherwise(F.col("quote"))).drop("action", "_quote")


def naming_points(comments: Column) -> Column:
    """What a thread gains by comments that name a product: half a point each, three at most."""
    return F.least(F.lit(3.0), 0.5 * comments)


def searched(threads: DataFrame, most: int) -> DataFrame:
    """Each category's threads to read: relevant ones, by need and then relevance within spans of age, the best few. threads: category,
    thread_id, span, needs, relevance."""
    place = F.row_number().over(Window.partitionBy("category").orderBy("span", F.desc("needs"), F.desc("relevance"), "thread_id"))
    return threads.filter("relevance > 0").withColumn("place", place).filter(F.col("place") <= most)


def unconfirmed(asks: DataFrame, rules: DataFrame, facts: DataFrame) -> DataFrame:
    """For each request (request, ask) and product what its rules (ask, fact, value, hard) say of the product's facts (product_key, kind, fact,
    value): conflicts, cautions, and what no fact confirms. A rule may be for one kind of product only."""
    wanted = asks.join(rules, "ask").select("request", F.coalesce("kind", F.lit("*")).alias("kind"), "fact", F.col("value").alias("wanted"), "hard").distinct()
    products = facts.select("product_key", F.explode(F.array_distinct(F.array(F.coalesce("kind", F.lit("*")), F.lit("*")))).alias("kind")).distinct()
    each = products.join(wanted, "kind")
    state = F.when(F.col("value").isNull(), "unconfirmed").when(F.col("value") == F.col("wanted"), "meets").when(F.col("hard"), "conflict").otherwise("caution")
    known = facts.select("product_key", "fact", "value").filter("value is not null")
    return each.join(known, ["product_key", "fact"], "left").groupBy("request", "product_key").agg(*(F.count_if(state == x).alias(x) for x in ("meets", "conflict", "caution", "unconfirmed")))


def fresh_profiles(profiles: DataFrame, today: Column, days: int = 30) -> DataFrame:
    """Profiles of writers that were looked up lately enough to be used; numbers below zero are unknown."""
    known = lambda c: F.when(F.col(c) >= 0, F.col(c)).alias(c)
    return profiles.filter(F.datediff(today, "looked_up") <= days).select("writer", known("karma"), known("contributions"), "looked_up")


def folded_lines(picks: DataFrame, qualifying: DataFrame) -> DataFrame:
    """Picks that are a brand's whole line step aside for a product of that brand that qualifies itself: its best is shown in their place.
    picks: category, brand, pick, is_line; qualifying: category, brand, product_key, place, is_line."""
    own = qualifying.filter(~F.col("is_line")).groupBy("category", "brand").agg(F.min_by("product_key", "place").alias("instead"))
    return picks.join(own, ["category", "brand"], "left").withColumn("instead", F.when(F.col("is_line"), F.col("instead")))


def read_or_expired(threads: DataFrame, capacity: int, today: Column, rules: Rules = RULES) -> DataFrame:
    """A pass over a library: the longest unread threads are read anew, as many as can be; of the others those beyond retention lose their
    words. threads: thread_id, checked, archived."""
    from plausia.operators.order import numbered
    from plausia.operators.threads import retention_over

    age = F.datediff(today, "checked")
    placed = numbered(threads, F.asc_nulls_first("checked"), "thread_id")
    over = F.coalesce(retention_over(age, F.col("archived"), rules), F.lit(True))
    return placed.withColumn("state", F.when(F.col("place") <= capacity, "read").when(over, "expired").otherwise("kept"))
