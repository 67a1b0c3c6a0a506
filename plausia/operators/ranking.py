"""Ranking of products by credible mentions: weights, one vote a writer, the bar, kinds, lists.

Input mentions carry category, product_key, product_name, thread_id, comment_id, author, stance, voice, evidence, honesty,
upvotes, thread_comments, share_beaten, products_named, meets_need and ordinal (the input order, any orderable type).
Every step is an aggregate that combines before it shuffles; windows run over products, never over mentions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plausia.rules import RULES, Rules


def _chosen(column: str, values: dict) -> Column:
    out = F.lit(None).cast("double")
    for k, v in values.items():
        out = F.when(F.col(column) == k, F.lit(float(v))).otherwise(out)
    return out


def mention_weight(rules: Rules = RULES) -> Column:
    """Voice value times evidence value (with a bonus for each sign of honesty) times the stance's sign."""
    evidence = _chosen("evidence", rules.evidence_value) * (1 + rules.honesty_bonus * F.col("honesty"))
    return _chosen("voice", rules.voice_value) * evidence * _chosen("stance", rules.stance_value)


def note_weight(rules: Rules = RULES) -> Column:
    return _chosen("voice", rules.voice_value) * _chosen("stance", rules.stance_value)


def is_credible(with_evidence: bool = True) -> Column:
    credible = (F.col("stance") != "neutral") & F.col("voice").isin("high", "medium")
    return credible & F.col("evidence").isin("long-term use", "short-term use") if with_evidence else credible


def counts_twice(rules: Rules = RULES) -> Column:
    """A credible recommendation with many upvotes, near the top of a large thread. Unknown numbers never count."""
    enough = (F.col("upvotes") >= rules.upvote_min_score) & (F.col("thread_comments") >= rules.upvote_thread_min_comments)
    return F.coalesce((F.col("stance") == "recommend") & is_credible() & enough & (F.col("share_beaten") >= rules.upvote_share_beaten), F.lit(False))


def stands_out(needs_asked: bool = False, rules: Rules = RULES) -> Column:
    """A credible recommendation whose upvotes are many for the size of its thread, naming few products."""
    enough = (F.col("upvotes") >= rules.standout_min_score) & (F.col("thread_comments") >= rules.standout_min_comments)
    few = F.col("products_named") <= rules.standout_max_products
    many = F.try_divide("upvotes", "thread_comments") >= rules.standout_per_comment
    need = F.col("meets_need") if needs_asked else F.lit(True)
    return F.coalesce((F.col("stance") == "recommend") & is_credible() & enough & few & many & need, F.lit(False))


def thread_upvotes(mentions: DataFrame) -> DataFrame:
    """Adds thread_comments and share_beaten: how many of a thread's other comments score strictly lower, as a share.

    One shuffle by thread: a comment's score is the most upvotes of its mentions, and its first mention stands for it when the
    comments below a score are counted."""
    of_comment = Window.partitionBy("thread_id", "comment_id")
    of_thread = Window.partitionBy("thread_id")
    lowest = F.lit(-(2**62))  # a comment without upvotes is below all others
    rows = mentions.repartition("thread_id").withColumn("_score", F.coalesce(F.max("upvotes").over(of_comment).cast("long"), lowest))
    rows = rows.withColumn("_first", (F.row_number().over(of_comment.orderBy("_score")) == 1).cast("long"))
    below = F.coalesce(F.sum("_first").over(of_thread.orderBy("_score").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumns({"thread_comments": F.sum("_first").over(of_thread), "_below": below})
    share = F.when(F.col("thread_comments") > 1, F.col("_below") / (F.col("thread_comments") - 1)).otherwise(F.lit(0.0))
    return rows.withColumn("share_beaten", share).drop("_score", "_first", "_below")


def voter() -> Column:
    """Who votes: a writer by name, a deleted account by its comment. The two never collide."""
    return F.coalesce(F.concat(F.lit("w:"), F.col("author")), F.concat(F.lit("c:"), F.col("comment_id").cast("string")))


def one_vote(items: DataFrame, *keys: str) -> DataFrame:
    """For each key and voter, the item with the largest weight either way; of equals the first by ordinal."""
    own = [c for c in items.columns if c not in keys]
    best = F.min_by(F.struct(*own), F.struct((-F.abs("weight")).alias("w"), F.col("ordinal")))
    return items.withColumn("_voter", voter()).groupBy(*keys, "_voter").agg(best.alias("_one")).select(*keys, "_one.*")


def kind_support(notes: DataFrame, placements: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Each kind's credible support; kinds with placements and no notes have 0. Notes are votes already (one_vote)."""
    sums = notes.groupBy("category", "kind_key").agg(
        F.round(F.coalesce(F.sum(F.when(is_credible(False), F.col("weight"))), F.lit(0.0)), rules.decimals).alias("support"),
        F.count_if(is_credible(False) & (F.col("stance") == "recommend")).alias("credible_notes"),
        F.count_distinct(F.when(is_credible(False) & (F.col("stance") == "warn"), voter())).alias("warning_writers"),
    )
    kinds = placements.select("category", "kind_key").distinct().join(sums, ["category", "kind_key"], "full")
    return kinds.select("category", "kind_key", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("support", "credible_notes", "warning_writers")))


def warned_off_kinds(kinds: DataFrame, rules: Rules = RULES) -> DataFrame:
    return kinds.filter((F.col("warning_writers") >= rules.skip_min_warnings) & (F.col("warning_writers") > F.col("credible_notes")))


def leading_kinds(kinds: DataFrame, rules: Rules = RULES) -> DataFrame:
    """In each category the kind with far more credible support than any other, where there is one."""
    w = Window.partitionBy("category").orderBy(F.desc("support"), F.lower("kind_key"), "kind_key")
    ranked = kinds.withColumn("place", F.row_number().over(w)).withColumn("_next", F.greatest(F.coalesce(F.lead("support").over(w), F.lit(0.0)), F.lit(0.0)))
    ahead = (F.col("support") > F.col("_next")) & (F.col("support") >= rules.kind_lead_ratio * F.col("_next"))
    return ranked.withColumn("leads", (F.col("place") == 1) & (F.col("credible_notes") >= rules.kind_min_notes) & (F.col("support") > 0) & ahead).drop("_next")


def kind_bonus(kinds: DataFrame, placements: DataFrame, rules: Rules = RULES) -> DataFrame:
    """For each placed product its kind (the leading one, else the best supported) and the bonus or penalty it brings."""
    ranked = leading_kinds(kinds, rules)
    warned = warned_off_kinds(kinds, rules).select("category", "kind_key", F.lit(True).alias("warned"))
    of = placements.join(ranked, ["category", "kind_key"]).join(warned, ["category", "kind_key"], "left")
    own = of.groupBy("category", "product_key").agg(F.min_by(F.struct("kind_key", "support", "leads", F.coalesce("warned", F.lit(False)).alias("warned")), F.struct((~F.col("leads")).alias("a"), F.col("place"))).alias("k"))
    bonus = F.when(F.col("k.leads"), rules.kind_bonus).when(F.col("k.warned"), -rules.kind_bonus).otherwise(0.0)
    return own.select("category", "product_key", F.col("k.kind_key").alias("kind_key"), F.col("k.support").alias("kind_support"), bonus.alias("kind_bonus"))


def level_counts(rules: Rules = RULES) -> list[Column]:
    """Recommendations and warnings by voice and evidence level, zeros included."""
    out = []
    for stance in ("recommend", "warn"):
        for column, levels in (("voice", rules.voice_value), ("evidence", rules.evidence_value)):
            out += [F.count_if((F.col("stance") == stance) & (F.col(column) == level)).alias(f"{stance}_{level.split('-')[0].split(' ')[0]}_{column}") for level in levels]
    return out


def score_products(votes: DataFrame, bonuses: DataFrame | None = None, rules: Rules = RULES) -> DataFrame:
    """One row a product: its points and counts, and whether it meets the bar, stands out, is worth a look or is to skip."""
    good, bad = is_credible() & (F.col("stance") == "recommend"), is_credible() & (F.col("stance") == "warn")
    one = votes.groupBy("category", "product_key").agg(
        F.min("product_name").alias("product_name"),
        (F.round(F.sum("weight"), rules.decimals) + F.lit(0.0)).alias("points"),
        F.count_if(F.col("stance") == "recommend").alias("recommends"),
        F.count_if(F.col("stance") == "warn").alias("warnings"),
        F.count_if(F.col("stance") == "neutral").alias("neutral"),
        F.count_if(good).alias("credible_recommends"),
        F.count_if(bad).alias("credible_warnings"),
        F.count_distinct("thread_id").alias("threads"),
        F.count_distinct(F.when(good, F.col("thread_id"))).alias("credible_threads"),
        F.count_distinct(F.when(bad, F.col("thread_id"))).alias("warning_threads"),
        F.count_if(good & (F.col("voice") == "high")).alias("high_voices"),
        F.count_if(good & F.col("meets_need")).alias("fitting_need"),
        F.count_if(counts_twice(rules)).alias("could_count_twice"),
        F.count_if(stands_out(rules=rules)).alias("standouts"),
        *level_counts(rules),
    )
    if bonuses is None:
        one = one.withColumns({"kind_key": F.lit(None).cast("string"), "kind_bonus": F.lit(0.0)})
    else:
        one = one.join(bonuses.select("category", "product_key", "kind_key", "kind_bonus"), ["category", "product_key"], "left").fillna(0.0, ["kind_bonus"])
    short = F.greatest(F.lit(0), rules.min_credible - F.col("credible_recommends"))
    one = one.withColumn("twice", F.least("could_count_twice", short).cast("long"))
    one = one.withColumn("warned_off", (F.col("credible_warnings") >= rules.skip_min_warnings) & (F.col("credible_warnings") > F.col("credible_recommends")))
    one = one.withColumn("on_skip_list", F.col("warned_off") & (F.col("warning_threads") >= rules.skip_min_threads))
    one = one.withColumn("disputed", (F.col("credible_recommends") > 0) & (F.col("credible_warnings") >= rules.disputed_min_warnings))
    one = one.withColumn("shortfall", shortfall(rules))
    by_standout = (F.col("standouts") > 0) & F.col("shortfall").isNotNull() & (F.col("points") > 0) & ~F.col("warned_off") & (F.col("credible_warnings") < F.col("credible_recommends"))
    one = one.withColumn("by_standout", by_standout)
    fills = F.col("by_standout") & (F.col("credible_recommends") >= 2) & (F.col("credible_recommends") + F.col("standouts") >= rules.min_credible)
    one = one.withColumn("_fills", fills)
    one = one.withColumn("shortfall", F.when(~F.col("_fills"), F.col("shortfall"))).withColumn("twice", F.when(F.col("_fills"), F.lit(0)).otherwise(F.col("twice")))
    two = (F.col("credible_recommends") == rules.worth_credible) & (F.col("credible_threads") >= rules.worth_min_threads) & (F.col("points") > 0) & ~F.col("warned_off")
    one = one.withColumn("qualifies", F.col("shortfall").isNull())
    one = one.withColumn("worth_a_look", (two | F.col("by_standout")) & (~F.col("qualifies") | (F.col("twice") > 0) | F.col("by_standout")))
    one = one.withColumn("lifted", F.col("qualifies") & (F.col("twice") > 0) & (F.col("credible_recommends") < rules.min_credible))
    one = one.withColumn("on_its_own", F.col("qualifies") & ~F.col("lifted") & ~F.col("by_standout"))
    return one.withColumn("score", F.round(F.col("points") + F.col("kind_bonus"), rules.decimals)).drop("_fills", "could_count_twice")


def shortfall(rules: Rules = RULES) -> Column:
    """Which rules of the bar a product fails, in words; null for none."""
    bar = F.col("credible_recommends") + F.col("twice")
    counted = F.when(F.col("twice") > 0, F.format_string(" (%d counted twice for %s upvotes)", F.col("twice"), F.when(F.col("twice") == 1, "its").otherwise("their"))).otherwise("")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("warned_off"), F.concat(F.lit("more credible warnings than recommendations"), F.when(F.col("on_skip_list"), " (on the skip-these list)").otherwise(""))),
            F.when(bar < rules.min_credible, F.concat(F.format_string(f"%d of {rules.min_credible} credible recommendations", bar), counted)),
            F.when(F.col("credible_threads") < rules.min_threads, F.format_string(f"credible recommendations in %d of {rules.min_threads} threads", F.col("credible_threads"))),
            F.when(F.col("points") <= 0, F.lit("warnings outweigh its support")),
        )
    )
    return F.when(F.size(reasons) > 0, F.array_join(reasons, "; "))


def rank_order() -> list[Column]:
    return [F.desc("score"), F.desc("credible_recommends"), F.desc("credible_threads"), F.desc("high_voices"), F.lower("product_name"), F.col("product_key")]


def ranked(products: DataFrame) -> DataFrame:
    """Adds place, the rank within the category. Products of a category are few beside its mentions."""
    return products.withColumn("place", F.row_number().over(Window.partitionBy("category").orderBy(*rank_order())))


def picks(products: DataFrame, rules: Rules = RULES) -> DataFrame:
    """The first products that qualify; those that upvotes or a standing-out comment lifted come after the others."""
    later = F.col("by_standout") | F.col("lifted")
    w = Window.partitionBy("category").orderBy(later, "place")
    return products.filter("qualifies").withColumn("pick", F.row_number().over(w)).filter(F.col("pick") <= rules.picks_shown)


def worth_a_look(products: DataFrame, chosen: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Past the picks first, then products with two credible recommendations, then those that stand out."""
    rest = products.join(chosen.select("category", "product_key"), ["category", "product_key"], "left_anti")
    block = F.when(F.col("on_its_own"), 0).when(F.col("worth_a_look") & ~F.col("by_standout"), 1).when(F.col("worth_a_look"), 2)
    w = Window.partitionBy("category").orderBy("block", "place")
    return rest.withColumn("block", block).filter("block is not null").withColumn("shown", F.row_number().over(w)).filter(F.col("shown") <= rules.worth_shown)


def skip_list(products: DataFrame, rules: Rules = RULES) -> DataFrame:
    w = Window.partitionBy("category").orderBy(F.desc("credible_warnings"), "score", F.lower("product_name"), "product_key")
    return products.filter("on_skip_list").withColumn("shown", F.row_number().over(w)).filter(F.col("shown") <= rules.skip_shown)


#: What scoring reads of a mention; nothing else goes through the shuffle of the votes.
SCORED = ("category", "product_key", "product_name", "thread_id", "comment_id", "author", "stance", "voice", "evidence", "upvotes", "thread_comments", "share_beaten", "products_named", "meets_need", "weight", "ordinal")


def note_bonuses(notes: DataFrame, placements: DataFrame, rules: Rules = RULES) -> DataFrame:
    heard = one_vote(notes.withColumn("weight", note_weight(rules)), "category", "kind_key")
    return kind_bonus(kind_support(heard, placements, rules), placements, rules)


def rank_products(mentions: DataFrame, notes: DataFrame | None = None, placements: DataFrame | None = None, rules: Rules = RULES, bonuses: DataFrame | None = None) -> DataFrame:
    """Mentions to ranked products, every category at once. Mentions need thread_upvotes' columns. bonuses: note_bonuses made before."""
    votes = one_vote(mentions.withColumn("weight", mention_weight(rules)).select(*SCORED), "category", "product_key")
    if bonuses is None and notes is not None and placements is not None:
        bonuses = note_bonuses(notes, placements, rules)
    return ranked(score_products(votes, bonuses, rules))
