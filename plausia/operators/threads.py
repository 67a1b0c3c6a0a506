"""Operators over comments of threads: readability, standing in the thread, spans, spread of kinds, reply trees.

Comments carry thread_id, comment_id, author, kind, score, status and created_at; replies carry parent_id and body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plausia.operators.saved import saved
from plausia.rules import RULES, Rules

DAY_US = 86_400_000_000


def days_between(later: Column, earlier: Column) -> Column:
    """Elapsed days, floored to periods of 24 hours (not calendar days)."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.floor((micros(later) - micros(earlier)) / F.lit(DAY_US)).cast("long")


def readable(comments: DataFrame) -> DataFrame:
    """Comments readable when they were read, kept words or not."""
    return comments.filter(F.col("status").isin("ok", "not_kept"))


def without_unusable(comments: DataFrame) -> DataFrame:
    return comments.filter(F.col("status") == "ok")


def stubs(comments: DataFrame) -> DataFrame:
    """Comments as a library keeps them: a deleted or removed one loses its writer, never its id and score."""
    return comments.withColumn("author", F.when(~F.col("status").isin("deleted", "removed"), F.col("author")))


def upvotes(comments: DataFrame) -> DataFrame:
    """thread_comments and share_beaten of every readable comment, and the sign that its score gives."""
    w = Window.partitionBy("thread_id")
    out = readable(comments).withColumn("thread_comments", F.count(F.lit(1)).over(w)).withColumn("share_beaten", F.percent_rank().over(w.orderBy("score")))
    well = (F.col("thread_comments") > 1) & (F.col("score") >= RULES.well_upvoted_min_score) & (F.col("share_beaten") >= RULES.well_upvoted_share)
    return out.withColumn("sign", F.when(F.col("score") < 0, "downvoted").when(well, "well upvoted"))


def shown_comments(comments: DataFrame, most: int) -> DataFrame:
    """The highest-scored readable comments of each thread, with their place in thread order; ties by earlier place."""
    w = Window.partitionBy("thread_id")
    top = without_unusable(comments).withColumn("_n", F.row_number().over(w.orderBy(F.desc("score"), "created_at", "comment_id"))).filter(F.col("_n") <= most)
    return top.withColumn("place", F.row_number().over(w.orderBy("created_at", "comment_id"))).drop("_n")


def first_seen(comments: DataFrame) -> DataFrame:
    """When each writer first wrote in each thread."""
    return comments.filter("author is not null").groupBy("thread_id", "author").agg(F.min("created_at").alias("first_seen"))


def flair_as_of(comments: DataFrame, flair: Column) -> DataFrame:
    """Each writer's flair at their latest comment that shows one; of equal times the later id."""
    shown = comments.withColumn("flair", flair).filter("author is not null and flair is not null and flair <> ''")
    return shown.groupBy("author").agg(F.max_by("flair", F.struct("created_at", "comment_id")).alias("flair"), F.max("created_at").alias("as_of"))


def newest_first_spans(threads: DataFrame) -> DataFrame:
    """Whole years of 365.25 days that a thread is older than the newest. One row of maxima is joined, not a window of all."""
    newest = threads.agg(F.max("created_at").alias("newest"))
    return threads.join(F.broadcast(newest)).withColumn("span", F.floor(days_between(F.col("newest"), F.col("created_at")) / F.lit(365.25)).cast("int")).drop("newest")


def relevance(titled: Column, posted: Column, talking: Column) -> Column:
    """How much a thread is about a product: its title, its post, and up to five comments that name it."""
    return 3.0 * titled.cast("int") + 1.0 * posted.cast("int") + F.least(F.lit(1.0), talking / F.lit(5.0))


def last_checked(checked_live_at: Column, from_archive: Column, collected_at: Column) -> Column:
    return F.coalesce(checked_live_at, F.when(~from_archive, collected_at))


def voice_level(red_flags: Column, worth: Column, old_and_reformulated: Column, rules: Rules = RULES) -> Column:
    """Two red flags are low; good signs worth enough and no flag are high, but for old comments on changing products."""
    high = (worth >= rules.voice_high_worth) & (red_flags == 0) & ~old_and_reformulated
    return F.when(red_flags >= rules.voice_low_flags, "low").when(high, "high").otherwise("medium")


def standing_signs(age_days: Column, karma: Column, contributions: Column, rules: Rules = RULES) -> dict[str, Column]:
    """Signs of a writer's standing when a comment was written. Unknown numbers give no sign."""
    per = F.try_divide(karma, contributions)
    per_year = F.try_divide(karma, age_days / F.lit(365.25))
    low = F.when(karma < 0, True).when((contributions > 0), per < rules.karma_per_contribution_low).otherwise(False)
    good = F.when(karma < 0, False).when(contributions > 0, per >= rules.karma_per_contribution_good).otherwise(per_year >= rules.karma_per_year_good)
    yes = lambda c: F.coalesce(c, F.lit(False))
    return {
        "new_account": yes(age_days < rules.new_account_days),
        "established": yes((age_days >= rules.established_years * 365.25) & (karma >= rules.established_min_karma)),
        "low_karma": yes(low),
        "well_regarded": yes(good),
    }


def evidence_merged(level: Column, other_level: Column, secondhand: Column, concrete: Column, first_person: Column, own_use: Column, someone_else: Column, verdict: Column, no_time: Column) -> Column:
    """The evidence level by rule, once a second reading of the mention is taken in (a decision table)."""
    use = other_level.isin("short-term use", "long-term use")
    none = F.lit("no first-hand use")
    hearsay = use & secondhand & (level != none) & ~own_use & (someone_else | verdict)
    adds = use & (level == none) & ~secondhand & (concrete | first_person)
    lengthens = (other_level == "long-term use") & (level == "short-term use") & (no_time | verdict) & ~secondhand & (concrete | first_person)
    takes = (other_level == none) & (level != none) & ~(verdict & ~secondhand)
    return F.when(hearsay, none).when(adds, other_level).when(lengthens, F.lit("long-term use")).when(takes, none).otherwise(level)


def agreeing_replies(replies: DataFrame, agrees: Column) -> DataFrame:
    """For each comment, how many replies agree with it, leaving out replies known to be by its own writer."""
    a, p = replies.alias("a").filter(agrees), replies.alias("p")
    on = (F.col("a.thread_id") == F.col("p.thread_id")) & (F.col("a.parent_id") == F.col("p.comment_id"))
    own = F.col("a.author").isNotNull() & F.col("a.author").eqNullSafe(F.col("p.author"))
    return a.join(p, on).filter(~own).groupBy("p.thread_id", "p.comment_id").agg(F.count_distinct("a.comment_id").alias("replies_agree"))


def first_reason(rules: list[tuple[str, Column]], kept: str | None = None) -> Column:
    """The name of the first rule that holds, in their order; what holds none is kept, under a name if one is given."""
    out = F.lit(kept)
    for name, holds in reversed(rules):
        out = F.when(holds, F.lit(name)).otherwise(out)
    return out


def refresh_due(days: Column, comments: Column, rules: Rules = RULES) -> Column:
    """Whether a thread is due to be read anew: after some days, or more where little is said."""
    return days >= F.when(comments < rules.quiet_comments, rules.refresh_quiet_days).otherwise(rules.refresh_days)


def retention_over(age_days: Column, archived: Column, rules: Rules = RULES) -> Column:
    """Whether a comment's words may no longer be kept: unchecked for too long, longer where an archive gave them."""
    return age_days > F.when(archived, rules.keep_days + rules.archive_days).otherwise(rules.keep_days)


def post_score(asks_advice: Column, talked: Column, talk: Column, tiny: Column, old: Column, wanted: Column) -> Column:
    """A post's score for reading: advice asked for counts most, then its kind and the talk under it; tiny and old ones lose. Unwanted
    kinds have none."""
    score = F.when(asks_advice, 3.0).otherwise(1.0) + F.when(talked, 0.5).otherwise(0.0) + F.log10(1 + talk) - F.when(tiny, 2.0).otherwise(0.0) - F.when(old, 1.5).otherwise(0.0)
    return F.when(wanted, F.round(score, 6))


def readable_above(replies: DataFrame, readable: Column) -> DataFrame:
    """For each comment whether its parent can be read, and whether any comment further up can: what a reply that names nothing may be about."""
    of = levels(replies.withColumn("_ok", readable), F.col("_ok"))
    n = F.size("path")
    earlier = F.exists(F.slice("path", F.lit(1), F.greatest(n - 2, F.lit(0))), lambda ok: ok)
    return of.select("thread_id", "comment_id", F.coalesce(F.get("path", n - 2), F.lit(False)).alias("parent"), F.coalesce(earlier, F.lit(False)).alias("earlier"))


def levels(replies: DataFrame, key: Column) -> DataFrame:
    """thread_id, comment_id, depth and path, an array of the keys from a thread's root down to the comment.

    Level by level: each step joins the comments of the next level to those found, until none is left; a step's rows are
    saved, and every comment is joined once. A comment without a parent, or whose parent isn't there, is a root; comments that
    answer one another in a circle hang below no root and are an error.
    """
    rows = saved(replies.select("thread_id", "comment_id", "parent_id", key.alias("key")))
    parents = rows.select("thread_id", F.col("comment_id").alias("parent_id")).distinct()
    below = saved(rows.join(parents, ["thread_id", "parent_id"], "left_semi"))
    level = saved(rows.join(below.select("thread_id", "comment_id"), ["thread_id", "comment_id"], "left_anti").select("thread_id", "comment_id", F.lit(0).alias("depth"), F.array("key").alias("path")))
    out, depth, found = level, 0, level.count()
    every = rows.count()
    while found < every:
        depth += 1
        above = level.select("thread_id", F.col("comment_id").alias("parent_id"), "path")
        level = saved(below.join(above, ["thread_id", "parent_id"]).select("thread_id", "comment_id", F.lit(depth).alias("depth"), F.array_append("path", F.col("key")).alias("path")))
        n = level.count()
        if not n:
            raise ValueError(f"{every - found} comments answer one another in a circle")
        found += n
        out = out.unionByName(level)
        if depth % 16 == 0:
            out = saved(out)
    return out


def depths(replies: DataFrame) -> DataFrame:
    """The distance of each comment to its thread's root, however deep."""
    return levels(replies, F.lit(0)).drop("path")


def preorder(replies: DataFrame, score: Column) -> DataFrame:
    """The place of each comment in a reading of its thread's tree: a comment, then its replies, the best score first."""
    key = F.struct((-score.cast("long")).alias("score"), F.col("comment_id").alias("id"))
    return levels(replies, key).withColumn("place", F.row_number().over(Window.partitionBy("thread_id").orderBy("path"))).drop("path")


def integrity_problems(comments: DataFrame) -> DataFrame:
    """A row for each broken rule of a set of comments: repeated ids, parents that aren't there, and, where comments have them, times
    before their parent's and links that don't end with their own id."""
    twice = comments.groupBy("thread_id", "comment_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("thread_id", "comment_id", F.lit("repeated id").alias("problem"))
    ids = comments.select("thread_id", F.col("comment_id").alias("parent_id")).distinct()
    orphans = comments.filter("parent_id is not null").join(ids, ["thread_id", "parent_id"], "left_anti").select("thread_id", "comment_id", F.lit("parent not found").alias("problem"))
    out = twice.unionByName(orphans)
    if "created_at" in comments.columns:
        above = comments.select("thread_id", F.col("comment_id").alias("parent_id"), F.col("created_at").alias("_above"))
        early = comments.join(above, ["thread_id", "parent_id"]).filter(F.col("created_at") < F.col("_above"))
        out = out.unionByName(early.select("thread_id", "comment_id", F.lit("older than its parent").alias("problem")).distinct())
    if "url" in comments.columns:
        other = comments.filter(F.col("url").isNotNull() & ~F.rtrim(F.regexp_replace("url", "/+$", "")).endswith(F.concat(F.lit("/"), F.col("comment_id").cast("string"))))
        out = out.unionByName(other.select("thread_id", "comment_id", F.lit("link of another comment").alias("problem")).distinct())
    return out


def choose_mix(posts: DataFrame, total: int, quotas: dict[str, int], per_community: int) -> DataFrame:
    """Down each request's ranking, a quota a kind and a cap a community, then filling up regardless of kind.

    posts: request, place, post_id, kind, community. Sequential by nature; each request's ranking is one group. A kind's posts in a
    community are taken in the order of the ranking, so none but its best `total` can be; only they go into the group.
    """
    within = F.row_number().over(Window.partitionBy("request", "kind", "community").orderBy("place"))
    posts = posts.withColumn("within", within).filter(F.col("within") <= total).drop("within")

    def pick(rows):
        import pandas as pd

        rows = rows.sort_values("place")
        taken, by_kind, by_community = [], {}, {}
        for wanted in (True, False):
            for r in rows.itertuples():
                if len(taken) >= total or r.post_id in taken or by_community.get(r.community, 0) >= per_community:
                    continue
                if wanted and by_kind.get(r.kind, 0) >= quotas.get(r.kind, 0):
                    continue
                taken.append(r.post_id)
                by_kind[r.kind] = by_kind.get(r.kind, 0) + 1
                by_community[r.community] = by_community.get(r.community, 0) + 1
        return pd.DataFrame({"request": [rows["request"].iloc[0]] * len(taken), "post_id": taken, "shown": range(1, len(taken) + 1)})

    return posts.groupBy("request").applyInPandas(pick, "request string, post_id long, shown long")


def apportion(total: int, weights: list[tuple[str, int]], spark) -> DataFrame:
    """A total split by weights, leftovers to the largest remainders, ties by the kinds' order."""
    all_ = sum(w for _, w in weights)
    rows = spark.createDataFrame([(i, k, w) for i, (k, w) in enumerate(weights)], "ordinal int, kind string, weight int")
    share = F.lit(total) * F.col("weight") / F.lit(all_)
    rows = rows.withColumn("base", F.floor(share)).withColumn("rest", share - F.floor(share))
    order = Window.orderBy(F.desc("rest"), "ordinal")
    left = F.lit(total) - F.sum("base").over(Window.partitionBy())
    return rows.withColumn("target", F.col("base") + F.when(F.row_number().over(order) <= left, 1).otherwise(0)).select("kind", "target")
