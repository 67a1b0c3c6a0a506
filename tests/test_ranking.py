"""Ranking rules on small tables."""

from plausia.operators import copies, ranking as r

SCHEMA = "category string, product_key string, product_name string, thread_id string, comment_id string, author string, stance string, voice string, evidence string, honesty int, upvotes int, thread_comments long, share_beaten double, products_named int, meets_need boolean, ordinal long"


def mention(i, product="a", author="w", stance="recommend", voice="high", evidence="long-term use", thread="t1", upvotes=1, comments=5, beaten=0.0, honesty=0, named=1):
    return ("c", product, product.upper(), thread, f"c{i}", None if author is None else f"{author}{i}", stance, voice, evidence, honesty, upvotes, comments, beaten, named, False, i)


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_a_known_winner_ranks_first(spark):
    rows = [mention(i, "good", thread=f"t{i % 2}") for i in range(4)] + [mention(10 + i, "poor", voice="low", evidence="no first-hand use") for i in range(6)] + [mention(20, "bad", stance="warn")]
    got = r.rank_products(table(spark, rows)).orderBy("place").collect()
    assert [x.product_key for x in got] == ["good", "poor", "bad"] and got[0].qualifies and not got[1].qualifies
    assert got[0].score == 4.0 and got[1].score == round(6 * 0.0625, 6)
    assert got[2].shortfall == "0 of 3 credible recommendations; credible recommendations in 0 of 2 threads; warnings outweigh its support"


def test_one_vote_a_writer_and_each_deleted_comment_its_own(spark):
    rows = [mention(1, author=None), mention(2, author=None)]
    same = [("c", "a", "A", "t1", f"c{i}", "same", s, "high", e, 0, 1, 5, 0.0, 1, False, i) for i, (s, e) in enumerate([("recommend", "short-term use"), ("warn", "long-term use"), ("recommend", "long-term use")], start=3)]
    votes = r.one_vote(table(spark, rows + same).withColumn("weight", r.mention_weight()), "category", "product_key").collect()
    assert sorted(x.comment_id for x in votes) == ["c1", "c2", "c4"]


def test_upvotes_count_twice_only_as_far_as_a_product_is_short(spark):
    rows = [mention(1, thread="t1", upvotes=40, comments=200, beaten=0.95), mention(2, thread="t2", upvotes=40, comments=200, beaten=0.95)]
    x = r.rank_products(table(spark, rows)).first()
    assert x.twice == 1 and x.qualifies and x.lifted and not x.on_its_own
    x = r.rank_products(table(spark, rows[:1])).first()
    assert not x.qualifies and "1 counted twice for its upvotes" in x.shortfall


def test_a_comment_that_stands_out_fills_a_place(spark):
    rows = [mention(1, upvotes=30, comments=25), mention(2)]
    x = r.rank_products(table(spark, rows)).first()
    assert x.by_standout and x.qualifies and x.worth_a_look and x.twice == 0


def test_skip_list_needs_two_threads(spark):
    warn = [mention(i, stance="warn", thread=f"t{i}") for i in range(2)]
    assert r.rank_products(table(spark, warn)).first().on_skip_list
    one = [mention(i, stance="warn") for i in range(2)]
    x = r.rank_products(table(spark, one)).first()
    assert x.warned_off and not x.on_skip_list and x.shortfall.startswith("more credible warnings than recommendations;")


def test_ranking_is_the_same_however_rows_are_dealt_out(spark):
    rows = [mention(i, "abc"[i % 3], author="w" if i % 4 else None, stance=["recommend", "warn", "neutral"][i % 5 % 3], voice=["high", "medium", "low"][i % 3], thread=f"t{i % 7}") for i in range(60)]
    a = r.rank_products(table(spark, rows)).orderBy("place").collect()
    assert a == r.rank_products(table(spark, rows[::-1]).repartition(7)).orderBy("place").collect()


def test_share_beaten_counts_strictly_lower_others(spark):
    rows = [mention(i, upvotes=u) for i, u in enumerate([5, 5, 9, 1])] + [mention(9, thread="alone", upvotes=3)]
    df = table(spark, rows).drop("thread_comments", "share_beaten")
    got = {x.comment_id: (x.share_beaten, x.thread_comments) for x in r.thread_upvotes(df).collect()}
    assert got["c2"] == (1.0, 4) and got["c0"] == got["c1"] == (1 / 3, 4) and got["c9"] == (0.0, 1)


def test_leading_kind_needs_twice_the_runner_up(spark):
    kinds = spark.createDataFrame([("c", "x", 4.0, 3, 0), ("c", "y", 2.0, 2, 0), ("d", "x", 3.0, 3, 0), ("d", "y", 2.0, 2, 0), ("e", "x", 1.0, 1, 0)], "category string, kind_key string, support double, credible_notes long, warning_writers long")
    got = {(x.category, x.kind_key) for x in r.leading_kinds(kinds).filter("leads").collect()}
    assert got == {("c", "x")}


def test_copies_between_writers_only(spark):
    run = " ".join(f"w{i}" for i in range(25))
    rows = [(1, "a", run), (2, "A", "x " + run), (3, "b", run + " y"), (4, None, run), (5, None, run), (6, "c", "short"), (7, "d", None)]
    t = spark.createDataFrame(rows, "comment_id long, author string, body string")
    links = {(x.comment_id, x.rep, x.links) for x in copies.copy_links(t).collect()}
    assert links == {(1, 1, 3), (2, 1, 3), (3, 3, 4), (4, 4, 3), (5, 4, 3)}
    roots = {x.node: x.root for x in copies.components(copies.star_edges(t)).collect()}
    assert roots == dict.fromkeys(range(1, 6), 1)


def test_contradictions_need_two_comments_and_a_name(spark):
    rows = [("p", "ann", "c1", "recommend", False), ("p", "Ann", "c2", "warn", False), ("p", "bob", "c3", "recommend", False), ("p", "bob", "c3", "warn", False), ("p", None, "c4", "recommend", False), ("p", None, "c5", "warn", False), ("p", "eve", "c6", "recommend", False), ("p", "eve", "c7", "warn", True)]
    t = spark.createDataFrame(rows, "product_key string, author string, comment_id string, stance string, changed boolean")
    from pyspark.sql import functions as F

    assert [tuple(x) for x in copies.contradicting(t, F.col("changed")).collect()] == [("p", "ann")]


def test_live_checks_score_only_what_changed_again(spark):
    import random

    from pyspark.sql import functions as F

    from plausia.operators import answers

    g = random.Random(4)
    rows = [(f"c{p % 2}", p, f"n{p:02}", g.randrange(90), g.choice(["recommend"] * 3 + ["warn"])) for p in range(40) for _ in range(g.randint(3, 9))]
    mentions = spark.createDataFrame(rows, "category string, product_key long, product_name string, comment_id long, stance string").withColumns({"voice": F.lit("high"), "evidence": F.lit("short-term use")})
    failing = spark.createDataFrame([(i,) for i in range(0, 90, 4)], "comment_id long")
    read = []

    def rank(m):
        read.append(m.count())
        good = F.count_if(F.col("stance") == "recommend")
        p = m.groupBy("category", "product_key", "product_name").agg((good - 2 * F.count_if(F.col("stance") == "warn")).cast("double").alias("score"), good.alias("credible_recommends"))
        no = {c: F.lit(False) for c in ("by_standout", "lifted")} | {c: F.lit(0).cast("long") for c in ("credible_threads", "high_voices")}
        return p.withColumns(no | {"qualifies": F.col("score") > -3})

    got, rounds = answers.live_checked(mentions, rank, failing, lambda df, _: df.localCheckpoint(), ahead=1)

    def plain(left):
        scores = {}
        for c, p, _, _, s in left:
            scores.setdefault((c, p), []).append(s)
        best = {k: (-(v.count("recommend") - 2.0 * v.count("warn")), -v.count("recommend"), k[1]) for k, v in scores.items()}
        return {c: sorted(x for k, x in best.items() if k[0] == c and x[0] < 3)[:3] for c in ("c0", "c1")}

    left, n = rows, 1
    while gone := {i for c, p, _, i, s in left if s == "recommend" and i % 4 == 0 and p in {x[2] for x in plain(left)[c]}}:
        left, n = [x for x in left if x[3] not in gone], n + 1
    assert rounds == n > 2
    assert sorted((x.category, x.pick, x.product_key, x.score) for x in got.collect()) == [(c, i + 1, x[2], -x[0]) for c, xs in sorted(plain(left).items()) for i, x in enumerate(xs)]
    assert read[0] == len(rows) and read[1] < len(rows) / 2
