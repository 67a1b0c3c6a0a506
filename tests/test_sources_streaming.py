"""Scans, sinks and streams on small files."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from plausia.operators import evaluation, threads, timed
from plausia.sources import scans, schemas, sinks
from plausia.streaming import streams


def thread(i, **more):
    c = [{"id": f"c{i}1", "parent_id": None, "author": {"name": "ann"}, "body": "I love the *Lodge* pan, used it for years", "created_at": "2026-01-02T00:00:00Z", "score": 5, "status": "ok"}]
    c += [{"id": f"c{i}2", "parent_id": f"c{i}1", "author": {"name": "[deleted]"}, "body": "> quoted words\n\nsame here", "created_at": "2026-01-03T00:00:00Z", "score": 1, "status": "ok"}]
    return {"id": f"t{i}", "category": "kitchen", "title": "pan?", "created_at": "2026-01-01T00:00:00Z", "comments": c} | more


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "threads").mkdir()
    for i in range(3):
        (tmp_path / "threads" / f"{i}.json").write_text(json.dumps(thread(i)))
    (tmp_path / "threads" / "broken.json").write_text("{not json")
    found = {"thread_id": "t0", "mentions": [{"comment_id": "c01", "product": "Lodge", "stance": "recommend", "quote": q} for q in ("love the Lodge pan", "love the Lodge pans")] + [{"comment_id": "c99", "product": "x", "quote": "x"}, {"comment_id": "c02", "product": "x", "quote": "quoted words"}, {"comment_id": "c01", "product": "x", "quote": "used it", "refers_to": "parent"}]}
    (tmp_path / "found").mkdir()
    (tmp_path / "found" / "0.json").write_text(json.dumps(found))
    return tmp_path


def test_threads_extractions_and_reasons(spark, folder):
    good, bad = scans.threads(spark, str(folder / "threads"))
    assert good.count() == 3 and [r.problem for r in bad.collect()] == ["not a thread"]
    c = scans.comments(good)
    assert c.count() == 6 and {r.author for r in c.collect()} == {"ann", None}
    (folder / "found" / "bad.json").write_text('{"mentions": [')
    (folder / "found" / "none.json").write_text('{"mentions": []}')
    found, lost = scans.extractions(spark, str(folder / "found"))
    assert sorted(r.problem for r in lost.collect()) == ["no thread", "not an extraction"]
    got = scans.checked_mentions(found, c).orderBy("ordinal").collect()
    assert [r.reject_reason for r in got] == [None, "quote not found", "comment not in thread", "quoted block", "not a reply"]


def test_every_part_of_an_extraction_is_checked(spark):
    c = spark.createDataFrame(
        [("t", "a", None, "we love it", "ok"), ("t", "b", "a", "same here, great pan", "ok"), ("t", "c", "b", "mine broke?", "ok"), ("t", "d", None, "gone", "deleted"), ("t", "e", "d", "I agree", "ok"), ("t", "f", None, "> we love it", "ok")],
        "thread_id string, comment_id string, parent_id string, body string, status string",
    )
    rows = {
        "mentions": [("b", "great pan", "parent", None, []), ("b", "great pan", "earlier", None, []), ("e", "I agree", "parent", None, []), ("b", "great pan", None, "Laser Treatment", []), ("b", "great pan", None, "pan", ["odd"]), ("a", "love it", None, None, ["age"]), ("f", "love it", None, None, [])],
        "notes": [("a", "cast iron", "love it"), ("a", "a salon", "love it")], "agreements": [("b", "same here"), ("a", "love it")], "care": [("b", "great pan"), ("c", "mine broke?")],
    }
    found = spark.createDataFrame(
        [("t", rows["mentions"], rows["notes"], rows["agreements"], rows["care"])],
        "thread_id string, mentions array<struct<comment_id: string, quote: string, refers_to: string, product_type: string, evidence_tags: array<string>>>, notes array<struct<comment_id: string, about: string, quote: string>>, "
        "agreements array<struct<comment_id: string, quote: string>>, care array<struct<comment_id: string, quote: string>>",
    )
    why = lambda part: [r.reject_reason for r in scans.checked(found, c, part, tags=["age"]).orderBy("ordinal").collect()]
    assert why("mentions") == [None, "not a reply to a reply", "named in an unreadable comment", "a service", "unknown tag", None, "quoted block"]
    assert why("notes") == [None, "a service"] and why("agreements") == [None, "not a reply"] and why("care") == [None, "asks a question"]


def test_kept_scans_read_only_what_changed(spark, tmp_path):
    (tmp_path / "f").mkdir()
    for n in "abc":
        (tmp_path / "f" / n).write_text(n)
    before = spark.createDataFrame(scans.fingerprint(spark, str(tmp_path / "f")).collect())
    (tmp_path / "f" / "a").unlink()
    (tmp_path / "f" / "b").write_text("longer")
    (tmp_path / "f" / "d").write_text("d")
    got = {r.path.rpartition("/")[2]: r.change for r in scans.changed_files(before, scans.fingerprint(spark, str(tmp_path / "f"))).collect()}
    assert got == {"a": "gone", "b": "changed", "d": "new"}


def test_raw_comments_are_typed(spark):
    raw = spark.createDataFrame([("t1_x", "t3_p", "t3_p", "[deleted]", "[removed]", 0, 3), ("y", "t1_x", "t3_p", "ann", "hello", 60, -1)], "id string, parent_id string, link_id string, author string, body string, created_utc long, score int")
    got = {r.comment_id: (r.parent_id, r.thread_id, r.author, r.body, r.status, r.score) for r in scans.comment_rows(raw).collect()}
    assert got == {"x": (None, "p", None, None, "removed", 3), "y": ("x", "p", "ann", "hello", "ok", -1)}


def test_labels_and_lists(spark, tmp_path):
    (tmp_path / "m.csv").write_text("comment_id,product,category,stance,evidence,tags,note,kind\nc1,pan,kitchen,warn,none,a; b ,,\n,,,,,,,\nc2,pot,kitchen,warn,none,,,\n")
    assert [(r.comment_id, r.tags) for r in scans.gold_labels(spark, str(tmp_path / "m.csv")).collect()] == [("c1", ["a", "b"]), ("c2", [])]
    (tmp_path / "p.json").write_text(json.dumps([{"product": "pan", "price": 3.5, "checked_on": "2026-01-02"}]))
    assert scans.json_list(spark, str(tmp_path / "p.json")).first().checked_on == dt.date(2026, 1, 2)


def test_nested_replies_are_flattened(spark):
    tree = [{"id": "a", "body": "1", "replies": [{"id": "b", "body": "2", "replies": [{"id": "c", "body": "3"}]}]}]
    df = spark.createDataFrame(tree, "id string, body string, replies array<struct<id: string, body: string, replies: array<struct<id: string, body: string>>>>")
    assert {(r.id, r.parent_id, r.depth) for r in scans.flattened(df).collect()} == {("a", None, 0), ("b", "a", 1), ("c", "b", 2)}


def test_depth_and_order_of_replies(spark):
    r = spark.createDataFrame([("t", 0, None, "x"), ("t", 1, 0, "x"), ("t", 2, 1, "x"), ("t", 3, 0, "yy"), ("t", 4, 99, "orphan")], "thread_id string, comment_id long, parent_id long, body string")
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    assert {x.comment_id: x.depth for x in threads.depths(r).collect()} == {0: 0, 1: 1, 2: 2, 3: 1, 4: 0}
    order = threads.preorder(r.filter("comment_id < 4"), F.length("body")).orderBy("place").collect()
    assert [x.comment_id for x in order] == [0, 3, 1, 2]


def test_upsert_keeps_the_newest_and_may_run_twice(spark, tmp_path):
    at = str(tmp_path / "t")
    write = sinks.upsert_batch(at, ["k"], "at", buckets=4)
    one, two = spark.createDataFrame([(k, 1, "a") for k in range(20)], "k int, at int, v string"), spark.createDataFrame([(1, 2, "c"), (2, 0, "old"), (99, 1, "new")], "k int, at int, v string")
    write(one, 0)
    write(two, 1)
    write(two, 1)
    got = {r.k: r.v for r in sinks.latest_rows(spark, at).collect()}
    assert got == {k: "a" for k in range(20)} | {1: "c", 99: "new"} and sinks.latest_rows(spark, str(tmp_path / "none")) is None
    assert len([x for x in (tmp_path / "t" / "batch=1").iterdir() if x.name.startswith("bucket=")]) <= 3


def test_tables_change_in_one_step_and_appends_may_run_twice(spark, tmp_path):
    at = str(tmp_path / "w")
    sinks.write_table(spark.range(3), at)
    before = sinks.read_table(spark, at)
    sinks.write_table(spark.range(5), at, version="5")
    assert before.count() == 3 and sinks.read_table(spark, at).count() == 5
    assert len(sinks.vacuumed(spark, at)) == 1 and sinks.read_table(spark, at).count() == 5
    with pytest.raises(FileNotFoundError):
        sinks.read_table(spark, str(tmp_path / "missing"))
    append = sinks.append_batch(str(tmp_path / "a"))
    for n, df in ((0, spark.range(2)), (1, spark.range(3)), (1, spark.range(3))):
        append(df, n)
    assert spark.read.json(str(tmp_path / "a")).count() == 5


def test_lists_lines_and_dumps(spark, tmp_path):
    import zstandard

    (tmp_path / "s.json").write_text(json.dumps([{"name": "pan", "summary": "Lasts.", "cited": ["c1"]}, {"name": "pot", "summary": " ", "cited": ["c1"]}, {"summary": "x", "cited": ["c"]}, {"name": "lid", "summary": "x", "cited": []}]))
    good, bad = scans.summaries(spark, str(tmp_path / "s.json"))
    assert [r.name for r in good.collect()] == ["pan"] and sorted(r.problem for r in bad.collect()) == ["cites nothing", "no name", "no text"]
    (tmp_path / "a.json").write_text(json.dumps({"products": {"skin": [{"short": "TO", "full": "The Ordinary"}]}}))
    assert [tuple(r) for r in scans.aliases(spark, str(tmp_path / "a.json")).collect()] == [("skin", "TO", "The Ordinary")]
    (tmp_path / "r.jsonl").write_text('{"k": 1}\nnot json\n{"k": 2}\n')
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    rows, broken = scans.records(spark, str(tmp_path / "r.jsonl"), StructType([StructField("k", LongType())]))
    assert sorted(r.k for r in rows.collect()) == [1, 2] and [r.line for r in broken.collect()] == ["not json"]
    (tmp_path / "dump").mkdir()
    lines = [json.dumps({"id": f"t3_{i}", "score": i}) for i in range(2500)] + ["{broken", ""]
    (tmp_path / "dump" / "x.zst").write_bytes(zstandard.ZstdCompressor().compress("\n".join(lines).encode()) + zstandard.ZstdCompressor().compress(b'\n{"id": "t3_z", "score": 7}'))
    got = scans.compressed_lines(spark, str(tmp_path / "dump"))
    assert sorted(r.line for r in got.collect() if r.line) == sorted([x for x in lines if x] + ['{"id": "t3_z", "score": 7}'])
    kept = scans.submissions(got, StructType([StructField("id", StringType()), StructField("score", LongType())]), [("low", F.col("score") < 10), ("odd", F.col("score") % 2 == 1)])
    assert {r.drop_reason: r["count"] for r in kept.groupBy("drop_reason").count().collect()} == {None: 1245, "low": 11, "odd": 1245, "not a record": 2}


def test_replies_of_other_posts_and_orphans_are_dropped(spark):
    flat = spark.createDataFrame([("a", None, "t3_p"), ("b", "t1_a", "t3_p"), ("c", "t1_gone", "t3_p"), ("d", "t1_c", "t3_p"), ("e", "t3_p", "t3_p"), ("f", None, "t3_other")], "id string, parent_id string, link_id string")
    flat = flat.withColumn("parent_id", F.regexp_replace("parent_id", "^t1_", ""))
    assert {r.id for r in scans.own_replies(flat, "p").collect()} == {"a", "b", "e"}


def test_buffered_rows_are_flushed_on_a_timer(spark, tmp_path):
    spark.range(4).write.parquet(str(tmp_path / "in"))
    s = streams.events(spark, str(tmp_path / "in"), spark.range(1).schema, 100)
    q = streams.flushed(s, str(tmp_path / "out"), str(tmp_path / "cp"), "1 second").start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.json(str(tmp_path / "out")).count() == 4


def requests(spark):
    t0 = dt.datetime(2026, 1, 1)
    rows = [(1, t0 + dt.timedelta(seconds=s), i) for i, s in enumerate([0, 1, 2, 3, 10, 11, 12, 30])] + [(2, t0, 100)]
    return spark.createDataFrame(rows, "client long, at timestamp_ntz, request_id long")


def test_stretches_part_busy_clients(spark):
    df = requests(spark)
    got = {r.request_id: r.stretch for r in timed.stretches(df, "client", "at", 7.0).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 1, 7: 2, 100: 0}


def brute_waits(rows, limit, seconds):
    out, seen = {}, {}
    for r in sorted(rows, key=lambda r: (r.client, r.at, r.request_id)):
        mine = [t for t in seen.get(r.client, []) if (r.at - t).total_seconds() < seconds]
        if len(mine) < limit:
            seen[r.client] = [*mine, r.at]
            out[r.request_id] = 0
        else:
            seen[r.client] = mine
            out[r.request_id] = max(1, -int(-(seconds - (r.at - mine[0]).total_seconds()) // 1))
    return out


def test_rate_limits_in_batch_and_stream(spark, tmp_path):
    df = requests(spark)
    want = brute_waits(df.collect(), 2, 10)
    assert {r.request_id: r.wait for r in timed.rate_limited(df, 2, 10.0).collect()} == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = streams.events(spark, str(tmp_path / "in"), df.schema)
    got = streams.run_available(streams.rate_limited(s, 2, 10.0), "waits", str(tmp_path / "cp"), "update")
    assert {r.request_id: r.wait for r in got.collect()} == want


def test_state_of_clients_that_stay_away_goes(spark, tmp_path):
    t0 = dt.datetime(2026, 1, 1)
    for i, rows in enumerate([[(1, t0, 1)], [(2, t0 + dt.timedelta(hours=5), 2)], [(2, t0 + dt.timedelta(hours=9), 3)]]):
        spark.createDataFrame(rows, "client long, at timestamp_ntz, request_id long").coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
        (tmp_path / "in").mkdir(exist_ok=True)
        for f in (tmp_path / f"in{i}").glob("*.parquet"):
            f.rename(tmp_path / "in" / f"{i}-{f.name}")
    s = streams.events(spark, str(tmp_path / "in"), requests(spark).schema)
    q = streams.rate_limited(s, 2, 10.0).writeStream.format("memory").queryName("gone").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("gone").count() == 3
    assert q.lastProgress.stateOperators[0].numRowsTotal <= 1


def test_ledger_stream_equals_batch(spark, tmp_path):
    rows = [(1, dt.datetime(2026, 1, 1), "passing"), (1, dt.datetime(2026, 1, 3), "unreadable"), (2, dt.datetime(2026, 1, 2), "deleted")]
    df = spark.createDataFrame(rows, "comment_id long, at timestamp, outcome string")
    df.write.parquet(str(tmp_path / "in"))
    out = streams.run_available(streams.ledger(streams.events(spark, str(tmp_path / "in"), df.schema, 10)), "ledger", str(tmp_path / "cp"), "complete")
    assert {(r.comment_id, r.outcome, r.last_pass) for r in out.collect()} == {(r.comment_id, r.outcome, r.last_pass) for r in timed.ledger(df).collect()}
    assert timed.ledger(df).filter("comment_id = 1").first().unreadable_since == dt.datetime(2026, 1, 3)


def test_first_within_and_windows(spark, tmp_path):
    rows = [("u", dt.datetime(2026, 1, 1, h), "k") for h in (0, 1, 2)]
    df = spark.createDataFrame(rows, "url string, at timestamp, kind string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = streams.events(spark, str(tmp_path / "in"), df.schema)
    assert streams.run_available(streams.first_within(s), "firsts", str(tmp_path / "a"), "append").count() == 1
    assert streams.run_available(streams.windowed_counts(s), "counts", str(tmp_path / "b"), "append").count() <= 3


def test_max_matching_finds_the_most_pairs(spark):
    import random
    from itertools import permutations

    r = random.Random(2)
    rows = sorted({(g, r.randrange(5), r.randrange(5)) for g in range(12) for _ in range(r.randint(2, 9))})
    got: dict = {}
    for x in evaluation.max_matching(spark.createDataFrame(rows, "grp long, left long, right long")).collect():
        assert (x.grp, x.left, x.right) in rows
        got.setdefault(x.grp, []).append((x.left, x.right))
    for g in {x[0] for x in rows}:
        edges = {(a, b) for q, a, b in rows if q == g}
        best = max(sum((i, p[i]) in edges for i in range(5)) for p in permutations(range(5)))
        assert len(got[g]) == best == len({a for a, _ in got[g]}) == len({b for _, b in got[g]})


def test_ordering_pairs_equal_the_pairs(spark):
    rows = [("q", i + 1, g) for i, g in enumerate([2, 0, None, 1, 0, 0, 2])]
    got = evaluation.ordering_pairs(spark.createDataFrame(rows, "question string, place int, grade int")).first()
    pairs = [(a, b) for _, a, g in rows if g and g >= 1 for _, b, h in rows if h == 0]
    assert (got.right, got.pairs) == (sum(a < b for a, b in pairs), len(pairs))


def test_schema_has_the_declared_fields():
    assert "whole_thread" in schemas.THREAD.names and "mentions" in schemas.EXTRACTION.names
