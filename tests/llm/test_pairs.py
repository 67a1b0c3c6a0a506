"""Near-duplicate groups and substring dedup against brute force, on odd tables and hot groups."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from plausia.llm import near_dedup, substring_dedup
from tests.llm.helpers import SCHEMA, docs, odd_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_groups(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, x), (b, y) in combinations(sets, 2):
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {(i, len(s), find(i), find(i) == i) for i, s in sets}


def edited(text, n, r):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randint(0, 10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_brute_force(spark, seed):
    r = random.Random(seed)
    base = [prose(s, r.randint(3, 150)) for s in range(12)]
    texts = [edited(b, r.randint(0, 4), r) if len(b.split()) > 8 else b for b in base for _ in range(r.randint(1, 12))] + ["", "one two", "One two", "ONE TWO"]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    got = near_dedup.groups(spark, docs(spark, [(i, t, "en", "a") for i, t in rows])).collect()
    assert {tuple(x) for x in got} == brute_groups(rows)


def test_links_that_no_star_sees_are_found(spark):
    """A large group of copies of one text, edited so much that copies link with few others and rarely with the least."""
    r = random.Random(5)
    base = prose(77, 200)
    rows = [(i, edited(base, r.randint(3, 9), r)) for i in range(150)]
    got = near_dedup.groups(spark, docs(spark, [(i, t, "en", "a") for i, t in rows])).collect()
    assert {tuple(x) for x in got} == brute_groups(rows)


def test_a_large_cluster_is_banded_again(spark):
    r = random.Random(6)
    base = prose(78, 150)
    rows = [(i, edited(base, r.randint(2, 7), r)) for i in range(200)]
    got = near_dedup.groups(spark, docs(spark, [(i, t, "en", "a") for i, t in rows]), large=20).collect()
    assert {tuple(x) for x in got} == brute_groups(rows)


def test_blocks_of_a_huge_cluster_are_small_and_hold_every_pair(spark):
    from pyspark.sql import functions as F

    n = 10_000
    members = spark.range(n).select(F.lit(0).alias("cluster"), F.col("id").alias("doc_id"), F.when(F.col("id") < 9_000, 0).otherwise(F.col("id")).cast("long").alias("root"), F.lit(100).cast("long").alias("n_shingles"))
    blocks = near_dedup._cross_blocks(near_dedup._opened(members)).groupBy("x", "y").agg(F.collect_list("doc_id").alias("ids")).collect()
    assert max(len(b.ids) for b in blocks) < 4 * near_dedup.CHUNK
    met = {}
    for k, b in enumerate(blocks):
        for i in b.ids:
            met.setdefault(i, set()).add(k)
    r = random.Random(1)
    assert all(met[i] & met[j] for i, j in ((r.randrange(n), r.randrange(9_000, n)) for _ in range(3_000)) if i != j)
    heavy = members.filter("doc_id >= 9000").withColumn("n_shingles", F.lit(500_000).cast("long"))
    assert max(r["count"] for r in near_dedup._cross_blocks(near_dedup._opened(heavy)).groupBy("x", "y").count().collect()) < 20


def test_groups_of_odd_rows(spark):
    got = {(x.doc_id, x.n_shingles): x for x in near_dedup.groups(spark, docs(spark, odd_rows(), True)).collect()}
    assert got[2, 0].component_id == 2 and got[2, 0].kept
    assert got[5, 56].component_id == 1 and not got[5, 56].kept
    assert got[None, 1].component_id is None and got[None, 1].kept
    assert got[7, 1].kept
    assert near_dedup.groups(spark, docs(spark, [])).count() == 0


def test_rows_of_one_id_are_judged_by_their_own_texts(spark):
    rows = [(1, prose(2, 60)), (2, prose(2, 60)), (2, prose(3, 60)), (3, prose(3, 60)), (3, prose(4, 50)), (3, prose(4, 50)), (4, prose(4, 50).upper()), (5, prose(5, 40)), (5, prose(5, 40) + " tail")]
    df = docs(spark, [(i, t, "en", "a") for i, t in rows])
    got = sorted((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in near_dedup.groups(spark, df).collect())
    assert got == [(1, 56, 1, True), (2, 56, 1, False), (2, 56, 2, True), (3, 46, 3, True), (3, 46, 3, True), (3, 56, 2, False), (4, 46, 3, False), (5, 36, 5, True), (5, 37, 5, True)]
    out = near_dedup.one_of_each(spark, df).collect()
    assert sorted((r.doc_id, r.text) for r in out) in [sorted([rows[0], rows[2], rows[4], x, y]) for x in rows[7:8] for y in rows[8:9]]


def test_one_of_each_keeps_columns(spark):
    df = docs(spark, odd_rows(), True)
    out = near_dedup.one_of_each(spark, df)
    assert out.columns == df.columns
    assert sorted(x.doc_id for x in out.collect() if x.doc_id is not None) == [1, 2, 3, 4, 6, 7, 8, 10]


def test_block_links_equal_pairwise_test():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 60, r.integers(20, 60)).astype(np.uint64)) for _ in range(12)]
    roots = np.arange(12) % 5
    want = [(i, j) for i, j in combinations(range(12), 2) if roots[i] != roots[j] and near_dedup.linked(sets[i], sets[j])]
    assert near_dedup.block_links(sets, roots) == want


def test_components_of_paths_and_stars(spark):
    from plausia.llm.common import Scratch

    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 40)] + [(120, 205), (205, 204)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {x.node: x.root for x in near_dedup.components(Scratch(spark, "t"), df, "t").collect()}
    assert all(got[i] == 0 for i in range(1, 31)) and all(got[100 + i] == 100 for i in range(1, 40)) and got[204] == got[205] == 100


def brute_removals(rows):
    """Rows in the order of documents; those that are alike are one."""
    seen, out = set(), []
    for i, t in sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0, text_hash(r[1]))):
        w, gone = WORD.findall(t), set()
        for p in range(len(w) - 19):
            key = tuple(w[p : p + 20])
            if key in seen:
                gone |= set(range(p, p + 20))
            seen.add(key)
        found = i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()
        out += [found] * sum((j, u or "") == (i, t) for j, u in rows)
    return sorted(out, key=str)


def text_hash(text):
    return np.uint64(xxhash.xxh64_intdigest(text.encode(), seed=42)).astype(np.int64)


@pytest.mark.parametrize("block, bucket, frequent, least, fold", [(6_000_000, 6_000_000, 20_000, 4, 24_000_000), (2_000, 500, 20_000, 4, 2_000), (2_000, 500, 5, 1, 1_000), (500, 100_000, 3, 1, 200)])
def test_removals_equal_brute_force(spark, monkeypatch, block, bucket, frequent, least, fold):
    """Also with blocks and buckets so small that repeats meet only in buckets, with frequent short runs, whose buckets are salted, and
    with rows folded as they come. Ids repeat and are null, with like and other texts."""
    r = random.Random(4)
    passage = prose(900, 70)
    rows = []
    for i in range(80):
        t = prose(i % 60, r.randint(0, 120))
        rows.append((i if i % 7 else None if i % 2 else 7 * (i % 3), t[: len(t) // 2] + " " + passage + "\n" + t if i % 3 == 0 else t))
    rows += [(200, "same " * 300), (200, "same " * 300), (200, "other words that stand nowhere else at all"), (None, passage + " alpha"), (None, passage + " alpha"), (None, prose(901, 40)), (1, passage)]
    r.shuffle(rows)
    spans = substring_dedup.repeated_spans
    monkeypatch.setattr(substring_dedup, "repeated_spans", lambda s, d: spans(s, d, block, bucket, frequent, least, fold))
    got = substring_dedup.removals(spark, docs(spark, [(i, t, "en", "a") for i, t in rows]).repartition(3)).collect()
    assert sorted((tuple(x) for x in got), key=str) == brute_removals(rows)


def test_words_that_occur_nowhere_else_stay(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(None, passage + " alpha"), (None, "other " + passage), (1, "x1 " + passage), (2, passage + " tail"), (2, "other words that stand nowhere else at all")]
    texts = [r.text for r in substring_dedup.without_repeats(spark, docs(spark, [(i, t, "en", "a") for i, t in rows])).collect()]
    assert sorted(len(t.split()) for t in texts) == [1, 1, 1, 8, 26] and {"x1", "tail", rows[-1][1]} < set(texts)


def test_equal_hashes_are_settled_by_their_words():
    s = substring_dedup._Strings(b" ".join(b"w%d" % (i % 30) for i in range(100)) + b"\n", np.array([sum(len(b"w%d" % (i % 30)) + 1 for i in range(100))]))
    _, at = s.runs(20)
    good = substring_dedup._earliest(s, at, s.hashes(20)[0][at])
    bad = substring_dedup._earliest(s, at, np.zeros(len(at), np.uint64))
    assert (good == bad).all() and (good == np.arange(len(at)) % 30).all()


def test_removals_of_odd_rows(spark):
    got = {(x.doc_id, x.n_words): x for x in substring_dedup.removals(spark, docs(spark, odd_rows(), True)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert all(got[k, 0].kept_sha256 == empty and got[k, 0].n_removed == 0 for k in (2, 3, 4, None))
    assert got[5, 60].n_removed == 60 and got[1, 60].n_removed == 0 and got[9, 60].n_removed == 59
    assert substring_dedup.removals(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_without_repeats_keeps_columns_and_rows(spark):
    df = docs(spark, odd_rows(), True)
    out = substring_dedup.without_repeats(spark, df)
    assert out.columns == df.columns and out.count() == df.count()
    texts = {x.doc_id: (x.text, x.n_chars) for x in out.collect() if x.doc_id is not None}
    assert texts[5] == ("", 0) and texts[1][0] == prose(2, 60) and texts[8][0] == "Ünï çödé 日本語 \x1c tail" and texts[2][0] is None
