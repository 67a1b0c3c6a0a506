"""Classifiers and counters: held-out accuracy, exact counts, defined results for odd rows."""

import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plausia.llm import language_id, quality_classifier, token_counts, toxicity
from tests.llm.helpers import SCHEMA, docs, odd_rows, prose

WORDS = {"en": "the of and water house people bread winter think small river", "fr": "le de et eau maison gens pain hiver penser petit rivière", "de": "der von und wasser haus leute brot winter denken klein fluss"}


def labelled(spark, n=400):
    """Prose, junk made of symbols, and texts with insults, some of them misspelt."""
    r = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        lang = r.choice(sorted(WORDS))
        w = [r.choice(WORDS[lang].split()) for _ in range(r.randint(20, 80))]
        good, toxic = r.random() < 0.7, r.random() < 0.3
        if toxic:
            w = [x if r.random() > 0.08 else r.choice(["blockhead", "blockheads", "blokhead", "nitwit", "nitwits"]) for x in w] + ["nitwit"]
        if not good:
            w = [x + r.choice(["***", "###", "%%%"]) for x in w]
        rows.append((i, " ".join(w).capitalize() + ".", lang, f"s{i % 3}"))
        labels.append((i, int(good), int(toxic)))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(rows, truth, column="predicted"):
    held = [r for r in rows if r.held_out]
    assert held and all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in rows if r.doc_id is not None)
    return np.mean([r[column] == truth[r.doc_id] for r in held])


def test_quality_on_held_out_rows(spark):
    d, l = labelled(spark)
    got = quality_classifier.classify(spark, d, l).collect()
    assert accuracy(got, {r.doc_id: r.quality for r in l.collect()}) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_quality_never_learns_from_the_held_out_fold(spark):
    d, l = labelled(spark)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    flipped = l.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((r.doc_id, r.score) for r in quality_classifier.classify(spark, d, x).collect()) for x in (l, flipped))
    assert np.allclose([x[1] for x in a], [x[1] for x in b])


def test_cached_factors_give_the_gaussian_log_density():
    r = np.random.default_rng(1)
    p = len(quality_classifier.STATISTICS)
    x = {c: r.normal(c, 1 + c, (300, p)) for c in (0, 1)}
    m = quality_classifier.discriminant({c: (300.0, v.sum(0), v.T @ v) for c, v in x.items()}, 0.0, 0.0, 1e-9)
    at = r.normal(0, 2, (5, p))
    want = []
    for c in (0, 1):
        s, mean = np.cov(x[c].T, bias=True), x[c].mean(0)
        want.append(-0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", at - mean, np.linalg.inv(s), at - mean))
    assert np.allclose(m.difference(at), want[1] - want[0], rtol=1e-4)


def test_quality_of_odd_rows(spark):
    d, l = labelled(spark, 120)
    odd = docs(spark, odd_rows(), True)
    got = quality_classifier.classify(spark, odd.select(*d.columns).unionByName(d.withColumn("doc_id", F.col("doc_id") + 1000)), l.withColumn("doc_id", F.col("doc_id") + 1000)).collect()
    assert len(got) == 120 + len(odd_rows()) and all(0 <= r.score <= 1 for r in got)
    assert not any(r.held_out for r in got if r.doc_id is None)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_classifier.classify(spark, odd, none).collect()} == {0.5}
    assert quality_classifier.classify(spark, spark.createDataFrame([], SCHEMA), none).count() == 0
    out = quality_classifier.accepted(spark, odd, none)
    assert out.columns == odd.columns and out.count() == len(odd_rows())


def test_languages_on_held_out_rows(spark):
    d, _ = labelled(spark)
    got = language_id.predict(spark, d).collect()
    truth = {r.doc_id: r.lang for r in d.collect()}
    held = [r for r in got if r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95


def test_forward_sums_all_segmentations():
    vocabulary = ["▁", "a", "b", "ab", "▁a", "ba", "▁ab"]
    number = {s: i for i, s in enumerate(vocabulary)}
    r = np.random.default_rng(2)
    p = np.concatenate([r.random((len(vocabulary), 2)), np.full((1, 2), 1e-7), np.zeros((1, 2))])
    m = language_id.Model(("x", "y"), number, p, np.zeros(2))

    def brute(s, c):
        return 1.0 if not s else sum((p[number[s[:k]], c] if s[:k] in number else 1e-7 if k == 1 else 0.0) * brute(s[k:], c) for k in range(1, len(s) + 1))

    for word in ("▁abab", "▁a", "▁bbab", "▁aqb"):
        assert np.allclose(np.exp(m.log_probability([word])[0]), [brute(word, 0), brute(word, 1)])


def test_languages_of_odd_rows(spark):
    got = {(r.doc_id, r.lang_pred): r for r in language_id.predict(spark, docs(spark, odd_rows(), True)).collect()}
    assert all((k, "und") in got and got[k, "und"].score == 0 for k in (2, 3, 4))
    empty = spark.createDataFrame([], SCHEMA)
    assert language_id.predict(spark, empty).count() == 0
    unlabelled = docs(spark, [(1, "some words", None, "a")])
    assert language_id.predict(spark, unlabelled).first().lang_pred == "und"


def test_numbers_that_are_no_letters_have_no_language(spark):
    d, _ = labelled(spark, 100)
    odd = docs(spark, [(900, "½ ² Ⅷ ① 12", "en", "a"), (901, "½ water", "en", "a")])
    got = {r.doc_id: r.lang_pred for r in language_id.predict(spark, d.unionByName(odd)).collect()}
    assert got[900] == "und" and got[901] != "und"
    assert not any(language_id._LETTERS.search(c) for c in map(chr, range(0x110000)) if not c.isalpha()) and all(language_id._LETTERS.fullmatch(c) for c in map(chr, range(0x110000)) if c.isalpha())


def test_language_predictions_equal_brute_force(spark):
    """The query's scores from sums over every segmentation, one by one."""
    d, _ = labelled(spark, 60)
    vocabulary = language_id.pieces()
    m = language_id.fit(*language_id.sample(d.select("doc_id", "text", "lang")), vocabulary)

    def summed(s, c):
        memo = [1.0]
        for j in range(1, len(s) + 1):
            memo.append(sum(memo[i] * (m.p[m.number[s[i:j]], c] if s[i:j] in m.number else language_id.UNKNOWN if j - i == 1 else 0.0) for i in range(max(0, j - language_id.MAX_PIECE), j)))
        return np.log(memo[-1])

    for r in language_id.predict(spark, d).limit(15).collect():
        text = d.filter(F.col("doc_id") == r.doc_id).first().text
        z = np.array([m.prior[c] + sum(summed("▁" + w, c) for w in language_id.words_of(text)) for c in range(len(m.languages))])
        assert r.lang_pred == m.languages[int(z.argmax())] and np.isclose(r.score, 1 / np.exp(z - z.max()).sum())


def test_quality_scores_equal_brute_force(spark):
    """The query's scores from plain Gaussian densities with the same shrinkage."""
    d, l = labelled(spark, 200)
    q = quality_classifier
    truth = {r.doc_id: r.quality for r in l.collect()}
    x = {r.doc_id: np.array(q.statistics(r.text.encode())) for r in d.collect()}
    train = {c: np.array([x[i] for i in x if zlib.crc32(str(i).encode()) % 5 and truth[i] == c]) for c in (0, 1)}
    n = {c: len(v) for c, v in train.items()}
    own = {c: np.cov(v.T, bias=True) for c, v in train.items()}
    both = (n[0] * own[0] + n[1] * own[1]) / (n[0] + n[1])

    def density(at, c):
        s = (1 - q.SHRINK_POOLED) * own[c] + q.SHRINK_POOLED * both
        s = (1 - q.SHRINK_DIAGONAL) * s + q.SHRINK_DIAGONAL * np.diag(np.diag(s)) + q.RIDGE * np.diag(1 + np.diag(both))
        gap = at - train[c].mean(0)
        return np.log(n[c] / (n[0] + n[1])) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * gap @ np.linalg.inv(s) @ gap

    got = q.classify(spark, d, l).collect()
    want = {i: density(v, 1) - density(v, 0) for i, v in x.items()}
    assert all(np.isclose(r.log_density_difference, want[r.doc_id], rtol=1e-5, atol=1e-5) for r in got)
    order = sorted(got, key=lambda r: want[r.doc_id])
    assert all(a.score <= b.score + 1e-12 for a, b in zip(order, order[1:], strict=False))


def test_toxicity_scores_equal_brute_force(spark, tmp_path):
    """The query's scores from the softmax over averaged embeddings, word by word; and one fit whatever the table's layout."""
    d, l = labelled(spark, 300)
    got = {r.doc_id: r.score for r in toxicity.score(spark, d, l).collect()}
    again = {r.doc_id: r.score for r in toxicity.score(spark, d.orderBy(F.rand(3)).repartition(5), l).collect()}
    assert got == again
    from plausia.llm.common import Scratch

    m = toxicity.trained(d, l, Scratch(spark, "t"))
    for r in d.limit(40).collect():
        words = toxicity.words_of(r.text)
        z = sum(np.mean([m.bucket[b] for b in toxicity.bag(w)]) for w in words) / (len(words) + toxicity.PADDING) + m.bias
        assert np.isclose(got[r.doc_id], 1 / (1 + np.exp(-z)))


def test_toxicity_on_held_out_rows_and_misspellings(spark):
    d, l = labelled(spark, 600)
    got = toxicity.score(spark, d, l).collect()
    assert accuracy(got, {r.doc_id: r.toxic for r in l.collect()}) > 0.95
    probe = docs(spark, [(10_000, "the people think you are a nitwitt and a blockhed in winter", "en", "a"), (10_001, "the people think of bread and water in winter by the river", "en", "a")])
    s = {r.doc_id: r.score for r in toxicity.score(spark, d.unionByName(probe), l).collect()}
    assert s[10_000] > 0.5 > s[10_001]


def test_toxicity_of_odd_rows(spark):
    d, l = labelled(spark, 120)
    odd = docs(spark, odd_rows(), True)
    got = toxicity.score(spark, odd.select(*d.columns).unionByName(d.withColumn("doc_id", F.col("doc_id") + 1000)), l.withColumn("doc_id", F.col("doc_id") + 1000)).collect()
    assert len(got) == 120 + len(odd_rows()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(spark, odd, none).collect()} == {0.0}


ODD_TEXTS = ["The", "I'll", "we've", "l'eau", "''s", "'''ll", "naïve", "ÉCOLE", "İstanbul", "ΣΟΦΟΣ", "日本語テキスト", "한국어", "각각", "été", "👍🏽👩‍👩‍👧", "<|endoftext|>", "x<|startoftext|>y", "<|endoftext", "12345", "a1b2", "foo.bar,baz!!", "***&&&", "ﬁ", "क्षि", "ß", "antidisestablishmentarianism", "aaaaaaaaaaaaaaaa", "\x1c\x1f", "ǅ", "it's's", "'S", "'re\u0301", "'r", "d\u0323\u0307", "\u0301", "ที่นี่", "\u1112\u1161\u11ab", "\u037e", "\u212b", "!!!'"]


@pytest.mark.parametrize("seed", range(3))
def test_counts_at_every_prefix_equal_the_library(seed):
    c = token_counts.counter(token_counts.vocabulary_path())
    r = random.Random(seed)
    for _ in range(40):
        t = "".join(r.choice(ODD_TEXTS) + r.choice([" ", "\n", "\t ", "", "\xa0", " ", "\x85", "\x1c"]) for _ in range(r.randint(0, 8)))
        want = [len(c.library.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]
        assert list(c.prefixes(t)) == want and c.total(t) == want[-1]


@pytest.mark.parametrize("unit", ["ที่นี่กำลังใจ", "\u1112\u1161\u11ab\u1100\u1173\u11af", "e\u0301to\u0302", "abcdefg", "'", "<|endoftext|>"])
def test_long_runs_cost_what_their_length_is(unit):
    """200,000 code points without a blank, in any script, whole and at every prefix."""
    c = token_counts.counter(token_counts.vocabulary_path())
    text = (unit * (200_000 // len(unit) + 1))[:200_000]
    began = time.process_time()
    whole, prefixes = c.total(text), c.prefixes(text)
    assert time.process_time() - began < 60
    assert whole == prefixes[-1] == len(c.library.encode(text, add_special_tokens=False).ids)
    assert [*prefixes[:150]] == [len(c.library.encode(text[:k], add_special_tokens=False).ids) for k in range(150)]


def test_counts_are_the_ledgers_last_entries(spark):
    rows = odd_rows() + [(50 + i, "".join(random.Random(i).choice(ODD_TEXTS) for _ in range(40)), "en", "a") for i in range(5)]
    d = docs(spark, rows)
    key = lambda r: (r.doc_id is None, r.doc_id or 0)
    counts = sorted((*key(r), r.n_tokens) for r in token_counts.token_counts(spark, d).collect())
    assert counts == sorted((*key(r), token_counts.tokens_at(bytes(r.steps), 10**9)) for r in token_counts.prefix_ledger(spark, d).collect())


def test_tokens_follow_as_plain_merging_has_it():
    c = token_counts.counter(token_counts.vocabulary_path())
    r, opened, closed = random.Random(3), sorted(c.open), sorted(c.closed)
    for _ in range(3_000):
        ends = r.random() < 0.5
        a, b = r.choice(opened), r.choice(closed if ends else opened)
        symbols = [*a, *b[:-1], b[-1] + c.end] if ends else [*a, *b]
        assert c._may_follow(a, b, ends) == (c._merged(symbols) == [a, b + c.end if ends else b]), (a, b, ends)


def test_ledger_answers_budget_questions(spark):
    text = prose(3, 200) + " don't stop"
    c = token_counts.counter(token_counts.vocabulary_path())
    steps = token_counts.prefix_ledger(spark, docs(spark, [(1, text, "en", "a")])).first().steps
    count = lambda s: len(c.library.encode(s, add_special_tokens=False).ids)
    for k in (0, 1, 17, 500, len(text)):
        assert token_counts.tokens_at(bytes(steps), k) == count(text[:k])
    cut = token_counts.longest_within(bytes(steps), 100)
    assert count(text[:cut]) <= 100 and all(count(text[:k]) > 100 for k in range(cut + 1, min(cut + 30, len(text))))


def test_token_counts_of_odd_rows(spark):
    c = token_counts.counter(token_counts.vocabulary_path())
    rows = odd_rows()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_bytes, r.over_limit) for r in token_counts.token_counts(spark, docs(spark, rows, True)).collect())
    n = lambda t: len(c.library.encode(t or "", add_special_tokens=False).ids)
    assert got == sorted((i is None, i or 0, n(t), len((t or "").encode()), n(t) > 2048) for i, t, *_ in rows)
    assert token_counts.token_counts(spark, spark.createDataFrame([], SCHEMA)).count() == 0
