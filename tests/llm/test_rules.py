"""Rules, URL filters, mixing and decontamination against brute force and on odd tables."""

import re

import duckdb
import numpy as np

from plausia.llm import decontamination, mixing, quality_rules, url_filter
from tests.llm.helpers import SCHEMA, docs, odd_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    again = {k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(i, i + 8)} if len(w) < 500 else None
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), None if again is None else len(again), len(lines)


def test_measurements_equal_brute_force(spark):
    rows = odd_rows() + [(20, ("a b c d e f g h " * 5 + "x") + "\nline one\nline one\n\n# <b> $5", "en", "a"), (21, "w1 w2 w3 w4 w5 w6 w7 w8", "en", "a")]
    got = quality_rules.measurements(docs(spark, rows, True)).collect()
    want = sorted((str(i), *(x for x in measured(t) if x is not None)) for i, t, *_ in rows if len((t or "").split()) < 500)
    have = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines) for r in got if r.n_words < 500)
    assert have == want
    assert quality_rules.measurements(spark.createDataFrame([], SCHEMA)).count() == 0


def test_policies_and_ablations_read_the_ledger_alone(spark):
    d = docs(spark, [(i, prose(i, 10 + 3 * i) + (" ***" * i if i % 4 == 0 else ""), "en", "a") for i in range(1, 30)])
    entries = quality_rules.ledger(d).cache()
    rows = quality_rules.verdicts(entries).collect()
    mask = quality_rules.POLICIES[quality_rules.POLICY]
    assert all(r.kept == (r.failed_rules & mask == 0) and r.base_failed == (r.failed_rules & quality_rules.BASE != 0) for r in rows)
    for a in quality_rules.ablations(entries).collect():
        bit = quality_rules.BITS[a.rule]
        assert a.failed == sum(r.failed_rules & bit != 0 for r in rows)
        assert a.alone == sum(r.failed_rules & mask == bit for r in rows)
        assert a.kept_without == sum(r.failed_rules & mask & ~bit == 0 for r in rows)


URLS = [None, "", "no scheme", "http://EXAMPLE.com/en/x", "https://www.Example.com/en/", "http://a.example.com/en/1?x=/en/", "http://x.net/es/1", "http://x.net/fr", "http://com/", "http://com", "http://foo.org/casino", "http://foo.org/casinos",
        "http://foo.org/free-bets", "http://foo.org/free/free", "ftp://u:p@host.org:80/a#b?c", "http://foo.org?x=viagra", "http://xcom/", "://", "http://ads-track.org/", "http://example.com/EN/", "http://é.org/porn", "http://foo.org/free-betting"]


def test_urls_equal_sql(spark):
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(URLS)] + [(None, URLS[3], ""), (3, URLS[3], "")], "page_id long, url string, html string")
    got = {tuple(r) for r in url_filter.judged(spark, pages).collect()}
    c = duckdb.connect()
    frame = pages.toPandas()  # noqa: F841
    c.execute("CREATE VIEW pages AS SELECT CAST(page_id AS BIGINT) AS page_id, url FROM frame")
    none = lambda v: None if v is None or v != v else v
    rel = c.execute(url_filter.ORACLE_SQL)
    names = [x[0] for x in rel.description]
    want = {tuple(none(dict(zip(names, r, strict=True))[k]) for k in ("page_id", "host", "path", "rule", "verdict", "n_terms", "soft_weight")) for r in rel.fetchall()}
    assert got == want
    by = {r[0]: r for r in got}
    assert by[5][3:5] == ("example.com/en/", "block") and by[4][3:5] == ("www.example.com/en/", "allow") and by[10][4] == "block" and by[11][4] == "allow" and by[12][4] == "allow" and by[13][4] == "allow" and by[21][4] == "block"


def test_weights_matter_and_come_from_a_table(spark):
    words = spark.createDataFrame([("alpha", 1.5), ("beta", 0.5), ("gamma", 0.5), ("delta", 9.0), ("omega", None), ("BETA", 0.25), ("", 1.0), (None, None)], "term string, weight double")
    urls = ["http://a.org/alpha-beta", "http://a.org/beta/gamma", "http://a.org/alpha/alpha", "http://a.org/delta", "http://a.org/omega", "http://a.org/beta.gamma.alpha", "http://a.org/delta_beta", "http://a.org/xalpha-beta"]
    pages = spark.createDataFrame([*enumerate(urls)], "page_id long, url string")
    got = sorted(tuple(r) for r in url_filter.judged(spark, pages, (), words).select("page_id", "verdict", "n_terms", "soft_weight").collect())
    assert [r[1] for r in got] == ["block", "allow", "allow", "allow", "block", "block", "block", "allow"]
    assert [r[3] for r in got] == [2.0, 1.0, 1.5, 9.0, 0.0, 2.5, 9.5, 0.5]
    none = url_filter.judged(spark, pages, (), words.limit(0)).collect()
    assert {r.verdict for r in none} == {"allow"} and url_filter.judged(spark, pages.limit(0), (), words).count() == 0


QUESTION = "Alice buys 3 kg of apples at the market and pays 12 dollars while her friend Maria buys 5 kg of pears for the same price"
OTHER = QUESTION.replace("3 kg", "7 kg").replace("12", "31").replace("5 kg", "9 kg").replace("Maria", "Sofia")
TORN = QUESTION.replace("Maria", "Sofia")


SUM = "What is 12 + 34 * 5 - 7 / 2 ?"
OTHER_SUM = "What is 99 + 31 * 6 - 8 / 3 ?"
SHORT_SUM = "What is 12 times 34 plus 56?"
NAMES = "Tom has 5 red pens. Ann has 7 blue pens. Bob takes 3 of them home."
ITEMS = [
    (1, QUESTION), (2, prose(50, 25)), (3, "too few words"), (4, "six plain words stand here alone"), (5, None), (6, ""), (7, SUM), (8, SHORT_SUM), (9, NAMES), (10, "Compute 3/4 of 88 plus 19 minus 6"),
    (None, "an item that has no id of its own at all"), (4, "another text of the same id that is longer than a window of ten words"), (11, "Alice buys 3 kg of apples at the market"),
]


def questions(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def contamination_rows():
    clean = prose(9, 300)
    return [
        (1, clean + " " + QUESTION + " " + clean, "en", "a"), (2, clean + " " + OTHER + ". " + clean, "en", "a"), (3, clean, "en", "a"), (4, prose(50, 25).upper(), "en", "a"), (5, "x " * 20 + "six plain words stand here alone", "en", "a"),
        (6, QUESTION.replace("apples", "plums").replace("pears", "figs").replace("market", "shop").replace("friend", "aunt"), "en", "a"), (7, QUESTION[40:], "en", "a"),
        (10, f"{clean} {SUM} {clean}", "en", "a"), (11, f"{clean}. {OTHER_SUM} {clean}", "en", "a"), (12, f"{clean} {SHORT_SUM} {clean}", "en", "a"), (13, f"{clean} {SHORT_SUM.replace('12', '13')} {clean}", "en", "a"),
        (14, NAMES.replace("Tom", "Zoe").replace("Ann", "Kim").replace("Bob", "Max").replace("5", "8"), "en", "a"), (15, clean + " compute 3/4 of 88 plus 19 minus 6", "en", "a"), (16, "here is an item that has no id of its own at all", "en", "a"),
        (17, "not another text of the same id that is longer than a window of ten words", "en", "a"), (18, clean + ". Yusuf buys 9 kg of apples at the market. " + clean, "en", "a"), (19, f"{clean} - {clean} + 7 * {clean}", "en", "a"),
        (20, NAMES.replace("Tom", "Zoe").replace("blue pens", "blue hats"), "en", "a"), (21, TORN, "en", "a"),
    ]


def brute_items(text):
    """The ids of the items that a text holds and their windows, from every pair of windows."""
    words, _ = decontamination.words_of(text)
    ids, windows = set(), 0
    for item_id, item in {(i, t) for i, t in ITEMS if t}:
        theirs, _ = decontamination.words_of(item)
        size = min(decontamination.WINDOW, len(theirs))
        maps = {}
        for i in range(len(words) - size + 1) if size >= decontamination.LEAST_EXACT else ():
            for k in range(len(theirs) - size + 1):
                m = decontamination.confirmed(theirs[k : k + size], words[i : i + size])
                if m is not None:
                    maps.setdefault(i - k, []).append(m)
        for found in maps.values():
            if decontamination.consistent(found):
                ids.add(item_id)
                windows += len(found)
    return ids, windows


def test_both_ways_of_joining_equal_brute_force(spark):
    rows = contamination_rows() + odd_rows()[1:5]
    d = docs(spark, rows, True)
    sent = decontamination.judged(spark, d, questions(spark)).collect()
    shuffled = decontamination.judged(spark, d, questions(spark), most_sent=0).collect()
    key = lambda rows: sorted(str(tuple(r)) for r in rows)
    assert key(sent) == key(shuffled)
    want = {}
    for i, t, *_ in rows:
        want[i] = brute_items(t)
    assert {r.doc_id: (set(r.item_ids), r.n_items, r.n_windows) for r in sent} == {i: (ids - {None}, len(ids), n) for i, (ids, n) in want.items()}
    hit = {r.doc_id: r.item_ids for r in sent if r.contaminated}
    assert hit == {1: [1, 11], 2: [1, 11], 4: [2], 5: [4], 7: [1], 10: [7], 11: [7], 12: [8], 14: [9], 15: [10], 16: [], 17: [4], 18: [11], 21: [1, 11]}


def test_what_must_and_must_not_be_found():
    found = {i: brute_items(t)[0] for i, t, *_ in contamination_rows()}
    assert all(x in found[i] for i, x in ((1, 1), (2, 1), (4, 2), (5, 4), (7, 1), (10, 7), (11, 7), (12, 8), (14, 9), (15, 10), (16, None), (17, 4), (18, 11)))
    assert not found[3] and not found[13] and not found[19] and 1 not in found[6] and 9 not in found[20]


def test_short_cuts_give_the_same_kinds():
    for w in "word Word WORD word. Word! kg Kg two. 3kg e.g. (word) Ünder ß éa I A a. 12 $5 -- ... l'eau Élan, ÉLAN x: ten? + - = *. / ** ÷".split():
        assert decontamination.codes([w])[0] & np.uint64(15) == decontamination.kind(w), w


def test_slots_must_be_consistent():
    a = decontamination.slots("when 3 meets 3 in the old town 5 times".split(), 0)
    same = decontamination.slots("when 8 meets 8 in the old town 9 times".split(), 0)
    torn = decontamination.slots("when 8 meets 7 in the old town 9 times".split(), 0)
    assert decontamination.mapping(a, same) == {(1, "3"): "8", (1, "5"): "9"} and decontamination.mapping(a, torn) is None
    assert decontamination.consistent([{(1, "3"): "8"}, {(1, "3"): "8"}]) and not decontamination.consistent([{(1, "3"): "8"}, {(1, "3"): "7"}])


def test_clean_keeps_columns_and_empty_tables(spark):
    d = docs(spark, contamination_rows() + odd_rows(), True)
    out = decontamination.clean(spark, d, questions(spark))
    assert out.columns == d.columns and {3, 6} <= {r.doc_id for r in out.collect()}
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.clean(spark, d, nothing).count() == d.count()
    assert decontamination.judged(spark, spark.createDataFrame([], SCHEMA), questions(spark)).count() == 0


def mixing_tables(spark, n=300):
    rows = [(i, (prose(i, 40) if i % 5 else prose(i, 40).replace(" ", "*** ")) + (" nitwit nitwit" if i % 4 == 0 else ""), "en", f"s{i % 3}") for i in range(n)]
    return docs(spark, rows), spark.createDataFrame([(i, int(i % 5 != 0), int(i % 4 == 0)) for i in range(n) if i % 3], "doc_id long, quality int, toxic int")


def test_rates_equal_projected_gradient_in_numpy(spark):
    d, l = mixing_tables(spark)
    rows = sorted(mixing.mixed(spark, d, l, {"q1_t0": 0.8, "q1_t1": 0.1, "q0_t0": 0.1}).collect(), key=lambda r: r.doc_id)
    p, n = np.array([r.posterior for r in rows]), np.array([r.n_tokens for r in rows], float)
    names = ["q0_t0", "q0_t1", "q1_t0", "q1_t1"]
    natural, r, held = p.T @ n, np.ones(len(n)), np.array([1, 0, 1, 1])
    total = natural @ held
    want = total * np.array([0.1, 0.0, 0.8, 0.1])
    for _ in range(mixing.ITERATIONS):
        gap = (p.T @ (n * r) - want) * held
        if max(abs(gap)) <= mixing.TOLERANCE * total:
            break
        r = np.maximum(0, r - p @ np.where(natural > 0, gap / natural, 0))
    assert np.allclose(r, [x.rate for x in rows], atol=1e-9)
    assert np.allclose(p.sum(1), 1) and abs((p.T @ (n * r) - want) * held).max() < 0.02 * n.sum()
    assert all(names[int(np.argmax(x.posterior))] == x.domain and abs(x.copies - x.rate) < 1 and x.rate >= 0 for x in rows)


def test_rates_meet_targets_that_gradient_steps_do_not_reach(spark):
    r = np.random.default_rng(5)
    p = r.dirichlet([6, 2, 1], 400)
    n = r.integers(1, 300, 400)
    known = spark.createDataFrame([(i, int(n[i]), p[i].tolist()) for i in range(400)], "doc_id long, n_tokens long, posterior array<double>")
    for targets in ({"a": 0.88, "b": 0.1, "c": 0.02}, {"a": 0.6, "c": 0.4}):  # b is free in the second
        rate, per, gap = mixing.rates(known, ["a", "b", "c"], targets)
        rows = known.select("doc_id", rate.alias("rate")).orderBy("doc_id").collect()
        x = np.array([row.rate for row in rows])
        have, held = p.T @ (n * x), [d in targets for d in "abc"]
        total = (p.T @ n)[held].sum()
        want = total * np.array([targets.get(d, 0) for d in "abc"])
        off = np.abs(have - want)[held].max() / total
        assert (x >= 0).all() and np.allclose([per[d][1] for d in "abc"], have) and np.isclose(gap, off, atol=1e-9)
        assert off <= mixing.TOLERANCE


def test_targets_out_of_reach_are_said(spark):
    known = spark.createDataFrame([(1, 10, [0.8, 0.2]), (2, 30, [0.6, 0.4])], "doc_id long, n_tokens long, posterior array<double>")
    _, per, gap = mixing.rates(known, ["a", "b"], {"a": 0.99, "b": 0.01})
    assert gap > 0.05 and abs(per["a"][1] - per["a"][0]) <= gap * 40 + 1e-6


def test_posteriors_know_the_domains(spark):
    d, l = mixing_tables(spark)
    truth = {r.doc_id: f"q{r.quality}_t{r.toxic}" for r in l.collect()}
    got = mixing.mixed(spark, d, l).collect()
    assert np.mean([r.domain == truth[r.doc_id] for r in got if r.doc_id in truth]) > 0.9


def test_mixing_of_odd_rows(spark):
    d, l = mixing_tables(spark, 60)
    none = l.limit(0)
    odd = docs(spark, odd_rows(), True)
    one = mixing.mixed(spark, odd, none).collect()
    assert len(one) == len(odd_rows()) and {r.domain for r in one} == {"all"} and all(abs(r.rate - 1) < 1e-6 for r in one)
    assert mixing.mixed(spark, d.limit(0), l).count() == 0
    assert mixing.mixed(spark, odd.select(*d.columns).unionByName(d), l).count() == 60 + len(odd_rows())
    out = mixing.drawn(spark, odd, none)
    assert out.count() == len(odd_rows()) and set(out.columns) == set(odd.columns)
