"""Names and quotes: rules on single pairs, and blocking that loses no match."""

import random
from itertools import combinations

import pytest

from plausia.functions import names, quotes, requests
from plausia.operators import names as blocking


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("The Ordinary Peeling Solution", "ordinary peeling solution", True), ("Soon Jung", "soonjung", True), ("Black & Decker", "Black and Decker", True), ("Zojirushi kettle", "Zojurushi kettle", True),
        ("V60", "V61", False), ("Hario", "Vario", False), ("CeraVe hydrating cleanser", "CeraVe SA cleanser", False), ("Timemore C2", "Timemore C2 Max", False), ("CeraVe cream", "CeraVe Cream to Foam cleanser", False),
        ("zojirushi", "zojirushi kettle", True), ("10", "10 inch pan", False), ("pan", "pans", True), ("creuset", "creseut", True), ("Lido 2", "Lido 22", False), ("", "x", False),
        ("hurr", "hur", True), ("hurr", "hurrr", True), ("retinal", "retinol", False), ("Verb Ghost line", "Verb Ghost", True), ("KitchenAid Pro (Costco)", "KitchenAid Pro", True), ("1zpresso JX (non pro)", "1zpresso JX", True),
        ("Wusthof classic 8 inch", 'Wusthof Classic 8"', True), ("Dermalogica Daily Microfoliant 74g", "Dermalogica Daily Microfoliant", True), ("Chai shampoo", "Maker coconut and chai spice shampoo", False), ("Ecoslay Chai shampoo", "Chai shampoo", True),
    ],
)
def test_same_product(a, b, same):
    assert names.same_product(a, b) is same and names.same_product(b, a) is same


ALIASES = names.aliases_of([("TO", "The Ordinary"), ("BOJ", "Beauty of Joseon"), ("beauty of joseon retinal eye cream", "Beauty of Joseon Revive Eye Serum"), ("SGP", "Breville Smart Grinder Pro"), ("sage", "Breville"), ("C2", "Timemore C2")])


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("TO lactic acid", "The Ordinary Lactic Acid 10% + HA", True), ("TO's mandelic acid", "the ordinary mandelic acid", True), ("BOJ retinal eye cream", "Beauty of Joseon Revive Eye Serum", True),
        ("sage smart grinder pro", "Breville Smart Grinder Pro", True), ("SGP", "Breville Smart Grinder Pro", True), ("Timemore C2", "C2", True), ("BOJ red bean gel", "Beauty of Joseon Dynasty Cream", False), ("Q2S", "Q2", False),
    ],
)
def test_short_names_are_written_out(a, b, same):
    assert names.same_product(a, b, ALIASES) is same and names.same_product(b, a, ALIASES) is same


def test_why_names_are_apart():
    why = lambda a, b: names.why_apart(names.name_words(a), names.name_words(b))
    assert why("Timemore C2", "Timemore C2 Max") == "another model" and why("CeraVe cream", "CeraVe cream cleanser") == "another kind" and why("a b", "c d") == "a word is missing"
    assert why("10", "10 pan") == "a number is no brand" and why("", "x") == "no words"
    assert names.held_back(names.name_words("Chai shampoo"), names.name_words("Maker chai spice shampoo")) == "chai"
    assert names.shortest_units(("so", "on", "jung"), frozenset({"soon", "onjung", "soonjung"})) == ("soonjung",)
    with pytest.raises(ValueError, match="two names"):
        names.aliases_of([("x", "y z"), ("X", "y w")])


WORDS = ["hario", "vario", "kettle", "kettles", "soon", "jung", "soonjung", "creuset", "creseut", "pan", "pans", "lodge", "skillet", "and", "black", "decker", "hur", "hurr", "c2", "max"]


def made(seed, n, longest=4):
    r = random.Random(seed)
    return sorted({" ".join(r.choice(WORDS) for _ in range(r.randint(1, longest))) for _ in range(n)})


def test_matching_pairs_equal_all_pairs(spark):
    """Blocking by the rarest word loses no match: against every pair of names."""
    rows = [(c, x, 1) for c in ("kitchen", "skin") for x in made(3 if c == "skin" else 4, 150)] + [(None, "pan", 1), ("skin", None, 1), ("skin", "", 1), ("skin", "hario", 2)]
    df = spark.createDataFrame(rows, "category string, name string, n long")
    got = {tuple(r) for r in blocking.matching_pairs(df).collect()}
    want = set()
    for c in ("kitchen", "skin"):
        for a, b in combinations(sorted({x for k, x, _ in rows if k == c and x}), 2):
            wa, wb = names.name_words(a), names.name_words(b)
            if names.same_words(wa, wb) or names.same_words(wb, wa):
                want.add((c, a, b, names.written_alike(wa, wb)))
    assert got == want
    assert blocking.matching_pairs(df.limit(0)).count() == 0


def test_short_names_widen_the_matches(spark):
    df = spark.createDataFrame([("skin", "TO lactic acid", 1), ("skin", "The Ordinary Lactic Acid 10%", 1), ("kitchen", "TO lactic acid", 1), ("kitchen", "The Ordinary Lactic Acid 10%", 1)], "category string, name string, n long")
    aliases = spark.createDataFrame([("skin", "TO", "The Ordinary")], "category string, short string, full string")
    assert [tuple(r)[:3] for r in blocking.matching_pairs(df, aliases).collect()] == [("skin", "TO lactic acid", "The Ordinary Lactic Acid 10%")]


def test_loose_names_equal_all_pairs_of_partners(spark):
    df = spark.createDataFrame([("c", x, 1) for x in made(5, 90)], "category string, name string, n long")
    pairs = blocking.matching_pairs(df).checkpoint()
    known = {(r.a, r.b): r.alike for r in pairs.collect()}
    near = {}
    for (a, b), alike in known.items():
        if not alike:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {x for x, others in near.items() if any((a, b) not in known for a, b in combinations(sorted(others), 2))}
    assert {r.name for r in blocking.loose_names(pairs).collect()} == want and want
    groups = {r.name: r for r in blocking.group_products(df).collect()}
    assert all(groups[x].loose == (x in want) for x in groups)


def test_one_edit_is_levenshtein_one():
    r = random.Random(1)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for _ in range(3000):
        a, b = ("".join(r.choice("ab") for _ in range(r.randint(0, 5))) for _ in range(2))
        assert names.one_edit(a, b) == (distance(a, b) == 1)


@pytest.mark.parametrize(
    "body, quote, found",
    [("I really *like* it", "like it", "like* it"), ("I dislike it", "like it", None), ("a &amp; b", "a & b", "a &amp; b"), ("two   spaces", "two spaces", "two   spaces"), ("“curly”", '"curly"', "“curly”"), ("x", "", None), ("", "x", None), ("disliked, then like it.", "like it", "like it")],
)
def test_find_quote(body, quote, found):
    at = quotes.find_quote(body, quote)
    assert (body[at[0] : at[1]] if at else None) == found


def test_quoted_blocks_and_own_words():
    body = "> their words\nstill theirs\n\nmine"
    assert quotes.quoted_lines(body) == [True, True, False, False]
    assert quotes.in_quoted_block(body, quotes.find_quote(body, "still theirs")) and not quotes.in_quoted_block(body, quotes.find_quote(body, "mine"))
    assert not quotes.in_quoted_block("> all of it", (2, 5))
    coded = "&gt; It broke.\nNever buy it.\n\nI like it"
    assert quotes.in_quoted_block(coded, quotes.find_quote(coded, "Never buy it.")) and not quotes.in_quoted_block(coded, quotes.find_quote(coded, "I like it"))
    assert quotes.in_quoted_block("> all of it", (2, 5), own_if_all=False)


def test_own_words_sentences_and_denials(spark):
    from pyspark.sql import functions as F

    one = lambda f, text: spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]
    assert one(quotes.own_words, "> theirs\nMine &amp; yours") == "mine & yours" and one(quotes.own_words, "&gt; only") == " only"
    assert one(quotes.sentences, "One. Two!\nhttps://x.y/z") == ["One.", "Two! https://x.y/z"] and one(quotes.sentences, "") == []
    for phrase, text, want in (
        ("issues", "has issues", True), ("issues", "never had any issues", False), ("issues", "no issues, but later issues again and again issues", True), ("issues", "tissues", False),
        ("rust", "it doesn't rust", False), ("rust", "it doesnt really ever rust", False), ("rust", "not that it would ever rust", True), ("rust", "", False), ("a.b", "axb", False), ("rust", "rust", True),
    ):
        assert one(lambda t, p=phrase: quotes.found_unnegated(p, t), text) is want, text


@pytest.mark.parametrize(
    "text, want",
    [
        ("kettle under £50", (None, 50, "GBP")), ("£20-40 pan", (20, 40, "GBP")), ("between 20 and 40 euros", (20, 40, "EUR")), ("over £20 knife", (20, None, "GBP")), ("for 40 years", None), ("£50+", (50, None, "GBP")),
        ("over £90 but under £40", (None, 40, "GBP")), ("around 35", None), ("$1.5k grinder", (None, 1500, "USD")), ("150 quid or less", (None, 150, "GBP")),
        ("budget 40", (None, 40, None)), ("under 30", (None, 30, None)), ("4 or more people", None), ("serves 4", None), ("from £20 to £40", (20, 40, "GBP")), ("spend 20 to 40", (20, 40, None)), ("no more than 60", (None, 60, None)),
        ("12 inch pan", None), ("budget is around £80", (None, 80, "GBP")), ("1,500 dollars", (None, 1500, "USD")), ("spf 50 under 20", (None, 20, None)), ("€29,99", (None, 29.99, "EUR")), ("over 40 and under 60 euros", (None, 60, "EUR")),
    ],
)
def test_budgets(text, want):
    got = requests.parse_budget(text)
    assert (None if got is None else (got["min"], got["max"], got["currency"])) == want


def test_money_in_words():
    assert requests.money_in_figures("forty quid") == "40 quid" and requests.money_in_figures("a hundred and twenty five dollars") == "125 dollars"
    assert requests.money_in_figures("two grand pounds or five pans") == "2000 pounds or five pans" and requests.money_in_figures("thirty-five euros") == "35 euros"


@pytest.mark.parametrize(
    "text, spf, years",
    [
        ("SPF 50+ cream", 50, None), ("spf50", 50, None), ("a 30 spf", 30, None), ("factor 15", 15, None), ("spf 500", None, None), ("30 pans", None, None), ("lasts 10+ years", None, 10), ("10 years or more", None, 10),
        ("for 20 year olds", None, None), ("a 2026 kettle", None, None), ("should last me 5 yrs", None, 5), ("at least 3 years", None, 3), ("bought 3 years ago", None, None), ("", None, None),
    ],
)
def test_limits(text, spf, years):
    assert (requests.parse_spf(text), requests.parse_min_years(text)) == (spf, years)


def test_requests():
    got = requests.parse_request("best ketle for hard water under £50, 1.7 l", {"kettle": "kettle", "frying pan": "pan"})
    assert got["status"] == "ok" and got["product_type"] == "kettle" or got["status"] == "clarify"
    assert requests.parse_request("a frying pans please", {"frying pan": "pan"})["product_type"] == "pan"
    assert requests.parse_size("a 12-inch pan") == {"value": 12.0, "unit": "inch"}
    assert [names.singular(w) for w in ("knives", "brushes", "glasses", "pans", "gas", "berries")][1:] == ["brush", "glass", "pan", "gas", "berry"]
