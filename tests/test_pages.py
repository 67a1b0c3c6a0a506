"""Facts of pages, and rules on what requests and quotes say."""

import json

from pyspark.sql import functions as F

from plausia.operators import assembly, pages, threads, understanding as u

LD = '<script type="application/ld+json">%s</script>'
THING = {"@type": "Product", "name": "Pan", "image": ["a.jpg", "b.jpg"], "offers": {"price": "12.50", "priceCurrency": "GBP", "availability": "https://schema.org/InStock"}}
PAGES = [
    "<html lang='en'><title> T </title>" + LD % json.dumps(THING),
    LD % json.dumps([{"@type": "Thing"}, THING | {"offers": [{"price": 3, "availability": "OutOfStock"}]}]),
    LD % json.dumps({"@graph": [THING | {"name": "Pot"}]}),
    '<meta property="og:title" content="Shared"><meta content="9" property="product:price:amount"><meta property="og:availability" content="in stock">',
    LD % "{broken" + "<title>Only a title</title>", "", None,
]


def test_structured_data_comes_first(spark):
    df = spark.createDataFrame([*enumerate(PAGES)], "page_id long, html string")
    got = {r.page_id: (r.name, r.price, r.currency, r.image, r.available) for r in pages.facts(df).collect()}
    assert got[0] == ("Pan", 12.5, "GBP", '["a.jpg","b.jpg"]', True) and got[1][:2] == ("Pan", 3.0) and got[1][4] is False and got[2][0] == "Pot"
    assert got[3] == ("Shared", 9.0, None, None, True) and got[4][:2] == ("Only a title", None) and got[5] == got[6] == (None,) * 5


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())).select(column).first()[0]


def test_words_are_said_or_denied(spark):
    w = u.tokens(F.col("t"))
    for text, want in (("it is quiet", True), ("not at all quiet", False), ("not that it would matter, quiet", True), ("", False), (None, False), ("QUIET!", True), ("never quiet but quiet now", False), ("never quiet but later it is quiet", True)):
        assert one(spark, u.said(w, ["quiet"]), t=text) is want, text
    assert one(spark, u.denied(w, ["quiet"]), t="isn't quiet") and not one(spark, u.denied(w, ["quiet"]), t="quiet")


def test_rules_read_requests(spark):
    t = F.col("t")
    assert one(spark, u.must_haves(t), t="Must be big, has to be red, must be big") == ["big", "red"]
    assert one(spark, F.trim(u.outside_context(t)), t="a lid for my old pan, cheap") == "a lid  , cheap"
    assert one(spark, u.kind_parts(t, ("pan",)), t="Cast iron pans or glass boxes, knives") == ["cast iron", "box glass", "knive"]
    assert one(spark, u.without_last_types(F.split(t, " "), ("set", "pan")), t="red pan set") == ["red"] and one(spark, u.without_last_types(F.split(t, " "), ("set",)), t="set") == ["set"]
    assert one(spark, u.widened(F.lit("It broke."), t), t="I had a pan. It broke. Bad.") == "I had a pan. It broke." and one(spark, u.widened(F.lit("Bad."), t), t="I had a pan. It broke. Bad.") == "Bad."
    own, other = u.product_context(t, F.lit("Lodge"), F.array(F.lit("Smithey")))
    assert one(spark, own, t="I like my Lodge. Heavy. The Smithey is light. Shiny too.") == ["I like my Lodge.", "Heavy."] and one(spark, other, t="I like my Lodge. Heavy. The Smithey is light. Shiny too.") == ["The Smithey is light.", "Shiny too."]
    assert one(spark, assembly.base_name(t), t="Toner (New Formula)") == "Toner" and one(spark, assembly.maker_spelling(t, {"sage": "Breville"}), t="Sage Dose") == "Breville Dose"


def test_ancestors_of_any_depth_are_asked(spark):
    df = spark.createDataFrame([(1, 0, None, True), (1, 1, 0, False), (1, 2, 1, False), (1, 3, 2, False), (1, 9, 8, True)], "thread_id long, comment_id long, parent_id long, ok boolean")
    got = {r.comment_id: (r.parent, r.earlier) for r in threads.readable_above(df, F.col("ok")).collect()}
    assert got == {0: (False, False), 1: (True, False), 2: (False, True), 3: (False, True), 9: (False, False)}


def test_gates_and_checks(spark):
    q = spark.createDataFrame([("a", "it works well", "works well"), ("a", "it works", "work"), ("b", "fine", "fine")], "answer string, body string, quote string")
    assert {(r.answer, r.quotes, r.failing, r.refused) for r in assembly.gated(q).collect()} == {("a", 2, 1, True), ("b", 1, 0, False)}
    items = spark.createDataFrame([(1, 1, "works"), (1, 2, "gone"), (2, 1, "any")], "comment_id long, item int, quote string")
    kept = assembly.kept_after_edit(items, spark.createDataFrame([(1, "it works still")], "comment_id long, body string"))
    assert {(r.comment_id, r.item): r.kept for r in kept.collect()} == {(1, 1): True, (1, 2): False, (2, 1): True}


def test_quotes_are_found_in_whatever_form(spark, monkeypatch):
    from plausia.operators import copies

    texts = spark.createDataFrame([(1, "it works  well and will last for years"), (2, "works"), (3, "it works, well and will last"), (4, None), (5, "")], "comment_id long, body string")
    quotes = spark.createDataFrame([(1, "works well and will last for"), (2, "works"), (3, "absent words are not here now"), (4, ""), (5, None), (6, "well and will")], "item_id long, quote string")
    want = {(1, 1), (2, 1), (2, 2), (2, 3), (6, 1), (6, 3)}
    assert {tuple(r) for r in copies.holders(texts, quotes).collect()} == want
    monkeypatch.setattr(copies, "MOST_STARTS", 1)
    assert {tuple(r) for r in copies.holders(texts, quotes).collect()} == want
