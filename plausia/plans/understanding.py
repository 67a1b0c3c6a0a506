"""Queries of what requests, titles and quotes say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plausia.functions import requests as q
from plausia.operators import names as nm, understanding as u
from plausia.operators.copies import components
from plausia.plans.views import TURNS, table, turns

NOUNS = ("anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget")
PRAISE, FAILURE = ("love", "great", "grail", "good", "better"), ("broke", "avoid", "overpriced", "worse")
TOPICS = {"price": ("overpriced", "cheaper", "price"), "age": ("years", "weeks"), "trust": ("sponsored", "code", "brand"), "use": ("used", "tried")}
NEEDS = {"quiet": ("quiet", "silent"), "light": ("light", "lightweight"), "waterproof": ("waterproof", "rain"), "vegan": ("vegan",)}
OPPOSITES = {"quiet": ("loud", "noisy"), "lasting": ("broke", "weeks"), "cheap": ("overpriced",)}
INGREDIENTS = ("retinol", "alcohol", "perfume")
LITTLE = ("a", "an", "the", "for", "with", "no", "not", "but", "must", "be", "that", "is", "looking", "my", "needs", "to", "without")
ASKS = (
    "a quiet @ without perfume for my large rod, must be refillable", "looking for a @ that is not loud, needs to be waterproof, must be vegan", "light @ with retinol but no alcohol, must have a lid",
    "the @ to go with a blue gear", "vegan @ alcohol free, must be vegan", "not a red ring, a silent @",
)


def asks(spark: SparkSession, sf: str) -> DataFrame:
    """A request in words for each part."""
    form = F.element_at(F.array(*map(F.lit, ASKS)), (F.col("p_partkey") % len(ASKS) + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", F.split("p_name", " ")[1].alias("noun"), F.replace(form, F.lit("@"), F.col("p_name")).alias("text"))


_LIST = "[" + ", ".join(f"'{a}'" for a in ASKS) + "]"
_ASKS = f"asks AS (SELECT p_partkey, p_name, p_brand, p_type, string_split(p_name, ' ')[2] AS noun, replace(list_extract({_LIST}, (p_partkey % {len(ASKS)} + 1)::INT), '@', p_name) AS text FROM part)"


def _words(text: str) -> str:
    return rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}'']+')"


def _sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_NO = _sql_list(u.DENIALS_SAID)


def _said(w: str, vocabulary, before: int = 3, denied: bool = False) -> str:
    """SQL: whether a word of the vocabulary stands in w, without (or with) a denial among the words before it."""
    denial = f"list_has_any(CASE WHEN i > 1 THEN {w}[greatest(1, i - {before}):i - 1] ELSE [] END, {_NO})"
    return f"(len([i FOR i IN range(1, len({w}) + 1) IF list_contains({_sql_list(vocabulary)}, {w}[i]) AND {'' if denied else 'NOT '}{denial}]) > 0)"


def _names(w: str, vocabulary) -> str:
    return "[x FOR x IN [" + ", ".join(f"CASE WHEN {_said(w, ws)} THEN '{n}' END" for n, ws in vocabulary.items()) + "] IF x IS NOT NULL]"


def stance_words(spark: SparkSession, sf: str) -> DataFrame:
    """Quotes that don't carry the stance they stand for."""
    t = turns(spark, sf).withColumn("stance", F.when(F.col("turn") % 2 == 0, "recommend").otherwise("warn"))
    return t.select("conv_id", "turn", u.stance_problem(F.col("text"), F.col("stance"), PRAISE, FAILURE).alias("problem"))


_GOOD, _BAD = f"({_said('w', PRAISE)} OR {_said('w', FAILURE, 3, True)})", f"({_said('w', FAILURE)} OR {_said('w', PRAISE, 3, True)})"
_STANCE = (
    f"{TURNS}, w AS (SELECT conv_id, turn, {_words('text')} AS w, CASE WHEN turn % 2 = 0 THEN 'recommend' ELSE 'warn' END AS stance FROM turns), g AS (SELECT *, {_GOOD} AS good, {_BAD} AS bad FROM w), "
    "p AS (SELECT conv_id, turn, CASE WHEN stance = 'recommend' AND bad AND NOT good THEN 'reads as a warning' WHEN stance = 'warn' AND good AND NOT bad THEN 'reads as praise' WHEN NOT good AND NOT bad THEN 'says neither' END AS problem FROM g)"
)


def incoherent_quotes(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates to look at again: quotes that read against their stance."""
    return stance_words(spark, sf).filter(F.startswith("problem", F.lit("reads"))).groupBy("problem").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("conv_id").alias("conversations"))


def opposite_of_ask(spark: SparkSession, sf: str) -> DataFrame:
    asked = F.array(F.when(F.col("conv_id") % 2 == 0, "lasting").otherwise("cheap"), F.lit("quiet"))
    return turns(spark, sf).filter(u.says_opposite(F.col("text"), asked, OPPOSITES)).select("conv_id", "turn")


def topics_in_text(spark: SparkSession, sf: str) -> DataFrame:
    return turns(spark, sf).select("conv_id", "turn", F.array_join(u.topics(F.col("text"), TOPICS, ("the brand", "10 years")), ",").alias("topics"))


def needs_met(spark: SparkSession, sf: str) -> DataFrame:
    asked = F.array(F.lit("age"), F.when(F.col("conv_id") % 3 == 0, "price").otherwise("use"))
    return turns(spark, sf).select("conv_id", "turn", F.array_join(u.needs_met(F.col("text"), asked, TOPICS, ("3 years",)), ",").alias("met"))


def names_a_kind(spark: SparkSession, sf: str) -> DataFrame:
    """Requests that name a rod, outside the names of longer things."""
    return asks(spark, sf).filter(u.names_product(F.col("text"), "rod", ("large rod",))).select("p_partkey")


def about_request(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a title or a post names the kind asked for, the next part's."""
    a = asks(spark, sf).withColumn("asked", F.element_at(F.array(*map(F.lit, NOUNS)), (F.col("p_partkey") % len(NOUNS) + 1).cast("int")))
    w = u.tokens(F.concat_ws(" ", "p_name", "text"))
    return a.select("p_partkey", "asked", F.array_contains(u.kinds_named(w, NOUNS), F.col("asked")).alias("about"))


def titled_as_another(spark: SparkSession, sf: str) -> DataFrame:
    a = asks(spark, sf).withColumn("asked", F.element_at(F.array(*map(F.lit, NOUNS)), (F.col("p_partkey") % len(NOUNS) + 1).cast("int")))
    return a.filter(u.another_kind(u.tokens(F.col("text")), F.col("asked"), NOUNS)).select("p_partkey", "asked")


def community_words(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds that titles name by words that only their own community uses so."""
    extra = spark.createDataFrame([("PROMO", "small", "miniature"), ("LARGE", "small", "compact"), ("LARGE", "hot", "heated"), ("SMALL", "old", "vintage")], "community string, word string, kind string")
    titles = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("community"), F.explode(F.split("p_name", " ")).alias("word"))
    return u.community_kinds(titles, F.broadcast(extra)).filter("size(kinds) > 0").select("id", "community", F.array_join("kinds", ",").alias("kinds"))


def known_words(spark: SparkSession, sf: str) -> DataFrame:
    """Which kinds of the vocabulary each request names: its words semi-joined with the vocabulary, then gathered."""
    vocabulary = table(spark, sf, "part").select(F.split("p_name", " ")[1].alias("w")).distinct()
    w = asks(spark, sf).select("p_partkey", F.explode(F.array_distinct(u.tokens(F.col("text")))).alias("w"))
    return w.join(vocabulary, "w", "left_semi").groupBy("p_partkey").agg(F.array_join(F.array_sort(F.collect_set("w")), ",").alias("kinds"))


def must_haves(spark: SparkSession, sf: str) -> DataFrame:
    return asks(spark, sf).select("p_partkey", F.array_join(u.must_haves(F.col("text")), ";").alias("demands"))


def features_asked(spark: SparkSession, sf: str) -> DataFrame:
    return asks(spark, sf).select("p_partkey", F.array_join(u.before_noun(u.tokens(F.col("text")), F.col("noun"), LITTLE), ",").alias("features"))


def ingredients_asked(spark: SparkSession, sf: str) -> DataFrame:
    wanted, refused = u.ingredients_asked(u.tokens(F.col("text")), INGREDIENTS)
    return asks(spark, sf).select("p_partkey", F.array_join(wanted, ",").alias("wanted"), F.array_join(refused, ",").alias("refused"))


def ingredient_evidence(spark: SparkSession, sf: str) -> DataFrame:
    actives = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("retinol"))).when(F.col("p_size") % 3 == 1, F.array().cast("array<string>"))
    name = F.when(F.col("p_partkey") % 4 == 0, F.concat("p_name", F.lit(" Retinol"))).otherwise(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", u.ingredient_evidence(F.lit("retinol"), name, actives, F.lower("p_type"), ("promo", "small")).alias("evidence"))


def needs_asked(spark: SparkSession, sf: str) -> DataFrame:
    known, own = u.own_needs(u.tokens(F.col("text")), NEEDS, F.split("p_name", " "), LITTLE)
    return asks(spark, sf).select("p_partkey", F.array_join(known, ",").alias("needs"), F.array_join(own, ",").alias("own_words"))


def main_product(spark: SparkSession, sf: str) -> DataFrame:
    """The kind that a request is for: the last one named outside what it is to go with."""
    kinds = u.kinds_named(u.tokens(u.outside_context(F.col("text"))), NOUNS)
    return asks(spark, sf).select("p_partkey", F.element_at(kinds, -1).alias("kind"), (F.element_at(kinds, -1) == F.col("noun")).alias("right"))


def money_words(spark: SparkSession, sf: str) -> DataFrame:
    """Budgets written in words, read as figures."""
    small, tens = F.array(*map(F.lit, list(q.SMALL)[1:10])), F.array(*map(F.lit, q.TENS))
    n, t = F.col("c_custkey") % 9, F.floor(F.col("c_custkey") / 9) % 8
    text = F.concat(F.lit("a pan under "), F.element_at(tens, (t + 1).cast("int")), F.lit(" "), F.element_at(small, (n + 1).cast("int")), F.lit(" quid"))

    @F.pandas_udf("struct<max:double,currency:string>")
    def budget(s):
        import pandas as pd

        got = [q.parse_budget(q.money_in_figures(x)) or {} for x in s]
        return pd.DataFrame({"max": [g.get("max") for g in got], "currency": [g.get("currency") for g in got]})

    return table(spark, sf, "customer").select("c_custkey", budget(text).alias("b")).select("c_custkey", "b.max", "b.currency")


def kind_parts(spark: SparkSession, sf: str) -> DataFrame:
    about = F.concat("p_name", F.lit("s or "), F.lower("p_type"), F.lit(" boxes, heavy "), F.split("p_name", " ")[1], F.lit("es"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(u.kind_parts(about, ("bolt", "box", "ring")), ";").alias("kinds"))


def type_bases(spark: SparkSession, sf: str) -> DataFrame:
    """Names without the type words at their end."""
    words = F.split(F.concat_ws(" ", "p_name", F.when(F.col("p_size") % 2 == 0, "set"), F.when(F.col("p_size") % 3 == 0, "ring")), " ")
    return table(spark, sf, "part").select("p_partkey", F.array_join(u.without_last_types(words, ("set", "ring", "bolt", "new")), " ").alias("base"))


def brand_forms(spark: SparkSession, sf: str) -> DataFrame:
    """How names are written with a brand of two words, counted."""
    brand = F.array(F.lit("black"), F.lit("forge"))
    line = F.split("p_name", " ")
    forms = F.array(F.lit("black forge"), F.concat(F.lit("black forge "), F.col("p_name")), F.concat(F.lit("bf "), F.col("p_name")), F.col("p_name"), F.concat(F.lit("new "), F.col("p_name")))
    words = F.split(F.element_at(forms, (F.col("p_partkey") % 5 + 1).cast("int")), " ")
    return table(spark, sf, "part").groupBy("p_type", u.brand_form(words, brand, line).alias("form")).agg(F.count(F.lit(1)).alias("n"))


def product_context(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of a request's discussion that are about its product, and about another one."""
    a = asks(spark, sf).withColumn("body", F.concat(F.lit("I bought the "), "p_name", F.lit(". It works well. The old anvil was worse! It broke. My "), "p_name", F.lit(" did not.")))
    own, other = u.product_context(F.col("body"), F.col("p_name"), F.array(F.lit("old anvil")))
    return a.select("p_partkey", F.size(own).alias("own"), F.size(other).alias("other"))


def widened_quotes(spark: SparkSession, sf: str) -> DataFrame:
    """Quotes that lean on what was said before, with the sentence before them."""
    body = F.concat(F.lit("I have a "), F.col("p_name"), F.lit(". It never fails. Buy two."))
    quote = F.when(F.col("p_partkey") % 3 == 0, "It never fails.").when(F.col("p_partkey") % 3 == 1, "Buy two.").otherwise(F.concat(F.lit("I have a "), "p_name"))
    return table(spark, sf, "part").select("p_partkey", u.widened(quote, body).alias("quote"))


def kind_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds written in other orders or in one word, as one."""
    n = table(spark, sf, "part").select(F.col("p_name").alias("kind"))
    turned = n.select(F.concat_ws(" ", F.reverse(F.split("kind", " "))).alias("kind"))
    joined = n.select(F.regexp_replace("kind", " ", "").alias("kind"))
    return components(u.same_kind_sets(n.unionByName(turned).unionByName(joined)))


def care_tips(spark: SparkSession, sf: str) -> DataFrame:
    """Tips put to products: a tip that names a product of its own goes there; one about a kind goes to the products whose narrowest kind it is."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("product_key"), "p_name", "p_size")
    words = p.select("product_key", F.explode(F.split("p_name", " ")).alias("w"))
    kinds = p.filter("p_size <= 25").select(F.col("p_name").alias("kind"), F.explode(F.split("p_name", " ")).alias("w")).union(words.select("w", "w")).distinct()
    narrow = u.narrowest(u.placed_kinds(words, kinds))
    by_kind = narrow.groupBy("kind").agg(F.count(F.lit(1)).alias("products"))
    named = p.groupBy("p_name").agg(F.count(F.lit(1)).alias("n"), F.min("product_key").alias("product_key")).filter("n = 1").select(F.col("p_name").alias("kind"), F.lit(1).cast("long").alias("own"))
    return by_kind.join(named, "kind", "left").select("kind", "products", F.coalesce("own", F.lit(0).cast("long")).alias("own"))


def deck_sample(spark: SparkSession, sf: str) -> DataFrame:
    return u.deck(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment", "pairs-1", 10).select("c_custkey", "c_mktsegment", "place", "side")


def backed_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Summaries with a number, in digits or words, that their comment doesn't hold."""
    summary = F.when(F.col("turn") % 3 == 0, "used for three years").when(F.col("turn") % 3 == 1, "broke after 2 weeks").otherwise("lasts ten years")
    return turns(spark, sf).select("conv_id", "turn", F.array_join(u.unbacked_numbers(summary, F.col("text")), ",").alias("unbacked"))


def titles_with_word(spark: SparkSession, sf: str) -> DataFrame:
    wanted = F.when(F.col("p_partkey") % 4 == 0, "widg").when(F.col("p_partkey") % 4 == 1, "hotrod").when(F.col("p_partkey") % 4 == 2, "colour").otherwise("rin")
    words = F.split(F.when(F.col("p_size") % 5 == 0, F.concat("p_name", F.lit(" color"))).otherwise(F.col("p_name")), " ")
    return table(spark, sf, "part").filter(u.has_word(words, wanted, {"colour": "color"})).select("p_partkey")


def need_stems(spark: SparkSession, sf: str) -> DataFrame:
    """A request's words without the product's and little ones, as stems."""
    w = F.array_except(u.tokens(F.col("text")), F.concat(F.split("p_name", " "), F.array(*map(F.lit, LITTLE))))
    return asks(spark, sf).select("p_partkey", F.array_join(F.array_distinct(F.transform(w, u.stem)), ",").alias("stems"))


def name_index(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of a list that each asked name could mean: a table of keys that is made once and joined by each request."""
    entries = table(spark, sf, "part").select(F.col("p_type").alias("category"), "p_name").distinct().withColumnRenamed("p_name", "name")
    index = nm.named_words(entries)
    asked = entries.withColumn("name", F.concat(F.lit("the "), "name", F.lit("s")))
    return nm.candidates(nm.named_words(asked), index).groupBy("category", "name").agg(F.count(F.lit(1)).alias("candidates"))


def pairs_of_request(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs of a library's names that a request's names are among: the library's pairs once, semi-joined at both ends."""
    names = table(spark, sf, "part").select(F.col("p_type").alias("category"), F.concat_ws(" ", F.regexp_replace("p_brand", "#", ""), F.col("p_name")).alias("name")).distinct()
    pairs = nm.matching_pairs(names.unionByName(names.select("category", F.concat("name", F.lit("s")).alias("name"))))
    wanted = names.filter("category <> 'PROMO'").unionByName(names.filter("category = 'SMALL'").select("category", F.concat("name", F.lit("s")).alias("name")))
    return nm.pairs_among(pairs, wanted).groupBy("category").agg(F.count(F.lit(1)).alias("pairs"))


_KINDS_SQL = f"list_distinct([CASE WHEN list_contains({_sql_list(NOUNS)}, x) THEN x ELSE regexp_replace(x, 's$', '') END FOR x IN @ IF list_contains({_sql_list(NOUNS)}, x) OR list_contains({_sql_list(NOUNS)}, regexp_replace(x, 's$', ''))])"
_ASKED = f"list_extract({_sql_list(NOUNS)}, (p_partkey % {len(NOUNS)} + 1)::INT)"
_OUTSIDE = r"regexp_replace(lower(text), '\b(for my|to go with|to use with|instead of|not a|not an)\b[^,]*', ' ', 'g')"


def _blanked(phrase: str, text: str) -> str:
    return rf"regexp_replace({text}, '(^|[^\p{{L}}\p{{N}}]){phrase}([^\p{{L}}\p{{N}}]|$)', '\1 \2', 'g')"


QUERIES = {
    "stance_words": (stance_words, f"WITH {_STANCE} SELECT * FROM p"),
    "incoherent_quotes": (incoherent_quotes, f"WITH {_STANCE} SELECT problem, count(*) AS n, count(DISTINCT conv_id) AS conversations FROM p WHERE starts_with(problem, 'reads') GROUP BY 1"),
    "opposite_of_ask": (
        opposite_of_ask,
        f"WITH {TURNS}, w AS (SELECT conv_id, turn, {_words('text')} AS w, CASE WHEN conv_id % 2 = 0 THEN 'lasting' ELSE 'cheap' END AS asked FROM turns) SELECT conv_id, turn FROM w WHERE "
        + " OR ".join(f"(({'true' if a == 'quiet' else f'''asked = '{a}' '''}) AND ({_said('w', ws, 8)} OR {_said('w', [a], 8, True)}))" for a, ws in OPPOSITES.items()),
    ),
    "topics_in_text": (
        topics_in_text,
        f"WITH {TURNS}, w AS (SELECT conv_id, turn, {_words(_blanked('the brand', _blanked('10 years', 'lower(text)')))} AS w FROM turns) "
        f"SELECT conv_id, turn, array_to_string({_names('w', TOPICS)}, ',') AS topics FROM w",
    ),
    "needs_met": (
        needs_met,
        f"WITH {TURNS}, w AS (SELECT conv_id, turn, {_words(_blanked('3 years', 'lower(text)'))} AS w FROM turns) "
        f"SELECT conv_id, turn, array_to_string([x FOR x IN ['age', CASE WHEN conv_id % 3 = 0 THEN 'price' ELSE 'use' END] IF list_contains({_names('w', TOPICS)}, x)], ',') AS met FROM w",
    ),
    "names_a_kind": (names_a_kind, rf"WITH {_ASKS} SELECT p_partkey FROM asks WHERE regexp_matches({_blanked('large rod', 'lower(text)')}, '(^|[^\p{{L}}\p{{N}}])rod(s|es)?($|[^\p{{L}}\p{{N}}])')"),
    "about_request": (about_request, f"WITH {_ASKS} SELECT p_partkey, {_ASKED} AS asked, list_contains({_KINDS_SQL.replace('@', _words('p_name || chr(32) || text'))}, {_ASKED}) AS about FROM asks"),
    "titled_as_another": (titled_as_another, f"WITH {_ASKS}, k AS (SELECT p_partkey, {_ASKED} AS asked, {_KINDS_SQL.replace('@', _words('text'))} AS k FROM asks) SELECT p_partkey, asked FROM k WHERE len(k) > 0 AND NOT list_contains(k, asked)"),
    "community_words": (
        community_words,
        "WITH e(community, word, kind) AS (VALUES ('PROMO', 'small', 'miniature'), ('LARGE', 'small', 'compact'), ('LARGE', 'hot', 'heated'), ('SMALL', 'old', 'vintage')), w AS (SELECT p_partkey AS id, p_type AS community, unnest(string_split(p_name, ' ')) AS word FROM part) "
        "SELECT id, community, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM w JOIN e USING (community, word) GROUP BY ALL",
    ),
    "known_words": (known_words, f"WITH {_ASKS}, w AS (SELECT DISTINCT p_partkey, unnest({_words('text')}) AS w FROM asks) SELECT p_partkey, string_agg(w, ',' ORDER BY w) AS kinds FROM w WHERE w IN (SELECT string_split(p_name, ' ')[2] FROM part) GROUP BY 1"),
    "must_haves": (
        must_haves,
        rf"WITH {_ASKS}, m AS (SELECT p_partkey, [trim(x) FOR x IN regexp_extract_all(lower(text), '(?:must be|must have|has to be|needs to be|need it to be) ([\p{{L}}\p{{N}} -]+)', 1)] AS m FROM asks) "
        "SELECT p_partkey, array_to_string([m[i] FOR i IN range(1, len(m) + 1) IF list_position(m, m[i]) = i], ';') AS demands FROM m",
    ),
    "features_asked": (
        features_asked,
        f"WITH {_ASKS}, w AS (SELECT p_partkey, {_words('text')} AS w, noun FROM asks), b AS (SELECT p_partkey, [x FOR x IN w[1:list_position(w, noun) - 1] IF NOT list_contains({_sql_list(LITTLE)}, x)] AS b FROM w) "
        "SELECT p_partkey, array_to_string([b[i] FOR i IN range(1, len(b) + 1) IF list_position(b, b[i]) = i], ',') AS features FROM b",
    ),
    "ingredients_asked": (
        ingredients_asked,
        f"WITH {_ASKS}, w AS (SELECT p_partkey, {_words('text')} AS w FROM asks), r AS (SELECT p_partkey, "
        + ", ".join(f"list_contains(w, '{x}') AS h_{x}, {_said('w', [x], 3, True)} OR len([i FOR i IN range(1, len(w)) IF w[i] = '{x}' AND w[i + 1] = 'free']) > 0 AS r_{x}" for x in INGREDIENTS)
        + " FROM w) SELECT p_partkey, array_to_string([x FOR x IN [" + ", ".join(f"CASE WHEN h_{x} AND NOT r_{x} THEN '{x}' END" for x in INGREDIENTS) + "] IF x IS NOT NULL], ',') AS wanted, array_to_string([x FOR x IN ["
        + ", ".join(f"CASE WHEN h_{x} AND r_{x} THEN '{x}' END" for x in INGREDIENTS) + "] IF x IS NOT NULL], ',') AS refused FROM r",
    ),
    "ingredient_evidence": (
        ingredient_evidence,
        "WITH h AS (SELECT p_partkey, lower(p_type) AS form, CASE p_size % 3 WHEN 0 THEN 'listed' WHEN 1 THEN 'not listed' ELSE CASE WHEN p_partkey % 4 = 0 THEN 'named' ELSE 'unknown' END END AS held FROM part) "
        "SELECT p_partkey, CASE WHEN held IN ('listed', 'named') AND form IN ('promo', 'small') THEN held || ', rinsed off' ELSE held END AS evidence FROM h",
    ),
    "needs_asked": (
        needs_asked,
        f"WITH {_ASKS}, w AS (SELECT p_partkey, p_name, {_words('text')} AS w FROM asks), o AS (SELECT *, [x FOR x IN w IF NOT list_contains(list_concat(string_split(p_name, ' '), {_sql_list([*LITTLE, *(x for ws in NEEDS.values() for x in ws)])}), x)] AS o FROM w) "
        f"SELECT p_partkey, array_to_string({_names('w', NEEDS)}, ',') AS needs, array_to_string([o[i] FOR i IN range(1, len(o) + 1) IF list_position(o, o[i]) = i], ',') AS own_words FROM o",
    ),
    "main_product": (
        main_product,
        f"WITH {_ASKS}, k AS (SELECT p_partkey, noun, [x FOR x IN {_words(_OUTSIDE)} IF list_contains({_sql_list(NOUNS)}, x) OR list_contains({_sql_list(NOUNS)}, regexp_replace(x, 's$', ''))] AS k FROM asks), "
        "d AS (SELECT p_partkey, noun, [k[i] FOR i IN range(1, len(k) + 1) IF list_position(k, k[i]) = i] AS k FROM k) SELECT p_partkey, k[len(k)] AS kind, k[len(k)] = noun AS right FROM d",
    ),
    "money_words": (money_words, "SELECT c_custkey, ((c_custkey // 9 % 8 + 2) * 10 + c_custkey % 9 + 1)::DOUBLE AS max, 'GBP' AS currency FROM customer"),
    "kind_parts": (
        kind_parts,
        r"WITH a AS (SELECT p_partkey, lower(p_name || 's or ' || p_type || ' boxes, heavy ' || string_split(p_name, ' ')[2] || 'es') AS about FROM part), p AS (SELECT p_partkey, unnest(string_split_regex(about, '\s*,\s*|\s+or\s+')) AS p, generate_subscripts(string_split_regex(about, '\s*,\s*|\s+or\s+'), 1) AS i FROM a), "
        r"w AS (SELECT p_partkey, i, [regexp_replace(regexp_replace(regexp_replace(x, '(.{2,})ies$', '\1y'), '(.{2,}(?:ss|sh|ch|x))es$', '\1'), '(.{2,}[^sui])s$', '\1') FOR x IN string_split_regex(p, '\s+') IF x <> ''] AS w FROM p), "
        "k AS (SELECT p_partkey, i, array_to_string(list_sort(list_distinct([x FOR x IN w IF x NOT IN ('bolt', 'box', 'ring')])), ' ') AS k FROM w) SELECT p_partkey, coalesce(string_agg(k, ';' ORDER BY i) FILTER (k <> ''), '') AS kinds FROM k GROUP BY 1",
    ),
    "type_bases": (
        type_bases,
        "WITH w AS (SELECT p_partkey, concat_ws(' ', p_name, CASE WHEN p_size % 2 = 0 THEN 'set' END, CASE WHEN p_size % 3 = 0 THEN 'ring' END) AS w FROM part), b AS (SELECT p_partkey, w, trim(regexp_replace(' ' || w, '( (set|ring|bolt|new))+$', '')) AS b FROM w) "
        "SELECT p_partkey, CASE WHEN b = '' THEN w ELSE b END AS base FROM b",
    ),
    "brand_forms": (
        brand_forms,
        "SELECT p_type, CASE p_partkey % 5 WHEN 0 THEN 'brand alone' WHEN 1 THEN 'in full' WHEN 2 THEN 'by initials' WHEN 3 THEN 'without brand' ELSE 'other' END AS form, count(*) AS n FROM part GROUP BY ALL",
    ),
    "product_context": (product_context, "SELECT p_partkey, CASE WHEN p_name = 'old anvil' THEN 5 ELSE 3 END AS own, CASE WHEN p_name = 'old anvil' THEN 0 ELSE 2 END AS other FROM part"),
    "widened_quotes": (widened_quotes, "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'I have a ' || p_name || '. It never fails.' WHEN 1 THEN 'Buy two.' ELSE 'I have a ' || p_name END AS quote FROM part"),
    "kind_sets": (
        kind_sets,
        "WITH n AS (SELECT DISTINCT string_split(p_name, ' ') AS w FROM part), f AS (SELECT array_to_string(w, ' ') AS k, w FROM n UNION SELECT w[2] || ' ' || w[1], w FROM n UNION SELECT w[1] || w[2], w FROM n) "
        "SELECT k AS node, min(k) OVER (PARTITION BY w) AS root FROM f",
    ),
    "care_tips": (
        care_tips,
        "WITH k AS (SELECT DISTINCT p_name AS kind FROM part WHERE p_size <= 25 UNION SELECT unnest(string_split(p_name, ' ')) FROM part), "
        "p AS (SELECT p_partkey, kind FROM part JOIN k ON list_has_all(string_split(p_name, ' '), string_split(kind, ' '))), s AS (SELECT kind, count(*) AS products FROM p GROUP BY 1), "
        "n AS (SELECT p_partkey, arg_min(kind, {'n': products, 'k': kind}) AS kind FROM p JOIN s USING (kind) GROUP BY 1), o AS (SELECT p_name AS kind FROM part GROUP BY 1 HAVING count(*) = 1) "
        "SELECT kind, count(*) AS products, (kind IN (SELECT kind FROM o))::BIGINT AS own FROM n GROUP BY kind",
    ),
    "deck_sample": (
        deck_sample,
        "WITH m AS (SELECT c_custkey, c_mktsegment, sha256('pairs-1:' || c_custkey::VARCHAR) AS mark FROM customer) SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY mark) AS place, "
        "CASE WHEN strpos('02468ace', mark[64]) > 0 THEN 'left' ELSE 'right' END AS side FROM m QUALIFY place <= 10",
    ),
    "backed_numbers": (
        backed_numbers,
        f"WITH {TURNS}, s AS (SELECT conv_id, turn, text, CASE turn % 3 WHEN 0 THEN '3' WHEN 1 THEN '2' ELSE '10' END AS n, CASE turn % 3 WHEN 0 THEN 'three' WHEN 1 THEN 'two' ELSE 'ten' END AS w FROM turns), "
        "f AS (SELECT conv_id, turn, n, w, regexp_extract_all(lower(text), '\\d+(?:\\.\\d+)?|[a-z]+') AS t FROM s) SELECT conv_id, turn, CASE WHEN list_contains(t, n) OR list_contains(t, w) THEN '' ELSE n END AS unbacked FROM f",
    ),
    "titles_with_word": (
        titles_with_word,
        "SELECT p_partkey FROM part WHERE CASE p_partkey % 4 WHEN 0 THEN p_name LIKE '% widg%' WHEN 1 THEN p_name = 'hot rod' WHEN 2 THEN p_size % 5 = 0 ELSE false END",
    ),
    "need_stems": (
        need_stems,
        f"WITH {_ASKS}, w AS (SELECT p_partkey, [x FOR x IN {_words('text')} IF NOT list_contains(list_concat(string_split(p_name, ' '), {_sql_list(LITTLE)}), x)] AS w FROM asks), "
        "s AS (SELECT p_partkey, [regexp_replace(x, '^(.*[a-z]{3})(?:ing|ness|ly|ed|es|s)$', '\\1') FOR x IN w] AS s FROM w) SELECT p_partkey, array_to_string([s[i] FOR i IN range(1, len(s) + 1) IF list_position(s, s[i]) = i], ',') AS stems FROM s",
    ),
    "name_index": (name_index, None),
    "pairs_of_request": (pairs_of_request, None),
}
