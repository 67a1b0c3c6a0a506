"""What requests, titles and quotes say: vocabulary words said or denied, needs, features, ingredients, topics, kinds.

Everything is a function of columns over a text's words, so rules stay in the generated code; vocabularies are parameters. A word is
said if it stands in the text and no denial stands among the few words before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plausia.functions.quotes import DENIALS, DENIED_VERBS, sentences

DENIALS_SAID = (*DENIALS, "free", *(v + t for v in DENIED_VERBS for t in ("n't", "nt")))
Vocabulary = dict[str, tuple[str, ...]]


def tokens(text: Column) -> Column:
    """Lower-case words with their apostrophes."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}']+)"), 1)


def _list(words) -> Column:
    return F.array(*map(F.lit, words)).cast("array<string>")


def said_at(words: Column, vocabulary, before: int = 3, denied: bool = False) -> Column:
    """The places (from 0) of a vocabulary's words that are said; or, if so asked, of those that are denied."""
    own, no = _list(vocabulary), _list(DENIALS_SAID)

    def place(w: Column, i: Column) -> Column:
        denial = F.arrays_overlap(F.slice(words, F.greatest(i - before + 1, F.lit(1)), F.least(i, F.lit(before))), no)
        return F.when(F.array_contains(own, w) & (denial if denied else ~denial), i)

    return F.array_compact(F.transform(words, place))


def said(words: Column, vocabulary, before: int = 3) -> Column:
    return F.size(said_at(words, vocabulary, before)) > 0


def denied(words: Column, vocabulary, before: int = 3) -> Column:
    return F.size(said_at(words, vocabulary, before, denied=True)) > 0


def names_of(words: Column, vocabulary: Vocabulary, before: int = 3) -> Column:
    """The names of the entries of a vocabulary that are said, in the vocabulary's order."""
    return F.array_compact(F.array(*(F.when(said(words, ws, before), F.lit(n)) for n, ws in vocabulary.items())))


def blanked(text: Column, phrases) -> Column:
    """A text with phrases taken out, the longest first: names that hold a topic's word, or words that only look like a need."""
    out = F.lower(text)
    for p in sorted(phrases, key=lambda p: (-len(p), p)):
        out = F.regexp_replace(out, r"(?<![\p{L}\p{N}])\Q" + p.lower() + r"\E(?![\p{L}\p{N}])", " ")
    return out


def topics(text: Column, vocabulary: Vocabulary, product_names=()) -> Column:
    """The topics that a text speaks of, names of products left aside."""
    return names_of(tokens(blanked(text, product_names)), vocabulary)


def needs_met(text: Column, asked: Column, vocabulary: Vocabulary, lookalikes=()) -> Column:
    """Which of the needs asked for a text talks about."""
    return F.array_intersect(asked, topics(text, vocabulary, lookalikes))


def stance_problem(quote: Column, stance: Column, praise, failure) -> Column:
    """Why a quote doesn't carry its stance: it reads the other way, or says nothing either way; null where it does."""
    w = tokens(quote)
    good, bad = said(w, praise) | denied(w, failure), said(w, failure) | denied(w, praise)
    return F.when((stance == "recommend") & bad & ~good, "reads as a warning").when((stance == "warn") & good & ~bad, "reads as praise").when((stance != "neutral") & ~good & ~bad, "says neither")


def says_opposite(quote: Column, asks: Column, opposites: Vocabulary, before: int = 8) -> Column:
    """Whether a quote says the opposite of something asked: a word for the opposite is said, or a word for the ask itself is denied."""
    w = tokens(quote)
    checks = [F.array_contains(asks, ask) & (said(w, words, before) | denied(w, [ask], before)) for ask, words in opposites.items()]
    out = F.lit(False)
    for c in checks:
        out = out | c
    return out


def names_product(text: Column, kind: str, longer=()) -> Column:
    """Whether a text names a kind of product, singular or plural, outside longer names that hold its word."""
    return F.rlike(blanked(text, longer), F.lit(r"(^|[^\p{L}\p{N}])" + kind + r"(s|es)?($|[^\p{L}\p{N}])"))


def kinds_named(words: Column, kinds) -> Column:
    """The kinds that a title's words name, singular or plural, in the title's order."""
    own = _list(kinds)
    one = F.transform(words, lambda w: F.when(F.array_contains(own, w), w).when(F.array_contains(own, F.regexp_replace(w, "s$", "")), F.regexp_replace(w, "s$", "")))
    return F.array_distinct(F.array_compact(one))


def another_kind(words: Column, asked: Column, kinds) -> Column:
    """Whether a title names kinds of product, and not the one asked for."""
    found = kinds_named(words, kinds)
    return (F.size(found) > 0) & ~F.array_contains(found, asked)


def community_kinds(titles: DataFrame, extra: DataFrame) -> DataFrame:
    """titles (id, community, word exploded) with the kind that a community's own words stand for. extra: community, word, kind."""
    return titles.join(extra, ["community", "word"], "left").groupBy("id", "community").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def must_haves(text: Column) -> Column:
    """What a request demands, in its order, each once: what follows a word of demanding up to a comma or the end."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(?:must be|must have|has to be|needs to be|need it to be) ([\p{L}\p{N} -]+)"), 1)
    return F.array_distinct(F.transform(found, F.trim))


def before_noun(words: Column, noun: Column, little) -> Column:
    """The features asked for: words before the product's noun but little ones, in their order."""
    at = F.array_position(words, noun).cast("int")
    return F.array_except(F.when(at > 1, F.slice(words, F.lit(1), at - 1)).otherwise(F.slice(words, 1, 0)), _list(little))


def ingredients_asked(words: Column, ingredients) -> tuple[Column, Column]:
    """Ingredients that a request asks for, and those that it refuses: after a denial, or before "free"."""
    refused = lambda w: denied(words, [w]) | F.exists(F.transform(words, lambda x, i: (x == w) & (F.get(words, i + 1) == "free")), lambda b: F.coalesce(b, F.lit(False)))
    pick = lambda test: F.array_compact(F.array(*(F.when(F.array_contains(words, w) & test(w), F.lit(w)) for w in ingredients)))
    return pick(lambda w: ~refused(w)), pick(refused)


def ingredient_evidence(ingredient: Column, name: Column, actives: Column, form: Column, rinse_off) -> Column:
    """What is known of an ingredient in a product: its listed actives decide, else its name; a form that is rinsed off is told apart."""
    by_list = F.array_contains(actives, ingredient)
    held = F.when(actives.isNotNull(), F.when(by_list, "listed").otherwise("not listed")).when(F.contains(F.lower(name), ingredient), "named").otherwise("unknown")
    return F.when(held.isin("listed", "named") & form.isin(*rinse_off), F.concat(held, F.lit(", rinsed off"))).otherwise(held)


def own_needs(words: Column, vocabulary: Vocabulary, noun_words: Column, little) -> tuple[Column, Column]:
    """The vocabulary's needs that a request names, and its other words: neither the product's, nor little, nor part of a need."""
    every = [w for ws in vocabulary.values() for w in ws]
    return names_of(words, vocabulary), F.array_except(words, F.concat(noun_words, _list([*little, *every])))


def outside_context(text: Column) -> Column:
    """A request without what the thing asked for is to go with: after "for my", "to go with", "to use with" or "instead of", up to a comma."""
    return F.trim(F.regexp_replace(F.lower(text), r"\b(for my|to go with|to use with|instead of|not a|not an)\b[^,]*", " "))


def singular(word: Column) -> Column:
    """A word's singular by its ending."""
    w = F.regexp_replace(word, r"(.{2,})ies$", r"$1y")
    w = F.regexp_replace(w, r"(.{2,}(?:ss|sh|ch|x))es$", r"$1")
    return F.regexp_replace(w, r"(.{2,}[^sui])s$", r"$1")


def kind_parts(about: Column, type_words) -> Column:
    """The kinds that a note is about: parted at "or" and commas, each as sorted singular words without words of the type."""
    parts = F.split(F.lower(about), r"\s*,\s*|\s+or\s+")
    words = lambda p: F.array_sort(F.array_except(F.transform(F.filter(F.split(p, r"\s+"), lambda w: w != ""), singular), _list(type_words)))
    return F.filter(F.transform(parts, lambda p: F.array_join(words(p), " ")), lambda p: p != "")


def without_last_types(words: Column, type_words) -> Column:
    """A name's words without the type words at its end; all of them where nothing else is left."""
    kept = F.aggregate(F.reverse(words), F.array().cast("array<string>"), lambda a, w: F.when((F.size(a) == 0) & F.array_contains(_list(type_words), w), a).otherwise(F.concat(F.array(w), a)))
    return F.when(F.size(kept) > 0, kept).otherwise(words)


def brand_form(words: Column, brand: Column, line: Column) -> Column:
    """How a name is written with its brand: the brand alone, by initials, the model without it, or in full. brand, line: arrays."""
    initials = F.array_join(F.transform(brand, lambda w: F.substring(w, 1, 1)), "")
    n = F.size(brand)
    return (
        F.when(words == brand, "brand alone").when(F.slice(words, F.lit(1), n) == brand, "in full")
        .when((F.size(words) > 0) & (F.get(words, F.lit(0)) == initials) & (n > 1), "by initials").when(words == line, "without brand").otherwise("other")
    )


def product_context(text: Column, own: Column, others: Column) -> tuple[Column, Column]:
    """Sentences about a product, and about others: a sentence belongs to the product that was last named in it or before it."""
    s = sentences(text)
    mark = lambda x: F.when(F.contains(F.lower(x), F.lower(own)), F.lit(1)).when(F.exists(others, lambda o: F.contains(F.lower(x), F.lower(o))), F.lit(2))
    start = F.struct(F.lit(1).alias("now"), F.array().cast("array<string>").alias("own"), F.array().cast("array<string>").alias("other"))

    def step(a: Column, x: Column) -> Column:
        now = F.coalesce(mark(x), a["now"])
        return F.struct(now.alias("now"), F.when(now == 1, F.concat(a["own"], F.array(x))).otherwise(a["own"]).alias("own"), F.when(now == 2, F.concat(a["other"], F.array(x))).otherwise(a["other"]).alias("other"))

    both = F.aggregate(s, start, step)
    return both["own"], both["other"]


def widened(quote: Column, body: Column) -> Column:
    """A quote that begins in lower case or with a word that stands for something said before, with the sentence before it in front."""
    s = sentences(body)
    at = F.array_max(F.transform(s, lambda x, i: F.when(F.contains(x, quote), i)))
    leans = F.rlike(quote, F.lit("^([a-z]|(It|This|That|They|These|Those|He|She)\\b)"))
    before = F.get(s, at - 1)
    return F.when(leans & (at > 0), F.concat_ws(" ", before, quote)).otherwise(quote)


def same_kind_sets(notes: DataFrame) -> DataFrame:
    """Edges (a, b) between kinds written as the same words in any order, or as the same letters in one run. notes: kind."""
    k = notes.select("kind").filter("kind is not null").distinct()
    words = F.array_join(F.array_sort(F.array_distinct(F.split(F.lower("kind"), " "))), " ")
    keyed = k.select("kind", F.explode(F.array(F.concat(F.lit("w:"), words), F.concat(F.lit("j:"), F.regexp_replace(F.lower("kind"), " ", "")))).alias("key"))
    first = keyed.groupBy("key").agg(F.min("kind").alias("a"))
    return keyed.join(first, "key").filter("kind <> a").select("a", F.col("kind").alias("b")).distinct()


def narrowest(placed: DataFrame) -> DataFrame:
    """Of the kinds that a product fits, the one with the fewest products. placed: product_key, kind."""
    sizes = placed.groupBy("kind").agg(F.count_distinct("product_key").alias("products"))
    return placed.join(sizes, "kind").groupBy("product_key").agg(F.min(F.struct("products", "kind"))["kind"].alias("kind"))


def placed_kinds(words: DataFrame, kinds: DataFrame) -> DataFrame:
    """product_key and kind wherever a product's words hold all of a kind's. words: product_key, w; kinds: kind, w."""
    sizes = kinds.groupBy("kind").agg(F.count_distinct("w").alias("size"))
    return words.distinct().join(kinds.distinct(), "w").groupBy("product_key", "kind").agg(F.count(F.lit(1)).alias("n")).join(sizes, "kind").filter("n = size").select("product_key", "kind")


def deck(cards: DataFrame, key: str, group: str, secret: str, each: int) -> DataFrame:
    """A sample that looks random and is the same for the same secret: so many cards of each group, the side drawn by another bit."""
    mark = F.sha2(F.concat_ws(":", F.lit(secret), F.col(key).cast("string")), 256)
    ranked = cards.withColumn("mark", mark).withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("mark")))
    side = F.when(F.conv(F.substring("mark", 64, 1), 16, 10).cast("int") % 2 == 0, "left").otherwise("right")
    return ranked.filter(F.col("place") <= each).withColumn("side", side)


#: Numbers in words, as texts write them beside digits.
NUMBER_WORDS = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve".split())}


def numbers_said(text: Column) -> Column:
    """The numbers of a text, each once: digits, and words for small ones."""
    words = F.create_map(*(F.lit(x) for pair in NUMBER_WORDS.items() for x in pair))
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+(?:\.\d+)?|[a-z]+)"), 1)
    return F.array_distinct(F.array_compact(F.transform(found, lambda x: F.when(F.rlike(x, F.lit("^[0-9]")), x).otherwise(F.try_element_at(words, x)))))


def unbacked_numbers(summary: Column, cited: Column) -> Column:
    """The numbers of a summary that no cited comment holds."""
    return F.array_except(numbers_said(summary), numbers_said(cited))


def stem(word: Column) -> Column:
    """A word without its ending, for comparing needs."""
    return F.regexp_replace(word, "(?<=[a-z]{3})(ing|ness|ly|ed|es|s)$", "")


def has_word(words: Column, wanted: Column, variants: dict[str, str]) -> Column:
    """Whether a title has a word asked for: one that begins with it, if it has four letters or more, its spelling elsewhere, or two neighbours
    that make it together."""
    other = F.lit(None).cast("string")
    for a, b in variants.items():
        other = F.when(wanted == a, F.lit(b)).when(wanted == b, F.lit(a)).otherwise(other)
    one = F.exists(words, lambda w: (w == wanted) | ((F.length(wanted) >= 4) & F.startswith(w, wanted)) | F.coalesce(w == other, F.lit(False)))
    joined = F.exists(F.transform(words, lambda w, i: F.concat(w, F.coalesce(F.get(words, i + 1), F.lit("")))), lambda w: w == wanted)
    return one | joined
