"""Matching names: blocking, verified pairs, grouping into products.

Every word of the shorter of two names that match stands in the longer one: as it is, misspelt, or joined with its neighbours. So
a name looks for partners with its rarest word only, among the names that hold that word in one of those forms; a brand's word, which
thousands of names share, is nobody's rarest but the brand's own. The exact test runs on these candidates only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plausia.functions import names as n
from plausia.operators.copies import components
from plausia.operators.saved import saved

#: Short names that are sent to every task at most.
MOST_ALIASES = 200_000


def forms(word: str) -> set[str]:
    """What a word and its misspellings have in common: the word, what is left of it without a letter that a slip may add or change, and
    for long words their letters in order. Only slips that functions.names forgives: a word with a digit has its plural alone."""
    out = {word}
    letters, long = word.isalpha(), len(word) >= n.TYPO_LENGTH and not any(map(str.isdigit, word))
    if len(word) >= min(n.PLURAL_LENGTH, n.DOUBLED_LENGTH):
        out.add("~" + word)
        for i in range(1, len(word)):
            if long or letters and word[i] == word[i - 1] or i == len(word) - 1 and word[i] == "s":
                out.add("~" + word[:i] + word[i + 1 :])
    if long:
        out.add("~~" + word[0] + "".join(sorted(word[1:])))
    return out


def joined_runs(words: tuple[str, ...], around: int | None = None) -> set[str]:
    """Runs of neighbours as one word; only those that hold a place, if one is given."""
    return {"".join(words[i : i + k]) for k in range(2, n.JOINED + 1) for i in range(len(words) - k + 1) if around is None or i <= around < i + k}


def held_keys(words: tuple[str, ...]) -> list[str]:
    return sorted({f for w in words for f in forms(w)} | joined_runs(words))


def sought_keys(words: tuple[str, ...], at: int) -> list[str]:
    return sorted(forms(words[at]) | joined_runs(words, at))


def without_a_letter(word: Column) -> Column:
    """A word and all that is left of it without one letter but the first: words one edit apart with one first letter share an entry."""
    cut = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.when((i == 1) | (i > F.length(word)), word).otherwise(F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word)))))
    return F.array_distinct(cut)


def alias_lists(aliases: DataFrame | None) -> dict[str, n.Aliases]:
    """A table of short names (category, short, full) by category; more than MOST_ALIASES are an error."""
    if aliases is None:
        return {}
    rows = aliases.select("category", "short", "full").limit(MOST_ALIASES + 1).collect()
    if len(rows) > MOST_ALIASES:
        raise ValueError(f"more than {MOST_ALIASES} short names")
    out: dict[str, list[tuple[str, str]]] = {}
    for r in sorted(rows):
        out.setdefault(r.category, []).append((r.short, r.full))
    return {c: n.aliases_of(pairs) for c, pairs in out.items()}


def _with_words(aliases: dict[str, n.Aliases]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [list(n.name_words(x, aliases.get(c))) if x is not None else [] for c, x in zip(b.column("category").to_pylist(), b.column("name").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("category"), b.column("name"), pa.array(words, pa.list_(pa.string()))], ["category", "name", "words"])

    return run


def named_words(names: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """category, name and words of the distinct names that have words."""
    distinct = names.select(F.col("category").cast("string"), F.col("name").cast("string")).distinct()
    return distinct.mapInArrow(_with_words(alias_lists(aliases)), "category string, name string, words array<string>").filter("size(words) > 0")


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = [held_keys(tuple(w)) for w in b.column("words").to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.list_(pa.string()))], [*b.schema.names, "keys"])


def _sought(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = [sought_keys(tuple(w), at) for w, at in zip(b.column("words").to_pylist(), b.column("at").to_pylist(), strict=True)]
        names = ["category", "name", "words"]
        yield pa.RecordBatch.from_arrays([*map(b.column, names), pa.array(keys, pa.list_(pa.string()))], [*names, "keys"])


def candidate_pairs(named: DataFrame) -> DataFrame:
    """Pairs (a < b) of a category's names of which one holds the other's rarest word."""
    places = named.select("category", "name", "words", F.posexplode("words").alias("at", "word"))
    spread = places.groupBy("category", "word").agg(F.count(F.lit(1)).alias("spread"))
    order = F.struct((F.col("word") == "and").alias("last"), "spread", "word", "at")  # an "and" may be left out by either name
    rarest = places.join(spread, ["category", "word"]).groupBy("category", "name").agg(F.min(order).alias("r"), F.first("words").alias("words")).select("category", "name", "words", F.col("r.at").alias("at"))
    schema = "category string, name string, words array<string>, keys array<string>"
    seeks = rarest.mapInArrow(_sought, schema).select("category", F.col("name").alias("x"), F.explode("keys").alias("key"))
    holds = named.mapInArrow(_held, schema).select("category", F.col("name").alias("y"), F.explode("keys").alias("key"))
    met = seeks.join(holds, ["category", "key"]).filter("x <> y")
    return met.select("category", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def candidates(asked: DataFrame, index: DataFrame) -> DataFrame:
    """Entries that each asked name could mean, a superset of those that match: names that share a form of a word. Both are tables of
    named_words; index, the list's, is made once and kept for every request. Names are the few of a request, so no word is hot."""
    schema = "category string, name string, words array<string>, keys array<string>"
    a = asked.mapInArrow(_held, schema).select("category", "name", F.explode("keys").alias("key"))
    b = index.mapInArrow(_held, schema).select("category", F.col("name").alias("entry"), F.explode("keys").alias("key"))
    return a.join(b, ["category", "key"]).select("category", "name", "entry").distinct()


def pairs_among(pairs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The pairs of which both names are wanted. pairs: a library's, made once; wanted: a request's names (category, name)."""
    w = wanted.select("category", "name").distinct()
    return pairs.join(w.withColumnRenamed("name", "a"), ["category", "a"], "left_semi").join(w.withColumnRenamed("name", "b"), ["category", "b"], "left_semi")


def _verified(aliases: dict[str, n.Aliases]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = lru_cache(maxsize=100_000)(lambda category, name: n.name_words(name, aliases.get(category)))
        for b in batches:
            pairs = [(words(c, x), words(c, y)) for c, x, y in zip(*(b.column(k).to_pylist() for k in ("category", "a", "b")), strict=True)]
            same = pa.array([n.same_words(x, y) for x, y in pairs], pa.bool_())
            alike = pa.array([n.written_alike(x, y) for (x, y), fits in zip(pairs, same.to_pylist(), strict=True) if fits], pa.bool_())
            out = pa.RecordBatch.from_arrays([b.column("category"), b.column("a"), b.column("b")], ["category", "a", "b"]).filter(same)
            yield pa.RecordBatch.from_arrays([*out.columns, alike], ["category", "a", "b", "alike"])

    return run


def matching_pairs(names: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """category, a, b and alike for the pairs (a < b) of a category's names that mean one product."""
    lists = alias_lists(aliases)
    named = saved(named_words(names, aliases))
    return candidate_pairs(named).mapInArrow(_verified(lists), "category string, a string, b string, alike boolean")


def both_ways(pairs: DataFrame) -> DataFrame:
    """category, name, other and alike, each pair from either end."""
    ends = lambda x, y: pairs.select("category", F.col(x).alias("name"), F.col(y).alias("other"), "alike")
    return ends("a", "b").unionByName(ends("b", "a"))


def loose_names(pairs: DataFrame) -> DataFrame:
    """category and name of the names that fit two names which don't fit one another.

    A name's first partner is held against its others: where one doesn't fit it, the name is loose, which settles names with
    very many partners. Only where the first partner fits all others are the others held against one another.
    """
    ends = both_ways(pairs).filter("not alike").select("category", "name", "other")
    known = pairs.select("category", F.col("a").alias("lo"), F.col("b").alias("hi"))

    def torn(two: DataFrame) -> DataFrame:
        """Of (category, name, x, y) the names of which some x and y aren't a pair."""
        return two.select("category", "name", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).join(known, ["category", "lo", "hi"], "left_anti").select("category", "name").distinct()

    first = ends.groupBy("category", "name").agg(F.min("other").alias("x"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    by_first = saved(torn(ends.join(first, ["category", "name"]).filter("other <> x").withColumnRenamed("other", "y")))
    open_ = ends.join(first.filter("n > 2").select("category", "name"), ["category", "name"], "left_semi").join(by_first, ["category", "name"], "left_anti")
    x, y = open_.withColumnRenamed("other", "x"), open_.withColumnRenamed("other", "y")
    return by_first.unionByName(torn(x.join(y, ["category", "name"]).filter("x < y"))).distinct()


def group_products(names: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """name to product, within a category: names written alike are one; a name that fits longer names which don't fit one
    another is loose and stays apart; the rest join the names they match. names: category, name, n (mentions)."""
    pairs = saved(matching_pairs(names, aliases))
    loose = saved(loose_names(pairs).withColumn("loose", F.lit(True)))
    firm = pairs.join(loose.select("category", F.col("name").alias("a")), ["category", "a"], "left_anti").join(loose.select("category", F.col("name").alias("b")), ["category", "b"], "left_anti")
    alike = pairs.filter("alike")
    key = lambda c: F.concat_ws("\t", "category", c)
    groups = components(firm.unionByName(alike).select(key("a").alias("a"), key("b").alias("b")).distinct())
    out = names.join(loose, ["category", "name"], "left").join(groups, key("name") == F.col("node"), "left")
    return out.select("category", "name", "n", F.coalesce("root", key("name")).alias("product"), F.coalesce("loose", F.lit(False)).alias("loose"))


def shown_names(groups: DataFrame) -> DataFrame:
    """For each product the name to show: the longest among those written at least half as often as the most common one."""
    top = groups.groupBy("category", "product").agg(F.max("n").alias("top"))
    fit = groups.join(top, ["category", "product"]).filter(F.col("n") * 2 >= F.col("top"))
    return fit.groupBy("category", "product").agg(F.min_by("name", F.struct((-F.size(F.split("name", " "))).alias("w"), (-F.col("n")).alias("n"), "name")).alias("shown"))


def looked_up(asked: DataFrame, entries: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Asked names (category, name) with every entry (category, name, entry, ...) whose name means the same: alike says whether it is
    written alike. An asked name that is an entry's own fits it, alike."""
    wanted = asked.select("category", "name").distinct()
    every = wanted.unionByName(entries.select("category", "name")).distinct()
    pairs = matching_pairs(every, aliases)
    own = wanted.select("category", "name", F.col("name").alias("other"), F.lit(True).alias("alike"))
    fits = wanted.join(both_ways(pairs), ["category", "name"]).unionByName(own)
    return fits.join(entries.withColumnRenamed("name", "other"), ["category", "other"])
