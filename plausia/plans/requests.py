"""Queries of the requests and lookups family: requests in words, and lists reached by matching names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plausia.functions import names as n, requests as q
from plausia.operators import names as nm
from plausia.operators.order import numbered
from plausia.operators.saved import saved
from plausia.plans.views import table

#: The vocabulary that requests are read with: the last words of part names.
PARSED = T.StructType([
    T.StructField("status", T.StringType()), T.StructField("product_type", T.StringType()), T.StructField("min", T.DoubleType()), T.StructField("max", T.DoubleType()), T.StructField("currency", T.StringType()),
    T.StructField("size", T.DoubleType()), T.StructField("unit", T.StringType()), T.StructField("need_words", T.ArrayType(T.StringType())),
])


def parsed(vocabulary: dict[str, str]):
    """A function that reads requests with a vocabulary of names; the vocabulary travels with it."""

    @F.pandas_udf(PARSED)
    def parse_request(text: pd.Series) -> pd.DataFrame:
        rows = []
        for t in text:
            p = q.parse_request(t or "", vocabulary)
            b, s = p["budget"] or {}, p["size"] or {}
            rows.append((p["status"], p["product_type"], b.get("min"), b.get("max"), b.get("currency"), s.get("value"), s.get("unit"), p["need_words"]))
        return pd.DataFrame(rows, columns=PARSED.names)

    return parse_request


#: Types that are sent to every task at most.
MOST_NOUNS = 10_000


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    noun = F.split("p_name", " ")[1]
    typo = F.when(F.col("p_partkey") % 4 == 1, F.concat(F.substring(noun, 1, 3), F.expr("substring(split(p_name, ' ')[1], 5, 20)"))).otherwise(noun)
    ask = F.concat(F.lit("a sturdy "), typo, F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" under £"), F.col("p_size").cast("string"))).otherwise(""), F.when(F.col("p_partkey") % 5 == 0, ", 12 inch").otherwise(""))
    return table(spark, sf, "part").select("p_partkey", noun.alias("noun"), ask.alias("request"))


def _nouns(spark: SparkSession, sf: str) -> list[str]:
    """The vocabulary of types, whole; more than MOST_NOUNS are an error, never cut."""
    nouns = [r[0] for r in table(spark, sf, "part").select(F.split("p_name", " ")[1].alias("w")).filter("w is not null").distinct().limit(MOST_NOUNS + 1).collect()]
    if len(nouns) > MOST_NOUNS:
        raise ValueError(f"more than {MOST_NOUNS} types, too many to send to every task")
    return nouns


def parsed_requests(spark: SparkSession, sf: str) -> DataFrame:
    nouns = _nouns(spark, sf)
    rows = _requests(spark, sf).withColumn("p", parsed({w: w for w in sorted(nouns)})("request"))
    return rows.select("p_partkey", "request", "p.status", "p.product_type", "p.max", "p.currency", "p.size")


def query_case_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """How often the type that a request was made with is the type it is read as."""
    nouns = _nouns(spark, sf)
    rows = _requests(spark, sf).withColumn("p", parsed({w: w for w in sorted(nouns)})("request"))
    return rows.agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("p.product_type") == F.col("noun")).alias("right"))


def typo_correction(spark: SparkSession, sf: str) -> DataFrame:
    """Words one edit from exactly one vocabulary word with the same first letter: they meet on what is left without a letter."""
    v = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("v")).distinct().filter("length(v) >= 5")
    w = v.select(F.concat(F.substring("v", 1, 2), F.expr("substring(v, 4, 20)")).alias("w")).distinct().join(v, F.col("w") == F.col("v"), "left_anti").filter("length(w) >= 4")
    left, right = w.select("w", F.explode(nm.without_a_letter(F.col("w"))).alias("key")), v.select("v", F.explode(nm.without_a_letter(F.col("v"))).alias("key"))
    near = left.join(right, "key").select("w", "v").distinct().filter(F.levenshtein("w", "v", 1) == 1)
    return near.groupBy("w").agg(F.count(F.lit(1)).alias("near"), F.min("v").alias("v")).filter("near = 1").select("w", "v")


def search_terms(spark: SparkSession, sf: str) -> DataFrame:
    """At most three search terms a request, the most specific first."""
    p = table(spark, sf, "part")
    terms = F.array_compact(F.array(F.when(F.col("p_size") % 2 == 0, F.concat_ws(" ", "p_name", F.lit("vegan"))), F.col("p_name"), F.split("p_name", " ")[1], F.lit("anything")))
    return p.select("p_partkey", F.array_join(F.slice(terms, 1, 3), ";").alias("terms"))


def _list(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A list of entries and the names writers use for them."""
    p = table(spark, sf, "part")
    base = F.concat_ws(" ", F.regexp_replace("p_brand", "#", ""), F.col("p_name"))
    entries = p.select(F.col("p_type").alias("category"), base.alias("name"), F.col("p_retailprice").alias("price"), (F.col("p_partkey") % 30).alias("day"), F.col("p_partkey").alias("entry"))
    asked = p.select(F.col("p_type").alias("category"), F.concat(F.lit("the "), base, F.when(F.col("p_partkey") % 2 == 0, "s").otherwise("")).alias("name")).distinct()
    return entries, asked


def fuzzy_price_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The price of each asked name: entries whose name means the same product, written alike first, then newest, then cheapest."""
    entries, asked = _list(spark, sf)
    fits = nm.looked_up(asked, entries)
    best = fits.groupBy("category", "name").agg(F.min_by(F.struct("price", "entry"), F.struct((~F.col("alike")).alias("a"), (-F.col("day")).alias("d"), "price", "entry")).alias("p"), F.count(F.lit(1)).alias("fits"))
    return best.select("category", "name", "p.price", "p.entry", "fits")


def facts_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The facts entry of each asked name; none where the name isn't written alike and fits two entries that are different products."""
    entries, asked = _list(spark, sf)
    listed = entries.groupBy("category", "name").agg(F.min("entry").alias("entry"), F.max("day").alias("day"))
    fits = saved(nm.looked_up(asked, listed))
    best = fits.groupBy("category", "name").agg(F.min_by(F.struct("entry", "alike", "other"), F.struct((~F.col("alike")).alias("a"), (-F.col("day")).alias("d"), "other")).alias("p"))
    open_ = fits.join(best.filter("not p.alike").select("category", "name", F.col("p.other").alias("best")), ["category", "name"]).filter("other <> best")
    pairs = nm.matching_pairs(listed).select("category", F.col("a").alias("lo"), F.col("b").alias("hi"))
    apart = open_.select("category", "name", F.least("other", "best").alias("lo"), F.greatest("other", "best").alias("hi")).join(pairs, ["category", "lo", "hi"], "left_anti")
    unclear = apart.select("category", "name").distinct().withColumn("unclear", F.lit(True))
    return best.join(unclear, ["category", "name"], "left").select("category", "name", F.when(F.col("unclear").isNull(), F.col("p.entry")).alias("entry"))


def duplicate_names(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of names shown in one category that mean one product."""
    entries, asked = _list(spark, sf)
    return nm.matching_pairs(entries.select("category", "name").unionByName(asked).distinct())


def generic_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names that name no one product: only words for kinds of product, or alternatives."""
    kinds = F.array(*map(F.lit, sorted({"ring", "widget", "bolt"} | n.TYPE_WORDS)))
    words = F.split(F.lower(F.when(F.col("p_partkey") % 6 == 0, F.split("p_name", " ")[1]).when(F.col("p_partkey") % 6 == 1, F.concat_ws(" or ", "p_name", "p_type")).otherwise(F.col("p_name"))), " ")
    return table(spark, sf, "part").filter((F.size(F.array_except(words, kinds)) == 0) | F.array_contains(words, "or")).select("p_partkey")


def due_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Writers in the order in which to look them up: quoted ones first, then those never looked up last, the stalest first."""
    c = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 4 == 0).alias("quoted"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey") * 37 % 1000).alias("looked"))
    return numbered(c, F.desc("quoted"), F.asc_nulls_last("looked"), F.col("c_custkey"))


_READ = """asked AS (SELECT p_partkey, p_size, string_split(p_name, ' ')[2] AS noun, CASE WHEN p_partkey % 4 = 1 THEN substr(string_split(p_name, ' ')[2], 1, 3) || substr(string_split(p_name, ' ')[2], 5) ELSE string_split(p_name, ' ')[2] END AS w FROM part),
v AS (SELECT DISTINCT noun AS v FROM asked), near AS (SELECT w, min(v) AS v FROM (SELECT DISTINCT w FROM asked) JOIN v ON v[1] = w[1] AND levenshtein(v, w) = 1 WHERE length(w) >= 5 AND w NOT IN (SELECT v FROM v) GROUP BY w HAVING count(*) = 1),
read AS (SELECT p_partkey, noun, 'a sturdy ' || w || CASE WHEN p_partkey % 3 = 0 THEN ' under £' || p_size::VARCHAR ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN ', 12 inch' ELSE '' END AS request,
  CASE WHEN w IN (SELECT v FROM v) THEN w ELSE near.v END AS kind, CASE WHEN p_partkey % 3 = 0 THEN p_size::DOUBLE END AS max, CASE WHEN p_partkey % 5 = 0 THEN 12.0::DOUBLE END AS size FROM asked LEFT JOIN near USING (w))"""
QUERIES = {
    "parsed_requests": (parsed_requests, f"WITH {_READ} SELECT p_partkey, request, CASE WHEN kind IS NULL THEN 'clarify' ELSE 'ok' END AS status, kind AS product_type, max, CASE WHEN max IS NOT NULL THEN 'GBP' END AS currency, size FROM read"),
    "query_case_accuracy": (query_case_accuracy, f"WITH {_READ} SELECT count(*) AS cases, count(*) FILTER (kind = noun) AS right FROM read"),
    "typo_correction": (
        typo_correction,
        "WITH v AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS v FROM part), l AS (SELECT v FROM v WHERE length(v) >= 5), w AS (SELECT DISTINCT substr(v, 1, 2) || substr(v, 4) AS w FROM l) "
        "SELECT w, min(v) AS v FROM w JOIN l ON w[1] = v[1] AND levenshtein(w, v) = 1 WHERE w NOT IN (SELECT v FROM l) AND length(w) >= 4 GROUP BY w HAVING count(*) = 1",
    ),
    "search_terms": (search_terms, "SELECT p_partkey, array_to_string(list_slice([x FOR x IN [CASE WHEN p_size % 2 = 0 THEN p_name || ' vegan' END, p_name, string_split(p_name, ' ')[2], 'anything'] IF x IS NOT NULL], 1, 3), ';') AS terms FROM part"),
    "fuzzy_price_lookup": (fuzzy_price_lookup, None),
    "facts_lookup": (facts_lookup, None),
    "duplicate_names": (duplicate_names, None),
    "generic_names": (
        generic_names,
        "WITH w AS (SELECT p_partkey, string_split(lower(CASE p_partkey % 6 WHEN 0 THEN string_split(p_name, ' ')[2] WHEN 1 THEN p_name || ' or ' || p_type ELSE p_name END), ' ') AS w FROM part) "
        "SELECT p_partkey FROM w WHERE len([x FOR x IN w IF x NOT IN (" + ", ".join(f"'{w}'" for w in sorted({"ring", "widget", "bolt"} | n.TYPE_WORDS)) + ")]) = 0 OR list_contains(w, 'or')",
    ),
    "due_profiles": (
        due_profiles,
        "WITH c AS (SELECT c_custkey, c_custkey % 4 = 0 AS quoted, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey * 37 % 1000 END AS looked FROM customer) SELECT *, row_number() OVER (ORDER BY quoted DESC, looked NULLS LAST, c_custkey) AS place FROM c",
    ),
}
