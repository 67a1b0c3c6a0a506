"""Lookups in curated lists: the price, the availability, the facts of a product; budgets; rules between facts and requests.

A list's entries reach a product by key, or by matching names (operators.names) that give the keys; of several entries the
best is one aggregate (min_by over a struct), so no window sorts a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plausia.rules import RULES, Rules


def best_price(entries: DataFrame, currency: Column, *keys: str) -> DataFrame:
    """For each product the price to show: the asked currency first, the newest check, the cheapest, the shop's name."""
    order = F.struct((~F.col("currency").eqNullSafe(currency)).alias("a"), (-F.unix_date("checked_on")).alias("b"), F.col("price").alias("c"), F.lower("shop").alias("d"))
    best = entries.filter("price is not null").groupBy(*keys).agg(F.min_by(F.struct("price", "currency", "shop", "checked_on"), order).alias("p"))
    return best.select(*keys, "p.*")


def latest_availability(entries: DataFrame, *keys: str) -> DataFrame:
    """For each product the entry that says whether it is sold: the newest check; of one day, sold first, new first, shop."""
    order = F.struct((-F.unix_date("checked_on")).alias("a"), (~F.col("available")).alias("b"), F.col("second_hand").alias("c"), F.lower("shop").alias("d"))
    best = entries.filter("available is not null").groupBy(*keys).agg(F.min_by(F.struct("available", "second_hand", "shop", "checked_on"), order).alias("p"))
    return best.select(*keys, "p.*")


def price_check(price: Column, currency: Column, checked_on: Column, limit: Column, limit_currency: Column, today: Column, rules: Rules = RULES) -> Column:
    """How a price compares with a budget, in the order in which the answers are tried."""
    return (
        F.when(limit.isNull() | limit_currency.isNull(), "no budget")
        .when(price.isNull(), "unknown")
        .when(~currency.eqNullSafe(limit_currency), "other currency")
        .when(F.datediff(today, checked_on) > rules.price_max_age_days, "out of date")
        .when(price > limit, "over")
        .otherwise("within")
    )


#: Rules of one request at most.
MOST_RULES = 1_000


def fact_checks(products: DataFrame, rules: DataFrame) -> DataFrame:
    """products (product_key, facts map) against a request's rules (fact, value, hard): conflicts, cautions and unconfirmed.
    A fact that isn't given never clashes; it only leaves the requirement unconfirmed. A request's rules are few (more than MOST_RULES are
    an error), so they become columns and each product is judged where it stands."""
    few = rules.select("fact", "value", "hard").limit(MOST_RULES + 1).collect()
    if len(few) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    given = [F.try_element_at("facts", F.lit(r.fact)) for r in few]
    state = [F.when(g.isNull(), "unconfirmed").when(g == F.lit(r.value), "meets").otherwise("conflict" if r.hard else "caution") for g, r in zip(given, few, strict=True)]
    states = F.array(*state).cast("array<string>")
    count = lambda name: F.size(F.filter(states, lambda x: x == name)).cast("long").alias(name)
    return products.select("product_key", *map(count, ("meets", "conflict", "caution", "unconfirmed")))


def current_model(voices: DataFrame) -> DataFrame:
    """voices: product_key, written, released. A newer model is shown where more than half of the dated voices came before it."""
    share = F.avg(F.when(F.col("written").isNotNull(), (F.col("written") < F.col("released")).cast("double")))
    return voices.groupBy("product_key").agg(share.alias("share")).withColumn("superseded", F.coalesce(F.col("share") > 0.5, F.lit(False)))


def upserted(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """A curated list with findings put in: for each key the new entry if there is one."""
    kept = old.join(new.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(new)


def released_from(text: Column) -> Column:
    """The first day that a release date written as a year, a month or a day can mean."""
    return F.to_date(F.when(F.length(text) == 4, F.concat(text, F.lit("-01-01"))).when(F.length(text) == 7, F.concat(text, F.lit("-01"))).otherwise(text))


def leader(rows: DataFrame, key: str, by: str, score: str, lead: int, least: int) -> DataFrame:
    """For each key the one entry ahead of all others: at least `least`, and `lead` more than any other."""
    top = rows.groupBy(key).agg(F.max(F.struct(score, by)).alias("_top"))
    second = rows.join(top, key).filter(F.col(by) != F.col("_top")[by]).groupBy(key).agg(F.max(score).alias("_second"))
    ahead = top.join(second, key, "left").filter((F.col("_top")[score] >= least) & (F.col("_top")[score] >= F.coalesce("_second", F.lit(0)) + lead))
    return ahead.select(key, F.col("_top")[by].alias(by), F.col("_top")[score].alias(score))
