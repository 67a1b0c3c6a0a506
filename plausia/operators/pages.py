"""What product pages say: structured data first, then the tags made for sharing, then the head."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _found(html: Column, pattern: str) -> Column:
    """What the first group of a pattern holds, null for nothing."""
    return F.nullif(F.trim(F.regexp_extract(html, pattern, 1)), F.lit(""))


def shared(html: Column, name: str) -> Column:
    """The content of a tag made for sharing, whichever of its attributes comes first."""
    return F.coalesce(
        _found(html, rf'(?is)<meta[^>]*?(?:property|name)=["\']{name}["\'][^>]*?content=["\']([^"\']*)["\']'),
        _found(html, rf'(?is)<meta[^>]*?content=["\']([^"\']*)["\'][^>]*?(?:property|name)=["\']{name}["\']'),
    )


def facts(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with name, price, currency, image, available, title and lang. The first block of structured data that names a product is
    read, also where it holds a list or a graph of things."""
    h = F.col(html)
    blocks = F.regexp_extract_all(h, F.lit(r'(?is)<script[^>]*type=["\']application/ld\+json["\'][^>]*>(.*?)</script>'), 1)
    things = F.flatten(F.transform(blocks, lambda b: F.coalesce(F.from_json(b, "array<string>"), F.from_json(F.get_json_object(b, "$[\'@graph\']"), "array<string>"), F.array(b))))
    product = F.get(F.filter(things, lambda t: F.get_json_object(t, "$[\'@type\']").contains("Product")), 0)
    of = lambda *paths: F.coalesce(*(F.get_json_object("_product", p) for p in paths))
    rows = pages.withColumn("_product", product)
    available = F.coalesce(of("$.offers.availability", "$.offers[0].availability"), shared(h, "(?:product|og):availability"))
    out = rows.withColumns(
        {
            "title": _found(h, r"(?is)<title[^>]*>([^<]*)</title>"),
            "lang": _found(h, r'(?is)<html[^>]*?lang=["\']([^"\']*)["\']'),
            "price": F.coalesce(of("$.offers.price", "$.offers[0].price", "$.offers.lowPrice"), shared(h, "(?:product|og):price:amount")).try_cast("double"),
            "currency": F.coalesce(of("$.offers.priceCurrency", "$.offers[0].priceCurrency"), shared(h, "(?:product|og):price:currency")),
            "image": F.coalesce(of("$.image", "$.image[0]"), shared(h, "og:image")),
            "available": F.when(available.isNotNull(), F.rlike(F.lower(available), F.lit("instock|in stock|limited|preorder"))),
        }
    )
    return out.withColumn("name", F.coalesce(of("$.name"), shared(h, "og:title"), F.col("title"))).drop("_product")


def candidates(urls: DataFrame, models: DataFrame) -> DataFrame:
    """Of the addresses (page_id, url) of each host those that hold every word of a model (model, words), with their place, the shortest
    first. Words are joined, and a pair counts if as many words met as the model has."""
    words = urls.select("page_id", "url", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("url"), F.lit("([a-z0-9_]+)"), 1))).alias("w"))
    wanted = models.select("model", F.size(F.array_distinct("words")).alias("size"), F.explode(F.array_distinct("words")).alias("w"))
    fits = words.join(wanted, "w").groupBy("model", "size", "page_id", "url").agg(F.count(F.lit(1)).alias("n")).filter("n = size")
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    place = F.row_number().over(Window.partitionBy("model", "host").orderBy(F.length("url"), "page_id"))
    return fits.withColumn("host", host).withColumn("place", place).select("model", "host", "page_id", "url", "place")
