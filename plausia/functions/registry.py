"""Registers the text functions as SQL functions: Arrow-batched, so that a query can call them on any column."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import SparkSession, functions as F, types as T

from plausia.functions import names, quotes, requests


@F.pandas_udf(T.ArrayType(T.StringType()))
def name_words(name: pd.Series) -> pd.Series:
    return name.map(lambda x: None if x is None else list(names.name_words(x)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def plain_words(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else names.plain_words(x))


@F.pandas_udf(T.BooleanType())
def same_product(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else names.same_product(x, y) for x, y in zip(a, b, strict=True)], dtype=object)


@F.pandas_udf(T.BooleanType())
def written_alike(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else names.written_alike(names.name_words(x), names.name_words(y)) for x, y in zip(a, b, strict=True)], dtype=object)


@F.pandas_udf(T.BooleanType())
def spelling_slip(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else names.slip(x, y) for x, y in zip(a, b, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def singular(word: pd.Series) -> pd.Series:
    return word.map(lambda x: None if x is None else names.singular(x))


@F.pandas_udf(T.StringType())
def unescaped(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else html.unescape(x))


@F.pandas_udf(T.StringType())
def quote_plain(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else quotes.plain(x)[0])


@F.pandas_udf(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
def find_quote(body: pd.Series, quote: pd.Series) -> pd.DataFrame:
    got = [quotes.find_quote(b, q) or (None, None) for b, q in zip(body, quote, strict=True)]
    return pd.DataFrame(got, columns=["start", "end"]).astype("Int32")


@F.pandas_udf(T.BooleanType())
def in_quoted_block(body: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
    return pd.Series([None if b is None or pd.isna(s) else quotes.in_quoted_block(b, (int(s), int(e))) for b, s, e in zip(body, start, end, strict=True)], dtype=object)


@F.pandas_udf(T.StructType([T.StructField("min", T.DoubleType()), T.StructField("max", T.DoubleType()), T.StructField("currency", T.StringType())]))
def parse_budget(text: pd.Series) -> pd.DataFrame:
    rows = [requests.parse_budget(t) or {} if t is not None else {} for t in text]
    return pd.DataFrame([{k: r.get(k) for k in ("min", "max", "currency")} for r in rows], columns=["min", "max", "currency"]).astype({"min": "float64", "max": "float64", "currency": object})


@F.pandas_udf(T.StructType([T.StructField("value", T.DoubleType()), T.StructField("unit", T.StringType())]))
def parse_size(text: pd.Series) -> pd.DataFrame:
    rows = [(requests.parse_size(t) if t is not None else None) or {} for t in text]
    return pd.DataFrame([{k: r.get(k) for k in ("value", "unit")} for r in rows], columns=["value", "unit"]).astype({"value": "float64", "unit": object})


@F.pandas_udf(T.StructType([T.StructField("spf", T.IntegerType()), T.StructField("min_years", T.IntegerType())]))
def parse_limits(text: pd.Series) -> pd.DataFrame:
    rows = [(None, None) if t is None else (requests.parse_spf(t), requests.parse_min_years(t)) for t in text]
    return pd.DataFrame(rows, columns=["spf", "min_years"]).astype("Int32")


FUNCTIONS = {
    f.__name__: f
    for f in (name_words, same_product, written_alike, spelling_slip, singular, unescaped, quote_plain, find_quote, in_quoted_block, parse_budget, plain_words, parse_size, parse_limits)
}


def register(spark: SparkSession) -> SparkSession:
    for name, f in FUNCTIONS.items():
        spark.udf.register(name, f)
    return spark
