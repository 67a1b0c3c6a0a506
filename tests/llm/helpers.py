"""Small tables and brute-force versions."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; a table that has them already must come through unharmed.
CLASHING = ("score", "bucket", "digest", "spans", "x", "label", "rate", "copies", "item_ids", "component_id", "root", "n_words", "kept", "hash", "id", "mark", "row", "text_", "__id", "__mark", "__spans", "__text", "__kept", "__row", "__rate", "__copies", "__item_ids", "__n_windows", "___id")


def docs(spark, rows, clashing=False):
    df = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], SCHEMA)
    if clashing:
        from pyspark.sql import functions as F

        for c in CLASHING:
            df = df.withColumn(c, F.lit(f"own {c}"))
    return df


def prose(seed: int, n: int, words=("alpha", "beta", "gamma", "delta", "river", "stone", "winter", "garden", "quiet", "letter", "amber", "sail", "copper", "meadow")) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(words) + (str(r.randint(0, 99)) if r.random() < 0.3 else "") for _ in range(n))


def odd_rows():
    """Nulls, empties, blanks, one very long text, ties and repeated rows."""
    long = prose(1, 30_000)
    unspaced = "".join(u * 400 for u in ("ที่นี่กำลังใจ", "\u1112\u1161\u11ab", "e\u0301to\u0302", "日本語", "abcdefg", "<|endoftext|>", "'", "12345", "👍🏽"))
    return [
        (1, prose(2, 60), "en", "a"), (2, None, "en", "a"), (3, "", "fr", "b"), (4, " \t\n\x0b", None, None), (5, prose(2, 60), "en", "b"), (None, "no id here at all", "en", "a"),
        (6, long, "en", "a"), (7, "word", "en", "a"), (7, "word", "en", "a"), (8, "Ünï çödé 日本語 \x1c tail", "de", "c"), (9, prose(2, 59) + " changed", "en", "a"), (None, None, None, None), (10, unspaced, "th", "d"),
    ]
