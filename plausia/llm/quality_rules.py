"""Quality rules: a ledger of one bit per failed rule, and policies that read it.

Every rule is evaluated once, in built-in column functions, and leaves a bit and its measurements. A policy is a
named, versioned mask: a document is kept if it fails none of the mask's rules. Changing a policy, or asking what each
rule costs, is then a bitwise aggregation over the ledger and never reads a text again.

A window of eight words counts as repeated if its 64-bit hash occurs twice in the document (the odds of an accidental
hit in a document of 100,000 words are below one in a thousand million).

Defined results: a null text has no words and no symbols; an empty text or one without words has 0 for every measure and
fails the rule on few words; rules on shares don't fail where there is nothing to measure; repeated rows are judged
each; a null doc_id stays null. Other columns of the input, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plausia.llm.common import table

BLANK = r"[\x20\x09-\x0D]+"
WINDOW = 8
#: Each rule's bit and what fails it, over the measurements. Written so that Spark and DuckDB both read it.
RULES = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 12 * n_words",
}
BITS = {name: 1 << i for i, name in enumerate(RULES)}
BASE = BITS["few_words"] | BITS["repeated_windows"]
#: Policies by version. A later version never changes an earlier one.
POLICIES = {"base-1": BASE, "prose-1": sum(BITS.values())}
POLICY = "prose-1"


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once: a lambda's variable isn't expanded by the optimiser."""
    return F.element_at(F.transform(F.array(value), f), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK), "")


def _hash_windows(words: Column) -> Column:
    """Hashes of all windows of WINDOW consecutive words."""
    count = F.greatest(F.size(words) - (WINDOW - 1), F.lit(0))
    return once(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: F.transform(F.slice(h, F.lit(1), count), lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, WINDOW)))),
    )


def _covered(windows: Column) -> Column:
    """Words inside the windows whose hash occurs at least twice."""

    def of(w: Column) -> Column:
        ordered = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        repeated = once(
            ordered,
            lambda s: F.filter(s, lambda e, i: (e["h"].eqNullSafe(F.get(s, i - 1)["h"])) | (e["h"].eqNullSafe(F.get(s, i + 1)["h"]))),
        )
        starts = F.array_sort(F.transform(repeated, lambda e: e["i"]))
        merged = F.aggregate(
            starts,
            F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
            lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + (i + WINDOW - F.greatest(i, a["end"])).cast("long")).alias("n")),
            lambda a: a["n"],
        )
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(merged)

    return once(windows, of)


def measurements(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of every row of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    return docs.select(
        F.col("doc_id").cast("long"),
        once(
            words_of(text),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
                _covered(_hash_windows(w)).alias("n_repeat_words"),
            ),
        ).alias("m"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        once(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("d"))).alias("l"),
    ).select(
        "doc_id", "m.n_words", "m.word_chars", "n_symbols", (F.col("l.n") - F.col("l.d")).alias("n_dup_lines"), "m.n_repeat_words", F.col("l.n").alias("n_lines"),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements and failed_rules, a bit for each rule of RULES that the row fails."""
    bits = [F.when(F.expr(rule), F.lit(BITS[name])).otherwise(F.lit(0)) for name, rule in RULES.items()]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measurements(docs).withColumn("failed_rules", total.cast("long"))


def verdicts(entries: DataFrame, policy: str = POLICY) -> DataFrame:
    """A ledger's rows with base_failed and kept under a policy."""
    failed = F.col("failed_rules")
    base = failed.bitwiseAND(F.lit(BASE).cast("long")) != 0
    return entries.withColumn("base_failed", base).withColumn("kept", ~base & (failed.bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0))


def ablations(entries: DataFrame, policy: str = POLICY) -> DataFrame:
    """For each rule of a policy: rows that fail it, that fail it alone, and that the policy without it keeps."""
    mask = POLICIES[policy]
    failed = F.col("failed_rules")
    part = lambda m: failed.bitwiseAND(F.lit(m).cast("long"))
    names = [n for n in RULES if BITS[n] & mask]
    sums = [F.count_if(e).alias(f"{n}_{k}") for n in names for k, e in (("failed", part(BITS[n]) != 0), ("alone", part(mask) == BITS[n]), ("kept_without", part(mask & ~BITS[n]) == 0))]
    one = entries.agg(*sums)
    return one.select(F.inline(F.array(*(F.struct(F.lit(n).alias("rule"), *(F.col(f"{n}_{k}").alias(k) for k in ("failed", "alone", "kept_without"))) for n in names))))


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "failed_rules")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(ledger(table(spark, sf_dir, "documents"))).select(*COLUMNS)


_BITS_SQL = " + ".join(f"CASE WHEN {rule} THEN {BITS[name]} ELSE 0 END" for name, rule in RULES.items())
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, r, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM d),
p AS (SELECT r, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) >= {WINDOW}),
s AS (SELECT r, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS s FROM p),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM s),
v AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM c, range(0, {WINDOW}) AS t(k) WHERE n > 1 GROUP BY r),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines FROM w LEFT JOIN v USING (r)),
b AS (SELECT *, ({_BITS_SQL})::BIGINT AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_rules & {BASE}) <> 0 AS base_failed,
  (failed_rules & {BASE | POLICIES[POLICY]}) = 0 AS kept, n_lines, failed_rules FROM b
"""
