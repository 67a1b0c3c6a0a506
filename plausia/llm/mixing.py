"""Mixing sources to target weights: soft domain membership, and document rates by projected gradient and Newton steps.

Domains are the label classes of the labelled table (`q1_t0` is quality 1, toxic 0). A naive Bayes classifier over a few
features of a text (bands of its statistics, and for each of the most telling words whether the text holds it or not) gives each
document a posterior over the domains; so a document counts partly towards several. Rates r >= 0, one a document, minimise

    sum over domains of ((expected tokens - target) / natural tokens) ** 2, weighted by natural tokens,

where expected tokens of a domain are the sum of rate * tokens * posterior, and natural tokens those at rate 1. In the
metric that weighs documents by tokens, a gradient step is r <- max(0, r - step * posterior . error), with one error a
domain, and a step of 1 is stable. So an iteration is one aggregation over the documents that returns one row, and the
rate of a document is a fold of its posterior over the errors so far: no join, no shuffle of documents, no state.

Where ITERATIONS steps don't bring every domain within TOLERANCE of its target, the rates that do and are nearest to those of
the last step are sought (in the sum of tokens * difference ** 2). They are max(0, rate - posterior . price) for one price a
domain, and the prices are the minimum of a convex function of as many variables as there are domains: a damped Newton step
on it is again one aggregation that returns one row. Prices are held by the weights RIDGES, one after the other, so that the
steps end also where no rates meet the targets, because every document has too much of some domain; then they end near the
nearest that can be had. The column gap has, in every row, by how much the domain that is furthest off misses its target, as a
share of the tokens of the domains with targets; beyond TOLERANCE, a warning says what each domain has and wants.

All of it is DataFrame functions; what reaches the driver is bounded: a row a domain, at most WORDS words, counts of the
features. The telling words are found on a bounded sample of labelled rows (SAMPLE, by a hash of doc_id); all labelled
rows fit the classifier, and all rows are mixed.

Defined results: null and empty texts have no tokens and features of their own; without labels there is one domain, `all`,
and every rate is the budget; a domain with the weight 0 has the target 0, one that the targets don't name is left free; a null doc_id is
never labelled; several labels of one doc_id count as their maximum; repeated rows have rates each. Columns may have any name.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plausia.llm.common import NULL_ID, Scratch, table, unused

#: Shares that the named domains should have of their tokens after mixing; scaled to a sum of 1 over those there are.
TARGETS = {"q1_t0": 0.90, "q1_t1": 0.03, "q0_t0": 0.06, "q0_t1": 0.01}
#: Expected tokens after mixing, as a share of the tokens before.
BUDGET = 1.0
#: SAMPLE: labelled rows that telling words are sought in, all their words. WORDS: telling words at most; a word must be in
#: LEAST_TEXTS of those texts and have a chi-square of LEAST_SCORE, far above what the most telling of many random words has.
SAMPLE, WORDS, LEAST_TEXTS, LEAST_SCORE = 4_000, 48, 8, 40.0
#: ITERATIONS: gradient steps at most. TOLERANCE: what a domain may be off its target. RIDGES: weights of the squares of the
#: prices, as shares of natural tokens. NEWTON: aggregations at most for each of them.
ITERATIONS, TOLERANCE = 24, 1e-4
RIDGES, NEWTON = (1e-6, 1e-8), 60
SMOOTHING = 0.5
#: What a telling word's feature begins with.
HAS = "has:"
BLANK = r"[\x20\x09-\x0D]"


def _bands(x: Column, edges: list[float], name: str) -> Column:
    """The name and number of the band that x falls in."""
    out = F.lit(f"{name}:{len(edges)}")
    for i in reversed(range(len(edges))):
        out = F.when(x < edges[i], F.lit(f"{name}:{i}")).otherwise(out)
    return out


def _plain_words(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}]+")


def domain_of(labels: DataFrame) -> DataFrame:
    """doc_id and domain of the labelled rows."""
    known = labels.filter("doc_id is not null and quality is not null and toxic is not null")
    one = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("q"), F.max(F.col("toxic").cast("int")).alias("t"))
    return one.select("doc_id", F.format_string("q%d_t%d", "q", "t").alias("domain"))


def telling_words(docs: DataFrame, domains: DataFrame, scratch: Scratch, most: int = WORDS, sample: int = SAMPLE) -> list[str]:
    """The words whose presence tells a document from those of the most common domain best: by chi-square over a bounded sample of
    labelled rows, of the other domains where a word is more frequent than expected. A language's own words, which only say that a
    text is prose, don't crowd them out."""
    n = domains.count()
    drawn = scratch.save(domains.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < min(1.0, sample / max(1, n)) * 1_000_003), "drawn")
    # about `sample` ids
    texts = docs.join(F.broadcast(drawn), "doc_id").select("doc_id", "domain", F.explode(F.array_distinct(_plain_words(F.col("text")))).alias("word")).filter("word <> ''")
    of = {r.domain: r["count"] for r in drawn.groupBy("domain").count().collect()}  # a row a domain
    total = sum(of.values())
    per = texts.groupBy("word").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("domain") == d).alias(f"n_{d}") for d in sorted(of))).filter(F.col("n") >= LEAST_TEXTS)
    score = F.lit(0.0)
    common = min(of, key=lambda d: (-of[d], d)) if len(of) > 1 else None
    for d, k in sorted(of.items()):
        if d != common:
            expected = F.col("n") * (k / total)
            more = F.greatest(F.lit(0.0), F.col(f"n_{d}") - expected)
            score = score + more * more / expected
    score = score / (1.0001 - F.col("n") / total)
    return [r.word for r in per.select("word", score.alias("score")).filter(F.col("score") >= LEAST_SCORE).orderBy(F.desc("score"), "word").limit(most).collect()]


def features(docs: DataFrame, words: list[str]) -> DataFrame:
    """doc_id, mark, n_tokens and the array features of every row of docs (doc_id, mark, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    chars = F.char_length(text)
    tokens = F.size(F.array_remove(F.split(text, BLANK + "+"), ""))
    lines = F.split(text, "\n")
    found = F.array_intersect(_plain_words(text), F.array(*map(F.lit, words)).cast("array<string>"))
    raw = docs.select(
        F.col("doc_id"), F.col("mark"), tokens.cast("long").alias("n_tokens"), chars.alias("chars"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).alias("symbols"),
        F.regexp_count(text, F.lit("[A-Z]")).alias("upper"), F.size(lines).alias("lines"), F.size(F.array_distinct(lines)).alias("distinct_lines"),
        F.size(F.array_distinct(F.split(text, " "))).alias("distinct_words"), found.alias("found"),
    )
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_tokens"), F.lit(1))
    bands = F.array(
        _bands(F.col("n_tokens"), [1, 10, 20, 50, 200, 1000, 5000], "tokens"),
        _bands(per_word("chars"), [3, 4, 5, 6, 7, 9, 12], "length"),
        _bands(per_word("symbols"), [0.001, 0.02, 0.1, 0.5, 1.5], "symbols"),
        _bands(per_word("upper"), [0.05, 0.1, 0.2, 0.4, 1, 3], "upper"),
        _bands(F.col("distinct_lines") / F.col("lines"), [0.5, 0.7, 0.9, 1.0], "lines"),
        _bands(per_word("distinct_words"), [0.1, 0.2, 0.35, 0.5, 0.7, 0.9], "words"),
    )
    return raw.select("doc_id", "mark", "n_tokens", F.concat(bands, F.transform("found", lambda w: F.concat(F.lit(HAS), w))).alias("features"))


def posteriors(known: DataFrame, domains: DataFrame) -> tuple[list[str], DataFrame]:
    """The domains, and known with posterior, the probability of each in that order."""
    labelled = known.join(domains, "doc_id").select("domain", "features")
    rows = {r.domain: r["count"] for r in labelled.groupBy("domain").count().collect()}  # a row a domain
    if not rows:
        return ["all"], known.withColumn("posterior", F.array(F.lit(1.0)))
    names = sorted(rows)
    counts: dict[str, dict[str, int]] = {}
    for r in labelled.select("domain", F.explode("features").alias("f")).groupBy("f", "domain").count().collect():  # bands and WORDS words
        counts.setdefault(r.f, {})[r.domain] = r["count"]
    share = lambda f, d: (counts[f].get(d, 0) + SMOOTHING) / (rows[d] + 2 * SMOOTHING)
    # a band speaks for itself; a telling word speaks where it stands and, as much as it is usual in a domain, where it doesn't
    words = [f for f in sorted(counts) if f.startswith(HAS)]
    bands = [f for f in sorted(counts) if not f.startswith(HAS)]
    table_ = {f: [math.log(share(f, d)) for d in names] for f in bands} | {f: [math.log(share(f, d)) - math.log(1 - share(f, d)) for d in names] for f in words}
    flat = [x for f, v in table_.items() for x in (F.lit(f), F.array(*map(F.lit, v)))]
    weight = F.create_map(*flat)
    total = sum(rows.values())
    start = F.array(*(F.lit(math.log(rows[d] / total) + sum(math.log(1 - share(f, d)) for f in words)) for d in names))
    log = F.aggregate("features", start, lambda a, f: F.zip_with(a, F.coalesce(F.try_element_at(weight, f), F.array(*[F.lit(0.0)] * len(names))), lambda x, y: x + y))
    lifted = F.transform(F.array(log), lambda a: F.transform(a, lambda x: F.exp(x - F.array_max(a))))[0]
    return names, known.withColumn("lifted", lifted).withColumn("posterior", F.transform("lifted", lambda x: x / F.aggregate("lifted", F.lit(0.0), lambda s, y: s + y))).drop("lifted")


def _folded(errors: list[list[float]], k: int) -> Column:
    """A document's rate after so many steps: max(0, rate - posterior . error) from 1 on, over the errors of each step."""
    if not errors:
        return F.lit(1.0)
    history = F.array(*(F.struct(*(F.lit(x).alias(f"e{i}") for i, x in enumerate(e))) for e in errors))
    dot = lambda e: sum((F.col("posterior")[i] * e[f"e{i}"] for i in range(1, k)), F.col("posterior")[0] * e["e0"])
    return F.aggregate(history, F.lit(1.0), lambda r, e: F.greatest(F.lit(0.0), r - dot(e)))


def _priced(known: DataFrame, start: Column, wanted: np.ndarray, natural: np.ndarray, held: np.ndarray, close: float) -> tuple[Column, list[float]]:
    """The rates nearest to start that give the held domains the tokens wanted, within close, and the expected tokens of all."""
    k, at = len(natural), np.flatnonzero(held)
    pairs = [(i, j) for i in range(len(at)) for j in range(i, len(at))]

    def priced(price: np.ndarray) -> Column:
        return F.greatest(F.lit(0.0), start - sum((F.col("posterior")[int(d)] * float(x) for d, x in zip(at, price, strict=True)), F.lit(0.0)))

    def measured(price: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Half the sum of tokens * rate ** 2, the expected tokens of each domain, and by how much those of held ones fall with a price."""
        n, r, p = F.col("n"), F.col("rate"), [F.col("posterior")[i] for i in range(k)]
        sums = [n * r * r / 2, *(n * r * x for x in p), *(F.when(r > 0, n * p[at[i]] * p[at[j]]).otherwise(0.0) for i, j in pairs)]
        row = known.select(F.col("n_tokens").cast("double").alias("n"), "posterior", priced(price).alias("rate")).agg(*(F.coalesce(F.sum(x), F.lit(0.0)) for x in sums)).first()
        falls = np.zeros((len(at), len(at)))
        for (i, j), x in zip(pairs, row[k + 1 :], strict=True):
            falls[i, j] = falls[j, i] = x
        return float(row[0]), np.array(row[1 : k + 1], float), falls

    goal, total = wanted[at], float(natural[at].sum())
    price = np.zeros(len(at))
    half, now, falls = measured(price)
    for weight in RIDGES:
        ridge = weight * np.maximum(natural[at], 1e-6 * total)
        value = lambda half, x: half + goal @ x + ridge @ (x * x) / 2
        passes = 0
        while passes < NEWTON and np.abs(now[at] - goal).max() > close:
            slope = goal - now[at] + ridge * price
            step = -np.linalg.solve(falls + np.diag(ridge), slope)
            gain, length = -float(slope @ step), 1.0
            if gain <= 1e-12 * total:  # the best prices for this weight
                break
            while (passes := passes + 1) <= NEWTON:
                trial = measured(price + length * step)
                if value(trial[0], price + length * step) <= value(half, price) - 1e-4 * length * gain:
                    price, (half, now, falls) = price + length * step, trial
                    break
                length /= 4
    return priced(price), now.tolist()


def rates(known: DataFrame, names: list[str], targets: dict[str, float] | None = None, budget: float = BUDGET, iterations: int = ITERATIONS) -> tuple[Column, dict[str, tuple[float, float]], float]:
    """The column of rates; for each domain its target (or what it has, without one) and the expected tokens that the rates give;
    and the largest difference of the two, as a share of the tokens of the domains with targets."""
    targets = TARGETS if targets is None else targets
    k = len(names)

    def masses(rate: Column) -> list[float]:
        one = known.select(F.col("n_tokens").alias("n"), "posterior", rate.alias("rate")).agg(*(F.coalesce(F.sum(F.col("n") * F.col("rate") * F.col("posterior")[i]), F.lit(0.0)) for i in range(k)))
        return [float(x) for x in one.first()]

    natural = masses(F.lit(1.0))
    held = [d in targets for d in names]
    if not any(targets.get(d, 0.0) > 0 for d in names):  # none of the named domains is there
        held, targets = [True] * k, dict(zip(names, natural, strict=True))
    total = sum(m for m, h in zip(natural, held, strict=True) if h)
    weight = sum(targets[d] for d, h in zip(names, held, strict=True) if h) or 1.0
    wanted = [budget * total * targets[d] / weight if h else m for d, h, m in zip(names, held, natural, strict=True)]
    errors: list[list[float]] = []
    now = natural
    gaps = lambda: [s - t if h else 0.0 for s, t, h in zip(now, wanted, held, strict=True)]
    met = lambda: total <= 0 or max(map(abs, gaps())) <= TOLERANCE * total
    for _ in range(iterations):
        if met():
            break
        errors.append([g / m if m > 0 else 0.0 for g, m in zip(gaps(), natural, strict=True)])
        now = masses(_folded(errors, k))
    rate = _folded(errors, k)
    if not met():
        rate, now = _priced(known, rate, np.array(wanted), np.array(natural), np.array(held), TOLERANCE * total)
    gap = max(map(abs, gaps())) / total if total > 0 else 0.0
    return rate, {d: (t if h else s, s) for d, t, s, h in zip(names, wanted, now, held, strict=True)}, gap


def _rated(spark: SparkSession, docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None, budget: float, iterations: int) -> DataFrame:
    """What mixed() returns, and mark, a hash of the row's text."""
    scratch = Scratch(spark, "mixing")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("mark"), F.col("text").cast("string").alias("text"))
    domains = scratch.save(domain_of(labels), "domains")
    words = telling_words(rows, domains, scratch)
    known = scratch.save(features(rows, words), "features")
    names, known = posteriors(known, domains)
    known = scratch.save(known.select("doc_id", "mark", "n_tokens", "posterior"), "posteriors")
    scratch.drop("features", "domains", "drawn")
    rate, per, gap = rates(known, names, targets, budget, iterations)
    if gap > TOLERANCE:
        warnings.warn("mixing misses its targets: " + ", ".join(f"{d} wants {t:.6g} tokens and has {s:.6g}" for d, (t, s) in per.items()), stacklevel=3)
    domain = F.element_at(F.array(*map(F.lit, names)), F.array_position("posterior", F.array_max("posterior")).cast("int"))
    out = known.select("doc_id", "mark", "n_tokens", domain.alias("domain"), "posterior", rate.alias("rate"), F.lit(gap).alias("gap"))
    part = F.pmod(F.xxhash64("doc_id", "mark"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    return out.withColumn("copies", (F.floor("rate") + F.when(part < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long"))


def mixed(spark: SparkSession, docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, budget: float = BUDGET, iterations: int = ITERATIONS) -> DataFrame:
    """doc_id, n_tokens, domain (the likeliest), posterior, rate, gap and copies for every row of docs. copies: the rate rounded
    up or down by a hash of doc_id and text, so that copies match rates in the mean and a rerun gives the same."""
    return _rated(spark, docs, labels, targets, budget, iterations).drop("mark")


def drawn(spark: SparkSession, docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """docs with rate and copies (in the place of columns of these names), without the rows that get no copy. Rows with one
    doc_id and one text have one rate."""
    own_id, own_mark, own_rate, own_copies = unused(docs.columns, "id", "mark", "rate", "copies")
    key = lambda c: F.coalesce(c, F.lit(NULL_ID))
    rated = _rated(spark, docs, labels, targets, BUDGET, ITERATIONS).filter("copies > 0")
    by = rated.groupBy(key(F.col("doc_id")).alias(own_id), F.col("mark").alias(own_mark)).agg(F.first("rate").alias(own_rate), F.first("copies").alias(own_copies))
    keyed = docs.withColumns({own_id: key(F.col("doc_id").cast("long")), own_mark: F.xxhash64(F.col("text").cast("string"))})
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("rate", "copies")]
    return keyed.join(by, [own_id, own_mark]).select(*own, F.col(own_rate).alias("rate"), F.col(own_copies).alias("copies"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
