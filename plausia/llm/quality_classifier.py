"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

One pass over the texts writes a small table of statistics per document. Class means and covariances come from sums
over every labelled training row (plain SQL sums, so nothing but one row per class reaches the driver); each
covariance is shrunk towards the pooled one and towards its diagonal. Scoring uses the Cholesky factor of each class,
inverted once and cached: the score is a sigmoid of the difference of the log densities, with slope and offset
fitted on a histogram of that difference over the training rows.

Defined results: a null text counts as empty; an empty text has a score like any other; a null doc_id is in no fold, so
it isn't held out; repeated rows are scored each; several labels for one doc_id count as their maximum; with fewer
than two classes in the labels every score is the share of label 1 (0.5 without labels). Other columns of the input
are neither read nor returned.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from plausia.llm.common import Scratch, fold, held_out, ready, table, turn_to

#: Weights of the pooled covariance and of the diagonal in each class covariance, and what is added to the diagonal.
SHRINK_POOLED, SHRINK_DIAGONAL, RIDGE = 0.10, 0.10, 1e-3
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0
STATISTICS = (
    "log_bytes", "log_words", "log_lines", "word_length", "word_length_spread", "symbols", "marks", "digits", "upper",
    "letters", "distinct_words", "top_word", "repeated_neighbours", "repeated_lines", "bare_words", "byte_entropy",
    "line_words", "deflated",
)
BINS, BIN_WIDTH = 200, 0.5

_SYMBOLS = np.zeros(256)
_SYMBOLS[list(b"#*$%&|<>{}[]~^_=+\\/@")] = 1
_MARKS = np.zeros(256)
_MARKS[list(b".,;:!?\"'()-")] = 1
_DIGITS = np.zeros(256)
_DIGITS[list(b"0123456789")] = 1
_UPPER = np.zeros(256)
_UPPER[65:91] = 1
_LETTERS = np.zeros(256)
_LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = 1
_BY_BYTE = np.stack([_SYMBOLS, _MARKS, _DIGITS, _UPPER, _LETTERS], axis=1)


def _share(x: float) -> float:
    """The logit of a share, kept off 0 and 1."""
    p = min(max(x, 0.0), 1.0) * 0.998 + 0.001
    return float(np.log(p / (1 - p)))


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of one whole text."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    by = counts @ _BY_BYTE
    spread = counts[counts > 0] / size
    lengths = np.fromiter(map(len, words), np.int64, n)
    times = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        np.log1p(size), np.log1p(n), np.log1p(len(lines)), np.log1p(lengths.mean()), np.log1p(lengths.std()),
        _share(by[0] / size), _share(by[1] / size), _share(by[2] / size), _share(by[3] / size), _share(by[4] / size),
        _share(len(times) / n), _share(max(times.values()) / n), _share(sum(map(eq, words, words[1:])) / n),
        _share(1 - len(set(lines)) / max(1, len(lines))), _share(sum(map(bytes.isalpha, words)) / n),
        float(-(spread * np.log(spread)).sum()), np.log1p(n / len(lines)),
        np.log(len(zlib.compress(text, 1)) / size),
    ]


def _with_statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    turn_to("quality")
    for b in batches:
        x = [statistics(t or b"") for t in b.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the array x of STATISTICS, for every document."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_with_statistics, "doc_id long, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """For each class its mean, the inverse of its covariance's Cholesky factor, and its log determinant and prior."""

    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, priors included."""
        if self.constant is not None:
            return np.zeros(len(x))
        log = [self.offsets[c] - 0.5 * (((x - self.means[c]) @ self.factors[c].T) ** 2).sum(1) for c in (0, 1)]
        return log[1] - log[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(x) + self.shift, -60, 60)))


def _sums(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    p = len(STATISTICS)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    got = rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*(F.sum(F.col("x")[i]) for i in range(p))).alias("s"),
        F.array(*(F.sum(F.col("x")[i] * F.col("x")[j]) for i, j in pairs)).alias("q"),
    )
    out = {}
    for r in got.collect():  # one row for each of two labels
        q = np.zeros((p, p))
        for (i, j), v in zip(pairs, r.q, strict=True):
            q[i, j] = q[j, i] = v
        out[r.label] = (float(r.n), np.array(r.s), q)
    return out


def discriminant(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled: float = SHRINK_POOLED, diagonal: float = SHRINK_DIAGONAL, ridge: float = RIDGE) -> Discriminant:
    """The model of the counts, sums and sums of products of two classes."""
    n = {c: sums[c][0] if c in sums else 0.0 for c in (0, 1)}
    if min(n.values()) < 2:
        nothing = np.zeros(0)
        return Discriminant(nothing, nothing, nothing, constant=n[1] / (n[0] + n[1]) if sum(n.values()) else 0.5)
    means = np.stack([sums[c][1] / n[c] for c in (0, 1)])
    own = [sums[c][2] / n[c] - np.outer(means[c], means[c]) for c in (0, 1)]
    both = (n[0] * own[0] + n[1] * own[1]) / (n[0] + n[1])
    factors, offsets = [], []
    for c in (0, 1):
        s = (1 - pooled) * own[c] + pooled * both
        s = (1 - diagonal) * s + diagonal * np.diag(np.diag(s)) + np.diag(ridge * (1 + np.diag(both)))
        lower = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(lower))
        offsets.append(np.log(n[c] / (n[0] + n[1])) - np.log(np.diag(lower)).sum())
    return Discriminant(means, np.stack(factors), np.array(offsets))


def calibrated(model: Discriminant, histogram: list[tuple[float, int, float]]) -> Discriminant:
    """Slope and offset by logistic regression on (difference, label, count); the difference itself if that fails."""
    if model.constant is not None or not histogram:
        return model
    x, y, w = (np.array(v, float) for v in zip(*histogram, strict=True))
    design = np.stack([x, np.ones_like(x)], axis=1)

    def loss(b: np.ndarray) -> float:
        z = design @ b
        return float((w * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (b * b).sum())

    beta = np.array([0.5, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design * (w * p * (1 - p))[:, None]).T @ design + np.eye(2), design.T @ (w * (y - p)) - beta)
        rate = 1.0
        while rate > 1e-6 and loss(beta + rate * step) > loss(beta):
            rate /= 2
        beta = beta + rate * step
    return Discriminant(model.means, model.factors, model.offsets, float(beta[0]), float(beta[1])) if np.isfinite(beta).all() and beta[0] > 0 else model


def _scored(model: Discriminant, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column("x").to_pylist(), float).reshape(-1, len(STATISTICS))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(model.difference(x))], ["doc_id", "held_out", "score", "predicted", "log_density_difference"])

    return run


def _histogram(model: Discriminant, rows: DataFrame) -> list[tuple[float, int, float]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column("x").to_pylist(), float).reshape(-1, len(STATISTICS))
            at = np.clip(np.rint(model.difference(x) / BIN_WIDTH), -BINS, BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), b.column("label")], ["bin", "label"])

    got = rows.select("x", "label").mapInArrow(run, "bin int, label int").groupBy("bin", "label").count()
    return [(r.bin * BIN_WIDTH, r.label, r["count"]) for r in got.collect()]  # 2 * BINS + 1 bins of two labels


def fitted(spark: SparkSession, known: DataFrame, labels: DataFrame, scratch: Scratch) -> Discriminant:
    """The model of the labelled rows outside the held-out fold."""
    marked = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("label"))
    train = scratch.save(known.filter(fold(F.col("doc_id"), FOLDS) != HELD_OUT).join(marked, "doc_id").filter(F.col("label").isin(0, 1)), "train")
    model = discriminant(_sums(train))
    return model if model.constant is not None else calibrated(model, _histogram(model, train))


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and log_density_difference for every row of docs."""
    ready(spark)
    scratch = Scratch(spark, "quality")
    known = scratch.save(document_statistics(docs), "statistics")
    model = fitted(spark, known, labels, scratch)
    rows = known.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "x")
    return rows.mapInArrow(_scored(model, threshold), "doc_id long, held_out boolean, score double, predicted int, log_density_difference double")


def _accepting(model: Discriminant, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            x = np.array([statistics(t or b"") for t in texts], float).reshape(-1, len(STATISTICS))
            yield b.filter(pa.array(model.score(x) >= threshold))

    return run


def accepted(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with docs' own columns. Each row is judged by its own text,
    read once more rather than joined with a verdict: that costs less than shuffling the texts."""
    ready(spark)
    scratch = Scratch(spark, "quality")
    model = fitted(spark, scratch.save(document_statistics(docs), "statistics"), labels, scratch)
    return docs.mapInArrow(_accepting(model, threshold), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
