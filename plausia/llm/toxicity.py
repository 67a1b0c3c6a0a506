"""Toxicity: bags of subword embeddings, averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams and itself, each hashed to one of BUCKETS embeddings, so that a misspelling
that was never seen shares most of its vectors with the word it stands for. A word's vector is the mean of its bag, a text's
the mean over its words and a few empty ones; a linear layer and a softmax over two classes give the score. Embeddings and layer are fitted
together by Adam on a bounded sample of labelled rows. Because everything up to the softmax is linear, scoring needs
one number for each bucket: the difference of the two classes' logits.

The sample: at most about SAMPLE labelled rows of each class, by a hash of doc_id; the class weights bring back the shares
among all labelled training rows. Buckets that fewer than LEAST_TEXTS texts of the sample touch stay at 0, so a word of one
text can't be learned by heart. All rows are scored, whole.

Defined results: null texts and texts without a word have the score of the bias alone; with fewer than two classes in the
labels every score is the share of label 1 (0 without labels); several labels of one doc_id count as their maximum;
repeated rows are scored each. Other columns of the input, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from plausia.llm.common import Scratch, cached_for, fold, held_out, ready, table, turn_to

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.5
BUCKETS, WIDTH = 1 << 17, 8
SHORTEST, LONGEST = 3, 5
SAMPLE, LEAST_TEXTS = 2_000, 15
#: Words of no weight that each text is taken to have besides its own, so that one odd word doesn't decide a short text.
PADDING = 15
STEPS, RATE, DECAY = 150, 0.05, 1e-5
MAX_WORDS = 400_000

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def bag(word: str) -> list[int]:
    """The buckets of a word: itself, and its n-grams between marks for its ends. Very long words are cut into stretches."""
    if len(word) > 64:
        return [b for i in range(0, len(word), 64) for b in bag(word[i : i + 64])]
    s = f"<{word}>"
    grams = {s, *(s[i : i + k] for k in range(SHORTEST, LONGEST + 1) for i in range(len(s) - k + 1))}
    return [zlib.crc32(g.encode()) % BUCKETS for g in sorted(grams)]


@dataclass(frozen=True)
class Model:
    """What each bucket adds to the difference of the logits, and the bias."""

    bucket: np.ndarray
    bias: float
    constant: float | None = None

    def word(self, word: str) -> float:
        return float(self.bucket[bag(word)].mean())


class Bags:
    """Texts as numbered words with their counts, in compact arrays: what the driver holds of the sample."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.words, self.counts, self.sizes, self.lengths = array("i"), array("i"), array("i"), array("i")

    def add(self, text: str) -> None:
        counts = Counter(words_of(text))
        number = self.number
        self.words.extend([number.setdefault(w, len(number)) for w in counts])
        self.counts.extend(counts.values())
        self.sizes.append(len(counts))
        self.lengths.append(sum(counts.values()))


def fit(texts: Bags, labels: np.ndarray, weights: np.ndarray, steps: int = STEPS) -> Model:
    """Embeddings and layer fitted on bags of words. weights: of each class."""
    many_texts, vocabulary = len(texts.sizes), len(texts.number)
    doc = np.repeat(np.arange(many_texts, dtype=np.int32), np.array(texts.sizes))
    word = np.array(texts.words, np.int32)
    share = np.array(texts.counts, float) / (np.array(texts.lengths) + PADDING)[doc]
    bucket, lengths = array("i"), array("i")
    for w in texts.number:
        grams = bag(w)
        bucket.extend(grams)
        lengths.append(len(grams))
    bucket = np.array(bucket, np.int32)
    owner = np.repeat(np.arange(vocabulary, dtype=np.int32), np.array(lengths))
    part = (1.0 / np.array(lengths, np.float32))[owner]
    # buckets that enough texts touch, renumbered
    seen = np.bincount(word, minlength=vocabulary)  # texts that hold a word
    touched = np.bincount(bucket, seen[owner], minlength=BUCKETS)
    used = np.flatnonzero(touched >= LEAST_TEXTS)
    place = np.full(BUCKETS, -1, np.int32)
    place[used] = np.arange(len(used))
    kept = place[bucket] >= 0
    owner, part, bucket = owner[kept], part[kept], place[bucket[kept]]
    del kept, seen, touched
    rng = np.random.default_rng(1)
    e = rng.normal(0, 0.1, (len(used), WIDTH))
    layer = rng.normal(0, 0.5, (WIDTH, 2))
    bias = np.zeros(2)
    target = np.stack([labels == 0, labels == 1], axis=1).astype(float)
    own = weights[labels] / weights[labels].sum()
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (e, layer, bias)]
    scale = 30.0  # a text's mean is small where one word in a hundred matters
    for t in range(1, steps + 1):
        # the mean of the embeddings, class by class, without building the texts' vectors
        by_bucket = e @ layer
        logits = np.empty((many_texts, 2))
        for c in (0, 1):
            by_word = np.bincount(owner, part * by_bucket[bucket, c], minlength=vocabulary)
            logits[:, c] = scale * np.bincount(doc, share * by_word[word], minlength=many_texts) + bias[c]
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(1, keepdims=True)
        g = (p - target) * own[:, None]
        back = np.empty_like(by_bucket)
        for c in (0, 1):
            by_word = np.bincount(word, share * (scale * g[:, c])[doc], minlength=vocabulary)
            back[:, c] = np.bincount(bucket, part * by_word[owner], minlength=len(used))
        grads = (back @ layer.T + DECAY * e, e.T @ back + DECAY * layer, g.sum(0))
        rate = RATE * min(1.0, 2 * (1 - t / (steps + 1)))
        for x, grad, (m, v) in zip((e, layer, bias), grads, state, strict=True):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    out = np.zeros(BUCKETS)
    out[used] = scale * (e @ (layer[:, 1] - layer[:, 0]))
    return Model(out, float(bias[1] - bias[0]))


class Scorer(dict):
    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= MAX_WORDS:
            self.clear()
        x = self[word] = self.model.word(word)
        return x

    def score(self, text: str | None) -> float:
        if self.model.constant is not None:
            return self.model.constant
        words = words_of(text) if text else []
        z = sum(map(self.__getitem__, words)) / (len(words) + PADDING)
        return float(1 / (1 + np.exp(-max(-60.0, min(60.0, z + self.model.bias)))))


_SCORERS: dict[int, Scorer] = {}
cached_for("toxicity", _SCORERS.clear)


def _scored(model: Model, key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("toxicity")
        scorer = _SCORERS.get(key)
        if scorer is None:
            _SCORERS.clear()
            scorer = _SCORERS[key] = Scorer(model)
        for b in batches:
            s = np.array([scorer.score(t) for t in b.column("text").to_pylist()], float)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def trained(docs: DataFrame, labels: DataFrame, scratch: Scratch, most: int = SAMPLE) -> Model:
    marked = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("label"))
    marked = marked.filter(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    rows = {r.label: r["count"] for r in marked.groupBy("label").count().collect()}  # two rows
    if len(rows) < 2:
        return Model(np.zeros(BUCKETS), 0.0, constant=float(1 in rows))
    share = F.when(F.col("label") == 1, F.lit(min(1.0, most / rows[1]))).otherwise(F.lit(min(1.0, most / rows[0])))
    drawn = scratch.save(marked.filter(F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1_000_003)) < share * 1_000_003), "drawn")
    # about 2 * most ids, so small enough to send to every task that reads the texts
    texts = docs.filter(F.col("text").isNotNull()).join(F.broadcast(drawn), "doc_id").select("doc_id", "label", "text")
    bags, of = Bags(), array("b")
    # in one order whatever the layout of the table, so that a rerun fits the same floats
    for r in texts.orderBy("doc_id", F.xxhash64("text")).toLocalIterator():
        bags.add(r.text)
        of.append(r.label)
    of = np.array(of, np.int64)
    drawn_rows = np.bincount(of, minlength=2)
    if not drawn_rows.all():
        return Model(np.zeros(BUCKETS), 0.0, constant=float(1 in of))
    return fit(bags, of, np.array([rows[0] / drawn_rows[0], rows[1] / drawn_rows[1]]))


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs."""
    ready(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    model = trained(rows, labels, Scratch(spark, "toxicity"))
    key = hash((model.bias, model.bucket.tobytes()))
    return rows.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "text").mapInArrow(_scored(model, key), "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
