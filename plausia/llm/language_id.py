"""Language ID: per-language unigram models over a fixed vocabulary of pieces, all segmentations summed.

Each language has a probability for every piece of a public vocabulary. The probability of a word is the sum, over all
ways to part it into pieces, of the product of the pieces' probabilities, by a forward recursion over the word's
letters; a text's is the product over its words. The piece probabilities are fitted by expectation-maximisation (forward
and backward sums) on words of a bounded sample of labelled rows, smoothed with those of all languages together.

The sample: SAMPLE rows a language are aimed at, by a hash of doc_id, after the labelled rows of each language have been
counted. Their words are counted where they are; the SAMPLE_WORDS most frequent pairs of word and language reach the driver. All rows are
scored. Of the vocabulary, pieces of up to MAX_PIECE letters are used; longer ones are covered by their parts.

Words are runs of letters, as str.isalpha has them, in lower case. Runs of over MAX_LETTERS letters are scored in stretches of that length, so that the
cost of a text grows with its length only. Letters that no piece holds count as one unknown piece.

Defined results: null texts and texts without a letter are `und` with score 0; without training rows every other text is
`und` too, with score 0; of languages that score the same, the first by name wins; repeated rows are scored each. Other columns of the
input, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from plausia.llm.common import cached_for, fold, held_out, ready, table, turn_to

VOCABULARY = "piece_bpe_32k.model"
FOLDS, HELD_OUT = 4, 2
#: Labelled rows a language that the model is fitted on, and counts of words at most.
SAMPLE, SAMPLE_WORDS = 400, 400_000
ROUNDS, SMOOTHING, UNKNOWN = 4, 2.0, 1e-7
MAX_LETTERS, MAX_PIECE = 48, 12
#: Words whose scores a worker keeps.
MAX_WORDS = 400_000
NONE = "und"

#: Letters, digits of other kinds, and numbers; nearly always letters only.
_WIDE = re.compile(r"[^\W\d_]+")
#: Letters: the same without numbers that are no letters.
_LETTERS = re.compile(r"[^\W\d_" + "".join(c for c in map(chr, range(0x80, 0x110000)) if c.isnumeric() and not c.isdecimal() and not c.isalpha()) + "]+")



def pieces(name: str = VOCABULARY) -> list[str]:
    """The vocabulary's pieces that lower-case words can be made of; ▁ marks a word's start."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    every = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return sorted({p for p in every if len(p) <= MAX_PIECE and p == p.lower() and (p.strip("▁").isalpha() or p == "▁")})


def words_of(text: str) -> list[str]:
    low = text.lower()
    words = _WIDE.findall(low)
    return words if not words or "".join(words).isalpha() else _LETTERS.findall(low)


def stretches(word: str) -> list[str]:
    """A word as it is scored: with a mark for its start, in parts of bounded length."""
    if len(word) <= MAX_LETTERS:
        return ["▁" + word]
    return [("▁" if i == 0 else "") + word[i : i + MAX_LETTERS] for i in range(0, len(word), MAX_LETTERS)]


def lattice(words: list[str], number: dict[str, int]) -> np.ndarray:
    """For words of one length n: the piece that ends at each place with each length, -1 for none. (words, n, longest)

    A single letter that is no piece is the unknown piece, numbered len(number).
    """
    n = len(words[0])
    out = np.full((len(words), n, min(n, MAX_PIECE)), -1, np.int32)
    get, unknown = number.get, len(number)
    for j in range(n):
        out[:, j, 0] = [get(w[j], unknown) for w in words]
        for k in range(2, min(j + 1, MAX_PIECE) + 1):
            out[:, j, k - 1] = [get(w[j + 1 - k : j + 1], -1) for w in words]
    return out


def forward(grid: np.ndarray, p: np.ndarray) -> np.ndarray:
    """(words, n + 1, languages): the summed probability of every prefix. p: (pieces + 2, languages), the last row 0."""
    many, n, longest = grid.shape
    out = np.zeros((many, n + 1, p.shape[1]))
    out[:, 0] = 1
    for j in range(n):
        for k in range(min(j + 1, longest)):
            at = grid[:, j, k]
            if (at >= 0).any():
                out[:, j + 1] += out[:, j - k] * p[at]
    return out


def backward(grid: np.ndarray, p: np.ndarray) -> np.ndarray:
    many, n, longest = grid.shape
    out = np.zeros((many, n + 1, p.shape[1]))
    out[:, n] = 1
    for j in range(n - 1, -1, -1):
        for k in range(min(j + 1, longest)):
            out[:, j - k] += out[:, j + 1] * p[grid[:, j, k]]
    return out


def by_length(words: list[str]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        out.setdefault(len(w), []).append(i)
    return out


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    number: dict[str, int]
    p: np.ndarray  # (pieces + 2, languages): the unknown piece, then a row of zeros that -1 points at
    prior: np.ndarray

    def log_probability(self, parts: list[str]) -> np.ndarray:
        """(parts, languages): the log of the sum over all segmentations."""
        out = np.empty((len(parts), len(self.languages)))
        for _, at in by_length(parts).items():
            for low in range(0, len(at), 4096):
                some = at[low : low + 4096]
                grid = lattice([parts[i] for i in some], self.number)
                out[some] = np.log(np.maximum(forward(grid, self.p)[:, -1], 1e-300))
        return out


def fit(counts: dict[str, Counter], rows: dict[str, int], vocabulary: list[str], rounds: int = ROUNDS) -> Model:
    """A model from the words' counts and the number of labelled rows of each language."""
    languages = tuple(sorted(counts))
    number = {s: i for i, s in enumerate(vocabulary)}
    size, many = len(vocabulary) + 2, len(languages)
    weight: dict[str, np.ndarray] = {}
    for c, lang in enumerate(languages):
        for w, n in counts[lang].items():
            for part in stretches(w):
                weight.setdefault(part, np.zeros(many))[c] += n
    parts = sorted(weight)
    times = np.array([weight[x] for x in parts]).reshape(len(parts), many)
    grids = [(at, lattice([parts[i] for i in at], number)) for _, at in sorted(by_length(parts).items())]
    p = np.full((size, many), 1.0 / size)
    p[-2:] = [[UNKNOWN] * many, [0.0] * many]
    for _ in range(rounds):
        expected = np.zeros((size, many))
        for at, grid in grids:
            a, b = forward(grid, p), backward(grid, p)
            share = times[at] / np.maximum(a[:, -1], 1e-300)
            for j in range(grid.shape[1]):
                for k in range(min(j + 1, grid.shape[2])):
                    g = grid[:, j, k]
                    some = a[:, j - k] * p[g] * b[:, j + 1] * share
                    for c in range(many):
                        expected[:, c] += np.bincount(np.where(g < 0, size - 1, g), some[:, c], minlength=size)
        expected[-2:] = 0
        every = expected.sum(1, keepdims=True) + 0.01
        base = every / every.sum()
        p = (expected + SMOOTHING * base * len(vocabulary) * 0.01) / (expected.sum(0) + SMOOTHING * len(vocabulary) * 0.01)
        p[-2:] = [[UNKNOWN] * many, [0.0] * many]
    prior = np.array([rows[x] for x in languages], float)
    return Model(languages, number, p, np.log(prior / prior.sum()) if many else prior)


class Scorer(dict):
    """Row numbers of words in a table of log probabilities that grows by batches."""

    def __init__(self, model: Model):
        self.model = model
        self.table = np.zeros((0, len(model.languages)))
        self.wanted: list[str] = []

    def __missing__(self, word: str) -> int:
        i = self[word] = len(self)
        self.wanted.append(word)
        return i

    def learn(self) -> None:
        """Works out the words that were asked for since the last time."""
        if self.wanted:
            parts = [stretches(w) for w in self.wanted]
            flat = self.model.log_probability([x for ps in parts for x in ps])
            ends = np.cumsum([len(ps) for ps in parts])
            self.table = np.concatenate([self.table, np.add.reduceat(flat, np.concatenate([[0], ends[:-1]]))])
            self.wanted = []

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if len(self) > MAX_WORDS:
            self.clear()
            self.table = self.table[:0]
        at = [np.fromiter(map(self.__getitem__, words_of(t)), np.int64) if t else None for t in texts]
        self.learn()
        names, scores = [], []
        for x in at:
            if x is None or not len(x) or not self.model.languages:
                names.append(NONE)
                scores.append(0.0)
                continue
            z = self.table[x].sum(0) + self.model.prior
            best = int(z.argmax())
            names.append(self.model.languages[best])
            scores.append(float(1 / np.exp(z - z[best]).sum()))
        return names, scores


_SCORERS: dict[int, Scorer] = {}
cached_for("language", _SCORERS.clear)


def _predicted(model: Model, key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("language")
        scorer = _SCORERS.get(key)
        if scorer is None:
            _SCORERS.clear()
            scorer = _SCORERS[key] = Scorer(model)
        for b in batches:
            names, scores = scorer.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def sample(docs: DataFrame, most: int = SAMPLE) -> tuple[dict[str, Counter], dict[str, int]]:
    """Word counts of a bounded sample of labelled rows outside the held-out fold, and the number of labelled rows, by language."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).filter(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    rows = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}  # one row a language
    share = F.lit(0.0)
    for lang, n in rows.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, most / n))).otherwise(share)
    drawn = labelled.filter(F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1_000_003)) < share * 1_000_003).select("lang", "text")
    words = drawn.mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, Counter] = {lang: Counter() for lang in rows}
    for r in words.orderBy(F.desc("n"), "word", "lang").limit(SAMPLE_WORDS).collect():
        counts[r.lang][r.word] = r.n
    return counts, rows


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    turn_to("language")
    for b in batches:
        counts: Counter = Counter()
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            for w, n in Counter(words_of(text)).items():
                counts[lang, w] += n
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array([*counts.values()], pa.int64())], ["lang", "word", "n"])


def predict(spark: SparkSession, docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of docs."""
    ready(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    model = fit(*sample(rows), pieces(vocabulary))
    key = hash((model.languages, model.p.tobytes()))
    return rows.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "text").mapInArrow(_predicted(model, key), "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(spark, table(spark, sf_dir, "documents"))
