"""Token counts: a table of the exact token count at every prefix of a text, by dynamic programming.

The vocabulary is a byte-level BPE with word ends (a JSON file of the tokenizers library). White space parts a text
into runs that are encoded on their own; a run is parted again by the tokenizer's own pattern. Within a piece the
encoding of a prefix is found from those of shorter prefixes: a token may follow the last token of the prefix before
it if, and only if, merging the two tokens' bytes afresh gives the same two tokens; exactly one token that ends at a
place passes. So one pass over a piece yields the last token, and the token count, at each of its prefixes, with and
without the word end. These entries stand in one table for the prefixes of all words, so a word costs what its longest
known prefix leaves, and the count of a whole run is the entry of its last prefix: the query reads its counts there.
Counts are kept as differences from one code point to the next; their running sum is the count of the text cut there,
which answers truncation and budget questions without encoding again.

Where a text holds marks or letters that combine, normalisation changes at most what stands since the last code point that
begins afresh. There the library's own normaliser is asked for that stretch only, and the piece before it grows on, so that the
cost of a run is in proportion to its length (and to the square only of the marks that stack on one letter). Strings of special tokens
part a run before all else; until the last character of one is there, it is text like any other.

Defined results: a null text counts as empty; empty texts have 0 tokens; repeated rows are counted each; a null doc_id
stays null. Other columns of the input, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from plausia.llm.common import cached_for, ready, table, turn_to

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Entries of the caches of runs, of token pairs and of prefixes; a cache that is full is emptied.
MAX_RUNS, MAX_PAIRS, MAX_PREFIXES = 500_000, 300_000, 500_000
#: Longer prefixes aren't kept, so that long pieces cost memory in proportion to their length.
LONGEST_KEPT = 24
#: Unicode's White_Space, which both the library's normaliser and its pattern split at.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_PLAIN = re.compile(r"[\x00-\x7f]*")
#: Code points that str.split takes for white space and the library doesn't.
_ODD_SPACE = "\x1c\x1d\x1e\x1f"
#: Runs of lower-case Latin letters and then marks are parted in just these two pieces.
_LETTERS_MARKS = re.compile("([a-z\xdf-\xf6\xf8-\xff]*)([.,;:!?()\"#*$%&|<>-]*)")


def _inert(c: str) -> bool:
    """Whether normalisation neither changes a code point nor joins it with others."""
    return not (unicodedata.category(c)[0] == "M" or "\u1100" <= c <= "\u11ff" or unicodedata.normalize("NFC", c) != c)


_JOINING: set[str] = set()


def _joins(c: str) -> bool:
    """Whether a code point may change with what stands before it: marks that are reordered, and second halves of compositions."""
    if c < "\u0300":
        return False
    if not _JOINING:
        for i in range(0x110000):
            parts = unicodedata.decomposition(chr(i)).split()
            if len(parts) == 2 and parts[0][0] != "<":
                _JOINING.add(chr(int(parts[1], 16)))
        _JOINING.update(map(chr, range(0x1161, 0x1176)), map(chr, range(0x11A8, 0x11C3)))
    return c in _JOINING or unicodedata.combining(c) > 0


class _Grown:
    """A run that grows by normalised stretches: the tokens of its finished pieces, and what its last piece ends with."""

    def __init__(self, counter: PrefixCounter):
        self.counter = counter
        self.before, self.closed = 0, 0  # tokens before the last piece, and of it
        self.kind = None  # the pattern of what makes the last piece longer
        self.tail: tuple[str, list[str], list[int]] = ("", [""], [0])  # its last letters, with the table's entries there
        self.held: tuple[str, int] | None = None  # an apostrophe that begins a piece and what follows it, while that may become one piece

    def _longer(self, tail: tuple[str, list[str], list[int]], lead: str) -> tuple[int, tuple[str, list[str], list[int]]]:
        c = self.counter
        more, closed = c._letters(lead), 0
        letters, last, count = tail[0] + more, [*tail[1]], [*tail[2]]
        for k in range(len(tail[0]) + 1, len(letters) + 1):
            token, n, closed = c._entry(letters, k, last, count)
            last.append(token)
            count.append(n)
        cut = max(0, len(letters) - 2 * c.longest)
        return closed, (letters[cut:], last[cut:], count[cut:])

    def count(self, stretch: str, keep: bool) -> int:
        """Tokens of the run with this stretch after it; the run keeps it, or not."""
        c, lead = self.counter, ""
        if self.held:
            text, before = self.held[0] + stretch, self.held[1]
        else:
            m = self.kind.match(stretch) if self.kind else None
            lead = m[0] if m else ""
            text, before = stretch[len(lead) :], self.before
            closed, tail = self._longer(self.tail, lead) if lead else (self.closed, self.tail)
            before += closed
        pieces = c.pattern.findall(text)
        counts = [c.closing(c._letters(x)) for x in pieces]
        total = before + sum(counts)
        if keep and pieces:
            self.before, self.closed = total - counts[-1], counts[-1]
            final = pieces[-1]
            suffix = final[0] == "'" and c.letter_run.match(final[1:])
            self.kind = None if suffix else next((k for k in (c.letter_run, c.mark_run) if k.match(final)), None)
            self.tail = self._longer(("", [""], [0]), final)[1] if self.kind else ("", [""], [0])
            self.held = None
            for i, x in enumerate(pieces):
                if x[0] == "'" and len(rest := "".join(pieces[i:])) <= 2:
                    self.held = rest, before + sum(counts[:i])
                    break
        elif keep and lead:
            self.closed, self.tail = closed, tail
        return total


class _Totals(dict):
    """Token counts of whole runs, found when first asked for."""

    def __init__(self, owner: PrefixCounter):
        self.owner = owner

    def __missing__(self, run: str) -> int:
        n = self.owner.whole(run)
        if len(run) <= 64:
            if len(self) >= MAX_RUNS:
                self.clear()
            self[run] = n
        return n


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PrefixCounter:
    """Token counts at every prefix, for one vocabulary file."""

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            kept = json.load(f)
        model = kept["model"]
        self.end = model["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {m: i for i, m in enumerate(merges)}
        self.special = re.compile("|".join(re.escape(t["content"]) for t in sorted(kept["added_tokens"], key=lambda t: -len(t["content"]))) or "(?!)")
        vocab = model["vocab"]
        # only tokens that merging really yields can be last
        self.open = {t for t in vocab if not t.endswith(self.end) and self._merged(list(t)) == [t]}
        self.closed = {t[: -len(self.end)] for t in vocab if t.endswith(self.end) and self._merged([*t[: -len(self.end)][:-1], t[: -len(self.end)][-1:] + self.end]) == [t]}
        self.longest = max(map(len, self.open | self.closed))
        # what may end a prefix: 1 for a token while the word goes on, 2 for one that ends it, 0 for the end of a longer token only
        self.kinds = {t[i:]: 0 for t in self.open | self.closed for i in range(len(t))} | {t: (t in self.open) + 2 * (t in self.closed) for t in self.open | self.closed}
        self.table: dict[str, tuple[str, int, int]] = {}
        self.pattern = self._pattern(kept["pre_tokenizer"])
        self.letter_run, self.mark_run = regex.compile(r"\p{L}+"), regex.compile(r"[^\s\p{L}\p{N}]+")
        self.bytes = self._byte_letters()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.spines: tuple[dict[str, list[tuple[str, float]]], dict[str, list[tuple[str, float]]]] = ({}, {})  # at most an entry a token
        self.runs: dict[str, np.ndarray] = {}
        self.totals = _Totals(self)

    @staticmethod
    def _byte_letters() -> list[str]:
        """The letters that stand for the 256 bytes: a printable byte for itself, the others from 256 on."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]

    @staticmethod
    def _pattern(part: dict):
        import regex

        split = next(x for x in part["pretokenizers"] if x["type"] == "Split")
        return regex.compile(split["pattern"]["Regex"], regex.V1)

    def _merged(self, symbols: list[str], few: int = 1) -> list[str]:
        """Plain BPE: the pair of least rank first, the leftmost of equals, down to so few symbols."""
        while len(symbols) > few:
            best = min((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)))
            if best[0] == 1 << 60:
                break
            i = best[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    def _spine(self, token: str, side: int) -> list[tuple[str, float]]:
        """What stands at one end of a token (side 0: its begin, 1: its end) while it is merged, from the whole token to one byte, each
        with the rank of the merge that takes it up. Pairs of symbols are merged in the order of their ranks, and a pair's rank is
        above those that made its symbols."""
        known = self.spines[side].get(token)
        if known is None:
            known, until = [(token, float("inf"))], token
            while True:
                if until.endswith(self.end) and len(until) > len(self.end):
                    body = until[: -len(self.end)]
                    symbols = [*body[:-1], body[-1] + self.end]
                else:
                    symbols = [*until]
                if len(symbols) == 1:
                    break
                pair = self._merged(symbols, 2)
                until = pair[side]
                known.append((until, self.ranks[pair[0], pair[1]]))
            self.spines[side][token] = known
        return known

    def _may_follow(self, a: str, b: str, closed: bool) -> bool:
        """Whether merging the bytes of two tokens afresh gives the same two: no pair across the border is merged while both of its
        symbols stand there (of equal ranks the left one is merged first)."""
        key = (a, b + self.end) if closed else (a, b)
        known = self.pairs.get(key)
        if known is None:
            ranks, known = self.ranks, True
            ends, begins = self._spine(a, 1), self._spine(key[1], 0)
            for x, until in ends:
                for y, till in begins:
                    r = ranks.get((x, y))
                    if r is not None and r < until and r <= till:
                        known = False
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def _ends(self, letters: str) -> list[tuple[int, str, int]]:
        """The tokens that letters end with, the longest first: where each begins, itself, and its kind."""
        kinds, out = self.kinds, []
        for i in range(len(letters) - 1, -1, -1):
            t = letters[i:]
            what = kinds.get(t)
            if what is None:
                break
            if what:
                out.append((i, t, what))
        out.reverse()
        return out

    def _entry(self, letters: str, k: int, last: list[str], count: list[int]) -> tuple[str, int, int]:
        """The table's entry for letters[:k], from those of shorter prefixes: last token and count while the word goes on, and the
        count if it ends there."""
        low = k - self.longest if k > self.longest else 0
        token, n, closed = "", 0, 0
        for i, t, what in self._ends(letters[low:k]):
            prior, before = last[low + i], count[low + i]  # an empty token where the piece begins
            if what & 1 and not n and self._fits(prior, t, False):
                token, n = t, before + 1
            if what & 2 and not closed and self._fits(prior, t, True):
                closed = before + 1
            if n and closed:
                break
        return token, n, closed

    def _fits(self, prior: str, t: str, closed: bool) -> bool:
        if not prior:
            return True
        known = self.pairs.get((prior, t + self.end) if closed else (prior, t))
        return self._may_follow(prior, t, closed) if known is None else known

    def piece(self, letters: str) -> list[int]:
        """For each length k from 1 on, the tokens of letters[:k] as a word of its own. letters: a letter for each byte."""
        table = self.table
        last, count, out = [""], [0], []
        for k in range(1, len(letters) + 1):
            if k > LONGEST_KEPT:
                entry = self._entry(letters, k, last, count)
            else:
                entry = table.get(letters[:k])
                if entry is None:
                    if len(table) >= MAX_PREFIXES:
                        table.clear()
                    entry = table[letters[:k]] = self._entry(letters, k, last, count)
            last.append(entry[0])
            count.append(entry[1])
            out.append(entry[2])
        return out

    def closing(self, letters: str) -> int:
        """Tokens of letters as a word of its own: the table's entry for its last prefix."""
        entry = self.table.get(letters)
        if entry is None:
            if len(letters) > LONGEST_KEPT:
                return self.piece(letters)[-1]
            entry = self._filled(letters)
        return entry[2]

    def _filled(self, letters: str) -> tuple[str, int, int]:
        """The table's entry for a prefix, with those of shorter prefixes that it rests on and the table lacks."""
        table = self.table
        token, n, closed = "", 0, 0
        for i, t, what in self._ends(letters):
            prior, before = (table.get(letters[:i]) or self._filled(letters[:i]))[:2] if i else ("", 0)
            if what & 1 and not n and self._fits(prior, t, False):
                token, n = t, before + 1
            if what & 2 and not closed and self._fits(prior, t, True):
                closed = before + 1
            if n and closed:
                break
        if len(table) >= MAX_PREFIXES:
            table.clear()
        entry = table[letters] = (token, n, closed)
        return entry

    def _counts(self, run: str) -> np.ndarray:
        """The token count at each code point of a run without white space."""
        out = np.zeros(len(run), np.int64)
        at = done = 0
        for m in self.special.finditer(run):
            out[at : m.end() - 1] = done + self._plain(run[at : m.end() - 1])
            done = int(out[m.start() - 1]) + 1 if m.start() > at else done + 1
            out[m.end() - 1] = done
            at = m.end()
        out[at:] = done + self._plain(run[at:])
        return out

    def _plain(self, run: str) -> np.ndarray:
        """The token count at each code point of a run that holds no special token's string."""
        n = len(run)
        lower = run.lower() if _PLAIN.fullmatch(run) else "".join(map(str.lower, run))
        if len(lower) != n or not all(c <= "\x7f" or _inert(c) for c in run):
            return self._by_stretches(run)
        out = np.zeros(n, np.int64)
        before = 0  # tokens of the pieces that end before this one
        for m in self.pattern.finditer(lower):
            a, z = m.span()
            if z - a == 1:
                out[a] = before + self.closing(self._letters(lower[a]))
            elif lower[a] == "'" and z - a <= 3:
                # an apostrophe's suffix, or marks that begin with one: its prefixes may be parted in other ways
                for k in range(a, z):
                    out[k] = before + sum(self.closing(self._letters(x)) for x in self.pattern.findall(lower[a : k + 1]))
            else:
                letters = self._letters(lower[a:z])
                ends = np.cumsum([len(c.encode()) for c in lower[a:z]]) if len(letters) > z - a else np.arange(1, z - a + 1)
                out[a:z] = before + np.array(self.piece(letters))[ends - 1]
            before = int(out[z - 1])
        return out

    def _by_stretches(self, run: str) -> np.ndarray:
        """The same for runs that normalisation may change: stretches from one code point that begins afresh to the next."""
        out = np.zeros(len(run), np.int64)
        normal = self.library.normalizer.normalize_str
        state = _Grown(self)
        starts = [i for i, c in enumerate(run) if i == 0 or not _joins(c)]
        for a, z in zip(starts, [*starts[1:], len(run)], strict=True):
            for k in range(a + 1, z + 1):
                out[k - 1] = state.count(normal(run[a:k]), k == z)
        return out

    def _letters(self, s: str) -> str:
        return "".join([self.bytes[b] for b in s.encode()])

    def run(self, run: str) -> np.ndarray:
        known = self.runs.get(run)
        if known is None:
            known = self._counts(run)
            if len(run) > 64:
                return known
            if len(self.runs) >= MAX_RUNS:
                self.runs.clear()
            self.runs[run] = known
        return known

    def whole(self, run: str) -> int:
        """Tokens of a whole run without white space: the entry of its last prefix."""
        lower = run.lower()
        m = _LETTERS_MARKS.fullmatch(lower)
        if m and len(lower) == len(run):
            letters, marks = m.groups()
            return (self.closing(letters if letters.isascii() else self._letters(letters)) if letters else 0) + (self.closing(marks) if marks else 0)
        if len(run) <= 64:
            return int(self._counts(run)[-1])
        total = at = 0
        for m in [*self.special.finditer(run), None]:
            pieces = self.pattern.findall(self.library.normalizer.normalize_str(run[at : m.start() if m else len(run)]))
            total += sum(self.closing(self._letters(x)) for x in pieces) + (m is not None)
            at = m.end() if m else at
        return total

    def total(self, text: str) -> int:
        """Tokens of the whole text: the sum of the last entries of its runs."""
        runs = [r for r in _SPACE.split(text) if r] if any(c in text for c in _ODD_SPACE) else text.split()
        return sum(map(self.totals.__getitem__, runs))

    def prefixes(self, text: str) -> np.ndarray:
        """The token count of text[:k] for each k from 0 on."""
        out = np.zeros(len(text) + 1, np.int64)
        before, at = 0, 0
        for gap in [*_SPACE.finditer(text), None]:
            a = gap.start() if gap else len(text)
            if a > at:
                out[at + 1 : a + 1] = before + self.run(text[at:a])
                before = int(out[a])
            if gap:
                at = gap.end()
                out[a + 1 : at + 1] = before
        return out


_COUNTERS: dict[str, PrefixCounter] = {}
cached_for("tokens", _COUNTERS.clear)


def counter(path: str) -> PrefixCounter:
    """This worker's counter, with its caches, for a vocabulary file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def _totals(name: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("tokens")
        c = counter(vocabulary_path(name))
        for b in batches:
            texts = b.column("text").to_pylist()
            n = np.array([c.total(t) if t else 0 for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(spark: SparkSession, docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for every row of docs."""
    ready(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInArrow(_totals(vocabulary, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def _ledgers(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("tokens")
        c = counter(vocabulary_path(name))
        for b in batches:
            steps = [np.diff(c.prefixes(t or "")).astype("<i4").tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(steps, pa.binary())], ["doc_id", "steps"])

    return run


def prefix_ledger(spark: SparkSession, docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and steps: little-endian 32-bit differences of the token count from one code point to the next."""
    ready(spark)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_ledgers(vocabulary), "doc_id long, steps binary")


def tokens_at(steps: bytes, code_points: int) -> int:
    """Tokens of the text cut after so many code points, from a ledger's steps."""
    return int(np.frombuffer(steps, "<i4")[:code_points].sum())


def longest_within(steps: bytes, budget: int) -> int:
    """The most code points that a text can be cut to so that the cut text has at most budget tokens."""
    n = np.concatenate([[0], np.cumsum(np.frombuffer(steps, "<i4"))])
    return int(np.flatnonzero(n <= budget).max()) if budget >= 0 else 0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark, table(spark, sf_dir, "documents"))
